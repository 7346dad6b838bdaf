"""One pass over a page's HTML: title, links, declared languages, visible text and the content as Markdown.

Everything that needs the tree comes out of one Arrow pass as one struct, so a
page is parsed once. The tree builder knows void elements and implied end tags;
unclosed elements end with their parent. NULL or empty HTML gives empty
strings and lists.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Where content is looked for, what is no content, attributes dropped, elements whose text names the language.
CONTENT = ("article", "main", "[role=main]", "[itemprop=articleBody]", ".article-content", ".article-body", ".entry-content", ".post-content", ".page-content", "#content")
REMOVED = (
    "script", "style", "noscript", "template", "svg", "canvas", "iframe", "button", "input", "select", "textarea", "nav", "header", "footer",
    "[role=navigation]", "[role=banner]", "[role=contentinfo]", "[aria-hidden=true]", ".advertisement", ".ads", ".breadcrumb", ".breadcrumbs",
    ".cookie-banner", ".cookie-consent", ".footer", ".header", ".menu", ".modal", ".navigation", ".newsletter", ".popup", ".related", ".share",
    ".sharing", ".sidebar", ".social",
)
TEXT_TAGS = ("title", "h1", "h2", "h3", "p", "li", "blockquote", "article", "main")
UNSEEN = frozenset(("script", "style", "noscript", "svg", "canvas", "template", "iframe"))
LEAST_CONTENT, MOST_TEXT = 100, 30_000
SCHEMA = "title string, html_lang string, meta_language string, og_locale string, links array<string>, visible_text string, markdown string"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS: dict[str, frozenset[str]] = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)), "tbody": frozenset(("thead", "tbody", "tr", "td", "th")),
    **{b: frozenset(("p", "b", "i", "em", "strong")) for b in _BLOCKS},
}


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        left = self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, Element):
                yield c
                left.extend(c.children[::-1])

    def strings(self) -> Iterator[str]:
        left = self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, Element):
                left.extend(c.children[::-1])
            elif c.strip():
                yield c.strip()

    def text(self) -> str:
        return " ".join(self.strings())

    def is_like(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in (self.attrs.get("class") or "").split()
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        if selector[0] == "[":
            name, _, value = selector[1:-1].partition("=")
            return self.attrs.get(name) == value
        return self.tag == selector


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = _ENDS.get(tag, frozenset())
        # An open paragraph ends here, and with it the inline elements left open in it.
        node, last = self.at, None
        while node.parent is not None and node.tag in ends:
            last, node = node, node.parent
        if last is not None and (tag not in _BLOCKS or any(n.tag == "p" for n in self._open(last))):
            self.at = last.parent or self.root
        child = Element(tag, {k: v for k, v in reversed(attrs)}, self.at)
        self.at.children.append(child)
        if tag not in _VOID:
            self.at = child

    def _open(self, last: Element) -> Iterator[Element]:
        node: Element | None = self.at
        while node is not None:
            yield node
            if node is last:
                return
            node = node.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node: Element | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def first(root: Element, test: Callable[[Element], bool]) -> Element | None:
    return next((e for e in root.walk() if test(e)), None)


def content(root: Element) -> Element:
    """The first element of the first selector with enough text, else the body, else everything."""
    for selector in CONTENT:
        found = first(root, lambda e, s=selector: e.is_like(s))
        if found is not None and len(found.text()) >= LEAST_CONTENT:
            return found
    return first(root, lambda e: e.tag == "body") or root


def cleaned(root: Element) -> Element:
    """``root`` without what is no content, without links to nowhere and images from nowhere."""
    kept: list[Element | str] = []
    for c in root.children:
        if isinstance(c, str):
            kept.append(c)
        elif any(c.is_like(s) for s in REMOVED):
            continue
        elif c.tag == "a" and not (c.attrs.get("href") or "").strip():
            kept.extend(cleaned(c).children)
        elif c.tag == "img" and not (c.attrs.get("src") or "").strip():
            continue
        else:
            kept.append(cleaned(c))
    out = Element(root.tag, root.attrs, root.parent)
    out.children = kept
    return out


def _inline(s: str) -> str:
    return re.sub(r"\s+", " ", s)


def render(node: Element, depth: int = 0, pre: bool = False) -> str:  # noqa: C901
    """Markdown of the element's content: # headings, - bullets, fenced blocks, pipe tables."""
    out: list[str] = []
    number = 0
    for c in node.children:
        if isinstance(c, str):
            out.append(c if pre else re.sub(r"([*_])", r"\\\1", _inline(c)))
            continue
        tag = c.tag
        body = "" if tag in ("ul", "ol", "table", "pre") else render(c, depth, pre)
        bare = body.strip()
        if tag == "br":
            out.append("  \n")
        elif tag == "hr":
            out.append("\n\n---\n\n")
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out.append(f"\n\n{'#' * int(tag[1])} {_inline(bare)}\n\n" if bare else "")
        elif tag in ("b", "strong"):
            out.append(body.replace(bare, f"**{bare}**", 1) if bare else body)
        elif tag in ("i", "em"):
            out.append(body.replace(bare, f"*{bare}*", 1) if bare else body)
        elif tag in ("code", "kbd", "samp", "tt") and not pre:
            raw = c.text()
            out.append(f"`{raw}`" if raw else "")
        elif tag == "pre":
            raw = render(c, depth, True).strip("\n")
            out.append(f"\n\n```\n{raw}\n```\n\n")
        elif tag == "a":
            href = (c.attrs.get("href") or "").strip()
            title = c.attrs.get("title")
            if not href or not bare:
                out.append(body)
            elif bare.replace("\\", "") == href and not title:
                out.append(f"<{href}>")
            else:
                tail = f' "{title}"' if title else ""
                out.append(body.replace(bare, f"[{bare}]({href}{tail})", 1))
        elif tag == "img":
            out.append(f"![{c.attrs.get('alt') or ''}]({c.attrs.get('src')})")
        elif tag in ("ul", "ol"):
            inner = render(c, depth + 1, pre).strip("\n")
            out.append(f"\n{inner}\n" if node.tag == "li" else f"\n\n{inner}\n\n")
        elif tag == "li":
            number += 1
            mark = f"{number}." if node.tag == "ol" else "-"
            pad = " " * (len(mark) + 1)
            out.append(f"{mark} " + re.sub(r"\n(?=[^\n])", f"\n{pad}", re.sub(r"\n{2,}", "\n", bare)) + "\n")
        elif tag == "blockquote":
            out.append("\n\n" + "\n".join(f"> {x}".rstrip() for x in bare.split("\n")) + "\n\n")
        elif tag == "table":
            rows = [[_inline(render(x).strip()) for x in r.children if isinstance(x, Element) and x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
                out.append("\n\n" + "\n".join(lines) + "\n\n")
        elif tag in _BLOCKS or tag in ("body", "html"):
            out.append(f"\n\n{bare}\n\n")
        else:
            out.append(body)
    return "".join(out)


def visible_text(root: Element) -> str:
    """Text of the elements that name the language, kind by kind; else all text."""

    def seen(e: Element) -> Iterator[str]:
        left = e.children[::-1]
        while left:
            c = left.pop()
            if not isinstance(c, str):
                left.extend(c.children[::-1] if c.tag not in UNSEEN else ())
            elif c.strip():
                yield c.strip()

    def below(e: Element) -> Iterator[Element]:
        left = e.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, Element) and c.tag not in UNSEEN:
                yield c
                left.extend(c.children[::-1])

    by_tag: dict[str, list[str]] = {t: [] for t in TEXT_TAGS}
    for e in below(root):
        if e.tag in by_tag and (text := " ".join(seen(e))):
            by_tag[e.tag].append(text)
    text = " ".join(x for t in TEXT_TAGS for x in by_tag[t]) or " ".join(seen(root))
    return re.sub(r"\s+", " ", text).strip()[:MOST_TEXT]


def examine(html: str | None) -> dict[str, object]:
    """All that is read off one page's tree."""
    root = parse(html)
    # What is left of recursion goes as deep as elements are nested, which is no deeper than there are tags.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * (html or "").count("<") + 1000))
    attr = lambda e, name: None if e is None else e.attrs.get(name)
    title = first(root, lambda e: e.tag == "title")
    meta = lambda key, value: first(root, lambda e: e.tag == "meta" and (e.attrs.get(key) or "").lower() == value)
    return {
        "title": title.text().strip() if title else "",
        "html_lang": attr(first(root, lambda e: e.tag == "html"), "lang"),
        "meta_language": attr(meta("http-equiv", "content-language"), "content"),
        "og_locale": attr(meta("property", "og:locale"), "content"),
        "links": [h for e in root.walk() if e.tag == "a" and (h := (e.attrs.get("href") or "").strip())],
        "visible_text": visible_text(root),
        "markdown": render(cleaned(content(root))),
    }


def examined(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, title, html_lang, meta_language, og_locale, links, visible_text, markdown) of ``pages``; Markdown isn't in normal form yet."""
    kind = dict(pages.dtypes)[id_column]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([examine(x if isinstance(x, str) else None) for x in b["h"]], columns=[c.split()[0] for c in SCHEMA.split(", ")])
            rows.insert(0, "i", b["i"].to_numpy())
            yield rows

    rows = pages.selectExpr(f"`{id_column}` AS i", f"`{html_column}` AS h")
    return rows.mapInPandas(of, f"i {kind}, {SCHEMA}").withColumnRenamed("i", id_column)
