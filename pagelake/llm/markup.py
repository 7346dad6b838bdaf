"""Markup residue in text documents, turned into clean text.

``clean`` reads a page as Markdown with leftovers of HTML, wiki or LaTeX
sources. Code (fenced, indented, inline) and formulas in dollar signs are laid
aside and put back untouched. Leftovers go through a tree builder: HTML with
implied end tags and visibility rules (comments, scripts, hidden elements emit
nothing), wiki and LaTeX as their Markdown equals. Headings, lists, code,
formulas and tables keep their structure; cells of tables are aligned; blocks
are parted by one blank line. The kinds of markup met on the way are reported.

NULL text gives NULL text and no kinds, rows with a NULL id are left out; empty text stays empty. Texts of any
length are handled whole. Text without leftovers comes out as it is, but for
line ends and trailing blanks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from unicodedata import east_asian_width

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The elements of HTML; other words in angle brackets are text.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite "
    "code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript "
    "object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select slot small source span strike strong "
    "style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_HIDDEN = frozenset("script style template head title noscript svg iframe object select datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html li main menu nav ol p pre section summary table tr ul caption".split()
)
# Which open elements a start tag closes by itself.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("td", "th", "tr", "thead"), "tfoot": ("td", "th", "tr", "tbody"),
}
_FENCE = re.compile(r"^[ ]{0,3}(?:(`{3,})[^`\n]*|(~{3,})[^\n]*)\n(?:(?:.*\n)*?[ ]{0,3}(?:\1`*|\2~*)[ \t]*(?=\n|\Z)|[\s\S]*\Z)", re.M)
_INDENTED = re.compile(r"(?:(?<=\n\n)|\A)(?:(?:[ ]{4}|\t)[^\n]*(?:\n+(?=[ ]{4}|\t)|\n|\Z))+")
_INLINE = re.compile(r"(?<!`)`(?!`)[^`\n]+`(?!`)|``(?!`)(?:(?!\n\n)[\s\S])+?``|`(?!`)(?:[^`\n]|\n(?!\n))+`")
FORMULA = re.compile(r"\$\$[^$]+\$\$|(?<![\\$\w])\$(?![\s{])[^$\n]+?(?<![\s\\])\$(?![\d{$])")
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)(/?)>|<!--[\s\S]*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<!\[CDATA\[([\s\S]*?)\]\]>", re.I)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
WIKI = re.compile(
    r"^={1,6}[ \t]*[^=\n][^\n]*?=={0,5}[ \t]*$(?<!^=)|'''?[^'\n]+'''?|\[\[[^\[\]\n]+\]\]|^\{\||^\|\}|^\|-|^h[1-6]\.[ \t]|\{(?:noformat|code|quote|panel)[^}\n]*\}"
    r"|^\|\|[^\n]+\|\||__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX)__|^[:;]{2,}[ \t]|<nowiki>|<ref[ >]|\{\{(?:[Cc]ite|[Ii]nfobox|reflist)[^}]*\}\}",
    re.M,
)
_LATEX = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}|\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{|\\(?:item|maketitle|noindent|newpage|clearpage|tableofcontents|hline|par|LaTeX|TeX)\b")
_HINT = re.compile(r"[<&\\=]|'''?|\[\[|\{[|nqcp]|\|[|}\-]|^h[1-6]\.|__[A-Z]|^::|^;;", re.M)


def newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def without_code(text: str, inline: str = " ", keep_lines: bool = False) -> str:
    """``text`` without fenced and indented blocks and with ``inline`` for each piece of inline code.

    With ``keep_lines`` every line that is left keeps its number, counted at LF.
    """
    text = text.replace("\r\n", "\n") if keep_lines else newlines(text)
    gone = (lambda m: "\n" * m.group().count("\n")) if keep_lines else "\n"
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(gone, text)
    if "    " in text or "\t" in text:
        text = _INDENTED.sub(gone, text)
    if "`" not in text:
        return text
    return _INLINE.sub((lambda m: inline + "\n" * m.group().count("\n")) if keep_lines else inline, text)


class _Aside:
    """Pieces laid aside under a private character and put back later."""

    def __init__(self, name: str = "a") -> None:
        self.name, self.kept = name, []  # type: ignore[var-annotated]

    def keep(self, m: re.Match[str]) -> str:
        self.kept.append(m.group())
        return f"\ue000{self.name}{len(self.kept) - 1}\ue001"

    def restore(self, text: str) -> str:
        if not self.kept:
            return text
        return re.sub(f"\ue000{self.name}(\\d+)\ue001", lambda m: self.kept[int(m[1])] if int(m[1]) < len(self.kept) else m.group(), text)


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in s)


def aligned(rows: list[list[str]]) -> str:
    """A Markdown table whose cells are padded to their columns."""
    rows = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] for r in rows if r]
    if not rows:
        return ""
    n = max(map(len, rows))
    rows = [r + [""] * (n - len(r)) for r in rows]
    widths = [max(3, *(_width(r[j]) for r in rows)) for j in range(n)]
    line = lambda r: "| " + " | ".join(c + " " * (w - _width(c)) for c, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join("-" * w for w in widths) + " |", *map(line, rows[1:])])


class _Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: str = "") -> None:
        self.name, self.attrs, self.children = name, attrs, []  # type: ignore[var-annotated]


def _hidden(node: _Node) -> bool:
    a = node.attrs.lower()
    return node.name in _HIDDEN or bool(a) and (re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", a) is not None)


def _tree(text: str) -> _Node:
    root = _Node("")
    stack = [root]
    at = 0
    for m in TAG.finditer(text):
        if m.start() < at:
            continue
        name = (m[2] or "").lower()
        if m[2] and name not in ELEMENTS:
            continue
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[5]:
            stack[-1].children.append(m[5])
        if not name:
            continue
        if m[1]:
            if any(n.name == name for n in stack[1:]):
                while stack.pop().name != name:
                    pass
            continue
        if name in _BLOCK and any(n.name == "p" for n in stack[1:]) and name not in ("dd", "dt", "li", "tr"):
            while stack.pop().name != "p":
                pass
        closes = _CLOSES.get(name, ())
        while len(stack) > 1 and stack[-1].name in closes:
            stack.pop()
        node = _Node(name, m[3])
        stack[-1].children.append(node)
        if name in ("script", "style"):
            end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif name not in _VOID and not m[4]:
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def _cells(node: _Node) -> Iterator[list[str]]:
    for c in node.children:
        if isinstance(c, _Node) and not _hidden(c):
            if c.name == "tr":
                yield [_render(x).strip() for x in c.children if isinstance(x, _Node) and x.name in ("td", "th")]
            else:
                yield from _cells(c)


def _render(node: _Node, depth: int = 0) -> str:  # noqa: C901
    out: list[str] = []
    number = 0
    for c in node.children:
        if isinstance(c, str):
            out.append(c if node.name not in ("ul", "ol", "table", "tr") else c.strip() and c)
            continue
        if _hidden(c):
            continue
        name = c.name
        if name == "br":
            out.append("\n")
        elif name == "hr":
            out.append("\n\n---\n\n")
        elif name == "img":
            m = re.search(r"alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", c.attrs)
            out.append((m[1] or m[2] or m[3] or "") if m else "")
        elif name == "pre":
            body = re.sub(r"^\n|\n$", "", _render(c, depth).replace("`", ""))
            out.append(f"\n\n```\n{body}\n```\n\n")
        elif name in ("code", "tt", "kbd", "samp"):
            body = _render(c, depth)
            out.append(body if node.name == "pre" or not body.strip() else f"`{body.strip()}`")
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            body = re.sub(r"\s+", " ", _render(c, depth)).strip()
            out.append(f"\n\n{'#' * int(name[1])} {body}\n\n" if body else "")
        elif name == "li":
            number += 1
            body = re.sub(r"\n\s*\n+", "\n", _render(c, depth + 1)).strip()
            mark = f"{number}. " if node.name == "ol" else "- "
            out.append(f"\n{mark}" + body.replace("\n", "\n" + " " * len(mark)))
        elif name == "table":
            out.append(f"\n\n{aligned(list(_cells(c)))}\n\n")
        elif name == "blockquote":
            out.append("\n\n" + "\n".join("> " + x for x in _render(c, depth).strip().split("\n")) + "\n\n")
        elif name in _BLOCK:
            out.append(f"\n\n{_render(c, depth).strip()}\n\n")
        else:
            out.append(_render(c, depth))
    return "".join(x for x in out if x)


def _from_latex(text: str) -> str:
    text = re.sub(r"\\begin\{(equation|align|displaymath|gather|eqnarray|math)\*?\}([\s\S]*?)\\end\{\1\*?\}", lambda m: f"\n$${m[2].strip()}$$\n", text)
    text = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}(?:\[[^\]]*\])?\n?([\s\S]*?)\n?\\end\{(?:verbatim|lstlisting)\}", r"\n```\n\1\n```\n", text)
    formulas = _Aside("f")
    text = FORMULA.sub(formulas.keep, text)
    text = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?", "", text)
    for level, name in enumerate(("chapter", "section", "subsection", "subsubsection", "paragraph"), 1):
        text = re.sub(rf"\\{name}\*?\{{([^{{}}]*)\}}", lambda m, k=level: f"\n{'#' * k} {m[1].strip()}\n", text)
    text = re.sub(r"^[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: f"- {m[1]} " if m[1] else "- ", text, flags=re.M)
    text = re.sub(r"[ ~]?\\(?:cite|citep|citet|label|footnotemark|vspace|hspace|usepackage|documentclass|bibliography|bibliographystyle)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:ref|eqref|autoref|pageref)\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\href\{([^{}]*)\}\{([^{}]*)\}", r"[\2](\1)", text)
    text = re.sub(r"\\(?:verb|texttt|lstinline)\{([^{}]*)\}", r"`\1`", text)
    for _ in range(8):
        new = re.sub(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
        if new == text:
            break
        text = new
    text = re.sub(r"\\(?:maketitle|noindent|newpage|clearpage|tableofcontents|hline|par|centering)\b[ ]?", "", text)
    text = re.sub(r"\\([%&_#{}])", r"\1", re.sub(r"(?<=\S)~(?=\S)", " ", text)).replace("\\LaTeX", "LaTeX").replace("\\TeX", "TeX")
    return formulas.restore(text)


def _wiki_table(m: re.Match[str]) -> str:
    rows: list[list[str]] = [[]]
    for line in m.group().split("\n")[1:]:
        line = line.strip()
        if line.startswith(("|}", "|+")):
            continue
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in "|!" and line:
            rows[-1] += re.split(r"\|\||!!", line[1:])
        elif line:
            (rows[-1] or [""])[-1] += " " + line
            if not rows[-1]:
                rows[-1].append(line)
    return "\n" + aligned(rows) + "\n"


def _from_wiki(text: str) -> str:
    text = re.sub(r"\{(?:noformat|code)[^}\n]*\}\n?([\s\S]*?)\n?\{(?:noformat|code)\}", r"\n```\n\1\n```\n", text)
    code = _Aside("c")
    text = _FENCE.sub(code.keep, text)
    text = re.sub(r"^\{\|[\s\S]*?(?:^\|\}[^\n]*$|\Z)", _wiki_table, text, flags=re.M)
    text = re.sub(r"(?:^\|\|[^\n]+\|\|[ \t]*\n?)(?:^\|(?!\|)[^\n]*\|[ \t]*\n?)*", lambda m: aligned([re.split(r"\|\|?", x.strip().strip("|")) for x in m.group().strip().split("\n")]) + "\n", text, flags=re.M)
    text = re.sub(r"^(={1,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", lambda m: f"{'#' * len(m[1])} {m[2]}", text, flags=re.M)
    text = re.sub(r"^h([1-6])\.[ \t]+", lambda m: "#" * int(m[1]) + " ", text, flags=re.M)
    text = re.sub(r"'''''([^\n]+?)'''''|'''([^\n]+?)'''|''([^\n]+?)''", lambda m: m[1] or m[2] or m[3], text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"__[A-Z]+__[ \t]*", "", re.sub(r"\{\{[^{}\n]*\}\}", "", text) if "{{cite" in text.lower() else text)
    text = re.sub(r"\{(?:quote|panel)[^}\n]*\}", "", text)
    return code.restore(re.sub(r"^[:;]{2,}[ \t]+", "", text, flags=re.M))


def is_html(m: re.Match[str]) -> bool:
    return not m[2] or m[2].lower() in ELEMENTS


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text, and which of html, latex, wiki stood in it outside code."""
    if text is None:
        return None, []
    text = newlines(text)
    if not _HINT.search(text):
        return re.sub(r"[ \t]+$", "", text, flags=re.M), []
    aside, kinds = _Aside(), set()
    body = _FENCE.sub(aside.keep, text) if "```" in text or "~~~" in text else text
    body = _INDENTED.sub(lambda m: aside.keep(m) + "\n", body) if "    " in body or "\t" in body else body
    body = _INLINE.sub(aside.keep, body) if "`" in body else body
    body = FORMULA.sub(aside.keep, body) if "$" in body else body
    if "\\" in body and _LATEX.search(body):
        kinds.add("latex")
        body = _from_latex(body)
        body = FORMULA.sub(aside.keep, body) if "$" in body else body
    if WIKI.search(body):
        kinds.add("wiki")
        body = _from_wiki(body)
        body = _FENCE.sub(aside.keep, body) if "```" in body else body
    for _ in range(3):  # escaped tags are tags once unescaped
        tags = "<" in body and any(is_html(m) for m in TAG.finditer(body))
        entity = "&" in body and any(html.unescape(m.group()) != m.group() for m in _ENTITY.finditer(body))
        if not tags and not entity:
            break
        kinds.add("html")
        if tags:
            body = _render(_tree(body))
            body = _FENCE.sub(aside.keep, body) if "```" in body else body
        if entity:
            body = _ENTITY.sub(lambda m: html.unescape(m.group()).replace("\xa0", " "), body)
    body = aside.restore(aside.restore(body)) if kinds else text
    body = re.sub(r"[ \t]+$", "", body, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", body).lstrip("\n") if kinds else body, sorted(kinds)


def clean_pages(pages: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, kinds) for each row of ``pages``."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [clean(x if isinstance(x, str) else None) for x in b["t"]]
            yield pd.DataFrame({"i": b["i"], "text": [x for x, _ in got], "kinds": [k for _, k in got]})

    kind = dict(pages.dtypes)[id_column]
    rows = pages.selectExpr(f"`{id_column}` AS i", f"`{text_column}` AS t").filter("i IS NOT NULL")
    return rows.mapInPandas(of, f"i {kind}, text string, kinds array<string>").withColumnRenamed("i", id_column)


def markup_kinds(pages: DataFrame) -> DataFrame:
    """(page_id, markup): each kind of leftover ``clean`` met in a page; rows are distinct."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = [clean(x if isinstance(x, str) else None)[1] for x in b["markdown"]]
            n = [len(k) for k in kinds]
            yield pd.DataFrame({"page_id": np.repeat(b["page_id"].to_numpy(), n), "markup": [x for k in kinds for x in k]}).astype({"markup": object})

    return pages.select("page_id", "markdown").filter("page_id IS NOT NULL").mapInPandas(of, "page_id long, markup string").distinct()
