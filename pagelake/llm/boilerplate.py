"""Page boilerplate mixed with main content: which lines of a page aren't its article.

A page is read as a tree: page, groups (runs of lines without a blank between
them; a label or heading standing before a list belongs to the list's group),
lines. Each group and each line is a node with features of its own (length,
punctuation, link density, letter case, tokens), of its subtree (density of
links, share of list items), its depth, its siblings and its place. Two
gradient-boosted models give the log-odds that a group or a line is furniture.
Decoding picks the labels of the whole tree at once: a group that is furniture
takes all its lines with it, a group that is article lets each line choose, so
no line contradicts its ancestor.

The models and the token odds are trained by ``train_boilerplate`` on a bounded
sample of labelled pages and stored in ``models/boilerplate.json``.

NULL or empty markdown has no lines, so no rows. Very long pages are processed
whole. Rows with a NULL id are left out. Repeated pages give repeated arrays; ``furniture_lines`` makes its rows
distinct. Only the named columns are read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.gbt import Model

MODEL = Path(__file__).parent / "models" / "boilerplate.json"
_WORD = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"\[([^\]\n]*)\]\(([^)\s]*)[^)]*\)")
_MARK = re.compile(r"(?:[>*+\-]|\d{1,3}[.)])[ \t\xa0]+")
_FENCE = re.compile(r" {0,3}(```+|~~~+)")
_DIGIT = re.compile(r"\d")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)\s*$")
LINE_FEATURES, GROUP_FEATURES = 40, 26


def site_words(url: str | None) -> frozenset[str]:
    """Words of the host name, by which a site speaks of itself."""
    host = re.sub(r"^[A-Za-z]+://", "", url or "").split("/")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    labels = host.split(".")
    return frozenset(w for label in labels[:-1] for w in label.split("-") if len(w) > 3 and w not in ("docs", "help", "learn"))


class Page:
    """The lines of one page with features of their own and the groups they form; lines are numbered from 1."""

    __slots__ = ("line_no", "rows", "raw", "starts", "title_at")

    def __init__(self, markdown: str | None, url: str | None, odds: dict[str, float]) -> None:  # noqa: PLR0912, PLR0915, C901
        raw = (markdown or "").split("\n")
        site = site_words(url)
        line_no: list[int] = []
        rows: list[tuple[float, ...]] = []
        starts: list[int] = []
        fence, gap, title_at, last_label, was_code = None, True, -1, False, 0
        for i, full in enumerate(raw):
            text = full.strip()
            if not text:
                gap = True
                continue
            body, depth, quote, item, level, emphasis, code = text, 0, 0, 0, 0, 0, 0
            c = text[0]
            if fence:
                code = 1
                if c == fence[0] and text.startswith(fence) and not text.strip(c):
                    fence = None
            elif c in "`~" and (m := _FENCE.match(full)):
                fence, code = m[1], 1
            elif gap and full[:4] == "    " and not last_label:
                code = 1
            if not code:
                while c in ">*+-0123456789" and (m := _MARK.match(body)):
                    depth += 1
                    if c == ">":
                        quote = 1
                    else:
                        item = 1
                    body = body[m.end() :]
                    c = body[:1] or " "
                if c == "#":
                    level = len(body) - len(body.lstrip("#"))
                    if body[level : level + 1] in (" ", "\t", "\xa0", ""):
                        body = body[level:].strip()
                    else:
                        level = 7  # a tag, no heading
                    c = body[:1] or " "
                if c in "*_" and len(body) > 4 and body[-1] == c:
                    emphasis, body = 1, body.strip("*_")
                if body[-1:] == "…":
                    body, emphasis = body[:-1].rstrip(), emphasis + 2
            shown, link_len, n_links, anchor, rel, ext, href = body, 0, 0, 0, 0, 0, 0.0
            if "](" in body:
                links = _LINK.findall(body)
                n_links = len(links)
                for label, to in links:
                    link_len += len(label)
                    if to[:1] == "#":
                        anchor += 1
                    elif to[:1] == "/":
                        rel += 1
                        href += odds.get(to.split("?")[0].strip("/").lower(), 0.0)
                    else:
                        ext += 1
                        href += odds.get(to.rstrip("/").rsplit("/", 1)[-1].lower(), 0.0)
                shown = _LINK.sub(r"\1", body) if links else body
            lower = _WORD.findall(shown.lower())
            says_site = 0
            if site and not site.isdisjoint(lower):
                says_site = 1
                lower = [w for w in lower if w not in site]
            values = [odds[w] for w in lower if w in odds]
            n, n_words, n_values = len(shown), len(lower), len(values)
            total = sum(values)
            ends = body[-1:]
            stop = 1 if ends in ".!?。！？।؟" else 2 if ends == ":" else 0
            label = not code and not item and not stop and n < 40 and n_words <= 5
            short = n < 160
            seps = body.count("|") + body.count("·") + body.count("›") + body.count("»") + body.count(" / ") + body.count(" > ") if short or n_links else 0
            if not rows or (gap and not code and not (last_label and item)) or (level and not code and not gap) or (code and gap and not was_code):
                starts.append(len(rows))
            line_no.append(i + 1)
            if title_at < 0 and not code:
                if level == 1 and not item and not quote:
                    title_at = len(rows)
                elif not gap and rows and c in "=-" and _SETEXT.match(full):
                    title_at = len(rows) - 1
            rows.append((
                math.log1p(n), n_words, total, max(values) if values else 0.0, min(values) if values else 0.0, total / (n_values + 1),
                n_values / (n_words + 1), shown.isupper(), depth, quote, item, code, level, emphasis, n_links,
                link_len / (n + 1), anchor, rel, ext, href, seps, stop, body.count(". ") + body.count("? ") + body.count("! ") + body.count("。") + body.count("।"), says_site, "©" in body, body.count("`"),
                len(_DIGIT.findall(body)) / (n + 1) if short else 0.0, "$" in body or "\\" in body or "{" in body, label, text[0] == "|",
            ))
            last_label, gap, was_code = bool(label or level or stop == 2), False, code
        self.raw, self.line_no, self.rows, self.starts, self.title_at = raw, line_no, rows, starts, title_at


def matrices(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, features of all groups, and the group of each line, over ``pages`` in order."""
    counts = np.array([len(p.rows) for p in pages], np.int64)
    n_groups = np.array([len(p.starts) for p in pages], np.int64)
    total, groups = int(counts.sum()), int(n_groups.sum())
    if not total:
        return np.zeros((0, LINE_FEATURES), np.float32), np.zeros((0, GROUP_FEATURES), np.float32), np.zeros(0, np.int64)
    x = np.array([r for p in pages for r in p.rows], np.float32)
    first_line = np.repeat(np.cumsum(counts) - counts, n_groups)
    starts = first_line + np.fromiter((s for p in pages for s in p.starts), np.int64, groups)
    size = np.diff(np.append(starts, total))
    owner = np.repeat(np.arange(groups), size)
    page_of_group = np.repeat(np.arange(len(pages)), n_groups)
    page_of_line = np.repeat(np.arange(len(pages)), counts)
    at = np.arange(total) - (np.cumsum(counts) - counts)[page_of_line]
    g_at = np.arange(groups) - (np.cumsum(n_groups) - n_groups)[page_of_group]
    title = np.array([p.title_at for p in pages])
    mean = np.add.reduceat(x, starts, axis=0) / size[:, None]
    most, least = np.maximum.reduceat(x[:, :4], starts, axis=0), np.minimum.reduceat(x[:, 2], starts)
    head = x[starts]
    after = n_groups[page_of_group] - 1 - g_at
    g = np.column_stack([
        size, mean[:, 2] * size, most[:, 2], least, mean[:, 2], head[:, 2], head[:, 28], head[:, 12],
        mean[:, 10], np.add.reduceat(x[:, 14] > 0, starts) / size, mean[:, 15], mean[:, 16], mean[:, 17], mean[:, 18], mean[:, 22],
        np.add.reduceat(x[:, 21] == 1, starts) / size, mean[:, 0], most[:, 0], head[:, 11], mean[:, 29], np.minimum(g_at, 9), np.minimum(after, 9),
        title[page_of_group] < 0, starts - first_line < title[page_of_group], mean[:, 23], mean[:, 9],
    ]).astype(np.float32)
    before = np.where(g_at > 0, np.roll(g[:, 4], 1), 0.0)
    behind = np.where(after > 0, np.roll(g[:, 4], -1), 0.0)
    in_group = np.arange(total) - starts[owner]
    rest = counts[page_of_line] - 1 - at
    lines = np.column_stack([
        x, np.minimum(size[owner], 30), np.minimum(in_group, 30), g[owner, 10], np.where(in_group > 0, head[owner, 2], 0.0), before[owner], behind[owner],
        at < title[page_of_line], at / np.maximum(counts[page_of_line] - 1, 1), np.minimum(at, 9), np.minimum(rest, 9),
    ]).astype(np.float32)
    return lines, g, owner


class Boilerplate:
    """The trained models with their decoding."""

    def __init__(self, model: dict) -> None:
        self.odds, self.line, self.group = model["odds"], Model(model["line"]), Model(model["group"])

    def flags(self, pages: list[Page]) -> list[list[bool]]:
        """For each page whether each of its non-blank lines is furniture."""
        lines, groups, owner = matrices(pages)
        if not len(lines):
            return [[] for _ in pages]
        s, t = self.line.log_odds(lines), self.group.log_odds(groups)
        # A furniture group holds furniture lines only; its weight against that of free choice, both as log-likelihoods.
        log1p = lambda v: -np.logaddexp(0, -v)
        as_furniture = log1p(t) + np.bincount(owner, log1p(s), len(t))
        as_article = log1p(-t) + np.bincount(owner, np.maximum(log1p(s), log1p(-s)), len(t))
        found = (s > 0) | (as_furniture > as_article)[owner]
        # The first top heading is the article's title, with its underline.
        at = 0
        for p in pages:
            if p.title_at >= 0:
                found[at + p.title_at] = False
                after = p.title_at + 1
                if after < len(p.rows) and p.line_no[after] == p.line_no[p.title_at] + 1 and _SETEXT.match(p.raw[p.line_no[after] - 1]):
                    found[at + after] = False
            own = slice(at, at + len(p.rows))
            body = lines[own, 12] == 0
            # A page has something to say under its headings: the likeliest line stays.
            if body.any() and found[own][body].all():
                found[at + np.nonzero(body)[0][s[own][body].argmin()]] = False
            at += len(p.rows)
        # An article group all of whose lines chose furniture is furniture all the same: both give the same lines.
        cuts = np.cumsum([len(p.rows) for p in pages])[:-1]
        return [x.tolist() for x in np.split(found, cuts)]


@lru_cache(maxsize=1)
def trained() -> Boilerplate:
    return Boilerplate(json.loads(MODEL.read_text()))


def split_batch(markdown: list[str | None], url: list[str | None], model: Boilerplate | None = None) -> list[tuple[list[int], str]]:
    """For each page its furniture line numbers and the article, which is the other lines."""
    model = model or trained()
    out = []
    for at in range(0, len(markdown), 500):
        pages = [Page(m, u, model.odds) for m, u in zip(markdown[at : at + 500], url[at : at + 500], strict=True)]
        for page, flags in zip(pages, model.flags(pages), strict=True):
            gone = [n for n, f in zip(page.line_no, flags, strict=True) if f]
            drop = set(gone)
            out.append((gone, "\n".join(x for n, x in enumerate(page.raw, 1) if n not in drop) if drop else "\n".join(page.raw)))
    return out


_SPLIT = T.StructType([T.StructField("furniture", T.ArrayType(T.IntegerType())), T.StructField("article", T.StringType())])


@F.pandas_udf(_SPLIT)
def split_page(markdown: pd.Series, url: pd.Series) -> pd.DataFrame:
    """Struct of the furniture's line numbers and the article; NULL markdown gives no lines and an empty article."""
    out = split_batch([x if isinstance(x, str) else None for x in markdown], [x if isinstance(x, str) else None for x in url])
    return pd.DataFrame({"furniture": [x for x, _ in out], "article": [x for _, x in out]})


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of each furniture line of ``pages`` (page_id, url, markdown); rows are distinct."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = split_batch([x if isinstance(x, str) else None for x in b["markdown"]], [x if isinstance(x, str) else None for x in b["url"]])
            lengths = [len(x) for x, _ in found]
            yield pd.DataFrame({
                "page_id": np.repeat(b["page_id"].to_numpy(), lengths),
                "line_no": np.fromiter((n for x, _ in found for n in x), np.int32, sum(lengths)),
            })

    return pages.select("page_id", "url", "markdown").filter("page_id IS NOT NULL").mapInPandas(of, "page_id long, line_no int").distinct()
