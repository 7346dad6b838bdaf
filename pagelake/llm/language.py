"""Missing or wrong document language labels: a language with a confidence for each page and each mixed part.

Character n-grams (four letters, or two in scripts without blanks) are looked up
in bit-sliced Bloom filters: one table of words in which bit l says that
language l may hold the n-gram; the words at an n-gram's hash positions, and-ed,
are all languages containing it at once. Per paragraph the popcounts of each
language, less what false positives of its filter would give, decide. The
filters are trained by ``train_language`` and stored in ``models``.

A paragraph too short or undecided takes no part in that, but where a page has no
other, its lines (table rows included) are pooled. A page's main language is
that of most of its letters; another one counts as mixed if whole paragraphs
of it are certain. Furniture, code, link targets and words with digits or
underscores don't count.

``document_languages`` gives every page its languages with their confidences,
``und`` with 0 where there is nothing to judge by; ``language_segments`` the runs of lines
in one language; ``corrected`` only the pages whose label is wrong, missing or one of
several languages, and for those without a judgement nothing. NULL or empty text has no
language; rows with a NULL id are left out. Repeated rows count once.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.functions.text import strip
from pagelake.llm.boilerplate import split_batch
from pagelake.llm.markup import without_code
from pagelake.llm.template_residue import EXAMINED, examine, residue_pages
from pagelake.session import cut

MODEL = Path(__file__).parent / "models" / "language.npz"
#: A paragraph votes from so many n-grams on; a second language needs so many n-grams in certain paragraphs.
LEAST_GRAMS, LEAST_MIXED = 12, 24
#: A paragraph whose best language holds less of its n-grams, or leads the next by less, is undecided.
LEAST_SHARE, LEAST_LEAD = 0.35, 0.08
_TARGET, _TAG, _ENTITY = re.compile(r"\]\([^)\s]*\)"), re.compile(r"<[^<>\n]*>"), re.compile(r"&[#\w]+;")
_NAME = re.compile(r"[A-Za-z]*[0-9_][A-Za-z0-9_.]*|[A-Z][a-z]+[A-Z][A-Za-z]*")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter or mark, else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = c
    for c in range(ord("a"), ord("z") + 1):
        table[c] = c
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``texts`` and the index of the text each is of."""
    joined = "\n".join(texts).lower()
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    owner = np.cumsum(code == 10)
    c = _letters()[code]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (code[1:] == 10)
    c, owner = c[keep].astype(np.uint64), owner[keep]
    c = np.concatenate([c, np.full(3, 32, np.uint64)])
    n = len(owner)
    owner_to = np.concatenate([owner, np.full(3, -1)])
    wide = c[:n] >= 0x2E80
    h = np.where(wide, c[:n] * np.uint64(0x1F0000) + c[1 : n + 1], ((c[:n] << np.uint64(16) ^ c[1 : n + 1]) << np.uint64(16) ^ c[2 : n + 2]) << np.uint64(16) ^ c[3 : n + 3])
    good = np.where(wide, c[1 : n + 1] >= 0x2E80, (c[1 : n + 1] != 32) & (c[2 : n + 2] != 32) & (owner_to[3 : n + 3] == owner) & (c[3 : n + 3] < 0x2E80))
    h, owner = h[good], owner[good]
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29)), owner


class Filters:
    """Bit-sliced Bloom filters of up to 64 languages; the words are as wide as these ask for."""

    def __init__(self, languages: list[str], words: np.ndarray, hashes: int = 2) -> None:
        self.languages, self.words, self.hashes = languages, words, hashes
        self.bits = int(np.log2(len(words)))
        self.false = np.array([(((words >> words.dtype.type(k)) & words.dtype.type(1)).mean()) ** hashes for k in range(len(languages))])

    @classmethod
    def build(cls, sets: dict[str, np.ndarray], bits: int = 17, hashes: int = 2) -> Filters:
        languages = sorted(sets)
        words = np.zeros(1 << bits, np.uint16 if len(sets) <= 16 else np.uint64)
        for k, name in enumerate(languages):
            for j in range(hashes):
                words[cls._at(sets[name], j, bits)] |= words.dtype.type(1 << k)
        return cls(languages, words, hashes)

    @staticmethod
    def _at(h: np.ndarray, j: int, bits: int) -> np.ndarray:
        return ((h * np.uint64((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)[j])) >> np.uint64(64 - bits)).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = self.words[self._at(h, 0, self.bits)]
        for j in range(1, self.hashes):
            out = out & self.words[self._at(h, j, self.bits)]
        return out

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of n-grams, and by language the share of them it holds, false positives taken off."""
        h, owner = grams(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        masks = self.masks(h)
        count = np.stack([np.bincount(owner, (masks >> masks.dtype.type(k)) & masks.dtype.type(1), len(texts)) for k in range(len(self.languages))], 1)
        share = np.maximum(0, count - n[:, None] * self.false) / ((1 - self.false) * np.maximum(n, 1)[:, None])
        return n, share

    @classmethod
    def load(cls) -> Filters:
        with np.load(MODEL) as z:
            return cls([str(x) for x in z["languages"]], z["words"], int(z["hashes"]))


@lru_cache(maxsize=1)
def trained() -> Filters:
    return Filters.load()


def bare_lines(bare: str) -> list[str]:
    """The lines of an article without code, without link targets, tags, entities and names."""
    if "](" in bare:
        bare = _TARGET.sub(" ", bare)
    if "<" in bare:
        bare = _TAG.sub(" ", bare)
    if "&" in bare:
        bare = _ENTITY.sub(" ", bare)
    return _NAME.sub(" ", bare).split("\n")


def paragraphs(bare: str) -> list[tuple[int, str]]:
    """(line number, text) of the lines of an article without code that may vote."""
    return [(i, line) for i, line in enumerate(bare_lines(bare), 1) if len(line) > 5 and line[0] != "|" and not line.isspace()]


def _judged(texts: list[str], filters: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the best language, its confidence, its n-grams and whether it is decided."""
    n, share = filters.shares(texts)
    at = np.arange(len(texts))
    best = share.argmax(1)
    top = share[at, best]
    rest = share.copy()
    rest[at, best] = 0
    confidence = top**2 / np.maximum((share**2).sum(1), 1e-9)
    return best, confidence, n, (n >= LEAST_GRAMS) & (top >= LEAST_SHARE) & (top - rest.max(1) >= LEAST_LEAD)


def decide(articles: list[str], filters: Filters | None = None) -> list[list[tuple[int, str, float, int]]]:
    """For each article without code its decided paragraphs: line, language, confidence, n-grams.

    An article without any is decided by all its lines at once, as line 0, if they suffice.
    """
    if len(articles) > 1000:  # bounds the arrays of n-grams
        return [x for at in range(0, len(articles), 1000) for x in decide(articles[at : at + 1000], filters)]
    filters = filters or trained()
    parts = [paragraphs(a) for a in articles]
    texts = [t for p in parts for _, t in p]
    out: list[list[tuple[int, str, float, int]]] = [[] for _ in articles]
    if texts:
        best, confidence, n, sure = _judged(texts, filters)
        k = 0
        for a, p in enumerate(parts):
            for line, _ in p:
                if sure[k]:
                    out[a].append((line, filters.languages[best[k]], float(confidence[k]), int(n[k])))
                k += 1
    left = [a for a, found in enumerate(out) if not found and articles[a] and not articles[a].isspace()]
    if left:
        best, confidence, n, sure = _judged([" ".join(bare_lines(articles[a])) for a in left], filters)
        for k, a in enumerate(left):
            if sure[k]:
                out[a].append((0, filters.languages[best[k]], float(confidence[k]), int(n[k])))
    return out


def page_languages(found: list[tuple[int, str, float, int]]) -> list[tuple[str, float]]:
    """The languages of a page with their confidences, that of most n-grams first; a second one only if certain."""
    weight: dict[str, float] = {}
    sure: dict[str, float] = {}
    for _, language, confidence, n in found:
        weight[language] = weight.get(language, 0) + n
        sure[language] = sure.get(language, 0) + n * confidence
    if not weight:
        return []
    order = sorted(weight, key=lambda k: (-weight[k], k))
    longest = {k: max(n for _, x, _, n in found if x == k) for k in order}
    return [(k, sure[k] / weight[k]) for i, k in enumerate(order) if not i or (weight[k] >= LEAST_MIXED and longest[k] >= 18 and sure[k] >= 0.5 * weight[k])]


def language_facts(pages: DataFrame) -> DataFrame:
    """(page_id, host, hit, lines, languages): what ``template_residue`` examines, and the page's languages."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = lambda c: [x if isinstance(x, str) else None for x in b[c]]
            articles = [a for _, a in split_batch(text("markdown"), text("url"))]
            bare = [without_code(a) for a in articles]
            residue = [examine(a, t, x) for a, t, x in zip(articles, text("title"), bare, strict=True)]
            found = decide([x if not r[0] else "" for x, r in zip(bare, residue, strict=True)])
            got = [[{"code": k, "confidence": round(v, 4)} for k, v in page_languages(x)] for x in found]
            yield pd.DataFrame({"page_id": b["page_id"], "host": b["host"], **{c: [r[k] for r in residue] for k, c in enumerate(("hit", "lines", "records"))}, "languages": got, "language": b["language"]})

    rows = pages.select("page_id", "url", "title", "language", "markdown", urls.host(F.col("url")).alias("host")).filter("page_id IS NOT NULL")
    schema = f"page_id long, host string, {EXAMINED}, languages array<struct<code string, confidence double>>, language string"
    return rows.mapInPandas(of, schema)


def _articles(markdown: list[str | None], url: list[str | None]) -> list[str]:
    """Each page's article without code, its lines still numbered as the page's."""
    out = []
    for text, (gone, _) in zip(markdown, split_batch(markdown, url), strict=True):
        drop = set(gone)
        lines = (text or "").split("\n")
        out.append(without_code("\n".join("" if n in drop else x for n, x in enumerate(lines, 1)) if drop else text or "", keep_lines=True))
    return out


def segments(found: list[tuple[int, str, float, int]]) -> list[tuple[int, int, str, float]]:
    """(first line, last line, language, confidence): the decided paragraphs of a page's languages, neighbours of one language joined."""
    kept = {k for k, _ in page_languages(found)}
    out: list[list] = []
    for line, language, confidence, n in found:
        if language not in kept:
            continue
        if out and out[-1][2] == language:
            out[-1][1], out[-1][3], out[-1][4] = line, out[-1][3] + n * confidence, out[-1][4] + n
        else:
            out.append([line, line, language, n * confidence, n])
    return [(a, b, language, weight / n) for a, b, language, weight, n in out]


def _per_page(pages: DataFrame, rows_of: Callable[[list[tuple[int, str, float, int]]], list[tuple]], columns: str) -> DataFrame:
    names = ["page_id", *(c.split()[0] for c in columns.split(", "))]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = lambda c: [x if isinstance(x, str) else None for x in b[c]]
            found = decide(_articles(text("markdown"), text("url")))
            rows = [(i, *row) for i, x in zip(b["page_id"].tolist(), found, strict=True) for row in rows_of(x)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "url", "markdown").filter("page_id IS NOT NULL").mapInPandas(of, f"page_id long, {columns}").distinct()


def document_languages(pages: DataFrame) -> DataFrame:
    """(page_id, language_code, confidence, is_main) of every page of ``pages`` (page_id, url, markdown), and of each further language of mixed ones."""
    rows = lambda found: [(k, round(v, 4), not i) for i, (k, v) in enumerate(page_languages(found))] or [("und", 0.0, True)]
    return _per_page(pages, rows, "language_code string, confidence double, is_main boolean")


def language_segments(pages: DataFrame) -> DataFrame:
    """(page_id, first_line, last_line, language_code, confidence): the runs of a page's lines that are in one language.

    Lines count from 1 in markdown; pages decided by all their lines at once have one segment of line 0.
    """
    rows = lambda found: [(a, b, k, round(v, 4)) for a, b, k, v in segments(found)]
    return _per_page(pages, rows, "first_line int, last_line int, language_code string, confidence double")


def label_code(label: Column) -> Column:
    """The part of a label before - or _, lower case; NULL if blank."""
    return F.nullif(F.lower(F.regexp_extract(strip(label), r"^([^\-_]*)", 1)), F.lit(""))


def corrected(pages: DataFrame) -> DataFrame:
    """(page_id, language_code, confidence) of the pages with a wrong or missing label or two languages.

    Pages of template residue or error messages are left out. Rows are distinct.
    """
    facts = cut(language_facts(pages))
    rows = facts.filter("NOT hit AND size(languages) > 0").join(residue_pages(pages, facts), "page_id", "left_anti")
    right = F.coalesce(label_code(F.col("language")) == F.col("languages")[0]["code"], F.lit(False))
    wrong = rows.filter((F.size("languages") > 1) | ~right).select("page_id", F.explode("languages").alias("x"))
    return wrong.groupBy("page_id", F.col("x.code").alias("language_code")).agg(F.max("x.confidence").alias("confidence"))
