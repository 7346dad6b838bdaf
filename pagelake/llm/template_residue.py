"""Template residue and error-page text.

Two kinds of evidence, both from aligning records made of one template:

* Slots. Pieces of titles and articles that symbols or underscores enclose, or
  that a default word opens, are records. Records of one shape (the same symbols and as many
  words) are aligned position by position: a word that several hosts have at a
  position is the template's, the others fill a slot. A template that repeats on
  several hosts, begins and ends with its own parts and whose slots hold ever
  new names keeps variables where values belong: its records were never filled. A
  template without slots is a default if a default word (``object``, ``TBD``)
  stands in it. No form of placeholder is listed anywhere. Paragraphs of filler words are the default of a text slot.
* Whole-page templates. Short articles are aligned line by line: words that few
  hosts share are slots, the others the template. A page all of whose lines are
  lines of templates that repeat over several hosts is an error, access,
  maintenance or scripts-needed page.

A record of a stored template whose slots are blank (``{{ }}``, ``[Your  name]``) is one that was never filled, too.

Templates of both kinds learned by the same alignment from a bounded sample
(``train_templates``) are stored in ``models``, so that small inputs behave as large ones; templates not among
them are induced from the pages at hand. Lines of known templates make a message of any
length; to be induced, a message must be bare (``MOST_CHARS``), since longer text that
repeats on several hosts is a copied article.

Only the title and the article count, without code: pages that write about
placeholders show them in code. Markdown, HTML, wiki and LaTeX syntax is taken off first.
NULL titles or markdown count as empty; an
empty article is no case. Rows with a NULL id are left out. Repeated pages are reported once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.llm import markup
from pagelake.llm.boilerplate import split_batch
from pagelake.llm.markup import without_code
from pagelake.session import cut

MODELS = Path(__file__).parent / "models"
TEMPLATES, SLOTS = MODELS / "page_templates.json", MODELS / "slot_templates.json"
#: An article of more characters is no bare message; those beyond U+0E00, of scripts that say more in less, count three times.
MOST_CHARS = 260
_WIDE = re.compile("[\u0e00-\uffdc]")
#: A template holds on at least so many pages of so many hosts; a word of it on so many hosts; a slot has so many fillings.
LEAST_PAGES, LEAST_HOSTS, LEAST_FILLINGS = 4, 3, 3
# Words that stand for a value that is missing.
_DEFAULT = frozenset("todo fixme tbd object undefined null nan none placeholder coming soon dummy lorem".split())
_OPENS = r"\b(?:TODO|FIXME):[ \t]*\w+[ \t]+\w+|\bTBD\b|(?im:^[ \t]*(?:coming soon|to be (?:done|written|determined)|placeholder text|text goes here)[ .!…]*$)"
_D = r"{}\[\]<>%$#@~\\"
#: A record: something enclosed by symbols, or an identifier of three parts and more, or what a default word opens.
_RECORD = re.compile(rf"[{{<%@$#]{{2,}}[ \t]*[}}>%@]{{1,2}}|[{_D}]+[ \t]?[^\s{_D}][^\n{_D}]{{0,79}}?[{_D}]+|(?<![^\W_])[^\W_]+(?:_+[^\W_]+){{2,}}(?![^\W_])|__[^\W_]\w*__|{_OPENS}")
_SINGLE = "%$#@~\\<>"
_PART = re.compile(r"[^\W_]+|_+|[^\w\s]+")
_MARKS = re.compile(r"^[ \t]*(?:#{1,6}[ \t]+|(?:=+|-+)[ \t]*$)", re.M)
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*[^)]*\)")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*")
_CODE = re.compile(r"<(code|pre|tt|kbd|samp)\b[^>]*>[\s\S]*?</\1>|\{(noformat|code)[^}\n]*\}[\s\S]*?\{\2\}")
_WORD = re.compile(r"\w+")
# Words of filler text.
_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate "
    "velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est "
    "laborum foo bar baz qux blah text copy dummy content goes here sample xxx placeholder filler asdf".split()
)


def is_filler(text: str) -> bool:
    """Whether some paragraph of ``text`` is nearly all filler words."""
    if len(_FILLER.intersection(text.lower().split())) < 3:
        return False
    for line in text.split("\n"):
        if len(line) < 20:
            continue
        words = _WORD.findall(line)
        n = sum(1 for w in words if w.lower() in _FILLER)
        if n >= 5 and n >= 0.75 * len(words) and len({w.lower() for w in words}) >= 3:
            return True
    return False


def without_syntax(text: str) -> str:
    """``text`` (without code) without what Markdown, HTML, wiki and LaTeX put in symbols."""
    if "#" in text or "=" in text or "--" in text:
        text = _MARKS.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "$" in text:
        text = markup.FORMULA.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    if "<" in text:
        text = markup.TAG.sub(lambda m: " " if markup.is_html(m) else m.group(), text)
    if any(x in text for x in ("[[", "__", "{|", "{{", "==", "{panel", "{quote")):
        text = markup.WIKI.sub(" ", text)
    return text


def records(text: str) -> list[list[str]]:
    """The parts (words, underscores, runs of symbols) of each record of ``text``, which has no code."""
    out = []
    for m in _RECORD.finditer(without_syntax(text)):
        whole = m.group()
        # One symbol with a blank behind it encloses nothing: it separates.
        if whole[0] in _SINGLE and (whole[1:2] == " " or whole[-2:-1] == " "):
            continue
        parts = _PART.findall(whole)
        if len(parts) > 1 or parts[0].lower() in _DEFAULT or not parts[0][0].isalnum():
            out.append(parts)
    return out


def shape(parts: list[str]) -> str:
    """What records must share to be aligned: the symbols, and how many words stand between them."""
    return " ".join("w" if x[0].isalnum() else x for x in parts)


def keeps_default(template: list[str | None]) -> bool:
    """Whether a template (None for a slot) that repeats was never filled: it encloses slots, or is a default word.

    It encloses if it begins and ends with its own parts, which are brackets of one kind, the same symbols, or words joined on by underscores.
    Single brackets and underscores, which also stand in plain text, need a word of the template's in them.
    """
    if not _DEFAULT.isdisjoint(x.lower() for x in template if x):
        return True
    first, last = template[0], template[-1]
    if None not in template or first is None or last is None:
        return False
    worded = any(x and x[0].isalnum() for x in template)
    if first[0].isalnum():
        return first == last and template[1][:1] == template[-2][:1] == "_" if template[1] and template[-2] else False
    if any(a in first and b in last for a, b in ("{}", "[]", "<>")):
        return len(first) > 1 or worded
    return first == last and first[0] not in "<>\\~" and (first[0] != "_" or worded)


@lru_cache(maxsize=1)
def slot_templates() -> dict[str, list[list[str | None]]]:
    """The stored templates by their shape."""
    out: dict[str, list[list[str | None]]] = {}
    for t in json.loads(SLOTS.read_text()) if SLOTS.exists() else []:
        out.setdefault(shape([x or "w" for x in t]), []).append(t)
    return out


@lru_cache(maxsize=1)
def blank_records() -> frozenset[str]:
    """The stored templates with slots as records look whose slots are blank."""
    return frozenset("".join(x for x in t if x) for group in slot_templates().values() for t in group if None in t)


@lru_cache(maxsize=1)
def enclosures() -> frozenset[tuple[str, str]]:
    """The symbols, two and more, that enclose the stored templates' slots: whatever they enclose is one slot."""
    return frozenset((t[0], t[-1]) for group in slot_templates().values() for t in group if t[0] and t[-1] and len(t[0]) > 1 and not t[0][0].isalnum())


def is_unfilled(parts: list[str]) -> bool:
    """Whether a record is of a stored template, its slots holding names or nothing, or enclosed as one."""
    if (parts[0], parts[-1]) in enclosures():
        return True
    if any(all(t is None or t == x for x, t in zip(parts, template, strict=True)) for template in slot_templates().get(shape(parts), ())):
        return True
    return "".join(parts) in blank_records()


def message_lines(text: str) -> list[list[str]]:
    """The words of each line of an article but its headings."""
    lines, before = [], None
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            continue
        if re.fullmatch(r"=+|-+", bare):
            if lines and before is not None:
                lines.pop()
            continue
        before = bare
        words = [w.lower() for w in _WORD.findall(re.sub(r"\]\([^)\s]*\)", "]", bare))]
        if not bare.startswith("#") and words:
            lines.append(words)
    return lines


@lru_cache(maxsize=1)
def templates() -> list[frozenset[str]]:
    return [frozenset(x) for x in json.loads(TEMPLATES.read_text())] if TEMPLATES.exists() else []


def is_known(line: list[str], known: list[frozenset[str]]) -> bool:
    words = frozenset(line)
    return any(t <= words and len(words) - len(t) <= 5 for t in known)


def is_bare(text: str) -> bool:
    """Whether an article is short enough for a message whose template isn't known."""
    return len(text) <= 4 * MOST_CHARS and len(text.strip()) + 2 * len(_WIDE.findall(text)) <= MOST_CHARS


def examine(article: str, title: str | None, bare: str | None = None) -> tuple[bool, list[list[str]], list[list[str]]]:
    """Whether records of known templates, filler or a known page template show a case; else the lines of a bare article and the records left to align.

    ``bare`` is the article without code, if the caller has it.
    """
    text = without_code(article) if bare is None else bare
    if "<" in text or "{" in text:
        text = _CODE.sub(" ", text)
    named = without_code(title, " ") if title else ""
    if is_filler(text) or is_filler(named):
        return True, [], []
    found = records(text) + (records(named) if named else [])
    if any(map(is_unfilled, found)):
        return True, [], []
    if text.strip() == article.replace("\r\n", "\n").strip():
        lines = message_lines(text)
        page = templates()
        if lines and all(is_known(x, page) for x in lines):
            return True, [], []
        return False, lines if is_bare(text) else [], found
    return False, [], found


EXAMINED = "hit boolean, lines array<array<string>>, records array<array<string>>"


def examined(pages: DataFrame) -> DataFrame:
    """(page_id, host, hit, lines, records) of ``pages`` (page_id, url, title, markdown)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = lambda c: [x if isinstance(x, str) else None for x in b[c]]
            got = [examine(a, t) for (_, a), t in zip(split_batch(text("markdown"), text("url")), text("title"), strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "host": b["host"], **{c: [g[k] for g in got] for k, c in enumerate(("hit", "lines", "records"))}})

    rows = pages.select("page_id", "url", "title", "markdown", urls.host(F.col("url")).alias("host")).filter("page_id IS NOT NULL")
    return rows.mapInPandas(of, f"page_id long, host string, {EXAMINED}")


def slot_alignment(rows: DataFrame) -> DataFrame:
    """(page_id, host, template, parts): each record of ``examined`` pages with the template it aligns to, slots NULL.

    Records of one shape are aligned; a part that ``LEAST_HOSTS`` hosts have at a position is the template's.
    """
    found = rows.filter("NOT hit AND size(records) > 0").select("page_id", "host", F.explode("records").alias("parts")).distinct()
    word = "CASE WHEN p rlike '^[^\\\\W_]' THEN 'w' ELSE p END"
    found = found.withColumn("shape", F.expr(f"array_join(transform(parts, p -> {word}), ' ')"))
    at = found.select("shape", "host", F.posexplode("parts").alias("n", "part")).distinct()
    fixed = at.groupBy("shape", "n", "part").agg(F.count("host").alias("hosts")).filter(F.col("hosts") >= LEAST_HOSTS).select("shape", "n", "part")
    key = ["page_id", "host", "shape", "parts"]
    held = found.select(*key, F.posexplode("parts").alias("n", "part")).join(fixed.withColumn("own", F.lit(True)), ["shape", "n", "part"], "left")
    aligned = held.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("own"), F.col("part")).alias("part")))).alias("t"))
    return aligned.select("page_id", "host", F.expr("transform(t, x -> x.part)").alias("template"), "parts")


def unfilled(rows: DataFrame) -> DataFrame:
    """(template): the slot templates induced from ``examined`` pages whose records were never filled."""
    filling = F.expr("array_join(filter(transform(template, (t, i) -> CASE WHEN t IS NULL THEN parts[i] END), x -> x IS NOT NULL), ' ')")
    groups = slot_alignment(rows).groupBy("template").agg(
        F.count_distinct("page_id").alias("pages"), F.count_distinct("host").alias("hosts"), F.count_distinct(filling).alias("fillings")
    )
    groups = groups.filter((F.col("pages") >= LEAST_PAGES) & (F.col("hosts") >= LEAST_HOSTS))
    groups = groups.filter(f"NOT exists(template, t -> t IS NULL) OR fillings >= {LEAST_FILLINGS}").select("template")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[keeps_default(list(t)) for t in b["template"]]]

    return groups.mapInPandas(of, groups.schema)


def residue_slots(rows: DataFrame) -> DataFrame:
    """(page_id) of ``examined`` pages with a record of an induced template that was never filled."""
    key = lambda df: df.withColumn("_k", F.xxhash64(F.to_json("template", {"ignoreNullFields": "false"})))
    return key(slot_alignment(rows)).join(key(unfilled(rows)).select("_k"), "_k", "left_semi").select("page_id").distinct()


def induced(rows: DataFrame) -> DataFrame:
    """(page_id) of ``examined`` pages, all of whose lines are lines of templates induced from these pages.

    A line's template is its words that stand in short articles of at least
    ``LEAST_HOSTS`` hosts; most of the line must be template.
    """
    lines = rows.filter("NOT hit AND size(lines) > 0").select("page_id", "host", F.posexplode("lines").alias("n", "words")).distinct()
    words = lines.select("page_id", "n", "host", F.explode(F.array_distinct("words")).alias("word"))
    pairs = words.select("word", "host").distinct()
    shared = pairs.groupBy("word").count().filter(F.col("count") >= LEAST_HOSTS).select("word")
    fixed = words.join(shared, "word").groupBy("page_id", "n", "host").agg(F.array_sort(F.collect_set("word")).alias("template"))
    sizes = lines.select("page_id", "n", F.size(F.array_distinct("words")).alias("size"))
    fixed = fixed.join(sizes, ["page_id", "n"]).filter("size(template) >= 3 AND 2 * size(template) >= size")
    by_host = fixed.groupBy("template", "host").agg(F.count_distinct("page_id").alias("pages"))
    good = by_host.groupBy("template").agg(F.sum("pages").alias("pages"), F.count("host").alias("hosts"))
    good = good.filter((F.col("pages") >= LEAST_PAGES) & (F.col("hosts") >= LEAST_HOSTS)).select("template")
    hits = fixed.join(good, "template", "left_semi").groupBy("page_id").agg(F.count_distinct("n").alias("hits"))
    total = lines.groupBy("page_id").agg(F.count_distinct("n").alias("total"))
    return hits.join(total, "page_id").filter("hits = total").select("page_id")


def residue_pages(pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(page_id) of the pages that hold residue or are nothing but an error message."""
    rows = cut(examined(pages).filter("hit OR size(lines) > 0 OR size(records) > 0")) if rows is None else rows
    return rows.filter("hit").select("page_id").unionByName(induced(rows)).unionByName(residue_slots(rows)).distinct()
