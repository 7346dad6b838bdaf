"""Sentence boundaries across languages and scripts.

A document is cut into blocks: fenced code, headings, list items, quoted lines
and indented code are one unit each; paragraphs are segmented. At each stop
(with the closing quotes and brackets behind it) cascading rule tables decide:
the tables of the languages written in the paragraph's script, then the common
one; each rule is a pair of regular expressions for the text before and behind
the position, and the first rule that matches says break or no break. Languages
aren't taken from a label, which may be wrong. In Thai a blank between two Thai
letters divides, as Thai has no stops.

Offsets count code points from 0 and stand just behind the last character of a
unit. NULL and blank texts have no units; rows
with a NULL id are left out. Texts are handled whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_STOP = re.compile(r"[.!?…؟۔।॥。！？｡]+(?:[   ]?»|[\"'”’“」』）)\]*_»›]+)*")
_LETTER = r"[^\W\d_]"


def _abbreviations(words: str, after: str = r"\s*\S") -> tuple[bool, re.Pattern[str], re.Pattern[str]]:
    """A no-break rule for words that a stop shortens, if ``after`` follows."""
    return False, re.compile(rf"(?:^|[^\w.]|(?<=[^\w]))(?:{'|'.join(map(re.escape, words.split()))})\.$"), re.compile(after)


def _rule(breaks: bool, before: str, after: str) -> tuple[bool, re.Pattern[str], re.Pattern[str]]:
    return breaks, re.compile(before), re.compile(after)


_NUMBER = r"\s*[0-9(]"
# Abbreviations and months by language. Those that may also end a sentence ask for a number behind them.
LATIN = [
    # English
    _abbreviations("Dr Mr Mrs Ms Prof St Rev Gen Capt Lt Sgt Hon Messrs vs e.g i.e cf approx resp viz al"),
    _abbreviations("Fig Figs Sec Secs No Nos Eq Eqs Ch Vol Art pp Ref fig sec eq", _NUMBER),
    # German
    _abbreviations("bzw vgl z z.B u u.a d d.h ca Nr Abb Tab Kap Abs evtl ggf inkl sog Hr Fr Str o", r"\s*\S"),
    _rule(False, r"\bz\.\s?B\.$", r"\s*\S"),
    _rule(False, r"(?:^|\D)[0-9]{1,2}\.$", r"\s*(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert)\b"),
    # French
    _abbreviations("M MM Mme Mlle env fig p art chap éd"),
    # Spanish, Portuguese
    _abbreviations("Sr Sra Srta Dra D Dña aprox fig figs pág págs núm Ud Uds p.ej Exmo Av"),
    # Dutch
    _abbreviations("bijv ca afb dhr mevr blz nr enz o.a m.b.t drs ir"),
    # Polish
    _abbreviations("np zob rys ok tzw tj ul dr mgr inż prof por str godz ww"),
    _abbreviations("p", r"\s*[A-ZŁŚŻĆŹÓ]"),
    # Turkish
    _abbreviations("bkz şek örn vb Dr Doç Av Sn yy", r"\s*\S"),
]
CYRILLIC = [_abbreviations("т е к д ок см рис г гг стр напр др проф табл п ул им руб тыс млн т.е т.к"), _rule(False, r"\bт\.\s?[екдп]\.$", r"\s*\S")]
INDIC = [_abbreviations("डॉ श्री सुश्री प्रो क्र सं चि")]
ARABIC = [_abbreviations("د أ م ص ج ت")]
CJK = [
    # A quoted sentence goes on: 「…？」と, “…？”然后.
    _rule(False, r"[。！？!?…][」』”’）)]+$", r"\s*[^\s「『“]"),
    _rule(True, r"[。！？｡][」』”’）)]*$", r""),
    _rule(True, r"[!?]$", r""),
]
COMMON = [
    # Within numbers, names of files and options, addresses.
    _rule(False, r"\.$", r"[a-zß-öø-ÿ0-9_/@\\-]|\.\w"),
    _rule(False, r"(?:^|[^\w])[A-Z]\.$", r"[A-Z]|\s*[A-Z]\."),
    # Inside or just behind something longer.
    _rule(False, r"", r"\s*[,;:،؛、)\]—–»]|\s+-\s"),
    _rule(False, r"[.!?…][\"'”’“»›)\]*_\s]*$", r"\s*[*_]*[a-zß-öø-ÿāăąćčďđēęěğīıłńňœřśşšťūůźżžа-яё]"),
    # An initial before a name.
    _rule(False, r"(?:^|[\s(\"'«„“])[A-ZÄÖÜÉÇŞŁА-Я]\.$", r"\s+[A-ZÄÖÜÉÇŞŁА-Я]"),
    _rule(True, r"", r"\s"),
    # A blank left out between two sentences.
    _rule(True, rf"(?:{_LETTER}|[0-9)`\"”»])(?:[.!?…؟।])+[\"'”’“»)]*$", rf"(?:[A-ZÀ-ÖØ-ÞĀ-ſА-ЯЁ`\"«¿¡„“(]|(?![A-Za-z]){_LETTER})"),
    _rule(True, r"[!?؟।॥۔][\"'”’»]*$", r"\S"),
    _rule(False, r"", r""),
]
#: For text in capitals only or without any: letter case says nothing, so only numbers and quotes that go on keep a stop from breaking.
CASELESS = [
    _rule(False, r"\.$", r"[a-z0-9_/@\\-]|\.\w"),
    _rule(False, r"", r"\s*[,;:،؛、)\]—–»]|\s+-\s"),
    _rule(False, r"[\"'”’“»›][)\]]*$|\.\.\.$", r"\s*[*_]*[^\W\d_]"),
    _rule(False, r"(?:^|[^\w])[^\W\d_]\.$", r"\s*\S"),
    _rule(False, r"(?:^|[^\w])(?:[^\W\d_]\.)+$", r"\s*[*_]*[^\W\d_]"),
    _rule(False, r"\b(?:inc|ltd|co|corp)\.$", r"\s"),
    _rule(True, r"", r"\s"),
]
_THAI, _CJK = re.compile("[ก-๛]"), re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_CYRILLIC, _INDIC, _ARABIC = re.compile("[Ѐ-ӿ]"), re.compile("[ऀ-෿]"), re.compile("[؀-ۿ]")
_THAI_BLANK = re.compile("(?<=[ก-๛])[ \t\r\n ]+(?=[ก-๛])")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t\r]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|([0-9]{1,9})[.)])(?:[ \t]|$)")
_CODE = re.compile("`[^`]*`")


def _tables(text: str) -> list[tuple[bool, re.Pattern[str], re.Pattern[str]]]:
    """The cascade for a paragraph: the tables of the scripts in it, then the common rules."""
    caseless = text.islower() or text.isupper()
    if text.isascii() and not caseless:
        return _CASCADE[""]
    key = "x" if caseless else ""
    if _CJK.search(text):
        key += "j"
    if _CYRILLIC.search(text):
        key += "c"
    if _INDIC.search(text):
        key += "i"
    if _ARABIC.search(text):
        key += "a"
    if key not in _CASCADE:
        own = [r for k, t in (("j", CJK), ("c", CYRILLIC), ("i", INDIC), ("a", ARABIC)) if k in key for r in t]
        _CASCADE[key] = [(x, re.compile(b.pattern, re.I), a) for x, b, a in own + LATIN] + CASELESS if caseless else own + LATIN + COMMON
    return _CASCADE[key]


_CASCADE = {"": LATIN + COMMON}


def paragraph_ends(text: str) -> list[int]:
    """Offsets just behind each sentence of one paragraph."""
    ends: list[int] = []
    stop_at = len(text.rstrip())
    if not stop_at:
        return ends
    rules = _tables(text)
    # Stops in inline code are no stops: code is blotted out in the copy that is searched.
    seen = _CODE.sub(lambda m: "`" + "x" * (len(m.group()) - 2) + "`", text) if "`" in text else text
    for m in _STOP.finditer(seen):
        at = m.end()
        mark = seen.find('"', m.start(), at)
        if mark >= 0 and seen.count('"', 0, mark) % 2 == 0:
            at = mark  # a quote that opens, with the blank before it left out
        mark = seen.find("“", m.start(), at)
        if mark >= 0 and seen.rfind("„", 0, mark) <= seen.rfind("“", 0, mark):
            at = mark
        if at >= stop_at:
            break
        window = seen[max(0, at - 32) : at]
        for breaks, before, after in rules:
            if after.match(seen, at) and before.search(window):
                if breaks:
                    ends.append(at)
                break
    thai = _THAI.search(text)
    if thai:
        ends = sorted({*ends, *(m.start() for m in _THAI_BLANK.finditer(seen))})
    ends.append(stop_at)
    return ends


def sentence_ends(text: str | None) -> list[int]:  # noqa: C901
    """Offsets just behind each unit of a document."""
    if not text:
        return []
    ends: list[int] = []
    at, open_at, open_end, kind, fence = 0, -1, -1, "", ""

    def close() -> None:
        nonlocal open_at
        if open_at >= 0:
            if kind == "p":
                ends.extend(open_at + e for e in paragraph_ends(text[open_at:open_end]))
            else:
                ends.append(open_end)
            open_at = -1

    blank, number = True, -1
    for line in text.split("\n"):
        bare = line.rstrip()
        end = at + len(bare)
        start = at
        at += len(line) + 1
        if fence:
            if bare:
                open_end = end
            m = _FENCE.match(line)
            if m and m[1].startswith(fence) and not bare.strip(" " + fence[0]):
                fence = ""
                close()
            continue
        if not bare:
            close()
            blank = True
            continue
        first = bare.lstrip()[0]
        if first in "`~" and (m := _FENCE.match(line)) and (first == "~" or "`" not in bare[m.end() :]):
            close()
            open_at, open_end, kind, fence = start, end, "u", m[1]
        elif (first == "#" and _HEADING.match(line)) or first == ">":
            close()
            ends.append(end)
        elif first in "-*+0123456789" and (m := _ITEM.match(line)) and (blank or open_at < 0 or first in "-*+" or (kind == "i" and int(m[1]) == number + 1)):
            close()
            number = int(m[1] or -1)
            open_at, open_end, kind = start, end, "i"
        elif open_at >= 0 and kind in "pi":
            if kind == "p" and re.fullmatch(r" {0,3}(?:=+|-+)", bare):
                kind = "u"
            open_end = end
        elif blank and line.startswith(("    ", "\t")):
            open_at, open_end, kind = start, end, "u"
        elif open_at >= 0:
            open_end = end
        else:
            open_at, open_end, kind = start, end, "p"
        blank = False
    close()
    return ends


def split_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_no, sent_start, sent_end, sentence) of ``documents`` (doc_id, text); repeated rows repeat."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, nos, starts, stops, texts = [], [], [], [], []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                begin = 0
                for n, e in enumerate(sentence_ends(t) if isinstance(t, str) else (), 1):
                    part = t[begin:e]
                    s = e - len(part.lstrip())
                    ids.append(i), nos.append(n), starts.append(s), stops.append(e), texts.append(t[s:e])
                    begin = e
            yield pd.DataFrame({"doc_id": ids, "sent_no": nos, "sent_start": starts, "sent_end": stops, "sentence": texts}).astype({"sentence": object})

    return documents.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInPandas(of, "doc_id long, sent_no int, sent_start long, sent_end long, sentence string")


def sentence_offsets(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_end) of ``documents`` (doc_id, text), whose doc_id is unique."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sentence_ends(t) if isinstance(t, str) else [] for t in b["text"]]
            n = [len(x) for x in got]
            yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy(), n), "sent_end": np.fromiter((e for x in got for e in x), np.int64, sum(n))})

    return documents.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInPandas(of, "doc_id long, sent_end long")
