"""Evaluation texts leaking into training text.

Prefix-filtered set join between documents and items. Both are reduced to
tokens (case, spacing, punctuation and markup aside; each Chinese or Japanese
character is one). An item's shingles of at most ``SHINGLE`` tokens (fewer in short items, of which
longer ones might be left in no passage) are ordered by how
many documents hold them, rarest first. A passage of at least half the item's
words with at most one altered word in ten leaves a known least number of the
item's shingles intact, so every true document shares one of the item's rarest
shingles, its necessary prefix; only these are joined. The position of the
shared shingle bounds the window of the document, of the item's size, in which
the passage is then verified word by word.

Items are a stated query set: they are taken in blocks of ``BLOCK`` bytes of
text at most, each of which is a broadcast of bounded size, against all
documents. Documents with NULL text or ids, and items without words, have no
rows. Repeated rows are reported once. Texts are handled whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a shingle; the share of the item a passage has at least; one altered word in so many.
SHINGLE, LEAST_SHARE, ALTERED = 4, 0.5, 10
#: Bytes of item text in one block.
BLOCK = 16 << 20
_CJK = "぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_PLAIN, _ANY_CJK = re.compile(r"[^\W_]+"), re.compile(f"[{_CJK}]")
_CHUNK = re.compile(r"\S+")
_MARKUP = re.compile(r"\]\([^)\s]*\)|</?[A-Za-z][^<>\n]*>|&[a-z]+;")
_PASSAGE = "doc_id long, item_id long, run long, altered long, first long, last long, by_character boolean"
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def bare(text: str) -> str:
    if "](" in text or "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return text.lower()


def tokens(text: str) -> list[str]:
    text = bare(text)
    return (_PLAIN if text.isascii() or not _ANY_CJK.search(text) else _TOKEN).findall(text)


def is_by_character(text: str) -> bool:
    """Whether an item's size counts in characters: Chinese and Japanese."""
    n = len(re.findall(rf"[{_CJK}]", text))
    return n * 3 > len(tokens(text))


def units(text: str, by_character: bool) -> tuple[list[str], list[int]]:
    """Tokens, and for each the number of the word it belongs to."""
    text = bare(text)
    if by_character:
        out = [c for t in _TOKEN.findall(text) for c in t]
        return out, list(range(len(out)))
    out, of, n = [], [], 0
    for m in _CHUNK.finditer(text):
        got = _TOKEN.findall(m.group())
        if got:
            out += got
            of += [n] * len(got)
            n += 1
    return out, of


def _runs(need: int, whole: int) -> list[int]:
    """The sizes from ``need`` to ``whole`` at which fewest shingles may be left: the least, and each that allows one more alteration."""
    return [need, *range((need // ALTERED + 1) * ALTERED, whole + 1, ALTERED)]


def least_intact(words: int, shingle: int = SHINGLE) -> int:
    """Shingles of the item that any passage, altered as much as may be, leaves intact.

    An altered word of m tokens breaks at most shingle - 1 + m shingles, and its
    tokens made m more, so words may be counted for tokens. A longer run may have
    fewer left than a shorter one, where it allows one more alteration.
    """
    return min(run - shingle + 1 - shingle * (run // ALTERED) for run in _runs(-(-words // 2), words))


def least_intact_characters(sizes: list[int], shingle: int = SHINGLE) -> int:
    """The same for an item that counts in characters, whose tokens have ``sizes`` characters."""
    whole = sum(sizes)
    least = len(sizes)
    for need in _runs(-(-whole // 2), whole):
        fewest, start, inside = len(sizes), 0, 0
        for end, size in enumerate(sizes):
            inside += size
            while inside - sizes[start] >= need:
                inside -= sizes[start]
                start += 1
            if inside >= need:
                fewest = min(fewest, end - start + 1)
        least = min(least, fewest - shingle + 1 - shingle * (need // ALTERED))
    return least


def shingle_of(item: str) -> tuple[int, int]:
    """The longest shingle of which any passage of ``item`` leaves one intact at least, and how many it leaves."""
    got = tokens(item)
    sizes = [len(t) for t in got] if is_by_character(item) else None
    words = units(item, False)[1][-1] + 1 if got else 0
    for shingle in range(SHINGLE, 1, -1):
        least = least_intact_characters(sizes, shingle) if sizes else least_intact(words, shingle)
        if least > 0:
            return shingle, least
    return 1, 1


def passage(item: list[str], item_word: list[int], text: list[str], text_word: list[int]) -> tuple[int, int, int, int] | None:
    """The longest run of at least half the item's words with at most one in ten altered.

    As its words, the altered ones, and the first and last word of ``text`` it
    covers; None if there is none.
    """
    n = item_word[-1] + 1
    need, best = n * LEAST_SHARE, None
    blocks = [b for b in SequenceMatcher(None, item, text, autojunk=False).get_matching_blocks() if b.size]
    for start in range(len(blocks)):
        a = blocks[start]
        first = item_word[a.a] + (a.a > 0 and item_word[a.a - 1] == item_word[a.a])
        altered = 0
        for k in range(start, len(blocks)):
            b = blocks[k]
            if k > start:
                before = blocks[k - 1]
                i0, i1, j0, j1 = before.a + before.size, b.a, before.b + before.size, b.b
                own = item_word[i1 - 1] - item_word[i0] + 1 if i1 > i0 else 0
                other = text_word[j1 - 1] - text_word[j0] + 1 if j1 > j0 else 0
                altered += max(own, other)
                if altered * ALTERED > n:
                    break
            end = b.a + b.size
            last = item_word[end - 1] - (end < len(item) and item_word[end] == item_word[end - 1])
            run = last - first + 1
            if run >= need and altered * ALTERED <= run and (best is None or run - altered > best[0] - best[1]):
                best = (run, altered, text_word[a.b], text_word[b.b + b.size - 1])
    return best


def passages(item: list[str], item_word: list[int], text: list[str], text_word: list[int]) -> list[tuple[int, int, int, int]]:
    """The passages of the item in ``text`` as ``passage`` gives them: the longest, and those in front of and behind it.

    A copy of a similar item may hide the item's own passage next to it, so all count.
    """
    out, rest, least = [], [(0, len(text))], (item_word[-1] + 1) * LEAST_SHARE * (1 - 1 / ALTERED)
    while rest:
        start, end = rest.pop()
        # What is altered may be missing in the text.
        if end - start < least:
            continue
        hit = passage(item, item_word, text[start:end], text_word[start:end])
        if hit:
            out.append(hit)
            rest += [(start, bisect_left(text_word, hit[2], start, end)), (bisect_right(text_word, hit[3], start, end), end)]
    return out


class Index:
    """The shingles of a block of items, each of its item's length, to be looked up in documents."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, bool, list[str], list[int], int]] = []
        places = defaultdict(list)
        least: list[int] = []
        lengths: set[int] = set()
        for item_id, text in items:
            got = tokens(text)
            if not got:
                continue
            by_character = is_by_character(text)
            own, word = units(text, by_character)
            k = len(self.items)
            self.items.append((item_id, by_character, own, word, len(got)))
            shingle, intact = shingle_of(text)
            lengths.add(shingle)
            least.append(intact)
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in got], np.uint64)
            for pos, h in enumerate(self._hash(ids, shingle).tolist()):
                places[h].append((k, pos))
        self.lengths = sorted(lengths)
        self.hashes = np.array(sorted(places), np.uint64)
        flat = [places[h] for h in self.hashes.tolist()]
        self.start = np.cumsum([0, *map(len, flat)])
        self.item_of = np.array([k for x in flat for k, _ in x], np.int64)
        self.place = np.array([pos for x in flat for _, pos in x], np.int64)
        self.in_prefix = np.ones(len(self.place), bool)
        self.least = np.array(least, np.int64)

    @staticmethod
    def _hash(ids: np.ndarray, shingle: int) -> np.ndarray:
        n = max(0, len(ids) - shingle + 1)
        h = np.full(n, shingle, np.uint64)
        for j in range(shingle):
            h += ids[j : j + n] * _P[j]
        return h ^ (h >> np.uint64(31))

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """Of all texts: the text, the position and the number of each shingle of the index found."""
        got = [tokens(t) for t in texts]
        get = self.vocabulary.get
        flat: list[int] = []
        for t in got:
            flat += [get(w, 0) for w in t]
            flat += [0] * SHINGLE
        ids = np.array(flat, np.uint64)
        none = np.zeros(0, int)
        if not len(ids) or not len(self.hashes):
            return none, none, none, got
        lengths = np.array([len(t) + SHINGLE for t in got])
        starts = np.cumsum(lengths) - lengths
        every = []
        for shingle in self.lengths:
            h = self._hash(ids, shingle)
            known = ids[: len(h)] > 0
            for j in range(1, shingle):
                known &= ids[j : j + len(h)] > 0
            at = np.nonzero(known)[0]
            found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            ok = self.hashes[found] == h[at]
            every.append((at[ok], found[ok]))
        at, found = (np.concatenate(x) for x in zip(*every, strict=True))
        doc = np.searchsorted(starts, at, side="right") - 1
        return doc, at - starts[doc], found, got

    def prefixes(self, frequency: dict[int, int]) -> None:
        """Marks of each item the places of its rarest shingles, one of which a true document can't miss."""
        rarity = np.repeat([frequency.get(s, 0) for s in range(len(self.hashes))], np.diff(self.start))
        order = np.lexsort((self.place, rarity, self.item_of))
        owner = self.item_of[order]
        count = np.bincount(owner, minlength=len(self.items))
        rank = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        self.in_prefix = np.zeros(len(owner), bool)
        self.in_prefix[order] = rank < (count - self.least + 1)[owner]

    def candidates(self, doc: np.ndarray, position: np.ndarray, found: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """For each (text, item) that shares a prefix shingle and enough shingles in all, the diagonals of the prefix shingles."""
        n = self.start[found + 1] - self.start[found]
        which = np.repeat(np.arange(len(found)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.start[found][which]
        d, k, place, diagonal = doc[which], self.item_of[at], self.place[at], position[which] - self.place[at]
        key = d * max(1, len(self.items)) + k
        hit = np.isin(key, np.unique(key[self.in_prefix[at]]))
        key, place, diagonal, first, k = key[hit], place[hit], diagonal[hit], self.in_prefix[at][hit], k[hit]
        # Of each pair the places of the item that are intact somewhere in the text: fewer than the least can't be a passage.
        width = int(self.place.max(initial=0)) + 1
        distinct = np.unique(key * width + place) // width
        pairs, intact = np.unique(distinct, return_counts=True)
        enough = pairs[intact >= self.least[pairs % max(1, len(self.items))]]
        keep = first & np.isin(key, enough)
        seen: dict[tuple[int, int], set[int]] = defaultdict(set)
        for x, g in zip(key[keep].tolist(), diagonal[keep].tolist(), strict=True):
            seen[divmod(x, len(self.items))].add(g)
        return seen


def _shingle_counts(documents: DataFrame, index: Index) -> dict[int, int]:
    """How many documents hold each shingle of the index; at most as many rows as the bounded index has."""
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        total = np.zeros(len(own.hashes), np.int64)
        for b in batches:
            doc, _, found, _ = own.hits([x for x in b["text"] if isinstance(x, str)])
            pairs = np.unique(doc.astype(np.int64) * max(1, len(own.hashes)) + found)
            total += np.bincount(pairs % max(1, len(own.hashes)), minlength=len(total)) if len(total) else 0
        s = np.nonzero(total)[0]
        yield pd.DataFrame({"s": s, "n": total[s]})

    counts = documents.select("text").mapInPandas(of, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {r["s"]: r["n"] for r in counts.collect()}


def _verified(documents: DataFrame, index: Index) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            b = b[b["text"].map(lambda x: isinstance(x, str))]
            texts = list(b["text"])
            doc, position, found, got = own.hits(texts)
            seen = own.candidates(doc, position, found)
            rows = []
            ids = b["doc_id"].to_numpy()
            # Of texts with candidates: the word of each token, the place of each token's first character.
            words_of: dict[int, list[int]] = {}
            starts_of: dict[int, np.ndarray] = {}
            for (d, k), diagonals in seen.items():
                item_id, by_character, item, word, size = own.items[k]
                # Windows of the item's size and the alterations it may have, one for each run of near diagonals.
                slack = size // 5 + 8
                order = sorted(diagonals)
                groups = [[order[0], order[0]]]
                for x in order[1:]:
                    if x - groups[-1][1] <= slack:
                        groups[-1][1] = x
                    else:
                        groups.append([x, x])
                for low, high in groups:
                    first, last = max(0, low - slack), high + size + slack
                    part = got[d][first:last]
                    if by_character:
                        if d not in starts_of:
                            starts_of[d] = np.cumsum([0, *map(len, got[d])])
                        base = int(starts_of[d][first])
                        part = [c for t in part for c in t]
                        where = list(range(base, base + len(part)))
                    else:
                        if d not in words_of:
                            words_of[d] = units(texts[d], False)[1]
                        where = words_of[d][first:last]
                    rows += [(ids[d], item_id, *hit, by_character) for hit in passages(item, word, part, where)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "altered", "first", "last", "by_character"]).astype({c: "int64" for c in ("doc_id", "item_id", "run", "altered", "first", "last")} | {"by_character": bool})

    return documents.select("doc_id", "text").mapInPandas(of, _PASSAGE)


def blocks(items: DataFrame, most: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of at most ``most`` bytes of text; one longer item is a block of its own."""
    block, size = [], 0
    for r in items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator():
        n = len(r["text"].encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, most: int = BLOCK) -> DataFrame:
    """(doc_id, item_id): the documents (doc_id, text) that hold a passage of an item (item_id, text)."""
    out = documents.sparkSession.createDataFrame([], _PASSAGE)
    documents = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    for block in blocks(items, most):
        index = Index(block)
        index.prefixes(_shingle_counts(documents, index))
        out = out.unionByName(_verified(documents, index))
    # Items built alike share runs: a passage goes to the item of which it is the better copy.
    found = out.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "run", "altered", "first", "last", "by_character")).alias("p"))
    better = """filter(p, x -> NOT exists(p, y -> y.item_id != x.item_id AND y.by_character = x.by_character AND y.altered < x.altered AND y.run >= x.run
        AND 2 * (least(x.last, y.last) - greatest(x.first, y.first) + 1) > x.last - x.first + 1))"""
    return found.select("doc_id", F.explode(F.expr(better)).alias("x")).select("doc_id", F.col("x.item_id").alias("item_id")).distinct()
