"""Deduplicating new batches against all history.

``HashForest`` keeps the articles accepted so far under one folder that any later
session can open again: ``TREES`` sorted permutations of a min-hash signature.
A permutation's label is ``DEPTH`` values of the signature, one byte each, as
one number; entries sorted by label are a prefix tree, in which the entries that
share a prefix are one range. The sorted entries are kept as leaves, rows of at
most ``LEAF`` entries of one tree and one slot (the label's top bits), packed as
sorted arrays. ``add`` signs the pages of a new batch only, writes them as a run
of their own and looks up each of its articles by binary search in the leaves
of all runs; no page and no token of an earlier batch is read but those of
candidates. The prefix starts as the whole label and is widened until
``TREES`` trees find an article at the least similarity a repeat of its size
can have with the recall asked for. ``merge`` makes one run of runs.

Features are pairs of neighbouring tokens, each line taken as a ring, so that
paragraphs may move; a pair that an article repeats counts as often. Tokens are
words; each Chinese, Japanese or Thai character (marks included) is one.
Candidates whose sizes or token histograms differ too much for a tenth are
dropped, as they can't be repeats; the others are verified on their whole token
lists: at most a tenth may be changed, added or dropped, wherever it stands.

Hot groups: exact copies (equal up to the order of lines) are folded into their
earliest page before anything is indexed. In a range of more than ``DENSE``
entries an article is compared with the earliest first, and with the others
below its answer only where that doesn't settle it. Nothing is capped: these
comparisons are streamed, and leaves stay bounded rows however hot a label is.

Pages without an article have no signature and take no part. NULL markdown
counts as empty; NULL ids are dropped; repeated rows count once; an empty batch
adds nothing. A run that breaks off isn't in the manifest and so doesn't exist.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.boilerplate import split_batch
from pagelake.llm.contamination import _CJK, bare
from pagelake.operators.incremental import Pointer
from pagelake.session import cut, shared_dir

VALUES, TREES, DEPTH, SHINGLE = 168, 48, 8, 2
#: Share of tokens that may differ; the recall asked for at the least similarity that leaves.
MOST_CHANGED, RECALL = 0.1, 0.98
#: Entries of a leaf; slots of a tree; entries of a range beyond which its earliest is tried first; classes of a token histogram.
LEAF, SLOTS, DENSE, CLASSES = 1 << 14, 16, 48, 64
#: A batch of so many leaves' worth of texts is broadcast (at most 80 MB); a larger one is joined by a shuffle.
SMALL = 4 * LEAF
#: Shingles hashed at a time, so that they stay in the processor's cache.
_BLOCK = 1 << 15
#: Thai letters, vowel and tone marks and digits: pages in Thai count in characters too.
_THAI = "ก-ฺเ-๎๐-๙"
_SEEDS = np.random.default_rng(20).integers(1, 2**32, (2, VALUES), dtype=np.uint32) | np.uint32(1)
_SIGNED = "page_id long, copy binary, size int, tokens binary, histogram binary, signature binary"
_LEAVES = "tree int, slot int, asking boolean, low long, high long, labels binary, ids binary, sizes binary, run int"


def _orders() -> np.ndarray:
    """Which values make each tree's label: the first six of neighbouring trees are disjoint, so that trees err independently."""
    rng, own, out = np.random.default_rng(5), 6, []
    while len(out) < TREES:
        whole = rng.permutation(VALUES)
        for at in range(0, VALUES - own + 1, own):
            first = whole[at : at + own]
            out.append(np.concatenate([first, rng.permutation(np.setdiff1d(np.arange(VALUES), first))[: DEPTH - own]]))
    return np.array(out[:TREES])


_ORDERS = _orders()


def least_similarity(size: int | np.ndarray, most_changed: float = MOST_CHANGED) -> np.ndarray:
    """The least similarity of shingles between an article of ``size`` tokens and a repeat of it.

    There are as many shingles as tokens and each token is in SHINGLE of them;
    changes are whole tokens, a tenth of the longer article at most.
    """
    size = np.asarray(size, float)
    lost = SHINGLE * np.floor(most_changed * np.floor(size / (1 - most_changed) + 1e-9) + 1e-9)
    return np.maximum(0.0, (size - lost) / np.maximum(size + lost, 1))


def prefix_length(similarity: float | np.ndarray, recall: float = RECALL, trees: int = TREES) -> np.ndarray:
    """The longest prefix with which ``trees`` trees find a pair of ``similarity`` with probability ``recall``; at least one value."""
    depths = np.arange(1, DEPTH + 1)
    reached = 1 - (1 - np.asarray(similarity, float)[..., None] ** depths) ** trees >= recall
    return np.maximum(1, (reached * depths).max(-1))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point 1 if it belongs to words, 2 if it is a token of its own, else 0."""
    table = np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.uint8, 0x110000)
    for first, last in re.findall("(.)-(.)", _CJK + _THAI):
        table[ord(first) : ord(last) + 1] = 2
    return table


@lru_cache(maxsize=4)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    powers = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(length, x, np.uint64)]))
    return powers(base), powers(pow(base, -1, 1 << 64))


def tokenized(articles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each token of ``articles``, the number of the article it is of, and the number of its line."""
    texts = [bare(x) for x in articles]
    joined = "\n".join(x + "\n" for x in texts)
    code = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    word = kind == 1
    inside = np.concatenate([[False], word[:-1]]) & word
    first = np.nonzero((kind > 0) & ~inside)[0]
    last = np.nonzero((kind == 2) | (word & ~np.concatenate([word[1:], [False]])))[0] + 1
    # A token's hash is that of its characters as digits, the same wherever it stands.
    up, down = _powers(1 << max(10, len(code).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)])])
    h = (total[last] - total[first]) * down[first]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    line = np.cumsum(code == 10)
    # Each article ends with a line of its own, and one more break parts it from the next.
    ends = np.cumsum([0, *(x.count("\n") + 2 for x in texts)])
    return (h >> np.uint64(32)).astype(np.uint32), np.searchsorted(ends, line[first], side="right") - 1, line[first]


def sign(articles: list[str]) -> list[tuple[bytes, int, bytes, bytes, bytes] | None]:
    """For each article its copy key, size, sorted token hashes, token histogram and signature; None without tokens."""
    out: list[tuple[bytes, int, bytes, bytes, bytes] | None] = []
    at, size = 0, 0
    for end, x in enumerate(articles, 1):  # bounds the arrays of characters
        size += len(x)
        if size > 1 << 20 or end == len(articles):
            out += _signs(articles[at:end])
            at, size = end, 0
    return out


def _signs(articles: list[str]) -> list[tuple[bytes, int, bytes, bytes, bytes] | None]:
    token, owner, line = tokenized(articles)
    size = np.bincount(owner, minlength=len(articles))
    starts = np.cumsum(size) - size
    out: list[tuple[bytes, int, bytes, bytes, bytes] | None] = [None] * len(articles)
    full = np.nonzero(size)[0]
    if not len(full):
        return out
    # Shingles run on from the end of a line to its start: one begins at each token.
    begins = np.nonzero(np.concatenate([[True], line[1:] != line[:-1]]))[0]
    ends = np.concatenate([begins[1:], [len(line)]])
    following = np.arange(1, len(token) + 1)
    following[ends - 1] = begins
    h = token * np.uint32(0x9E3779B1) + token[following] * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    # A line's hash depends on the order of its tokens, an article's copy key not on that of its lines.
    place = (np.arange(len(token)) - np.repeat(begins, ends - begins)).astype(np.uint64)
    mixed = (token.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(31)
    line_hash = np.add.reduceat(mixed * np.uint64(0x94D049BB133111EB), begins)
    line_owner = owner[begins]
    ordered = line_hash[np.lexsort((line_hash, line_owner))]
    line_cuts = np.searchsorted(line_owner, np.arange(len(articles) + 1))
    signature = np.empty((len(full), VALUES), np.uint8)
    stops = (starts + size)[full]
    low = 0
    while low < len(full):
        begin = int(starts[full[low]])
        high = max(low + 1, int(np.searchsorted(stops, begin + _BLOCK, side="right")))
        signature[low:high] = _least(h[begin : stops[high - 1]], size[full[low:high]]).T
        low = high
    kind = (token * np.uint32(0x2C1B3C6D) >> np.uint32(26)).astype(np.int64)
    counts = np.bincount(owner * CLASSES + kind, minlength=len(size) * CLASSES).reshape(-1, CLASSES)
    histogram = np.minimum(counts, 255).astype(np.uint8)
    by_hash = token[np.argsort((owner.astype(np.uint64) << np.uint64(32)) | token, kind="stable")]
    for k, d in enumerate(full.tolist()):
        copy = hashlib.blake2b(ordered[line_cuts[d] : line_cuts[d + 1]].tobytes(), digest_size=16).digest()
        out[d] = (copy, int(size[d]), by_hash[starts[d] : starts[d] + size[d]].tobytes(), histogram[d].tobytes(), signature[k].tobytes())
    return out


def _least(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The min-hashes of articles of ``size`` shingles each; a shingle that an article repeats counts as often as it stands there."""
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(owner.astype(np.uint64) << np.uint64(32) | h, kind="stable")
    h = h[order]
    at = np.arange(len(h))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    h = h + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint32) * np.uint32(0xD6E8FEB9)
    cuts = np.cumsum(size) - size
    out = np.empty((VALUES, len(size)), np.uint8)
    x, moved = np.empty_like(h), np.empty_like(h)
    for v in range(VALUES):
        np.multiply(h, _SEEDS[0, v], out=x)
        np.right_shift(x, np.uint32(16), out=moved)
        x ^= moved
        x *= _SEEDS[1, v]
        out[v] = np.minimum.reduceat(x, cuts) * np.uint32(0xC2B2AE3D) >> np.uint32(24)
    return out


def signed(pages: DataFrame) -> DataFrame:
    """(page_id, copy, size, tokens, histogram, signature) of the articles of ``pages`` (page_id, url, markdown)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = lambda c: [x if isinstance(x, str) else None for x in b[c]]
            got = sign([a for _, a in split_batch(text("markdown"), text("url"))])
            rows = [(i, *g) for i, g in zip(b["page_id"].tolist(), got, strict=True) if g]
            yield pd.DataFrame(rows, columns=["page_id", "copy", "size", "tokens", "histogram", "signature"])

    return pages.select("page_id", "url", "markdown").filter("page_id IS NOT NULL").mapInPandas(of, _SIGNED)


def labels(signatures: np.ndarray, tree: int) -> np.ndarray:
    """The labels of signatures (one row each) in a tree, as numbers that sort as their values do."""
    return np.ascontiguousarray(signatures[:, _ORDERS[tree]]).view(">u8")[:, 0].astype(np.uint64)


def _signed(label: np.uint64) -> int:
    """A label as a signed number that sorts as labels do."""
    return int((label ^ np.uint64(1 << 63)).view(np.int64))


def leaves(texts: DataFrame, run: int, slots: int = SLOTS) -> DataFrame:
    """The leaves of ``texts`` (text_id, size, signature, asking): for each tree and slot the entries sorted by label.

    A leaf holds the entries of one chunk of at most ``LEAF`` texts, so it is a bounded row; asking and
    other texts have leaves of their own. A column bound of the texts is carried along as bounds.
    """
    bounded = "bound" in texts.columns
    shift = np.uint64(64 - int(np.log2(slots)))

    def rows(ids: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, bounds: np.ndarray, asking: bool) -> Iterator[tuple]:
        for tree in range(TREES):
            label = labels(signatures, tree)
            order = np.lexsort((ids, label))
            label = label[order]
            slot = (label >> shift).astype(np.int64)
            cuts = np.nonzero(np.diff(slot))[0] + 1
            for s, part, own in zip(slot[np.concatenate([[0], cuts])].tolist(), np.split(label, cuts), np.split(order, cuts), strict=True):
                yield tree, s, asking, _signed(part[0]), _signed(part[-1]), part.tobytes(), ids[own].tobytes(), sizes[own].tobytes(), run, bounds[own].tobytes()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def packed() -> Iterator[pd.DataFrame]:
            b = pd.concat(held)
            for asking, part in b.groupby(b["asking"].astype(bool)):
                signatures = np.frombuffer(b"".join(part["signature"]), np.uint8).reshape(-1, VALUES)
                got = rows(part["text_id"].to_numpy(np.int64), part["size"].to_numpy(np.int32), signatures, part["bound" if bounded else "text_id"].to_numpy(np.int64), bool(asking))
                frame = pd.DataFrame(list(got), columns=[*(c.split()[0] for c in _LEAVES.split(", ")), "bounds"])
                yield frame if bounded else frame.drop(columns="bounds")
            held.clear()

        for b in batches:
            for at in range(0, len(b), LEAF // 4):
                held.append(b.iloc[at : at + LEAF // 4])
                if sum(map(len, held)) > LEAF - LEAF // 4:
                    yield from packed()
        if sum(map(len, held)):
            yield from packed()

    return texts.select("text_id", "size", "signature", "asking", *["bound"] * bounded).mapInPandas(of, _LEAVES + ", bounds binary" * bounded)


@lru_cache(maxsize=8)
def _widening(recall: float, limit: int) -> np.ndarray:
    """For each size below ``limit`` the bits of a label that a prefix as long as the recall allows leaves open."""
    depth = prefix_length(least_similarity(np.arange(limit)), recall).astype(np.uint64)
    return (np.uint64(1) << (np.uint64(8) * (np.uint64(DEPTH) - depth))) - np.uint64(1)


_Pairs = list[tuple[np.ndarray, np.ndarray, bool, bool]]


def _near(own: dict, other: dict, recall: float, below: bool, most: int) -> _Pairs:
    """Of one probing leaf and one leaf of the forest in the same slot the pairs (early ids, late ids, dense, own) that may be repeats.

    Of a pair the later text asks; ``own`` says that it is the probe's. ``dense`` pairs are of ranges searched for their earliest entry only; with
    ``below`` (the ids that bound the answers still wanted) all of a range is searched.
    """
    label, at_id, at_size = (np.frombuffer(other[c], t) for c, t in (("labels", np.uint64), ("ids", np.int64), ("sizes", np.int32)))
    probe, ids, sizes = (np.frombuffer(own[c], t) for c, t in (("labels", np.uint64), ("ids", np.int64), ("sizes", np.int32)))
    bound = np.frombuffer(own["bounds"], np.int64) if below else ids
    rest = _widening(recall, 1 << int(sizes.max()).bit_length())[sizes]
    first = np.searchsorted(label, probe & ~rest, side="left")
    size = np.searchsorted(label, probe | rest, side="right") - first
    # An earlier entry answers an asking probe; a later one of an earlier run, if it asks, is answered by the probe.
    back = bool(other["asking"]) and own["run"] != other["run"] and not below
    ahead = bool(own["asking"])
    out: _Pairs = []
    if not ahead and not back:
        return out
    dense = np.zeros(len(size), bool) if below else size > most
    todo = np.nonzero((size > 0) & ~dense)[0]
    step = max(1, (1 << 20) // max(1, int(size[todo].max(initial=1))))
    for at in range(0, len(todo), step):
        which = todo[at : at + step]
        n = size[which]
        p = np.repeat(which, n)
        e = np.arange(len(p)) + np.repeat(first[which] - np.cumsum(n) + n, n)
        a, b, x, y = ids[p], at_id[e], sizes[p], at_size[e]
        close = np.abs(x - y) <= np.maximum(x, y) * MOST_CHANGED
        if ahead:
            k = close & (b < bound[p]) & (b != a)
            out.append((b[k], a[k], False, True))
        if back:
            k = close & (b > a)
            out.append((a[k], b[k], False, False))
    if dense.any():
        d = np.nonzero(dense)[0]
        ranges, of = np.unique(np.stack([first[d], first[d] + size[d]]), axis=1, return_inverse=True)
        of = np.ravel(of)
        if ahead:
            head = np.array([at_id[a:b].min() for a, b in ranges.T.tolist()])[of]
            k = head < ids[d]
            out.append((head[k], ids[d][k], True, True))
        if back:
            # Entries of earlier runs that ask are first compared with the earliest probe of their range.
            for k, (a, b) in enumerate(ranges.T.tolist()):
                head = ids[d[of == k]].min()
                late = np.unique(at_id[a:b][at_id[a:b] > head])
                out.append((np.full(len(late), head), late, True, False))
    return [x for x in out if len(x[0])]


def search(probes: DataFrame, forest: DataFrame, recall: float = RECALL, below: bool = False, small: bool = False) -> DataFrame:
    """(early, late, dense, own) for the leaves ``probes`` of a batch against the leaves of a ``forest``, as ``_near`` gives them.

    ``small`` says that the probes are known to be few enough to be broadcast, so that no leaf of the forest is moved.
    """
    names, most = [c for c in probes.columns if c not in ("tree", "slot")], DENSE
    own = probes.select("tree", "slot", *(F.col(c).alias(f"o_{c}") for c in names))
    both = forest.join(F.broadcast(own) if small else own, ["tree", "slot"])
    if "low" in names:
        # No prefix is shorter than the least similarity of all sizes allows: ranges that can't meet even at it are left out.
        wide = 64 - 8 * int(prefix_length(least_similarity(np.arange(1, 10_000)), recall).min())
        both = both.filter(f"shiftright(low, {wide}) <= shiftright(o_high, {wide}) AND shiftright(o_low, {wide}) <= shiftright(high, {wide})")
    needed = [c for c in ("labels", "ids", "sizes", "asking", "run", "bounds") if c in names]
    both = both.select("labels", "ids", "sizes", "asking", "run", *(f"o_{c}" for c in needed))

    def packed(found: _Pairs) -> pd.DataFrame:
        n = [len(x[0]) for x in found]
        columns = {"early": np.concatenate([x[0] for x in found]), "late": np.concatenate([x[1] for x in found]), "dense": np.repeat([x[2] for x in found], n), "own": np.repeat([x[3] for x in found], n)}
        return pd.DataFrame(columns).drop_duplicates()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: _Pairs = []
        size = 0
        for b in batches:
            for row in zip(*(b[c] for c in b.columns), strict=True):
                other, mine = dict(zip(("labels", "ids", "sizes", "asking", "run"), row, strict=False)), dict(zip(needed, row[5:], strict=True))
                got = _near(mine, other, recall, below, most)
                found += got
                size += sum(len(x[0]) for x in got)
                if size > 1 << 20:
                    yield packed(found)
                    found, size = [], 0
        if found:
            yield packed(found)

    return both.mapInPandas(of, "early long, late long, dense boolean, own boolean")


class HashForest:
    """Runs of sorted leaves under one folder, which any later session opens again by the folder's name.

    ``sign`` writes what pages are compared by, once for each page. A run holds its pages, each distinct article once
    in its leaves (named by its earliest page of the run), and the links found when it
    was added. The manifest names the tables in force; it is swapped at once.
    """

    def __init__(self, spark: SparkSession, path: str, recall: float = RECALL, slots: int = SLOTS) -> None:
        self.spark, self.path, self.recall, self.slots = spark, path.rstrip("/"), recall, slots
        self.pointer = Pointer(spark, self.path)

    def manifest(self) -> dict[str, list[str]]:
        content = self.pointer.read()
        return json.loads(content) if content else {"signs": [], "runs": []}

    def runs(self) -> list[str]:
        return self.manifest()["runs"]

    def _all(self, table: str, schema: str, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{r}/{table}" for r in runs))

    def signs(self, tables: list[str] | None = None) -> DataFrame:
        """(page_id, copy, size, tokens, histogram, signature) of all signed pages."""
        return self._all("signs", _SIGNED, self.manifest()["signs"] if tables is None else tables)

    def pages(self, runs: list[str] | None = None) -> DataFrame:
        """(page_id, text_id) of all pages."""
        return self._all("pages", "page_id long, text_id long", self.runs() if runs is None else runs)

    def asked(self) -> DataFrame:
        """(page_id, text_id) of the pages that asked for the page they repeat."""
        return self._all("asked", "page_id long, text_id long", self.runs())

    def links(self) -> DataFrame:
        """(early, late): texts that are the same; the later one asks."""
        return self._all("links", "early long, late long", self.runs())

    def sign(self, pages: DataFrame) -> str:
        """Signs ``pages`` (page_id, url, markdown), which belong to no run yet; the name of what was written."""
        version, name = self.pointer.version(), f"signs-{uuid.uuid4().hex}"
        signed(pages).write.parquet(f"{self.path}/{name}/signs")
        now = self.manifest()
        self.pointer.swap(json.dumps({**now, "signs": [*now["signs"], name]}), version)
        return name

    def add(self, pages: DataFrame, asking: bool = True) -> str:
        """Signs a batch of ``pages`` (page_id, url, markdown) that the forest hasn't seen and adds it as ``add_signed`` does."""
        ids = cut(pages.select("page_id").filter("page_id IS NOT NULL").distinct())
        held = self.pages().join(ids, "page_id", "left_semi").select("page_id")
        return self.add_signed(ids, asking, [self.sign(pages.join(held, "page_id", "left_anti"))])

    def add_signed(self, ids: DataFrame, asking: bool = True, tables: list[str] | None = None) -> str:
        """Adds the signed pages ``ids`` (page_id) as a new run and links them; the run's name.

        ``tables`` of signs are looked through for them, all by default. With ``asking`` the pages are to be answered.
        A page delivered with two articles counts with both. Pages of earlier runs may ask, too.
        """
        before, version = self.runs(), self.pointer.version()
        number, name = len(before), f"run-{version}-{uuid.uuid4().hex}"
        home = f"{self.path}/{name}"
        ids = cut(ids.select("page_id").filter("page_id IS NOT NULL").distinct())
        old = cut(self.pages(before).join(ids, "page_id", "left_semi").distinct()) if before else None
        if old is not None and old.isEmpty():
            old = None
        fresh = ids if old is None else ids.join(old, "page_id", "left_anti")
        # Nothing but what the leaves take is moved.
        signs = self.signs(tables)
        narrow = cut(signs.select("page_id", "copy", "size", "signature").join(fresh, "page_id", "left_semi"))
        heads = narrow.groupBy("copy").agg(F.min("page_id").alias("text_id"))
        narrow.select("page_id", "copy").join(heads, "copy").select("page_id", "text_id").distinct().write.parquet(f"{home}/pages")
        named = self.pages([name])
        first = named.filter("page_id = text_id").select("page_id")
        entries = narrow.join(first, "page_id", "left_semi").dropDuplicates(["page_id", "copy"]).select(F.col("page_id").alias("text_id"), "size", "signature", F.lit(asking).alias("asking"))
        askers = named if asking else named.limit(0)
        if asking and old is not None:
            # Pages of earlier runs that ask for the first time have entries that say so.
            askers = askers.unionByName(old)
            again = self.signs().join(old.select(F.col("text_id").alias("page_id")).distinct(), "page_id", "left_semi")
            entries = entries.unionByName(again.select(F.col("page_id").alias("text_id"), "size", "signature", F.lit(True).alias("asking")))
        askers.write.parquet(f"{home}/asked")
        entries = cut(entries)
        size = entries.count()
        leaves(entries.repartition(max(1, -(-size // LEAF))), number, self.slots).write.option("compression", "zstd").parquet(f"{home}/leaves")
        if asking or before:
            self._link([*before, name], name, entries.select("text_id"), size <= SMALL)
        else:
            self._all("links", "early long, late long", []).write.parquet(f"{home}/links")
        self.pointer.swap(json.dumps({**self.manifest(), "runs": [*before, name]}), version)
        return name

    def _link(self, runs: list[str], name: str, own: DataFrame, small: bool) -> None:
        probes, forest = self._all("leaves", _LEAVES, [name]), self._all("leaves", _LEAVES, runs)
        near = cut(search(probes, forest, self.recall, small=small).groupBy("early", "late").agg(F.max("dense").alias("dense"), F.max("own").alias("own")))
        some = near.agg(F.coalesce(F.max("dense"), F.lit(False)).alias("dense"), F.coalesce(F.min("own"), F.lit(True)).alias("own")).first()
        same = cut(self.verify(near, own if small and some["own"] else None))
        if some["dense"]:
            # Askers for which the earliest entry of some dense range was no answer, or not their earliest one.
            answers = same.groupBy("late").agg(F.min("early").alias("answer"))
            left = near.filter("dense").join(answers, "late", "left").filter("answer IS NULL OR answer <> early")
            left = left.groupBy(F.col("late").alias("page_id")).agg(F.min(F.coalesce("answer", "late")).alias("bound"))
            entries = cut(self.signs().select("page_id", "size", "signature").join(cut(left), "page_id").select(F.col("page_id").alias("text_id"), "size", "signature", F.lit(True).alias("asking"), "bound"))
            size = entries.count()
            again = cut(leaves(entries.repartition(max(1, -(-size // LEAF))), -1, self.slots).drop("low", "high"))
            rest = search(again, forest, self.recall, below=True, small=size <= SMALL)
            rest = cut(rest.select("early", "late").distinct().join(near.select("early", "late"), ["early", "late"], "left_anti"))
            same = same.unionByName(self.verify(rest))
        same.select("early", "late").write.parquet(f"{self.path}/{name}/links")

    def verify(self, pairs: DataFrame, own: DataFrame | None = None, most_changed: float = MOST_CHANGED) -> DataFrame:
        """(early, late): the pairs whose articles are the same up to the changes allowed.

        ``own`` (text_id) are the texts of a small batch, if all late sides are of it.
        """
        signs = self.signs()
        side = lambda t, of, **c: t.select(F.col("page_id").alias(of), *(F.col(a).alias(b) for b, a in c.items()))
        short = signs.select("page_id", "size", "histogram")
        early = pairs.join(side(short, "early", n="size", x="histogram"), "early")
        late = side(short, "late", m="size", y="histogram")
        if own is not None:
            late = F.broadcast(late.join(F.broadcast(own), F.col("late") == F.col("text_id"), "left_semi"))
        sized = early.join(late, "late")

        def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, CLASSES).astype(np.int16) for c in "xy")
                    net = x - y
                    most = np.maximum(np.maximum(net, 0).sum(1), np.maximum(-net, 0).sum(1))
                    yield b.loc[most <= most_changed * np.maximum(b["n"], b["m"]).to_numpy(), ["early", "late"]]

        likely = cut(sized.select("early", "late", "n", "m", "x", "y").mapInPandas(possible, "early long, late long").distinct())
        wanted = cut(likely.select(F.col("early").alias("page_id")).unionByName(likely.select(F.col("late").alias("page_id"))).distinct())
        whole = cut(signs.select("page_id", "tokens").join(wanted, "page_id", "left_semi").distinct())

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                keep = [changed(x, y) <= most_changed for x, y in zip(b["x"], b["y"], strict=True)]
                yield b.loc[keep, ["early", "late"]]

        both = likely.join(side(whole, "early", x="tokens"), "early").join(side(whole, "late", y="tokens"), "late")
        return both.select("early", "late", "x", "y").mapInPandas(of, "early long, late long").distinct()

    def merge(self, runs: list[str] | None = None) -> str:
        """One run of ``runs`` (all by default): small leaves of a slot become larger ones, sorted anew; the old runs stay for readers that still use them."""
        now, version = self.runs(), self.pointer.version()
        runs = now if runs is None else runs
        name = f"run-{version}-{uuid.uuid4().hex}"
        home, number = f"{self.path}/{name}", min(map(now.index, runs), default=0)
        for table, schema in (("pages", "page_id long, text_id long"), ("asked", "page_id long, text_id long"), ("links", "early long, late long")):
            self._all(table, schema, runs).distinct().write.option("compression", "zstd").parquet(f"{home}/{table}")

        # A slot of more entries than a leaf takes is divided by further bits of the label, so that its leaves are disjoint ranges;
        # what can't be divided (one label on many texts) is put together up to LEAF entries and no further.
        rows = self._all("leaves", _LEAVES, runs).withColumn("n", F.expr("length(ids) div 8"))
        bits = rows.groupBy("tree", "slot", "asking").agg(F.ceil(F.log2(F.sum("n") / F.lit(LEAF // 2))).alias("bits"))  # as many rows as trees and slots
        names, slot_bits, leaf = [c.split()[0] for c in _LEAVES.split(", ")], np.uint64(np.log2(self.slots)), LEAF

        def divided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.to_dict("records"):
                    label, ids, sizes = (np.frombuffer(r[c], t) for c, t in (("labels", np.uint64), ("ids", np.int64), ("sizes", np.int32)))
                    k = max(0, min(int(r["bits"]), 32))
                    sub = ((label << slot_bits) >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(label), np.int64)
                    cuts = np.nonzero(np.diff(sub))[0] + 1
                    out = [(r["tree"], r["slot"], r["asking"], int(s), len(x), x.tobytes(), y.tobytes(), z.tobytes()) for s, x, y, z in zip(sub[np.concatenate([[0], cuts])], *(np.split(v, cuts) for v in (label, ids, sizes)), strict=True)]
                    yield pd.DataFrame(out, columns=["tree", "slot", "asking", "sub", "n", "labels", "ids", "sizes"])

        def joined(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            label, ids, sizes = (np.frombuffer(b"".join(b[c]), t) for c, t in (("labels", np.uint64), ("ids", np.int64), ("sizes", np.int32)))
            order = np.lexsort((ids, label))
            label = label[order]
            return pd.DataFrame([(key[0], key[1], key[2], _signed(label[0]), _signed(label[-1]), label.tobytes(), ids[order].tobytes(), sizes[order].tobytes(), number)], columns=names)

        parts = rows.join(bits, ["tree", "slot", "asking"]).select("tree", "slot", "asking", "labels", "ids", "sizes", "bits")
        parts = parts.mapInPandas(divided, "tree int, slot int, asking boolean, sub long, n long, labels binary, ids binary, sizes binary")
        parts = parts.withColumn("part", F.expr(f"(sum(n) OVER (PARTITION BY tree, slot, asking, sub ORDER BY n, xxhash64(ids) ROWS UNBOUNDED PRECEDING) - n) div {leaf}"))
        parts.groupBy("tree", "slot", "asking", "sub", "part").applyInPandas(joined, _LEAVES).write.option("compression", "zstd").parquet(f"{home}/leaves")
        at = {r: k for k, r in enumerate(now)}
        left = [r for r in now if r not in runs]
        self.pointer.swap(json.dumps({**self.manifest(), "runs": sorted([*left, name], key=lambda r: at.get(r, number))}), version)
        return name

    def answers(self) -> DataFrame:
        """(page_id_a, page_id_b): for each page b that asked the earliest page a < b with the same article."""
        first = self.links().groupBy("late").agg(F.min("early").alias("_early")).withColumnRenamed("late", "text_id")
        rows = self.asked().distinct().join(first, "text_id", "left")
        best = rows.groupBy("page_id").agg(F.min(F.least("text_id", F.coalesce("_early", "text_id"))).alias("page_id_a"))
        return best.filter("page_id_a < page_id").select("page_id_a", F.col("page_id").alias("page_id_b"))


def changed(x: bytes, y: bytes) -> float:
    """Share of tokens changed, added or dropped between two sorted token lists, of the longer one."""
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    if not len(a) or not len(b):
        return 1.0
    both = np.concatenate([a, b])
    side = np.concatenate([np.ones(len(a), np.int64), -np.ones(len(b), np.int64)])
    order = np.argsort(both, kind="stable")
    both, side = both[order], side[order]
    starts = np.concatenate([[0], np.nonzero(both[1:] != both[:-1])[0] + 1])
    net = np.add.reduceat(side, starts)
    return max(net[net > 0].sum(), -net[net < 0].sum()) / max(len(a), len(b))


def repeats(pages: DataFrame, history: DataFrame, batches: list[DataFrame], forest: HashForest | None = None) -> DataFrame:
    """(page_id_a, page_id_b): for each page b of ``batches`` the earliest page a < b of history or batches with the same article.

    ``history`` and each batch have page_id; ``pages`` has page_id, url, markdown of them all and is read once. The history and each
    batch in turn are added to ``forest``, a new one in the shared folder by default.
    """
    spark = pages.sparkSession
    forest = forest or HashForest(spark, f"{shared_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}")
    tables = [forest.sign(pages)]
    forest.add_signed(history, False, tables)
    for ids in batches:
        forest.add_signed(ids, True, tables)
    return forest.answers()
