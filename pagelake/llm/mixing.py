"""Mixing sources to target weights, in tokens of a public tokenizer, by subset-sum budget fitting.

Documents are counted by source and exact token length; this histogram, whose
size is bounded by the longest document and not by their number, is all the
driver sees. For each source the budget is its share of the total. Whole passes
over the source come first; of what is left, an even part of each length is
taken, and the last ``WINDOW`` tokens are fitted exactly by bounded-knapsack
dynamic programming over the remaining counts. The plan says how many documents
of each length are used once more; these are drawn by a seeded hash, counted in
256 salted parts, so that no length of a source is ranked in one task.

Without a total the largest one is taken at which every listed source that has
documents reaches its share within its repeats; shares are taken relative to
the sources that have documents. With a larger total the sources that fall
short give all they may.

Sources compare stripped and in lower case. Documents with NULL or unlisted
source, NULL id or NULL text, and texts without tokens take no part. Of a
source listed twice the larger share counts. NULL shares or repeats count as 0.
doc_id is taken as unique.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.text import blank_to_null
from pagelake.session import cut

TOKENIZER = os.environ.get("PAGELAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern by which this vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens left to the exact fit.
WINDOW = 1 << 12
SEED = 17


def _draw(seed: int, *key: object) -> float:
    """A number from 0 to 1 that depends on nothing but ``seed`` and ``key``."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest()) / 2**64


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of ``documents`` (doc_id, source, text)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [len(encode(x)) for x in b["text"]]})

    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")
    rows = rows.filter("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(of, "doc_id long, source string, n_tokens long").filter("n_tokens > 0")


def fit(lengths: dict[int, int], budget: int, seed: int = SEED) -> dict[int, int]:
    """How many of each length to take so that their sum comes as close below ``budget`` as any choice does.

    Of equally close choices the seed decides, so that no length is preferred.
    """
    steps: list[tuple[int, int, int]] = []
    reach = [1]
    mask = (1 << (budget + 1)) - 1
    for length, count in sorted(lengths.items(), key=lambda x: _draw(seed, "fit", x[0])):
        left, part = min(count, budget // length), 1
        while left > 0:
            k = min(part, left)
            new = (reach[-1] | reach[-1] << (k * length)) & mask
            if new != reach[-1]:
                steps.append((length, k, len(reach)))
                reach.append(new)
            left, part = left - k, part * 2
        if reach[-1] >> budget & 1:
            break
    best = reach[-1].bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, k, n in reversed(steps):
        if not reach[n - 1] >> best & 1:
            taken[length] += k
            best -= k * length
    return dict(taken)


def plan_source(lengths: dict[int, int], budget: int, most: int, window: int = WINDOW, seed: int = SEED) -> tuple[int, dict[int, int]]:
    """Full passes over a source, and how many documents of each length are used once more, for ``budget`` tokens."""
    total = sum(n * k for n, k in lengths.items())
    passes = min(most, budget // total) if total else 0
    if passes >= most:
        return passes, {}
    rest = budget - passes * total
    extra: dict[int, int] = {}
    if rest > window:
        part = (rest - window) / total
        extra = {n: min(k, int(k * part + _draw(seed, "even", n))) for n, k in lengths.items()}
        rest -= sum(n * k for n, k in extra.items())
        # Rounded by lot, the even part may be too much or too little by some documents; lots correct it up to the window.
        order = sorted(lengths, key=lambda n: _draw(seed, "order", n))
        for n in order:
            while rest < window // 2 and extra[n]:
                extra[n] -= 1
                rest += n
        for n in order:
            if rest - n > window and extra[n] < lengths[n]:
                k = min(lengths[n] - extra[n], max(1, (rest - window) // (n * len(order))))
                extra[n] += k
                rest -= n * k
    for n, k in fit({n: k - extra.get(n, 0) for n, k in lengths.items() if k > extra.get(n, 0)}, rest, seed).items():
        extra[n] = extra.get(n, 0) + k
    return passes, {n: k for n, k in extra.items() if k}


def plan(histogram: list[tuple[str, int, int]], weights: list[tuple[str, float, int]], total: int | None = None, seed: int = SEED) -> list[dict]:
    """For each listed source what is used of it; ``histogram`` is (source, n_tokens, documents)."""
    lengths: dict[str, dict[int, int]] = defaultdict(dict)
    for source, n, k in histogram:
        lengths[source][n] = lengths[source].get(n, 0) + k
    has = {s: sum(n * k for n, k in x.items()) for s, x in lengths.items()}
    listed = {}
    for s, share, most in sorted(weights, key=lambda w: w[1] or 0):
        listed[s] = (share or 0.0, most or 0)
    whole = sum(share for s, (share, most) in listed.items() if has.get(s) and most)
    usable = {s: share / whole for s, (share, most) in listed.items() if has.get(s) and most and share > 0}
    if total is None:
        total = int(min((has[s] * listed[s][1] / share for s, share in usable.items()), default=0))
    out = []
    for s, (share, most) in sorted(listed.items()):
        budget = min(round(usable.get(s, 0) * total), has.get(s, 0) * most)
        passes, extra = plan_source(lengths.get(s, {}), budget, most, seed=seed)
        used = passes * has.get(s, 0) + sum(n * k for n, k in extra.items())
        out.append({"source": s, "target_share": share, "max_repeats": most, "documents": sum(lengths.get(s, {}).values()), "tokens": has.get(s, 0), "budget": budget, "used": used, "passes": passes, "extra": extra})
    return out


def mix(documents: DataFrame, weights: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_tokens, uses) and the report by source with the shares reached."""
    spark = documents.sparkSession
    listed = weights.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL")
    rows = cut(sized(documents, tokenizer).join(listed.select("source").distinct(), "source", "left_semi").select("doc_id", "source", "n_tokens"))
    histogram = [tuple(r) for r in rows.groupBy("source", "n_tokens").count().toLocalIterator()]
    made = plan(histogram, [tuple(r) for r in listed.collect()], total, seed)
    reached = sum(p["used"] for p in made)
    report = spark.createDataFrame(
        [(p["source"], p["target_share"], p["max_repeats"], p["documents"], p["tokens"], p["budget"], p["used"], p["used"] / reached if reached else 0.0) for p in made],
        "source string, target_share double, max_repeats int, documents long, available_tokens long, budget_tokens long, used_tokens long, actual_share double",
    )
    passes = spark.createDataFrame([(p["source"], p["passes"]) for p in made], "source string, passes int")
    extra = spark.createDataFrame([(p["source"], n, k) for p in made for n, k in p["extra"].items()], "source string, n_tokens long, extra long")
    salted = rows.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("salt", F.shiftrightunsigned("order", 56))
    parts = salted.groupBy("source", "n_tokens", "salt").agg(F.count("*").alias("n")).join(extra, ["source", "n_tokens"])
    before = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.coalesce(before, F.lit(0))))
    parts = parts.select("source", "n_tokens", "salt", quota.alias("quota")).filter("quota > 0")
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "salt").orderBy("order", "doc_id"))
    drawn = salted.join(parts, ["source", "n_tokens", "salt"]).withColumn("rank", rank).filter("rank <= quota").select("doc_id", F.lit(1).alias("more"))
    uses = (F.col("passes") + F.coalesce("more", F.lit(0))).cast("int")
    chosen = rows.join(passes, "source").join(drawn, "doc_id", "left").select("doc_id", "source", "n_tokens", uses.alias("uses"))
    return chosen.filter("uses > 0"), report
