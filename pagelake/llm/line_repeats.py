"""Lines repeated across one site's documents.

The pages of each line of a host are a compressed bitmap: containers of 2^15
page ids, the low bits of which are a sorted array of 16-bit numbers where they
are few and a bitset of 4 KB where they are more than ``ARRAY``. Lines that have the same
letters (Unicode category L, lower case) are variants of one line; their
bitmaps are united container by container. The exact cardinality of a union is the sum over its
containers, which are rows of their own, so no group grows with a host beyond
one container. A line is deleted from a page if the page's bit is set in a
bitmap that reaches the thresholds.

NULL markdown has no lines; pages whose url is NULL or no address form no host
and take no part. Pages delivered twice count once. Lines of any length count
whole. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.session import cut

LEAST_LETTERS, LEAST_PAGES, LEAST_SHARE = 16, 5, 0.2
_LOW = 15
#: A container of more members is a bitset: from there on it is the smaller one.
ARRAY = 2048


def letters(line: Column) -> Column:
    """The letters of a line, lower case."""
    return F.regexp_replace(F.lower(line), r"\P{L}+", "")


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, host, line_no, k1, k2, line): the long enough lines, keyed by 128 bits of host and letters, with a hash of themselves."""
    rows = pages.select("page_id", urls.host(F.col("url")).alias("host"), "markdown").filter("host IS NOT NULL AND page_id IS NOT NULL")
    lines = rows.select("page_id", "host", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    lines = lines.filter(F.length("line") >= LEAST_LETTERS).withColumn("own", letters(F.col("line")))
    # A supplementary letter is two Java chars but one letter, so length() counts code points.
    lines = lines.filter(F.length("own") >= LEAST_LETTERS)
    keys = (F.xxhash64("host", "own").alias("k1"), F.xxhash64(F.lit(7), "own", "host").alias("k2"))
    return lines.select("page_id", "host", (F.col("line_no") + 1).alias("line_no"), *keys, F.xxhash64("line").alias("line"))


def split_id(page_id: Column) -> tuple[Column, Column]:
    """The container a page id falls in and its place there, as a signed 16-bit number."""
    return F.shiftright(page_id, _LOW), page_id.bitwiseAND(F.lit((1 << _LOW) - 1)).cast("smallint")


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """(k1, k2, line, host, high, low): for each line as it stands the containers of its pages, as sorted arrays."""
    high, low = split_id(F.col("page_id"))
    return lines.groupBy("k1", "k2", "line", "host", high.alias("high")).agg(F.array_sort(F.collect_set(low)).alias("low"))


def united(bitmaps: DataFrame) -> DataFrame:
    """(k1, k2, host, high, low, bits, card): the bitmaps of a line's variants as one; a container has either low or bits."""
    both = bitmaps.groupBy("k1", "k2", "host", "high").agg(F.collect_list("low").alias("lows"))
    one = both.select("k1", "k2", "host", "high", F.when(F.size("lows") == 1, F.col("lows")[0]).otherwise(F.array_sort(F.array_distinct(F.flatten("lows")))).alias("low"))
    one = one.withColumn("card", F.size("low"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = []
            for low in b["low"]:
                bits = np.zeros(1 << _LOW, bool)
                bits[np.asarray(low, np.int64)] = True
                packed.append(np.packbits(bits, bitorder="little").tobytes())
            yield b.assign(bits=packed).drop(columns="low")

    # Few containers are dense, so only they go through Python.
    dense = one.filter(F.col("card") > ARRAY).mapInPandas(of, "k1 long, k2 long, host string, high long, card int, bits binary")
    return one.filter(F.col("card") <= ARRAY).unionByName(dense, allowMissingColumns=True)


def is_set(low: Column, array: Column, bits: Column) -> Column:
    """Whether a container (array or bits) holds a place."""
    place = low.cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    masked = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), place % 8 + 1))
    return F.when(bits.isNull(), F.array_contains(array, low)).otherwise(masked > 0)


def host_pages(pages: DataFrame) -> DataFrame:
    """(host, pages): distinct pages of each host."""
    rows = pages.select("page_id", urls.host(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    return rows.groupBy("host").agg(F.count("*").alias("pages"))


def frequent(bitmaps: DataFrame, hosts: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(k1, k2, on_pages): the keys whose cardinality reaches both thresholds; the small amount makes up for 0.2 being no binary fraction."""
    total = bitmaps.groupBy("k1", "k2", "host").agg(F.sum("card").alias("card")).filter(F.col("card") >= least_pages)
    return total.join(hosts, "host").filter(F.col("card") >= F.col("pages") * F.lit(least_share) - 1e-9).select("k1", "k2", F.col("card").alias("on_pages"))


def repeated_lines(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, line_no) of each line that repeats over its host's pages as often as the thresholds ask; rows are distinct."""
    lines = page_lines(pages)
    bitmaps = cut(united(line_bitmaps(lines)))
    kept = bitmaps.join(frequent(bitmaps, host_pages(pages), least_pages, least_share), ["k1", "k2"], "left_semi").select("k1", "k2", "high", F.col("low").alias("_low"), "bits")
    high, low = split_id(F.col("page_id"))
    looked = lines.select("page_id", "line_no", "k1", "k2", high.alias("high"), low.alias("low")).join(kept, ["k1", "k2", "high"])
    return looked.filter(is_set(F.col("low"), F.col("_low"), F.col("bits"))).select("page_id", F.col("line_no").cast("int").alias("line_no")).distinct()


def without_repeats(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(page_id, markdown): each distinct page without its repeated lines; pages without any come out as they are."""
    found = repeated_lines(pages) if found is None else found
    gone = found.groupBy("page_id").agg(F.collect_set("line_no").alias("_gone"))
    rows = pages.select("page_id", "markdown").dropDuplicates(["page_id"]).join(gone, "page_id", "left")
    kept = F.expr("array_join(filter(split(markdown, '\n'), (x, i) -> _gone IS NULL OR NOT array_contains(_gone, i + 1)), '\n')")
    return rows.select("page_id", kept.alias("markdown"))
