"""What the state says about addresses: fresh, unchanged, to be fetched; and what a run leaves in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.functions.text import digest_key
from pagelake.operators.incremental import instant


def state(rows: DataFrame) -> DataFrame:
    """(url, saved_at, filename, content_hash): the last row of each address by instant, then run, then hash; without readable time the first rank."""
    order = F.struct(instant(F.col("saved_at")).alias("at"), F.col("run_id"), digest_key(F.col("content_hash")).alias("h"), F.coalesce("filename", F.lit("")).alias("f"))
    keyed = rows.select(urls.normalize(F.col("url")).alias("url"), order.alias("x")).filter("url IS NOT NULL")
    last = keyed.groupBy("url").agg(F.max("x").alias("x"))
    return last.select("url", F.col("x.at").alias("saved_at"), F.col("x.f").alias("filename"), F.col("x.h").alias("content_hash"))


def is_fresh(saved_at: Column, now: Column, hours: int, force: bool = False) -> Column:
    """Whether a time lies inside the window; a future one does, a missing one doesn't."""
    if force or hours == 0:
        return F.lit(False)
    return F.coalesce(saved_at > now - F.expr(f"INTERVAL {int(hours)} HOURS"), F.lit(False))


def split_fresh(addresses: DataFrame, known: DataFrame, now: Column, hours: int, force: bool = False) -> DataFrame:
    """(url, first_at, fresh) of distinct normalized ``addresses`` (url, ord), in the order they came."""
    rows = addresses.select(urls.normalize(F.col("url")).alias("url"), "ord").filter("url IS NOT NULL")
    rows = rows.groupBy("url").agg(F.min("ord").alias("first_at"))
    return rows.join(known.select("url", "saved_at"), "url", "left").select("url", "first_at", is_fresh(F.col("saved_at"), now, hours, force).alias("fresh"))


def unchanged(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(url, unchanged) of ``pages`` (url, content_hash): whether the state holds the same digest for the address."""
    rows = pages.select(urls.normalize(F.col("url")).alias("url"), digest_key(F.col("content_hash")).alias("h")).filter("url IS NOT NULL").distinct()
    same = F.coalesce(F.col("h") == F.col("_held"), F.lit(False))
    return rows.join(known.select("url", F.col("content_hash").alias("_held")), "url", "left").groupBy("url").agg(F.max(same).alias("unchanged"))


def upserted(known: DataFrame, successes: DataFrame) -> DataFrame:
    """The state after ``successes`` (seq, url, content_hash, filename, saved_at): the last one of an address replaces its row."""
    rows = successes.select(urls.normalize(F.col("url")).alias("url"), F.struct("seq", "saved_at", "filename", digest_key(F.col("content_hash")).alias("h")).alias("x"))
    last = rows.filter("url IS NOT NULL AND x.h IS NOT NULL").groupBy("url").agg(F.max("x").alias("x"))
    new = last.select("url", "x.saved_at", "x.filename", F.col("x.h").alias("content_hash"))
    return known.join(new, "url", "left_anti").unionByName(new)


def last_writers(successes: DataFrame) -> DataFrame:
    """(content_hash, url): the last address that had each digest."""
    rows = successes.select(digest_key(F.col("content_hash")).alias("content_hash"), F.struct("seq", urls.normalize(F.col("url")).alias("url")).alias("x"))
    return rows.filter("content_hash IS NOT NULL AND x.url IS NOT NULL").groupBy("content_hash").agg(F.max("x")["url"].alias("url"))


def skips(split: DataFrame) -> DataFrame:
    """One row: number and sorted list of fresh addresses; a report, so it is meant for site-sized inputs."""
    return split.filter("fresh").agg(F.count_distinct("url").alias("incremental_skipped"), F.array_sort(F.collect_set("url")).alias("incremental_skipped_urls"))
