"""Registering content: the first address of a digest is canonical, later ones are its duplicates.

Blank digests or addresses are rejected (``error``). Against records that exist
already these win. A new digest for an address that is canonical for another
one can't be canonical too: its decision is ``conflict`` and nothing is stored.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.functions.text import digest_key, strip
from pagelake.operators.incremental import Pointer
from pagelake.session import cut


def decisions(registrations: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(seq, url, content_hash, decision, canonical_url, canonical_path) of ``registrations`` (seq, content_hash, url, output_path).

    decision is canonical, duplicate, conflict or error. ``records`` has
    content_hash, canonical_url, canonical_path. One shuffle by digest; the
    earliest registration of a digest is found by a partial aggregate.
    """
    rows = registrations.select("seq", digest_key(F.col("content_hash")).alias("content_hash"), F.nullif(strip(F.col("url")), F.lit("")).alias("url"), "output_path")
    good = rows.filter("content_hash IS NOT NULL AND url IS NOT NULL")
    first = good.groupBy("content_hash").agg(F.min(F.struct("seq", "url", "output_path")).alias("first"))
    if records is not None:
        held = records.select(digest_key(F.col("content_hash")).alias("content_hash"), "canonical_url", "canonical_path").filter("content_hash IS NOT NULL")
        held = held.groupBy("content_hash").agg(F.min(F.struct("canonical_url", "canonical_path")).alias("held"))
        first = first.join(held, "content_hash", "left")
        taken = held.select(F.col("held.canonical_url").alias("url")).distinct().withColumn("_taken", F.lit(True))
    else:
        first = first.withColumn("held", F.lit(None).cast("struct<canonical_url:string,canonical_path:string>"))
        taken = None
    fresh = first.filter("held IS NULL").select("content_hash", F.col("first.url").alias("url"), F.col("first.seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("url").orderBy("seq"))
    fresh = fresh.withColumn("_rank", rank)
    if taken is not None:
        fresh = fresh.join(taken, "url", "left").withColumn("_rank", F.when(F.col("_taken"), 2).otherwise(F.col("_rank")))
    clash = fresh.filter("_rank > 1").select("content_hash", F.lit(True).alias("_clash"))
    # Blank digests would all meet in one partition of a join: they are errors and need none.
    joined = good.join(first, "content_hash", "left").join(clash, "content_hash", "left")
    joined = joined.unionByName(rows.filter("content_hash IS NULL OR url IS NULL"), allowMissingColumns=True)
    is_first = F.col("held").isNull() & (F.col("seq") == F.col("first.seq"))
    decision = (
        F.when(F.col("content_hash").isNull() | F.col("url").isNull(), "error").when(F.col("_clash"), "conflict").when(is_first, "canonical").otherwise("duplicate")
    )
    known = decision.isin("canonical", "duplicate")
    return joined.select(
        "seq", "url", "content_hash", decision.alias("decision"),
        F.when(known, F.coalesce("held.canonical_url", "first.url")).alias("canonical_url"),
        F.when(known, F.coalesce("held.canonical_path", "first.output_path")).alias("canonical_path"),
    )


def stored_duplicates(decided: DataFrame) -> DataFrame:
    """(url, content_hash, canonical_url, canonical_path): the last duplicate decision of each address."""
    rows = decided.filter("decision = 'duplicate'")
    last = rows.groupBy("url").agg(F.max(F.struct("seq", "content_hash", "canonical_url", "canonical_path")).alias("x"))
    return last.select("url", "x.content_hash", "x.canonical_url", "x.canonical_path")


def counts(decided: DataFrame) -> DataFrame:
    """(unique_count, duplicate_count): digests held and addresses known as duplicates, in one pass."""
    return decided.agg(
        F.count_if(F.col("decision") == "canonical").alias("unique_count"),
        F.count_distinct(F.when(F.col("decision") == "duplicate", F.col("url"))).alias("duplicate_count"),
    )


def orphans(duplicates: DataFrame, records: DataFrame) -> DataFrame:
    """Duplicates whose digest no record holds."""
    held = records.select(digest_key(F.col("content_hash")).alias("_hash")).distinct()
    return duplicates.withColumn("_hash", digest_key(F.col("content_hash"))).join(held, "_hash", "left_anti").drop("_hash")


def shared_canonicals(records: DataFrame) -> DataFrame:
    """(canonical_url, digests): addresses canonical for several digests."""
    rows = records.select("canonical_url", digest_key(F.col("content_hash")).alias("h")).distinct()
    return rows.groupBy("canonical_url").agg(F.count("h").alias("digests")).filter("digests > 1")


class Registry:
    """What has been registered, kept under one folder from session to session; opened again by its name, made if it isn't there.

    Records are only ever added (the first address of a digest stays), duplicates are put over older ones of the same
    address. A registration writes its own rows and swaps one pointer, so it costs what the batch costs.
    """

    RECORDS = "content_hash string, canonical_url string, canonical_path string, title string"
    DUPLICATES = "url string, content_hash string, canonical_url string, canonical_path string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.pointer = spark, path.rstrip("/"), Pointer(spark, path)

    def _parts(self) -> list[str]:
        return json.loads(self.pointer.read() or "[]")

    def _read(self, table: str, schema: str) -> DataFrame:
        parts = self._parts()
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{table}").withColumn("_part", F.lit(n)) for n, name in enumerate(parts)]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], f"{schema}, _part int")

    def records(self) -> DataFrame:
        """(content_hash, canonical_url, canonical_path, title)."""
        return self._read("records", self.RECORDS).drop("_part")

    def duplicates(self) -> DataFrame:
        """(url, content_hash, canonical_url, canonical_path): the last duplicate of each address."""
        rows = self._read("duplicates", self.DUPLICATES)
        last = rows.groupBy("url").agg(F.max(F.struct("_part", "content_hash", "canonical_url", "canonical_path")).alias("x"))
        return last.select("url", "x.content_hash", "x.canonical_url", "x.canonical_path")

    def register(self, registrations: DataFrame) -> DataFrame:
        """Decides ``registrations`` (seq, content_hash, url, output_path, and title if there) against what is stored, stores the outcome and gives the decisions."""
        base, parts = self.pointer.version(), self._parts()
        rows = registrations if "title" in registrations.columns else registrations.withColumn("title", F.lit(None).cast("string"))
        decided = cut(decisions(rows, self.records()))
        name = f"part-{base + 1}-{uuid.uuid4().hex}"
        titles = rows.select("seq", "title").groupBy("seq").agg(F.max("title").alias("title"))
        new = decided.filter("decision = 'canonical'").join(titles, "seq").select("content_hash", "canonical_url", "canonical_path", "title")
        new.write.parquet(f"{self.path}/{name}/records")
        stored_duplicates(decided).write.parquet(f"{self.path}/{name}/duplicates")
        self.pointer.swap(json.dumps([*parts, name]), base)
        return decided

    def counts(self) -> tuple[int, int]:
        """Digests held and addresses known as duplicates."""
        return self.records().count(), self.duplicates().count()
