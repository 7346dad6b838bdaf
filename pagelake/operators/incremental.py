"""Processing only what is new or changed since the last successful run.

State is one row per key with the hash of what was processed, when it was saved
and under which file name. A run freezes its rows' keys and hashes once, joins
them with the state, takes those without an equal entry, and commits exactly
what it froze, so a row that changes while the run works is taken up again by
the next one. ``StateStore`` keeps the state in buckets of the key's hash and in
versions: a run writes the buckets it touches anew and then swaps one pointer,
so a run that breaks off leaves the old version in force and the next run sees
exactly what it left undone.

NULLs: a row whose key is NULL or no address can't have an entry and counts as
new; a NULL hash on either side is unequal to all hashes, two NULLs included.
Repeated rows are reported once. Empty tables: without state all rows are new,
without rows nothing is. Only the named columns are read, so others may clash.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.functions.text import digest_key, strip
from pagelake.session import cut

_ISO = (
    r"(?i)^([0-9]{4})-?([0-9]{2})-?([0-9]{2})(?:[T ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"[ ]?(Z|[+\-][0-9]{2}(?::?[0-9]{2})?)?)?$"
)


def instant(text: Column) -> Column:
    """The instant an ISO-8601 text names, without offset in UTC; NULL if unreadable.

    Independent of the session's time zone.
    """

    def of(t: Column) -> Column:
        g = lambda i: F.regexp_extract(t, _ISO, i)
        or0 = lambda i: F.when(g(i) == "", "00").otherwise(g(i))
        zone = F.upper(g(8))
        hhmm = F.regexp_replace(zone, r"[^0-9]", "")
        offset = F.when(zone.isin("", "Z"), "+00:00").otherwise(
            F.concat(
                F.substring(zone, 1, 1),
                F.substring(hhmm, 1, 2),
                F.lit(":"),
                F.when(F.length(hhmm) > 2, F.substring(hhmm, 3, 2)).otherwise("00"),
            )
        )
        fraction = F.when(g(7) == "", "").otherwise(F.concat(F.lit("."), F.substring(g(7), 1, 6)))
        day = F.concat_ws("-", g(1), g(2), g(3))
        clock = F.concat(F.concat_ws(":", or0(4), or0(5), or0(6)), fraction)
        return F.when(t.rlike(_ISO), F.concat(day, F.lit("T"), clock, offset).try_cast("timestamp"))

    return urls.let(strip(text), of)


def latest_state(rows: DataFrame, runs: DataFrame, key: str = "url", hash_column: str = "content_hash") -> DataFrame:
    """(state_key, state_hash): what the newest row of a succeeded run left for each address.

    Rows of other runs and rows without a readable ``saved_at`` don't count. Of
    rows with one instant that of the higher run, then the higher hash, counts.
    """
    good = runs.filter(F.lower(strip(F.col("status"))) == "succeeded").select(F.col("run_id").alias("_run")).distinct()
    left = rows.select(
        urls.normalize(F.col(key)).alias("state_key"),
        instant(F.col("saved_at")).alias("_at"),
        digest_key(F.col(hash_column)).alias("_hash"),
        F.col("run_id").alias("_run"),
    ).filter("state_key IS NOT NULL AND _at IS NOT NULL")
    newest = F.max(F.struct("_at", "_run", "_hash"))
    return left.join(good, "_run", "left_semi").groupBy("state_key").agg(newest["_hash"].alias("state_hash"))


def new_or_changed(rows: DataFrame, state: DataFrame, id_column: str, key: Column, row_hash: Column) -> DataFrame:
    """(id, change): the ids of ``rows`` whose key has no entry in ``state`` or another hash; change is new or changed.

    ``state`` has one row per state_key, as ``latest_state`` and ``StateStore`` give it.
    """
    now = rows.select(F.col(id_column).alias("_id"), key.alias("_key"), row_hash.alias("_now")).distinct()
    seen = state.select(F.col("state_key").alias("_key"), F.col("state_hash").alias("_then"), F.lit(True).alias("_seen"))
    # An equal NULL would count as unchanged under <=>: a missing hash proves nothing, so it is compared with =.
    same = F.coalesce(F.col("_now") == F.col("_then"), F.lit(False))
    change = F.when(F.col("_seen").isNull(), "new").otherwise("changed")
    return now.join(seen, "_key", "left").filter(~same).select(F.col("_id").alias(id_column), change.alias("change")).distinct()


class Pointer:
    """One small text under a folder, in versions: the highest file ``current-N`` is in force.

    A version is written aside and put in place at once, and only if nobody else put one there: by a link on a
    local disk, by a rename that refuses to overwrite on HDFS, by an exclusive create elsewhere.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._root)

    def file(self, name: str):  # noqa: ANN201
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._root)]
        return sorted(int(n[8:]) for n in names if n.startswith("current-") and n[8:].isdigit())

    def version(self) -> int:
        """The number of the version in force, 0 before the first."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> str | None:
        """The text of a version, by default the one in force; None before the first."""
        version = self.version() if version is None else version
        if not version:
            return None
        stream = self.fs.open(self.file(f"current-{version}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, file, text: str, overwrite: bool) -> None:  # noqa: ANN001
        out = self.fs.create(file, overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def swap(self, text: str, base: int) -> int:
        """Puts ``text`` in force as the version after ``base``; ``RuntimeError``, and nothing changed, if that exists already."""
        jvm = self.spark._jvm
        target, aside = self.file(f"current-{base + 1}"), self.file(f".aside-{uuid.uuid4().hex}")
        scheme = self.fs.getUri().getScheme()
        won = False
        try:
            if scheme == "file":
                self._write(aside, text, True)
                place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(place(target), place(aside))
                won = True
            elif scheme == "hdfs":
                self._write(aside, text, True)
                won = self.fs.rename(aside, target)
            else:
                self._write(target, text, False)
                won = True
        except Exception as e:  # noqa: BLE001 - the exists exceptions of the file systems have no common class
            if not self.fs.exists(target):
                raise
            raise RuntimeError(f"version {base + 1} was committed by another run") from e
        finally:
            self.fs.delete(aside, False)
        if not won:
            raise RuntimeError(f"version {base + 1} was committed by another run")
        return base + 1


class StateStore:
    """Versions of a state table (state_key, state_hash, saved_at, filename) under one folder, one of them in force.

    A version names a folder for each bucket of keys; a commit rewrites only the buckets its keys fall in, so its
    cost follows the batch and not the history. It may carry the number of a batch, by which a batch that
    is run again after it was committed is known.
    """

    COLUMNS = "state_key string, state_hash string, saved_at timestamp, filename string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.pointer = spark, path.rstrip("/"), Pointer(spark, path)
        self.buckets = self._manifest().get("buckets", buckets)

    def _manifest(self, version: int | None = None) -> dict:
        text = self.pointer.read(version)
        return json.loads(text) if text else {"folders": {}, "batches": {}}

    def version(self) -> int:
        """The number of the version in force, 0 before the first."""
        return self.pointer.version()

    def committed(self, source: str) -> int:
        """The highest batch number of ``source`` that was committed, -1 before the first."""
        return self._manifest()["batches"].get(source, -1)

    def _read(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.COLUMNS)
        return self.spark.read.schema(self.COLUMNS).parquet(*(f"{self.path}/{name}/bucket={b}" for b, name in sorted(folders.items())))

    def read(self) -> DataFrame:
        """The state in force; empty before the first commit."""
        return self._read(self._manifest()["folders"])

    def commit(self, processed: DataFrame, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Puts ``processed`` (state_key, state_hash, and saved_at, filename if there) in force; the new version's number.

        Entries replace those of the same key; of several for one key that with the latest saved_at, then the highest hash, counts.
        ``base`` is the version the run started from; if another run has
        committed since, nothing is changed and ``RuntimeError`` is raised.
        """
        base = self.version() if base is None else base
        manifest = self._manifest(base)
        extra = lambda c, t: F.col(c).cast(t) if c in processed.columns else F.lit(None).cast(t)
        rows = processed.select("state_key", "state_hash", extra("saved_at", "timestamp").alias("saved_at"), extra("filename", "string").alias("filename")).filter("state_key IS NOT NULL")
        newest = rows.groupBy("state_key").agg(F.max(F.struct("saved_at", "state_hash", "filename")).alias("x")).select("state_key", "x.state_hash", "x.saved_at", "x.filename")
        bucket = F.pmod(F.xxhash64("state_key"), F.lit(self.buckets)).cast("int")
        new = cut(newest.withColumn("bucket", bucket))
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most one row a bucket
        if touched:
            name = f"state-{base + 1}-{uuid.uuid4().hex}"
            old = self._read({b: f for b, f in manifest["folders"].items() if int(b) in set(touched)}).withColumn("bucket", bucket)
            kept = old.join(new.select("state_key"), "state_key", "left_anti")
            kept.unionByName(new).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
            manifest["folders"].update({str(b): name for b in touched})
        if batch:
            manifest["batches"][batch[0]] = batch[1]
        return self.pointer.swap(json.dumps({**manifest, "buckets": self.buckets}), base)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the last ``keep`` versions names, and older pointers; how many folders."""
        versions = self.pointer.versions()
        used = {f for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        gone = 0
        for v in versions[:-keep]:
            self.pointer.fs.delete(self.pointer.file(f"current-{v}"), False)
        for status in self.pointer.fs.listStatus(self.pointer._root):
            name = status.getPath().getName()
            number = name.split("-")[1] if name.startswith("state-") else ""
            # A folder of a version to come may belong to a run that is still at work.
            if number.isdigit() and int(number) <= versions[-1] and name not in used:
                gone += bool(self.pointer.fs.delete(status.getPath(), True))
        return gone


def run_incremental(
    store: StateStore, rows: DataFrame, id_column: str, key: Column, row_hash: Column, process: Callable[[DataFrame], None],
    saved_at: Column | None = None, filename: Column | None = None,
) -> int:
    """One run: freezes ids, keys and hashes, selects, calls ``process(selected ids)`` and commits what was frozen; the new version.

    If ``process`` raises, the state stays as it was, and the next run selects the same rows again. A row whose
    hash changes in ``rows`` meanwhile is committed with the hash it had, so the next run selects it.
    """
    base = store.version()
    none = lambda t: F.lit(None).cast(t)
    frozen = cut(rows.select(
        F.col(id_column).alias("_id"), key.alias("state_key"), row_hash.alias("state_hash"),
        (none("timestamp") if saved_at is None else saved_at).alias("saved_at"), (none("string") if filename is None else filename).alias("filename"),
    ))
    todo = new_or_changed(frozen, store.read(), "_id", F.col("state_key"), F.col("state_hash"))
    process(todo.withColumnRenamed("_id", id_column))
    return store.commit(frozen, base)
