"""Pages and registrations as streams: the batch operators on each micro-batch, with state that survives restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelake.operators.incremental import StateStore, new_or_changed
from pagelake.session import cut


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sync(pages: DataFrame, store_path: str, key: Column, row_hash: Column, id_column: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch: new or changed rows go to ``sink``, then the state is committed together with the batch's number.

    A batch that is run again after a failure either finds its number
    uncommitted, and does its work again, or committed, and then ``sink`` isn't called.
    ``sink`` gets the batch number to make its own writes repeatable. The number counts within ``checkpoint``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        store = StateStore(rows.sparkSession, store_path)
        base = store.version()
        if number <= store.committed(checkpoint):
            return
        frozen = cut(rows.withColumns({"_key": key, "_hash": row_hash}))
        todo = new_or_changed(frozen, store.read(), id_column, F.col("_key"), F.col("_hash")).select(id_column).distinct()
        sink(frozen.join(todo, id_column, "left_semi").drop("_key", "_hash"), number)
        store.commit(frozen.select(F.col("_key").alias("state_key"), F.col("_hash").alias("state_hash")), base, (checkpoint, number))

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttle(events: DataFrame, base: float = 2.0, most: float = 60.0) -> DataFrame:
    """(domain, seq, consecutive, delay): backoff per domain over a stream of (domain, seq, throttled).

    State is one counter per domain. Events of one micro-batch are taken in the order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        found = []
        for throttled in rows["throttled"]:
            count = count + 1 if throttled else 0
            found.append(count)
        state.update((count,))
        delay = [min(most, base * 2.0 ** (n - 1)) if n else 0.0 for n in found]
        yield pd.DataFrame({"domain": key[0], "seq": rows["seq"], "consecutive": found, "delay": delay})

    return events.groupBy("domain").applyInPandasWithState(
        step, "domain string, seq long, consecutive long, delay double", "count long", "append", GroupStateTimeout.NoTimeout
    )


def per_minute(requests: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Requests per key and minute of a stream, late ones up to ``late``; the time must be a timestamp with zone."""
    return requests.withWatermark(time, late).groupBy(F.window(time, "1 minute"), key).agg(F.count("*").alias("requests"))
