"""Request pacing, retries and backoff as windows over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pagelake.session import cut


#: Events of one block, about: what one task sorts.
BLOCK = 1 << 18


def blocks(rows: DataFrame, key: list[str], order: list[str], carried: dict[str, Column], blocks: int | None = None) -> tuple[DataFrame, DataFrame, WindowSpec]:
    """The rows with the block they fall in, (key, _block, carried) with the sums of the blocks before, and the window within a block.

    Running sums over a key's ordered events need no task that holds them all: the rows are divided by ranges
    of key and order into blocks of about ``BLOCK`` rows, each block is summed up, and only the sums run along the key.
    ``blocks`` sets their number. The division is written once, so all parts of a plan see the same.
    """
    names = [f"_at{k}" for k in range(len(order))]
    kept = rows.withColumns(dict(zip(names, map(F.col, order), strict=True)))
    if blocks is None:
        blocks = max(1, -(-rows.count() // BLOCK))
    divided = cut(kept.repartitionByRange(blocks, *key, *names).withColumn("_block", F.spark_partition_id()).drop(*names))
    sums = divided.groupBy(*key, "_block").agg(*(c.alias(n) for n, c in carried.items()))
    along = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, "_block", *(F.coalesce(F.sum(n).over(along), F.lit(0)).alias(n) for n in carried))
    return divided, before, Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _earlier(parts: DataFrame, key: list[str], value: str) -> Column:
    """The greatest ``value`` of a key's earlier blocks, NULL in its first one."""
    return F.max(value).over(Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))


def schedule(arrivals: DataFrame, delay: Column, key: list[str], order: list[str], arrival: str = "arrival", blocks_: int | None = None) -> DataFrame:
    """Adds ``start``: each request starts at its arrival or ``delay`` after the one before, whatever is later.

    The recurrence has a closed form, a running maximum of arrival minus place
    times delay, which is taken within blocks and carried from block to block.
    """
    divided, before, w = blocks(arrivals, key, order, {"_n": F.count("*")}, blocks_)
    placed = divided.join(before, [*key, "_block"]).withColumn("_place", (F.row_number().over(w) - 1 + F.col("_n")) * delay)
    own = placed.withColumn("_most", F.max(F.col(arrival) - F.col("_place")).over(w))
    ends = own.groupBy(*key, "_block").agg(F.max("_most").alias("_end"))
    ends = ends.select(*key, "_block", _earlier(ends, key, "_end").alias("_before"))
    start = F.greatest("_most", "_before") + F.col("_place")
    return own.join(ends, [*key, "_block"]).select(*arrivals.columns, start.alias("start"))


def per_minute(requests: DataFrame, time: str, key: list[str]) -> DataFrame:
    """Requests of each key and minute, to audit a rate."""
    return requests.groupBy(*key, F.date_trunc("minute", time).alias("minute")).agg(F.count("*").alias("requests"))


def backoff(
    events: DataFrame, key: str, order: list[str], throttled: Column, base: float = 2.0, most: float = 60.0, retry_after: Column | None = None,
    configured: Column | None = None, crawl_delay: Column | None = None, blocks_: int | None = None,
) -> DataFrame:
    """Adds ``consecutive`` throttled answers so far and the ``delay`` they ask for; any success starts anew.

    ``retry_after`` is what an answer asks for itself and goes before the computed delay. Where ``configured`` isn't
    true, throttled answers are ignored. ``crawl_delay`` is what a robots file asks for at an event: a domain's first one that isn't
    NULL holds from there on, whatever later ones say, and no delay is less.
    """
    hit = F.coalesce(throttled, F.lit(False)) & (F.lit(True) if configured is None else F.coalesce(configured, F.lit(False)))
    rows = events.withColumns({"_throttled": hit, "_asked": F.lit(None).cast("double") if crawl_delay is None else crawl_delay.cast("double")})
    divided, _, w = blocks(rows, [key], order, {"_rows": F.count("*")}, blocks_)
    # Throttled answers since the last success in the block, and whether there was one.
    divided = divided.withColumn("_island", F.sum((~F.col("_throttled")).cast("long")).over(w))
    inner = Window.partitionBy(key, "_block", "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = divided.withColumns({"_run": F.sum(F.col("_throttled").cast("long")).over(inner), "_first": F.first("_asked", ignorenulls=True).over(w)})
    at = F.struct(*order)
    ends = own.groupBy(key, "_block").agg(F.max(F.struct(at.alias("at"), F.col("_run").alias("n")))["n"].alias("_tail"), F.max("_island").alias("_any"), F.min(F.when(F.col("_asked").isNotNull(), F.struct(at.alias("at"), "_asked")))["_asked"].alias("_lock"))
    along = Window.partitionBy(key).orderBy("_block")
    # A block without a success adds its run to that of the block before it.
    ends = ends.withColumn("_group", F.sum((F.col("_any") > 0).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    tail = F.sum("_tail").over(Window.partitionBy(key, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_sum", tail)
    ends = ends.select(key, "_block", F.coalesce(F.lag("_sum").over(along), F.lit(0)).alias("_carry"), F.first("_lock", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_held"))
    both = own.join(ends, [key, "_block"])
    consecutive = F.col("_run") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    grown = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), consecutive - 1))
    wait = grown if retry_after is None else F.coalesce(retry_after, grown)
    wait = F.greatest(F.when(F.col("_throttled"), wait).otherwise(0.0), F.coalesce("_held", "_first", F.lit(0.0)))
    return both.select(*events.columns, consecutive.alias("consecutive"), wait.alias("delay"))


def within_budget(attempts: DataFrame, key: list[str], order: list[str], failed: Column, budget: int = 3) -> DataFrame:
    """(key, attempts, failed): whether none of the first ``budget`` attempts of each request succeeded; attempts up to the first success."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    tried = attempts.withColumn("_n", rank).filter(F.col("_n") <= budget)
    success = F.min(F.when(~failed, F.col("_n")))
    return tried.groupBy(*key).agg(F.coalesce(success, F.max("_n")).cast("long").alias("attempts"), success.isNull().alias("failed"))


def folded(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The snapshot of each key: of every column the last value that isn't NULL, by a partial aggregate without a window."""
    at = F.struct(*order)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"].alias(c)
    return events.groupBy(key).agg(*map(last, columns))


def active(changes: DataFrame, key: list[str], order: list[str], change: str, blocks_: int | None = None) -> DataFrame:
    """Adds ``active``: the running sum of +1 and -1, not below 0 at any event.

    A sum kept from falling below 0 is the plain sum less its least value so far, if that is negative; both are carried from block to block.
    """
    divided, before, w = blocks(changes, key, order, {"_carry": F.sum(change)}, blocks_)
    own = divided.join(before, [*key, "_block"]).withColumn("_sum", F.sum(change).over(w) + F.col("_carry"))
    own = own.withColumn("_least", F.min("_sum").over(w))
    ends = own.groupBy(*key, "_block").agg((-F.min("_sum")).alias("_end"))
    ends = ends.select(*key, "_block", (-_earlier(ends, key, "_end")).alias("_before"))
    least = F.least(F.lit(0), "_least", F.coalesce("_before", F.lit(0)))
    return own.join(ends, [*key, "_block"]).select(*changes.columns, (F.col("_sum") - least).alias("active"))
