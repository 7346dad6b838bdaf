"""Breadth-first traversal of a link graph, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.session import cut


def initial(seeds: DataFrame, listed: DataFrame) -> DataFrame:
    """(site, url, ord): where a crawl of each site begins: its seed, then the addresses of its site maps, each once at its first place.

    ``seeds`` has site and url, ``listed`` site, url and rank (from 1); addresses are compared as normalized.
    """
    at = lambda df, rank: df.select("site", urls.normalize(F.col("url")).alias("url"), rank.cast("long").alias("ord"))
    rows = at(seeds, F.lit(0)).unionByName(at(listed, F.col("rank"))).filter("url IS NOT NULL")
    return rows.groupBy("site", "url").agg(F.min("ord").alias("ord"))


def add_discovered(found: DataFrame, known: DataFrame, start: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The addresses of ``found`` (url) that ``known`` (url) doesn't hold, normalized, their slash kept; and (added, duplicate_urls), one row.

    An address out of the scope of ``start`` is neither; one that is known or comes again counts as a duplicate each time.
    """
    rows = found.select(urls.normalize(F.col("url"), keep_slash=True).alias("url")).filter("url IS NOT NULL")
    if start is not None:
        rows = rows.filter(urls.in_scope(F.col("url"), start))
    counted = rows.groupBy("url").agg(F.count("*").alias("times"))
    seen = known.select(urls.normalize(F.col("url"), keep_slash=True).alias("url")).distinct().withColumn("_known", F.lit(True))
    marked = counted.join(seen, "url", "left")
    new = F.col("_known").isNull()
    figures = marked.agg(F.count_if(new).alias("added"), F.coalesce(F.sum(F.col("times") - F.when(new, 1).otherwise(0)), F.lit(0)).alias("duplicate_urls"))
    return marked.filter(new).select("url"), figures


def levels(seeds: DataFrame, edges: DataFrame, most_depth: int | None = None, most_urls: int | None = None) -> DataFrame:
    """(url, depth): addresses reachable from ``seeds`` (url) over ``edges`` (src_url, dst_url), at their least depth.

    Each level is one join with the edges and one anti join with what is known,
    written to the shared folder, so lineage doesn't grow and a lost executor
    repeats one level. ``most_urls`` ends the walk after the level that reaches
    it, keeping the first addresses by depth and address. NULLs lead nowhere.
    """
    # Every level reads the edges: they are computed once.
    edges = cut(edges.select("src_url", "dst_url").filter("src_url IS NOT NULL AND dst_url IS NOT NULL").distinct())
    found = cut(seeds.select("url").filter("url IS NOT NULL").distinct().withColumn("depth", F.lit(0).cast("long")))
    front, depth, total = found, 0, None
    while most_depth is None or depth < most_depth:
        depth += 1
        step = front.select(F.col("url").alias("src_url")).join(edges, "src_url").select(F.col("dst_url").alias("url"))
        step = step.filter("url IS NOT NULL").distinct().join(found.select("url"), "url", "left_anti")
        front = cut(step.withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if most_urls is not None:
            total = found.count()
            if total >= most_urls:
                break
    return found if most_urls is None else found.orderBy("depth", "url").limit(most_urls)


def counters(found: DataFrame, outcomes: DataFrame, most: int) -> DataFrame:
    """One row on an inventory: ``outcomes`` has url and outcome, is_redirect, is_english of each fetch.

    It is complete if nothing is left and fewer than ``most`` addresses were processed.
    """
    rows = found.join(outcomes, "url", "left")
    done = F.col("outcome").isNotNull()
    hit = lambda o: F.count_if(F.col("outcome") == o)
    counted = rows.agg(
        F.count("*").alias("discovered_urls"), F.count_if(done).alias("processed_urls"), hit("reachable").alias("reachable_pages"), hit("robots_blocked").alias("robots_blocked"),
        hit("not_found").alias("not_found_pages"), hit("timeout").alias("timeouts"), hit("failed").alias("failed_pages"), F.count_if("is_redirect").alias("redirects"),
        F.count_if((F.col("outcome") == "reachable") & F.col("is_english")).alias("english_urls"), F.count_if((F.col("outcome") == "reachable") & ~F.coalesce("is_english", F.lit(False))).alias("non_english_urls"),
    )
    left = F.col("discovered_urls") - F.col("processed_urls")
    return counted.withColumns({"remaining_urls": left, "discovery_complete": (left == 0) & (F.col("processed_urls") < most)})
