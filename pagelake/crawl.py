"""A whole run over fetched pages: filter, export, languages, duplicates, state and report. ``python -m pagelake`` starts it."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake import config
from pagelake.functions import text_language, urls
from pagelake.operators import export, freshness, frontier, links, registry, report
from pagelake.operators.incremental import StateStore
from pagelake.session import cut, local_session
from pagelake.sources import fetch

Listener = Callable[[Mapping[str, Any]], None]


def logger(folder: str | Path) -> logging.Logger:
    """A logger to the console and to ``pagelake.log`` under ``folder``; called again it starts anew."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("pagelake")
    log.setLevel(logging.INFO)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    form = logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s", "%Y-%m-%d %H:%M:%S")
    for handler in (logging.StreamHandler(), logging.FileHandler(Path(folder) / "pagelake.log", encoding="utf-8")):
        handler.setFormatter(form)
        log.addHandler(handler)
    return log


def crawl(spark: SparkSession, settings: config.Settings, pages: DataFrame, rendered: DataFrame | None = None, tell: Listener | None = None) -> dict[str, Any]:
    """One run over ``pages`` (url, html, and content_language if there); the report's payload, which is also written.

    ``rendered`` (url, html) are pages rendered on their own, for those without content. ``tell`` is told every phase. Files go to
    output_dir, state and registry to state_dir; both are folders all executors share.
    """
    started = datetime.now(UTC)
    said: dict[str, Any] = {}

    def step(phase: str, **figures: Any) -> None:
        said.update(figures)
        if tell:
            tell({"phase": phase, **said})

    store = StateStore(spark, f"{settings.state_dir}/urls")
    base = store.version()
    known = store.read().select(F.col("state_key").alias("url"), "saved_at", F.col("state_hash").alias("content_hash"))
    rows = pages.withColumn("url", urls.normalize(F.col("url"))).filter(F.col("url").isNotNull())
    scoped = urls.in_scope(F.col("url"), F.lit(settings.start_url))
    outside = rows.filter(~scoped).select("url").distinct().count()
    ordered = rows.filter(scoped).withColumn("ord", F.monotonically_increasing_id())
    split = cut(freshness.split_fresh(ordered, known, F.lit(started), settings.refresh_hours, settings.force_refresh))
    skipped = [r["url"] for r in split.filter("fresh").select("url").orderBy("url").collect()]  # one site's report
    step("selected", rejected_urls=outside, incremental_skipped=len(skipped), discovered=split.count())
    todo = rows.join(split.filter("NOT fresh").select("url"), "url", "left_semi").dropDuplicates(["url"])
    docs = cut(export.documents(todo))
    step("exported")
    texts = docs.withColumn("_d", F.when(F.col("language").isNull(), text_language.from_text(F.col("visible_text"))))
    english = F.coalesce(F.col("_d.is_english"), F.split_part(F.col("language"), F.lit("-"), F.lit(1)) == "en")
    texts = texts.withColumns({"is_english": english, "language": F.coalesce("language", "_d.language_code")})
    same = freshness.unchanged(texts.select("url", "content_hash"), known)
    facts = texts.join(same, "url", "left").select("url", F.when(~F.col("is_empty"), F.col("markdown")).alias("content"), F.size("links").alias("links"), "unchanged", "is_english")
    later = None
    if rendered is not None:
        shots = cut(export.documents(rendered.withColumn("url", urls.normalize(F.col("url"))).filter("url IS NOT NULL")))
        later = shots.select("url", F.col("markdown").alias("content"))
        fields = ("title", "output_path", "content_hash", "markdown")
        texts = texts.join(shots.select("url", *(F.col(c).alias(f"_{c}") for c in fields)), "url", "left")
        texts = texts.withColumns({c: F.when(F.col("is_empty"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in fields})
    outcomes = cut(report.page_outcomes(facts, later, settings.mode != "http"))
    good = texts.join(outcomes.filter("outcome IN ('saved', 'unchanged')").select("url", "outcome", "used_fallback"), "url")
    good = cut(good.select("url", "title", "language", "markdown", "output_path", "content_hash", "outcome", "used_fallback", F.xxhash64("url").alias("seq")))
    held = registry.Registry(spark, f"{settings.state_dir}/registry")
    decided = held.register(good.filter("outcome = 'saved'"))
    fresh = good.join(decided.filter("decision IN ('canonical', 'conflict')").select("seq"), "seq", "left_semi")
    written = cut(export.write_files(fresh, settings.output_dir))
    report.append_dataset(fresh.withColumnRenamed("used_fallback", "browser_fallback"), f"{settings.state_dir}/dataset")
    step("written", files=written.count())
    store.commit(good.select(F.col("url").alias("state_key"), F.col("content_hash").alias("state_hash"), F.lit(started).alias("saved_at"), F.col("output_path").alias("filename")), base)
    by = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    duplicates = decided.filter("decision = 'duplicate'").count()
    counts = {
        "processed": sum(by.values()), "saved": by.get("saved", 0) - duplicates + by.get("unchanged", 0), "duplicate_content": duplicates, "rejected_urls": outside,
        "empty_pages": by.get("discovery_only", 0), "non_english": by.get("non_english", 0), "failed": by.get("failed", 0),
    }
    payload = report.crawl_report(report.stats_payload(counts, settings.mode, started, datetime.now(UTC), skipped), {"start_url": settings.start_url, "refresh_hours": settings.refresh_hours})
    report.write_json(payload, settings.state_dir.removeprefix("file://"))
    step("finished", **counts)
    return payload


def inventory(spark: SparkSession, settings: config.Settings, answers: DataFrame, listed: DataFrame | None = None) -> dict[str, Any]:
    """What a site has, over its fetched ``answers`` (of ``sources.fetch``) and the addresses its site maps list (url): the payload, also written."""
    start = F.lit(settings.start_url)
    rows = answers.withColumn("url", urls.normalize(F.col("url"), keep_slash=True)).filter("url IS NOT NULL").dropDuplicates(["url"])
    docs = cut(export.documents(rows.filter("html IS NOT NULL").select("url", "html", "content_language")))
    edges = links.edges(docs.select("url", "links"), F.col("links")).select("src_url", "dst_url")
    listed = spark.createDataFrame([], "url string") if listed is None else listed
    seeds, figures = frontier.add_discovered(listed.unionByName(spark.createDataFrame([(settings.start_url,)], "url string")), spark.createDataFrame([], "url string"), start)
    found = frontier.levels(seeds, edges, most_urls=settings.max_requests)
    decided = docs.withColumn("_d", text_language.from_text(F.col("visible_text")))
    english = F.coalesce(F.split_part(F.col("language"), F.lit("-"), F.lit(1)) == "en", F.col("_d.is_english"))
    outcome = report.fetch_outcome(F.lit(False), F.col("error_kind"), F.col("status"), F.col("content_type"))
    redirected = F.coalesce(urls.normalize(F.col("final_url")) != urls.normalize(F.col("url")), F.lit(False))
    facts = rows.select("url", outcome.alias("outcome"), redirected.alias("is_redirect")).join(decided.select("url", english.alias("is_english")), "url", "left")
    counts = frontier.counters(found, facts, settings.max_requests).first().asDict()
    payload = report.inventory_payload(settings.start_url, {**counts, "duplicate_urls": figures.first()["duplicate_urls"], "sitemap_urls": listed.count()})
    report.write_json(payload, settings.state_dir.removeprefix("file://"), "site-inventory.json")
    return payload


def main(arguments: list[str] | None = None) -> int:
    """Exit code of a run over a table of pages (``--pages``), or over addresses that are fetched (``--urls``, one a line)."""
    parser = config.parser()
    parser.add_argument("--pages", help="a Parquet table of url, html")
    parser.add_argument("--urls", help="a file of addresses to fetch")
    parser.add_argument("--inventory-only", action="store_true")
    given = vars(parser.parse_args(arguments))
    pages, listed, only = given.pop("pages"), given.pop("urls"), given.pop("inventory_only")
    log = logging.getLogger("pagelake")
    try:
        settings = config.Settings.read(**given)
        log = logger(settings.state_dir.removeprefix("file://"))
        spark = SparkSession.getActiveSession() or local_session()
        if pages:
            rows = spark.read.parquet(pages)
        else:
            fetch.register(spark)
            asked = Path(listed).read_text() if listed else settings.start_url
            rows = cut(spark.read.format("pages").option("urls", asked).option("timeout", settings.timeout_seconds).option("requests_per_minute", settings.requests_per_minute).load())
        for name in ("content_language", "status", "final_url", "content_type", "error_kind"):
            if name not in rows.columns:
                rows = rows.withColumn(name, {"status": F.lit(200), "content_type": F.lit("text/html"), "final_url": F.col("url")}.get(name, F.lit(None).cast("string")))
        if only:
            payload = inventory(spark, settings, rows)
            log.info(report.inventory_text(payload))
            return report.inventory_exit(payload)
        payload = crawl(spark, settings, rows.filter("html IS NOT NULL"), tell=lambda event: log.info("%s", event))
        log.info("Finished: processed=%d saved=%d failed=%d", payload["processed"], payload["saved"], payload["failed"])
        return 0 if payload["failed"] == 0 else 1
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError) as e:
        log.error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
