"""Counters and derived figures of crawls and inventories."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators import pacing

# The outcomes a crawl counts, by the name of their counter.
OUTCOMES = ("saved", "duplicate_content", "incremental_skipped", "rejected_urls", "empty_pages", "non_english", "failed")


def counters(outcomes: DataFrame, key: list[str], outcome: str = "outcome") -> DataFrame:
    """One row per key: pages processed and each counter."""
    return outcomes.groupBy(*key).agg(
        F.count_if(~F.col(outcome).isin("incremental_skipped", "failed")).alias("processed"), *(F.count_if(F.col(outcome) == o).alias(o) for o in OUTCOMES)
    )


def with_progress(rows: DataFrame, most: Column, elapsed: Column) -> DataFrame:
    """Adds the figures a progress view shows; ``rows`` has the counters, queued and discovered."""
    c = F.col
    found = F.greatest(c("discovered"), c("processed") + c("queued"))
    total = F.when(found > 0, F.least(F.greatest(found, c("processed")), most)).otherwise(most)
    done = sum((c(o) for o in OUTCOMES[1:]), c(OUTCOMES[0]))
    good = c("saved") + c("duplicate_content") + c("incremental_skipped")
    rows = rows.withColumns({"completed_requests": done, "progress_total": total, "elapsed_seconds": elapsed})
    return rows.withColumns({
        "progress_completed": F.least(c("processed"), c("progress_total")),
        "requests_per_minute": F.when(c("elapsed_seconds") > 0, c("processed") / c("elapsed_seconds") * 60.0).otherwise(0.0),
        "success_rate": F.least(F.lit(100.0), good / F.greatest(c("completed_requests"), c("processed"), F.lit(1)) * 100.0),
        "skipped_total": c("duplicate_content") + c("incremental_skipped") + c("rejected_urls") + c("empty_pages") + c("non_english"),
        "exit_code": F.when(c("failed") == 0, 0).otherwise(1),
    })


def summary(processed: Column, saved: Column, duplicate: Column, skipped: Column, non_english: Column, failed: Column) -> Column:
    """The final line other programs parse."""
    return F.format_string(
        "Finished: processed=%d saved=%d duplicate=%d incremental_skipped=%d non_english=%d failed=%d", processed, saved, duplicate, skipped, non_english, failed
    )


def duration(seconds: Column) -> Column:
    """HH:MM:SS, rounded down, not below zero."""
    s = F.greatest(F.lit(0), F.floor(seconds).cast("long"))
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60)


def percentage(part: Column, whole: Column) -> Column:
    """A share from 0 to 100 with one digit in a field of six characters."""
    return F.when(whole > 0, F.format_string("%5.1f%%", F.least(F.lit(100.0), F.greatest(F.lit(0.0), part / whole * 100.0)))).otherwise("  0.0%")


def status(interrupted: Column, failed: Column) -> Column:
    return F.when(interrupted, "interrupted").when(failed > 0, "failures").otherwise("success")


def mark(flag: Column) -> Column:
    return F.when(flag, "✓ enabled").otherwise("✗ disabled")


def fetch_outcome(robots_blocked: Column, error_kind: Column, http_status: Column, content_type: Column) -> Column:
    """What came of one fetch; redirects are counted beside it."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(robots_blocked, "robots_blocked").when(error_kind == "timeout", "timeout").when(error_kind.isNotNull(), "failed")
        .when(http_status == 404, "not_found").when(http_status >= 400, "failed")
        .when(~kind.contains("text/html") & ~kind.contains("application/xhtml+xml"), "failed").otherwise("reachable")
    )


def page_outcomes(pages: DataFrame, rendered: DataFrame | None = None, browser: bool = False) -> DataFrame:
    """(url, outcome, content, used_fallback): what became of each of ``pages`` (url, content, links, unchanged, is_english).

    A page of another language is non_english and goes no further. Without a browser a page without content, or one
    that has neither content nor links, is looked up in ``rendered`` (url, content), the snapshot of pages
    rendered on their own; what is found there is its content. A page with content is unchanged
    or saved, one with links alone discovery_only, the rest failed. NULL content is none; NULL is_english is English.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    rows = pages.select("url", some(F.col("content")).alias("_own"), F.coalesce("links", F.lit(0)).alias("_links"), F.coalesce("unchanged", F.lit(False)).alias("_same"), F.coalesce("is_english", F.lit(True)).alias("_english"))
    if rendered is None or browser:
        rows = rows.withColumn("_later", F.lit(None).cast("string"))
    else:
        rows = rows.join(rendered.select("url", some(F.col("content")).alias("_later")).groupBy("url").agg(F.max("_later").alias("_later")), "url", "left")
    content = F.coalesce("_own", "_later")
    outcome = (
        F.when(~F.col("_english"), "non_english").when(content.isNotNull() & F.col("_same"), "unchanged").when(content.isNotNull(), "saved")
        .when(F.col("_links") > 0, "discovery_only").otherwise("failed")
    )
    kept = outcome.isin("saved", "unchanged")
    return rows.select("url", outcome.alias("outcome"), F.when(kept, content).alias("content"), (kept & F.col("_own").isNull()).alias("used_fallback"))


def running(events: DataFrame, key: list[str], order: list[str], outcome: str = "outcome") -> DataFrame:
    """The counters as each event leaves them: what a crawl tells its listener after every page.

    A key's events are counted block by block and the blocks' sums carried over, so that no task holds all events of a hot key.
    """
    ones = {o: (F.col(outcome) == o).cast("long") for o in OUTCOMES}
    ones["processed"] = (~F.col(outcome).isin("incremental_skipped", "failed")).cast("long")
    rows, carried, local = pacing.blocks(events, key, order, {n: F.sum(F.coalesce(c, F.lit(0))) for n, c in ones.items()})
    sums = {n: F.sum(F.coalesce(c, F.lit(0))).over(local) for n, c in ones.items()}
    own = rows.withColumns({f"_{n}": c for n, c in sums.items()})
    both = own.join(carried, [*key, "_block"])
    return both.select(*events.columns, *((F.col(f"_{n}") + F.col(n)).alias(n) for n in ones))


def inventory_progress(row: Mapping[str, int], discovered: int, queued: int) -> str:
    """The line an inventory prints as it goes."""
    classified = row["english_urls"] + row["non_english_urls"]
    problems = row["robots_blocked"] + row["not_found_pages"] + row["timeouts"] + row["failed_pages"]
    figures = {
        "processed": f"{row['processed_urls']}/{discovered}", "queued": queued, "reachable": row["reachable_pages"], "classified": classified,
        "english": row["english_urls"], "non_english": row["non_english_urls"], "blocked": row["robots_blocked"], "404": row["not_found_pages"],
        "timeouts": row["timeouts"], "failed": row["failed_pages"], "problems": problems,
    }
    return " | ".join(["Inventory progress", *(f"{k}={v}" for k, v in figures.items())])


def plain(value: Any) -> Any:
    """A value as JSON takes it: paths and unknown values as text, times in UTC, mappings and sets sorted."""
    match value:
        case None | str() | bool() | int() | float():
            return value
        case datetime():
            return value.astimezone(UTC).isoformat()
        case Mapping():
            return {str(k): plain(v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))}
        case list() | tuple():
            return [plain(v) for v in value]
        case set() | frozenset():
            return sorted(plain(v) for v in value)
    return str(value)


def write_json(payload: Mapping[str, Any], directory: str | Path, filename: str = "crawl-report.json") -> Path:
    """Writes a report at once: a reader sees the old file or the whole new one."""
    if not filename.strip():
        raise ValueError("a report needs a file name")
    folder = Path(directory).expanduser().resolve()
    folder.mkdir(parents=True, exist_ok=True)
    aside = folder / f".{filename}.{os.getpid()}"
    try:
        aside.write_text(json.dumps(plain(payload), indent=2, ensure_ascii=False, sort_keys=True) + "\n", encoding="utf-8")
        os.replace(aside, folder / filename)
    finally:
        aside.unlink(missing_ok=True)
    return folder / filename


# The counters of a stats payload, in its order.
STATS = (
    "processed", "saved", "duplicate_content", "rejected_urls", "empty_pages", "non_english", "failed", "sitemap_urls", "sitemap_files_checked",
    "sitemap_files_found", "sitemap_errors", "incremental_skipped",
)


def stats_payload(counts: Mapping[str, Any], mode: str, started_at: datetime, finished_at: datetime, skipped: list[str] | None = None) -> dict[str, Any]:
    """The figures of one crawl as its report states them: times in UTC, skipped addresses sorted and counted once."""
    urls_skipped = sorted(set(skipped or ()))
    payload = {"started_at": plain(started_at), "finished_at": plain(finished_at), "mode": mode, **{name: int(counts.get(name) or 0) for name in STATS}}
    if skipped is not None:
        payload["incremental_skipped"] = len(urls_skipped)
    return {**payload, "incremental_skipped_urls": urls_skipped}


def crawl_report(stats: Mapping[str, Any], configuration: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A stats payload with the configuration it was made under, if any."""
    return {**({} if configuration is None else {"configuration": plain(configuration)}), **stats}


# The figures of an inventory by the labels of its printed form.
INVENTORY = {
    "Sitemap URLs": "sitemap_urls", "Discovered URLs": "discovered_urls", "English URLs": "english_urls", "Non-English URLs": "non_english_urls",
    "Robots blocked": "robots_blocked", "Duplicate URLs": "duplicate_urls", "Redirects": "redirects", "Reachable pages": "reachable_pages",
    "404 pages": "not_found_pages", "Timeouts": "timeouts", "Other failures": "failed_pages", "Processed URLs": "processed_urls", "Remaining URLs": "remaining_urls",
}


def inventory_payload(seed_url: str, counts: Mapping[str, Any]) -> dict[str, Any]:
    """An inventory's figures, missing ones 0, with its seed and whether it is complete."""
    names = [*INVENTORY.values(), "sitemap_files_checked", "sitemap_files_found", "sitemap_errors"]
    return {"seed_url": seed_url, **{n: int(counts.get(n) or 0) for n in names}, "discovery_complete": bool(counts.get("discovery_complete"))}


def inventory_text(payload: Mapping[str, Any]) -> str:
    """An inventory as it is printed."""
    rule = "=" * 52
    figures = [f"{label + ':':<21}{payload[name]}" for label, name in INVENTORY.items()]
    done = "YES" if payload["discovery_complete"] else "NO"
    return "\n".join([rule, "SITE INVENTORY", rule, "", "Seed URL:", payload["seed_url"], "", *figures, "", f"{'Discovery complete:':<21}{done}"])


def inventory_exit(counts: Mapping[str, Any]) -> int:
    """0 for a complete inventory, 2 for one that stopped before."""
    return 0 if counts.get("discovery_complete") else 2


def append_dataset(pages: DataFrame, path: str) -> None:
    """Appends (url, title, language, output_path, content_hash, browser_fallback) of saved pages to a dataset."""
    flag = F.col("browser_fallback") if "browser_fallback" in pages.columns else F.lit(False)
    pages.select("url", "title", "language", "output_path", "content_hash", flag.alias("browser_fallback")).write.mode("append").parquet(path)


def dashboard(site: Mapping[str, Any], row: Mapping[str, Any], width: int = 40) -> str:
    """What a terminal shows of a crawl: the site, a bar of its progress and the figures of ``with_progress``."""
    total, done = max(1, int(row["progress_total"])), int(row["progress_completed"])
    share = min(1.0, max(0.0, done / total))
    bar = "█" * int(share * width) + "░" * (width - int(share * width))
    figures = [f"{name.replace('_', ' ')}: {row[name]}" for name in ("saved", "duplicate_content", "incremental_skipped", "empty_pages", "non_english", "failed", "queued") if name in row]
    return "\n".join([f"{site['domain']}{site['scope_path']}", f"{bar} {share * 100:5.1f}% {done}/{total}", f"{row['requests_per_minute']:.1f} pages a minute", *figures])
