"""Rendering as a provider's affair: the settings a browser is run with, and its pages as a snapshot table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.config import BLOCKED, BROWSERS


def words(values: tuple[str, ...] | frozenset[str] | list[str]) -> tuple[str, ...]:
    """The values that aren't blank, stripped."""
    return tuple(v.strip() for v in values if v.strip())


@dataclass(frozen=True)
class Rendering:
    """How pages are rendered; checked and in normal form."""

    headless: bool = True
    browser: str = "chromium"
    timeout_seconds: int = 60
    idle_milliseconds: int = 10_000
    blocked: frozenset[str] = frozenset(BLOCKED)
    arguments: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("browser", self.browser.strip().lower())
        put("blocked", frozenset(w.lower() for w in words(self.blocked)))
        put("arguments", words(self.arguments))
        if self.browser not in BROWSERS:
            raise ValueError(f"unknown browser: {self.browser!r}")
        for name in ("timeout_seconds", "idle_milliseconds"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    def blocks(self, resource: str) -> bool:
        """Whether a resource of this type isn't loaded."""
        return resource.strip().lower() in self.blocked

    def options(self, **more: object) -> dict[str, object]:
        """What a browser provider is started with; ``more`` goes before."""
        own = {"headless": self.headless, "browser_type": self.browser, "browser_launch_options": {"args": list(self.arguments)}}
        return {**own, **{k: v for k, v in more.items() if v is not None}}

    def report(self) -> dict[str, object]:
        """The settings as a report states them."""
        return {
            "headless": self.headless, "browser_type": self.browser, "request_timeout_seconds": self.timeout_seconds,
            "network_idle_timeout_milliseconds": self.idle_milliseconds, "blocked_resource_types": sorted(self.blocked), "browser_arguments": list(self.arguments),
        }


def route(rendering: Rendering, resources: DataFrame) -> DataFrame:
    """``resources`` (resource_type) with ``action``: abort for the types that are blocked, else continue."""
    kind = F.lower(F.trim(F.col("resource_type")))
    return resources.withColumn("action", F.when(kind.isin(*sorted(rendering.blocked)), "abort").otherwise("continue") if rendering.blocked else F.lit("continue"))


def with_rendered(pages: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``pages`` (url, html) whose html is the rendered one of ``snapshot`` (url, rendered_html) where there is one; ``is_rendered`` says so."""
    shots = snapshot.select("url", "rendered_html").filter("rendered_html IS NOT NULL").groupBy("url").agg(F.max("rendered_html").alias("rendered_html"))
    rows = pages.join(shots, "url", "left")
    return rows.withColumns({"is_rendered": F.col("rendered_html").isNotNull(), "html": F.coalesce("rendered_html", "html")}).drop("rendered_html")


def site(start_url: str, settings: Mapping[str, object] | None = None) -> dict[str, object]:
    """What a display says of a site: its address, domain and scope, and the settings given."""
    from urllib.parse import urlsplit

    p = urlsplit(start_url)
    return {"start_url": start_url, "domain": p.netloc or "—", "scope_path": p.path or "/", **(settings or {})}
