"""Settings of a crawl: arguments over environment over defaults, all checked."""

from __future__ import annotations

import argparse
import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

TRUE, FALSE = frozenset(("1", "true", "yes", "on")), frozenset(("0", "false", "no", "off"))
# Names by which the browser mode is also known, and the browsers.
MODES = {"http": "http", "playwright": "playwright", "browser": "playwright", "javascript": "playwright", "js": "playwright"}
BROWSERS = ("chromium", "firefox", "webkit")
BLOCKED = ("font", "image", "media", "websocket")


def integer(text: str, name: str, least: int = 1, most: int | None = None) -> int:
    try:
        value = int(str(text).strip())
    except ValueError:
        raise ValueError(f"{name} is no whole number: {text!r}") from None
    if value < least or (most is not None and value > most):
        raise ValueError(f"{name} is out of range: {value}")
    return value


def boolean(text: str, name: str) -> bool:
    word = str(text).strip().lower()
    if word not in TRUE | FALSE:
        raise ValueError(f"{name} is neither yes nor no: {text!r}")
    return word in TRUE


def mode(text: str) -> str:
    try:
        return MODES[text.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown mode: {text!r}") from None


def delay(text: str, name: str = "delay") -> float:
    """Seconds between requests: finite and not negative."""
    value = float(text)
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"{name} must be finite and not negative: {text!r}")
    return value


@dataclass(frozen=True)
class Settings:
    start_url: str = ""
    output_dir: str = "output"
    state_dir: str = "state"
    mode: str = "http"
    browser: str = "chromium"
    headless: bool = True
    language: str = "en"
    requests_per_minute: int = 6
    concurrency: int = 5
    max_requests: int = 10_000
    timeout_seconds: int = 60
    refresh_hours: int = 0
    force_refresh: bool = False
    respect_robots: bool = True
    blocked_resources: tuple[str, ...] = BLOCKED

    def __post_init__(self) -> None:
        integer(self.requests_per_minute, "requests_per_minute", 1, 60)
        integer(self.concurrency, "concurrency")
        integer(self.max_requests, "max_requests")
        integer(self.timeout_seconds, "timeout_seconds")
        integer(self.refresh_hours, "refresh_hours", 0, 8760)
        mode(self.mode)
        if self.browser not in BROWSERS:
            raise ValueError(f"unknown browser: {self.browser!r}")
        if self.language != "en":
            raise ValueError(f"unsupported language: {self.language!r}")

    @classmethod
    def read(cls, environment: Mapping[str, str] | None = None, prefix: str = "PAGELAKE_", **arguments: object) -> Settings:
        """Defaults, then ``PREFIX_NAME`` of the environment, then the arguments that aren't None."""
        environment = os.environ if environment is None else environment
        found: dict[str, object] = {}
        for f in fields(cls):
            text = environment.get(prefix + f.name.upper())
            if text is None or not text.strip():
                continue
            if f.type == "bool":
                found[f.name] = boolean(text, f.name)
            elif f.type == "int":
                found[f.name] = integer(text, f.name, 0)
            elif f.name == "mode":
                found[f.name] = mode(text)
            elif f.name == "blocked_resources":
                found[f.name] = tuple(sorted({x.strip().lower() for x in text.split(",") if x.strip()}))
            else:
                found[f.name] = text.strip().lower() if f.name in ("browser", "language") else text
        return replace(cls(), **found, **{k: v for k, v in arguments.items() if v is not None})


def parser() -> argparse.ArgumentParser:
    """Command-line arguments by the names of the settings."""
    p = argparse.ArgumentParser(prog="pagelake")
    p.add_argument("start_url")
    for f in fields(Settings)[1:]:
        if f.type == "bool":
            p.add_argument(f"--{f.name.replace('_', '-')}", type=lambda t, n=f.name: boolean(t, n), default=None)
        elif f.type == "int":
            p.add_argument(f"--{f.name.replace('_', '-')}", type=lambda t, n=f.name: integer(t, n, 0), default=None)
        elif f.name != "blocked_resources":
            p.add_argument(f"--{f.name.replace('_', '-')}", default=None)
    return p
