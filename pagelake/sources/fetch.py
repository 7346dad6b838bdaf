"""Pages over HTTP: a fetch of one address with all its checks, and a data source that fetches many, partitioned by host.

``spark.read.format("pages")`` after ``register`` gives one row for each address of
``option("urls", ...)`` (one a line): url, status, final_url, content_type, content_language, html, error_kind. A host's addresses stay in
one partition and are fetched in order at ``requests_per_minute``, so a site is never asked by two tasks at once.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a text that is read whole; of a longer one nothing is.
MOST_BYTES = 20 << 20
SCHEMA = "url string, status int, final_url string, content_type string, content_language string, html string, error_kind string"
_PORTS = {"http": 80, "https": 443}


class Refused(ValueError):
    """An address or a redirect that may not be followed, or too long an answer."""


def origin(url: str) -> tuple[str, str, int]:
    """Scheme, host and effective port of an HTTP address without user data; ``Refused`` for anything else."""
    try:
        p = urlsplit(url.strip())
        scheme, host, port = p.scheme.lower(), (p.hostname or "").rstrip("."), p.port
    except ValueError as e:
        raise Refused(f"no address: {url!r}") from e
    if scheme not in _PORTS or not host or p.username is not None or p.password is not None:
        raise Refused(f"no plain HTTP address: {url!r}")
    return scheme, host, port or _PORTS[scheme]


class SameOrigin(urllib.request.HTTPRedirectHandler):
    """Follows redirects within the origin that was asked for and no other."""

    def __init__(self, start: str) -> None:
        self.allowed = origin(start)

    def checked(self, url: str) -> str:
        if origin(url) != self.allowed:
            raise Refused(f"redirect to another origin: {url!r}")
        return url

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        return super().redirect_request(req, fp, code, msg, headers, self.checked(urljoin(req.full_url, newurl)))


class AnyHttp(urllib.request.HTTPRedirectHandler):
    """Follows redirects to any HTTP address, as an inventory does."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        origin(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def secure_open(target: str, timeout: float, same_origin: bool = True, agent: str = "pagelake"):  # noqa: ANN201
    """Opens an HTTP address, with no other scheme reachable by any redirect."""
    origin(target)
    if not timeout > 0:
        raise ValueError("a timeout must be positive")
    opener = urllib.request.OpenerDirector()
    guard = SameOrigin(target) if same_origin else AnyHttp()
    for handler in (urllib.request.HTTPHandler(), urllib.request.HTTPSHandler(), urllib.request.HTTPDefaultErrorHandler(), urllib.request.HTTPErrorProcessor(), guard):
        opener.add_handler(handler)
    return opener.open(urllib.request.Request(target, headers={"User-Agent": agent}), timeout=timeout)


def fetch_text(url: str, timeout: float, most: int = MOST_BYTES) -> tuple[str, bytes]:
    """The address at last and the body of ``url``, read up to ``most`` bytes and refused beyond."""
    with secure_open(url, timeout) as answer:
        body = answer.read(most + 1)
        if len(body) > most:
            raise Refused(f"more than {most} bytes: {url!r}")
        return answer.geturl(), body


def robots(url: str, timeout: float) -> str:
    """The robots file of an address's origin; an error or a status from 400 on is an empty one, which allows all."""
    try:
        return fetch_text(urljoin(url, "/robots.txt"), timeout)[1].decode("utf-8", "replace")
    except (OSError, ValueError):
        return ""


def fetch(url: str, timeout: float = 60.0) -> tuple:
    """A row of ``SCHEMA`` for one address; what fails is a row that says how."""
    try:
        with secure_open(url, timeout, same_origin=False) as answer:
            body = answer.read(MOST_BYTES + 1)
            charset = answer.headers.get_content_charset() or "utf-8"
            text = None if len(body) > MOST_BYTES else body.decode(charset, "replace")
            return url, answer.status, answer.geturl(), answer.headers.get("Content-Type"), answer.headers.get("Content-Language"), text, None if text is not None else "size"
    except urllib.error.HTTPError as e:
        return url, e.code, e.url, e.headers.get("Content-Type"), e.headers.get("Content-Language"), None, None
    except TimeoutError:
        return url, None, None, None, None, None, "timeout"
    except Refused:
        return url, None, None, None, None, None, "refused"
    except (OSError, LookupError) as e:
        late = isinstance(getattr(e, "reason", None), TimeoutError)
        return url, None, None, None, None, None, "timeout" if late else "network"


class Host(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class Pages(DataSource):
    """Addresses as a table of answers; a partition a host."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return PagesReader({k.lower(): v for k, v in self.options.items()})


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = list(dict.fromkeys(u.strip() for u in options.get("urls", "").splitlines() if u.strip()))
        self.timeout, self.rate, self.tries = float(options.get("timeout", 60)), float(options.get("requests_per_minute", 6)), 1 + int(options.get("retries", 2))

    def partitions(self) -> list[Host]:
        hosts = defaultdict(list)
        for u in self.urls:
            hosts[(urlsplit(u).hostname or "").lower()].append(u)
        return [Host(us) for us in hosts.values()] or [Host([])]

    def read(self, partition: Host) -> Iterator[tuple]:
        due = 0.0
        for u in partition.urls:
            for _ in range(self.tries):
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + 60.0 / self.rate
                row = fetch(u, self.timeout)
                if row[6] not in ("timeout", "network") and not (row[1] or 0) >= 500:
                    break
            yield row


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
