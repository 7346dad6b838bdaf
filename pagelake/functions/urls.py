"""Addresses as native columns: splitting, validity, origin, normal form, scope.

No function here raises on data: what is no HTTP address gives NULL (or false
for predicates) and ``reject_reason`` says why. NULL input gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.text import strip

# Query parameters that only track, besides those starting with utm_.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer", "source")

# File endings (as regular expressions) and path parts that are never followed as links.
LINK_EXTENSIONS = (
    "7z", "avi", "css", "csv", "doc", "docx", "gif", "gz", "ico", "jpe?g", "json", "m4a", "mov", "mp3", "mp4", "mpeg", "mpg", "pdf", "png", "ppt",
    "pptx", "rar", "rss", "svg", "tar", "tgz", "txt", "wav", "webm", "webp", "woff2?", "xls", "xlsx", "xml", "zip",
)
LINK_PARTS = ("login", "signin", "signup", "cart", "checkout")

# File endings and path parts that addresses from site maps may not have.
SITEMAP_EXTENSIONS = (
    ".7z", ".avi", ".avif", ".bin", ".bmp", ".bz2", ".css", ".csv", ".doc", ".docx", ".eot", ".exe", ".gif", ".gz", ".ico", ".iso", ".jpeg", ".jpg",
    ".js", ".json", ".m4a", ".m4v", ".mov", ".mp3", ".mp4", ".mpeg", ".mpg", ".odp", ".ods", ".odt", ".ogg", ".ogv", ".otf", ".pdf", ".png", ".ppt",
    ".pptx", ".rar", ".rss", ".svg", ".tar", ".tgz", ".tif", ".tiff", ".ttf", ".wav", ".webm", ".webp", ".woff", ".woff2", ".xls", ".xlsx", ".xml",
    ".xz", ".zip",
)
SITEMAP_PARTS = ("account", "admin", "auth", "cart", "checkout", "download", "downloads", "login", "logout", "register", "search", "signin", "signup")

_SPLIT = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(url: Column) -> Column:
    """Stripped, and without the tabs and line ends that address parsers skip."""
    return F.regexp_replace(strip(url), r"[\t\r\n]", "")


def parts(url: Column) -> Column:
    """Struct of scheme, host, port (NULL if none), userinfo, path and query, as spelled but for scheme and host."""

    def split(u: Column) -> Column:
        g = lambda i: F.regexp_extract(u, _SPLIT, i)
        host_port = F.regexp_replace(g(2), r"(?s)^.*@", "")
        return F.struct(
            F.lower(g(1)).alias("scheme"),
            F.rtrim(F.lower(F.regexp_replace(host_port, r":[^:]*$", "")), F.lit(".")).alias("host"),
            F.nullif(F.regexp_extract(host_port, r":([^:]*)$", 1), F.lit("")).alias("port"),
            g(2).contains("@").alias("userinfo"),
            g(3).alias("path"),
            g(4).alias("query"),
        )

    return let(clean(url), split)


def reject_reason(url: Column) -> Column:
    """Why ``url`` is no usable HTTP address, NULL if it is one."""
    return let(parts(url), _reason_of).alias("reject_reason")


def _reason_of(p: Column) -> Column:
    port = p["port"].try_cast("int") if hasattr(Column, "try_cast") else p["port"].cast("int")
    return (
        F.when(p["scheme"].isNull(), F.lit("missing"))
        .when(~p["scheme"].isin("http", "https"), F.lit("scheme"))
        .when(p["userinfo"], F.lit("userinfo"))
        .when(p["host"].rlike(r"[\[\]:\s]"), F.lit("host"))
        .when(p["host"] == "", F.lit("host"))
        .when(p["port"].isNotNull() & (~p["port"].rlike(r"^[0-9]{1,5}$") | (port > 65535)), F.lit("port"))
    )


def is_http_url(url: Column) -> Column:
    return reject_reason(url).isNull() & url.isNotNull()


def origin(url: Column) -> Column:
    """Struct of scheme, host and effective port; NULL for what is no HTTP address."""

    def of(p: Column) -> Column:
        default = F.when(p["scheme"] == "https", 443).otherwise(80)
        port = F.coalesce(F.nullif(p["port"].try_cast("int"), F.lit(0)), default)
        return F.when(
            _reason_of(p).isNull(), F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), port.alias("port"))
        )

    return let(parts(url), of)


def host(url: Column) -> Column:
    """Host of the normalized address: lower case, without port and final dots."""
    return let(parts(url), lambda p: F.when(_reason_of(p).isNull(), p["host"]))


def _decode(c: Column) -> Column:
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_params(query: Column) -> Column:
    """Decoded (k, v) pairs in the order they stand; a bare key has the value ''."""
    pieces = F.filter(F.split(query, "&", -1), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            _decode(F.regexp_replace(x, r"(?s)=.*$", "")).alias("k"),
            F.when(x.contains("="), _decode(F.regexp_replace(x, r"(?s)^[^=]*=", ""))).otherwise("").alias("v"),
        ),
    )


def is_tracking(key: Column) -> Column:
    return F.lower(key).startswith("utm_") | F.lower(key).isin(*TRACKING_KEYS)


def normalize_query(query: Column) -> Column:
    """Tracking pairs dropped, the rest sorted by decoded pair and encoded again."""
    kept = F.filter(query_params(query), lambda p: ~is_tracking(p["k"]))
    encoded = F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])))
    return F.when(query == "", F.lit("")).otherwise(F.array_join(encoded, "&"))


def normalize(url: Column, keep_slash: bool = False) -> Column:
    """The normal form by which addresses are compared; NULL for what is no HTTP address.

    ``keep_slash`` leaves the final slash of a path, as site inventories do.
    """

    def of(p: Column) -> Column:
        default = F.when(p["scheme"] == "https", "443").otherwise("80")
        number = p["port"].try_cast("int").cast("string")
        port = F.when(p["port"].isNull() | (number == default), "").otherwise(F.concat(F.lit(":"), number))
        path = F.regexp_replace(F.when(p["path"] == "", "/").otherwise(p["path"]), r"/{2,}", "/")
        path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/$", ""))
        query = normalize_query(p["query"])
        tail = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
        whole = F.concat(p["scheme"], F.lit("://"), p["host"], port, path, tail)
        if keep_slash:
            whole = F.when(p["path"].endswith("/") & (path != "/"), F.concat(whole, F.lit("/"))).otherwise(whole)
        return F.when(_reason_of(p).isNull(), whole)

    return let(parts(url), of)


def start_url(url: Column) -> Column:
    """Where a crawl starts: the normal form of a usable address, NULL for any other."""
    return F.when(is_http_url(url), normalize(url))


def site(url: Column) -> Column:
    """Struct of domain (with its port, — if there is none) and scope_path of a start address."""
    g = lambda i: F.nullif(F.regexp_extract(url, _SPLIT, i), F.lit(""))
    return F.struct(F.coalesce(g(2), F.lit("—")).alias("domain"), F.coalesce(g(3), F.lit("/")).alias("scope_path"))


def same_origin(a: Column, b: Column) -> Column:
    """True only where both are HTTP addresses of one origin."""
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def in_scope(url: Column, start: Column) -> Column:
    """Whether ``url`` lies at or under ``start``, case aside; both normalized."""
    u, s = F.lower(url), F.lower(F.regexp_replace(start, r"[/?#]+$", ""))
    root = s.rlike(r"^[a-z]+://[^/]+$")
    under = F.startswith(u, F.concat(s, F.lit("/")))
    beside = F.startswith(u, F.concat(s, F.lit("?"))) | F.startswith(u, F.concat(s, F.lit("#")))
    return F.coalesce(under | (~root & ((u == s) | beside)) | (root & (u == s)), F.lit(False))


def excluded_link(url: Column) -> Column:
    """Whether a link leads to a file or an account page; the whole address counts, query included."""
    endings = "|".join(LINK_EXTENSIONS)
    path_parts = "|".join(LINK_PARTS)
    return F.coalesce(
        url.rlike(rf"(?i)\.(?:{endings})(?:[?#].*)?$") | url.rlike(rf"(?i)/(?:{path_parts})(?:/|$|[?#])"), F.lit(False)
    )


def path_suffix(path: Column) -> Column:
    """The ending of a path's last part with its dot, as file systems see it; '' if there is none."""
    last = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    suffix = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    return F.when(last.rlike(r"^\.*[^.]+(?:\..*)?\.[^.]+$") & ~last.rlike(r"^\.[^.]*$"), suffix).otherwise("")


def sitemap_safe(url: Column, start: Column) -> Column:
    """Whether an address of a site map may be followed from ``start``: same origin, under its path, no file, no account page."""

    def of(both: Column) -> Column:
        path = F.lower(F.when(both["u"]["path"] == "", "/").otherwise(both["u"]["path"]))
        scoped = F.lower(F.regexp_replace(both["s"]["path"], r"/+$", ""))
        inside = (scoped == "") | (path == scoped) | F.startswith(path, F.concat(scoped, F.lit("/")))
        blocked = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SITEMAP_PARTS)))
        return inside & ~path_suffix(path).isin(*SITEMAP_EXTENSIONS) & ~blocked

    inside = let(F.struct(parts(normalize(url)).alias("u"), parts(normalize(start)).alias("s")), of)
    return F.coalesce(same_origin(url, start) & inside, F.lit(False))


def sitemap_candidates(start: Column) -> Column:
    """The three usual places of a site map."""
    root = let(parts(normalize(start)), lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], F.coalesce(F.concat(F.lit(":"), p["port"]), F.lit("")), F.lit("/")))
    return F.array(*(F.concat(root, F.lit(x)) for x in ("sitemap.xml", "sitemap_index.xml", "sitemap.xml.gz")))


def robots_url(start: Column) -> Column:
    return F.regexp_replace(F.element_at(sitemap_candidates(start), 1), r"sitemap\.xml$", "robots.txt")


def _without_dots(path: Column) -> Column:
    """RFC 3986 dot segments taken out of an absolute path."""
    pieces = F.split(path, "/", -1)
    last_is_dot = F.element_at(pieces, -1).isin(".", "..")
    step = lambda acc, x: (
        F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    )
    kept = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), F.array(F.lit("")), step)
    joined = F.array_join(F.when(last_is_dot, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(joined == "", "/").otherwise(joined)


def resolve(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base`` (RFC 3986); NULL if either is NULL or ``base`` no HTTP address."""

    def of(x: Column) -> Column:
        b, h = x["b"], x["h"]
        authority = F.regexp_extract(x["base"], r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        scheme = F.regexp_extract(x["base"], r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
        path = F.regexp_extract(h, r"^([^?#]*)", 1)
        tail = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
        folder = F.regexp_replace(F.when(b["path"] == "", "/").otherwise(b["path"]), r"[^/]*$", "")
        query = F.when(b["query"] == "", "").otherwise(F.concat(F.lit("?"), b["query"]))
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == "", F.concat(authority, b["path"], query))
            .when(h.startswith("#"), F.concat(authority, b["path"], query, h))
            .when(h.startswith("?"), F.concat(authority, b["path"], h))
            .when(h.startswith("/"), F.concat(authority, _without_dots(path), tail))
            .otherwise(F.concat(authority, _without_dots(F.concat(folder, path)), tail))
        )

    whole = F.struct(clean(base).alias("base"), parts(base).alias("b"), clean(href).alias("h"))
    return F.when(is_http_url(base) & href.isNotNull(), let(whole, of))
