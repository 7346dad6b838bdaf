"""Links of pages, as edges in the order they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.functions.text import strip


def markdown_targets(markdown: Column) -> Column:
    """Targets of inline Markdown links, in order."""
    return F.regexp_extract_all(markdown, F.lit(r"\]\(([^)\s]+)"), 1)


def html_targets(html: Column) -> Column:
    """Targets of a[href] in well-formed markup, in order; the DOM pass reads the rest."""
    quoted = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), 1)
    return F.transform(quoted, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def edges(pages: DataFrame, targets: Column, start: Column | None = None) -> DataFrame:
    """(src_url, pos, dst_url): each page's followable links, the first of equal ones.

    ``pages`` has url; ``start`` is the scope, by default the page's own host.
    Links that are invalid, blank, the page itself, out of scope or excluded
    are left out. A page delivered twice counts once.
    """
    rows = pages.select("url", targets.alias("_targets"), (start if start is not None else _root(F.col("url"))).alias("_start")).filter("url IS NOT NULL").distinct()
    found = rows.select("url", "_start", F.posexplode("_targets").alias("pos", "href")).filter(strip(F.col("href")) != "")
    found = found.select(urls.normalize(F.col("url")).alias("src_url"), "_start", "pos", urls.normalize(urls.resolve(F.col("url"), F.col("href"))).alias("dst_url"))
    found = found.filter(
        F.col("dst_url").isNotNull() & (F.col("dst_url") != F.col("src_url")) & urls.in_scope(F.col("dst_url"), F.col("_start")) & ~urls.excluded_link(F.col("dst_url"))
    )
    return found.groupBy("src_url", "dst_url").agg(F.min("pos").cast("long").alias("pos")).select("src_url", "pos", "dst_url")


def _root(url: Column) -> Column:
    return F.regexp_extract(urls.normalize(url), r"^([a-z]+://[^/?#]+)", 1)


def first_seen(addresses: DataFrame, order: str) -> DataFrame:
    """(url, first_at): distinct normalized addresses by the place they stand first."""
    rows = addresses.select(urls.normalize(F.col("url")).alias("url"), F.col(order).alias("_at")).filter("url IS NOT NULL")
    return rows.groupBy("url").agg(F.min("_at").alias("first_at"))


def out_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("src_url").agg(F.count("*").alias("out_links"))


def in_degree_top(links: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` addresses most pages link to; ties by address."""
    counts = links.groupBy("dst_url").agg(F.count("*").alias("in_links"))
    return counts.orderBy(F.desc("in_links"), "dst_url").limit(k)


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host_url, pos, sitemap_url): Sitemap lines of robots files (host_url, body), the first of equal ones."""
    lines = robots.select("host_url", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("pos", "line"))
    bare = strip(F.regexp_replace("line", r"(?s)#.*$", ""))
    key, value = F.lower(strip(F.split_part(bare, F.lit(":"), F.lit(1)))), strip(F.regexp_replace(bare, r"(?s)^[^:]*:", ""))
    found = lines.filter(bare.contains(":") & (key == "sitemap") & (value != ""))
    found = found.select("host_url", "pos", urls.normalize(urls.resolve(F.col("host_url"), value)).alias("sitemap_url")).filter("sitemap_url IS NOT NULL")
    return found.groupBy("host_url", "sitemap_url").agg(F.min("pos").cast("long").alias("pos")).select("host_url", "pos", "sitemap_url")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host_url, agent, rule_no, allow, path): one row per rule and user agent of its group."""
    lines = robots.select("host_url", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("n", "line"))
    bare = strip(F.regexp_replace("line", r"(?s)#.*$", ""))
    lines = lines.select("host_url", "n", F.lower(strip(F.split_part(bare, F.lit(":"), F.lit(1)))).alias("key"), strip(F.regexp_replace(bare, r"(?s)^[^:]*:", "")).alias("value"))
    lines = lines.filter(F.col("key").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host_url").orderBy("n")
    is_agent = F.col("key") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(w), F.lit(False))
    grouped = lines.withColumn("group", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.filter(is_agent).select("host_url", "group", F.lower("value").alias("agent"))
    rules = grouped.filter(~is_agent).select("host_url", "group", F.col("n").alias("rule_no"), ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path"))
    return rules.join(agents, ["host_url", "group"]).select("host_url", "agent", "rule_no", "allow", "path").distinct()


def _pattern(path: Column) -> Column:
    """A rule's path with its wildcards as a regular expression."""
    plain = F.regexp_replace(path, r"([\\.+?^{}()|\[\]]|\$(?!$))", r"\\$1")
    return F.concat(F.lit("^"), F.replace(plain, F.lit("*"), F.lit(".*")))


def allowed(addresses: DataFrame, rules: DataFrame, agent: str, longest: bool = False) -> DataFrame:
    """(url, allowed): whether rules permit each normalized address.

    The rules count of the first agent in the file that is part of ``agent``'s name, else those of ``*``. The first rule whose path begins the
    address's decides, or with ``longest`` the one with the longest path (allow on ties), whose ``*`` and final ``$`` are wildcards then.
    """
    root = F.concat(_root(F.col("url")), F.lit("/"))
    rows = addresses.select("url").distinct().withColumn("host_url", root)
    name = agent.split("/")[0].lower()
    own = rules.withColumn("rank", F.when(F.col("agent") == "*", 1).when((F.col("agent") != "") & F.lit(name).contains(F.col("agent")), 0)).filter("rank IS NOT NULL")
    best = own.groupBy("host_url").agg(F.min_by("agent", F.struct("rank", "rule_no")).alias("agent"))
    own = own.join(best, ["host_url", "agent"]).select("host_url", "rule_no", "allow", "path")
    rest = F.regexp_replace("url", r"^[a-z]+://[^/?#]+", "")
    rest = F.when(rest == "", "/").otherwise(rest)
    # A host's rules are one short row, so that a hot host's pages meet one row and not a group.
    lists = own.groupBy("host_url").agg(F.array_sort(F.collect_list(F.struct("rule_no", "allow", "path", _pattern(F.col("path")).alias("pattern")))).alias("rules"))
    both = rows.join(lists, "host_url", "left")
    if longest:
        hits = F.filter("rules", lambda r: (r["path"] != "") & F.rlike(rest, r["pattern"]))
        ranked = F.array_sort(F.transform(hits, lambda r: F.struct((-F.length(r["path"])).alias("n"), F.when(r["allow"], 0).otherwise(1).alias("worse"), r["allow"].alias("allow"))))
        first = F.get(ranked, 0)["allow"]
    else:
        first = F.get(F.filter("rules", lambda r: F.startswith(rest, r["path"])), 0)["allow"]
    return both.select("url", F.coalesce(first, F.lit(True)).alias("allowed"))
