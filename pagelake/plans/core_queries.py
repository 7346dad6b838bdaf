"""Registered queries of the core, each over its whole tables, and the SQL that states the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import languages, markdown, text_language, urls
from pagelake.functions.text import blank_to_null, digest_key
from pagelake.operators import export, freshness, frontier, incremental, links, pacing, registry, report, sitemaps
from pagelake.plans import sql as q
from pagelake.session import shared_dir
from pagelake.sources.tables import table
from pagelake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The moment freshness is asked for, and the window.
NOW, HOURS = "2025-05-20T00:00:00+00:00", 24 * 7
#: The scope the scope queries ask for.
START = "https://docs.brovenhall.example/docs"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "url_state", "url").distinct()


_ADDRESSES = "(SELECT DISTINCT url FROM url_state)"
def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


# ------------------------------------------------------------------ new or changed records

_NEWEST = f"""(SELECT norm AS state_key, last(h ORDER BY inst, run_id, h NULLS FIRST) AS state_hash FROM (
  SELECT norm, {q.instant('saved_at')} AS inst, {q.digest_key('content_hash')} AS h, run_id FROM {q.parsed('url_state', 'url')}
  WHERE run_id IN (SELECT run_id FROM sync_runs WHERE lower({q.strip('status')}) = 'succeeded')) WHERE inst IS NOT NULL AND norm IS NOT NULL GROUP BY norm)"""


@query(
    f"""SELECT DISTINCT page_id FROM (SELECT page_id, norm, {q.digest_key('content_hash')} AS h FROM {q.parsed('content_records', 'canonical_url')})
    LEFT JOIN {_NEWEST} ON state_key = norm WHERE NOT coalesce(h = state_hash, false)"""
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    state = incremental.latest_state(table(spark, d, "url_state", "url", "saved_at", "content_hash", "run_id"), table(spark, d, "sync_runs", "run_id", "status"))
    records = table(spark, d, "content_records", "page_id", "content_hash", "canonical_url")
    key, row_hash = urls.normalize(F.col("canonical_url")), digest_key(F.col("content_hash"))
    return incremental.new_or_changed(records, state, "page_id", key, row_hash).select("page_id").distinct()


# ------------------------------------------------------------------ addresses


@query(f"SELECT url, reason IS NULL AS is_valid, reason AS reject_reason FROM {q.parsed(_ADDRESSES, 'url')}")
def url_validate(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _addresses(spark, d).select(u, urls.is_http_url(u).alias("is_valid"), urls.reject_reason(u).alias("reject_reason"))


@query(f"SELECT url, norm AS normalized FROM {q.parsed(_ADDRESSES, 'url')}")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("url", urls.normalize(F.col("url")).alias("normalized"))


@query(f"SELECT url, norm_slash AS normalized FROM {q.parsed(_ADDRESSES, 'url')}")
def url_inventory_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("url", urls.normalize(F.col("url"), keep_slash=True).alias("normalized"))


@query(f"SELECT scheme, host, CAST(origin_port AS BIGINT) AS port, count(*) AS addresses FROM {q.parsed(_ADDRESSES, 'url')} WHERE reason IS NULL GROUP BY ALL")
def url_origin(spark: SparkSession, d: str) -> DataFrame:
    o = _addresses(spark, d).select(urls.origin(F.col("url")).alias("o")).filter("o IS NOT NULL")
    return o.groupBy("o.scheme", "o.host", F.col("o.port").cast("long").alias("port")).agg(F.count("*").alias("addresses"))


@query(
    f"""SELECT k AS param, starts_with(lower(k), 'utm_') OR lower(k) IN ({q.strings(urls.TRACKING_KEYS)}) AS is_tracking, count(*) AS uses
    FROM (SELECT unnest(pairs).k AS k FROM {q.parsed(_ADDRESSES, 'url')}) GROUP BY ALL"""
)
def url_tracking_params(spark: SparkSession, d: str) -> DataFrame:
    pairs = _addresses(spark, d).select(F.explode(urls.query_params(urls.parts(F.col("url"))["query"])).alias("p"))
    return pairs.groupBy(F.col("p.k").alias("param"), urls.is_tracking(F.col("p.k")).alias("is_tracking")).agg(F.count("*").alias("uses"))


@query(f"SELECT DISTINCT norm AS url FROM {q.parsed('markdown_documents', 'url')} WHERE lower(norm) = '{START}' OR regexp_matches(lower(norm), '^{START.replace('.', '[.]')}[/?#]')")
def url_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "url").select(urls.normalize(F.col("url")).alias("url")).distinct()
    return rows.filter(urls.in_scope(F.col("url"), F.lit(START)))


_TARGETS = r"(SELECT DISTINCT unnest(regexp_extract_all(markdown, '\]\(([^)\s]+)', 1)) AS target FROM markdown_documents)"


@query(
    rf"""SELECT target, regexp_matches(target, '(?i)\.({"|".join(urls.LINK_EXTENSIONS)})([?#].*)?$')
    OR regexp_matches(target, '(?i)/({"|".join(urls.LINK_PARTS)})(/|$|[?#])') AS excluded FROM {_TARGETS}"""
)
def url_excluded(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "markdown_documents", "markdown").select(F.explode(links.markdown_targets(F.col("markdown"))).alias("target")).distinct()
    return t.select("target", urls.excluded_link(F.col("target")).alias("excluded"))


@query(
    rf"""SELECT norm AS url, scheme = 'https' AND host = 'docs.brovenhall.example' AND origin_port = 443
     AND (lower(path2) = '/docs' OR starts_with(lower(path2), '/docs/')) AND regexp_extract(lower(path2), '[^/](\.[^./]+)$', 1) NOT IN ({q.strings(urls.SITEMAP_EXTENSIONS)})
     AND NOT list_has_any(string_split(lower(path2), '/'), [{q.strings(urls.SITEMAP_PARTS)}]) AS safe FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL GROUP BY ALL"""
)
def url_sitemap_safe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "url").select(urls.normalize(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    return rows.select("url", urls.sitemap_safe(F.col("url"), F.lit(START)).alias("safe"))


@query(
    f"""SELECT DISTINCT 'https://' || host || '/' || f AS candidate FROM {q.parsed('markdown_documents', 'url')},
    (VALUES ('sitemap.xml'), ('sitemap_index.xml'), ('sitemap.xml.gz')) v(f) WHERE reason IS NULL"""
)
def sitemap_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "url").filter(urls.is_http_url(F.col("url")))
    return rows.select(F.explode(urls.sitemap_candidates(F.col("url"))).alias("candidate")).distinct()


@query(f"SELECT host, count(DISTINCT norm) AS pages FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL GROUP BY host")
def pages_by_host(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "url").select(urls.host(F.col("url")).alias("host"), urls.normalize(F.col("url")).alias("u"))
    return rows.filter("u IS NOT NULL").groupBy("host").agg(F.count_distinct("u").alias("pages"))


@query(f"SELECT DISTINCT 'https://' || host || '/robots.txt' AS robots FROM {q.parsed('markdown_documents', 'url')} WHERE reason IS NULL")
def robots_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "url").filter(urls.is_http_url(F.col("url")))
    return rows.select(urls.robots_url(F.col("url")).alias("robots")).distinct()


@query(
    f"""SELECT DISTINCT a.url, a.canonical_url, coalesce(a.reason IS NULL AND b.reason IS NULL AND a.scheme = b.scheme AND a.host = b.host AND a.origin_port = b.origin_port, false) AS same
    FROM {q.parsed('duplicate_urls', 'url')} a JOIN {q.parsed('duplicate_urls', 'canonical_url')} b ON a.url IS NOT DISTINCT FROM b.url AND a.canonical_url IS NOT DISTINCT FROM b.canonical_url"""
)
def redirect_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether an address may redirect to its canonical one: only within its origin."""
    rows = table(spark, d, "duplicate_urls", "url", "canonical_url").distinct()
    return rows.select("url", "canonical_url", urls.same_origin(F.col("url"), F.col("canonical_url")).alias("same"))


@query(rf"SELECT DISTINCT norm AS start_url, regexp_extract(norm, '^[a-z]+://([^/?#]*)', 1) AS domain, coalesce(nullif(regexp_extract(norm, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS scope_path FROM {q.parsed('registrations', 'url')} WHERE norm IS NOT NULL")
def site_info(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "registrations", "url").select(urls.start_url(F.col("url")).alias("start_url")).filter("start_url IS NOT NULL").distinct()
    return rows.select("start_url", urls.site(F.col("start_url"))["domain"].alias("domain"), urls.site(F.col("start_url"))["scope_path"].alias("scope_path"))


# ------------------------------------------------------------------ Markdown


@query(f"SELECT DISTINCT page_id, sha256({q.md_normal('markdown')}) AS content_hash, CAST(length({q.md_normal('markdown')}) AS BIGINT) AS chars FROM markdown_documents")
def md_normalize(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("markdown")
    rows = table(spark, d, "markdown_documents", "page_id", "markdown")
    return rows.select("page_id", markdown.digest(m).alias("content_hash"), F.length(markdown.normalize(m)).cast("long").alias("chars")).distinct()


@query(f"SELECT doc_id, sha256({q.strip('replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))')}) AS content_hash FROM documents")
def content_hash_stripped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", markdown.stripped_digest(F.col("text")).alias("content_hash"))


_LINES = rf"list_transform(regexp_split_to_array(markdown, '[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {q.strip('l')})"
_HEADING = (
    rf"coalesce(list_filter(list_transform(list_filter({_LINES}, lambda l: starts_with(l, '#')), lambda l: {q.strip(f'''regexp_replace(l, '^#{{1,6}}{q.BLANK}+', '')''')}), lambda l: l <> '')[1], '')"
)


@query(f"SELECT DISTINCT page_id, {_HEADING} AS heading, coalesce({q.blank_to_null('title')}, nullif({_HEADING}, ''), url) AS resolved_title FROM markdown_documents")
def page_title_resolved(spark: SparkSession, d: str) -> DataFrame:
    t, m, u = F.col("title"), F.col("markdown"), F.col("url")
    rows = table(spark, d, "markdown_documents", "page_id", "title", "markdown", "url")
    return rows.select("page_id", markdown.heading(m).alias("heading"), markdown.resolved_title(t, m, u).alias("resolved_title")).distinct()


@query(f"SELECT DISTINCT title, {q.slug(q.plain('title'))} AS slug FROM markdown_documents")
def slugify_title(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "title").distinct()
    return rows.select("title", markdown.slug(F.col("title")).alias("slug"))


_SEGMENTS = f"list_transform(list_filter(string_split(regexp_replace(path, ';[^/]*$', ''), '/'), lambda y: {q.strip('y')} <> ''), lambda y: {q.slug(q.plain('y'))})"


#: Addresses with and without a path, with marks in them.
_PATHS = "(SELECT page_id, title, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^([A-Za-z]+://[^/?#]+).*$', '\\1/') WHEN 1 THEN regexp_replace(url, '/([^/]*)$', '/Größe-né/\\1') ELSE url END AS url FROM markdown_documents)"


@query(
    f"""SELECT DISTINCT page_id, array_to_string(list_concat(list_concat([{q.slug('host')}], s[1:greatest(len(s) - 1, 0)]),
     [CASE WHEN len(s) > 0 THEN substr(s[len(s)], 1, 80) ELSE substr({q.slug(q.plain('title'))}, 1, 100) END || '-' || substr(sha256(url), 1, 12) || '.md']), '/') AS output_path
    FROM (SELECT *, {_SEGMENTS} AS s FROM {q.parsed(_PATHS, 'url')})"""
)
def output_path(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    root, marked = F.regexp_replace(u, r"^([A-Za-z]+://[^/?#]+).*$", "$1/"), F.regexp_replace(u, r"/([^/]*)$", "/Größe-né/$1")
    rows = table(spark, d, "markdown_documents", "page_id", "url", "title").withColumn("url", F.when(F.col("page_id") % 4 == 0, root).when(F.col("page_id") % 4 == 1, marked).otherwise(u))
    return rows.select("page_id", markdown.output_path(F.col("url"), F.col("title")).alias("output_path")).distinct()


_TITLE = f"coalesce({q.blank_to_null('title')}, nullif({_HEADING}, ''), url)"


@query(
    f"""SELECT DISTINCT page_id, sha256('---' || chr(10) || 'url: ' || CAST(to_json(url) AS VARCHAR) || chr(10) || 'title: ' || CAST(to_json({_TITLE}) AS VARCHAR) || chr(10)
     || 'language: ' || CAST(to_json(coalesce(language, '')) AS VARCHAR) || chr(10) || 'content_hash: ' || content_hash || chr(10) || '---' || chr(10) || chr(10)
     || regexp_replace({q.md_normal('markdown')}, '{q.BLANK}+$', '') || chr(10)) AS document_hash FROM markdown_documents"""
)
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "page_id", "url", "title", "language", "content_hash", "markdown")
    title = markdown.resolved_title(F.col("title"), F.col("markdown"), F.col("url"))
    doc = markdown.document(F.col("url"), title, F.coalesce("language", F.lit("")), F.col("content_hash"), markdown.normalize(F.col("markdown")))
    return rows.select("page_id", F.sha2(doc, 256).alias("document_hash")).distinct()


@query(
    f"""SELECT DISTINCT page_id, sha256('---' || chr(10) || 'title: "' || {q.strip("replace(replace(replace(title, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), ' ')")} || '"' || chr(10) || 'url: "' || url || '"' || chr(10) || 'language: "'
     || {q.strip("coalesce(language, '')")} || '"' || chr(10) || 'content_hash: "' || content_hash || '"' || chr(10) || 'generated_at: "2025-05-20T00:00:00+00:00"' || chr(10) || '---' || chr(10) || markdown) AS document_hash FROM markdown_documents"""
)
def front_matter_dated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "page_id", "url", "title", "language", "content_hash", "markdown")
    doc = markdown.dated_document(F.col("url"), F.col("title"), F.coalesce("language", F.lit("")), F.col("content_hash"), F.col("markdown"), F.lit(NOW))
    return rows.select("page_id", F.sha2(doc, 256).alias("document_hash")).distinct()


# ------------------------------------------------------------------ links


def _edges(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "markdown_documents", "url", "markdown")
    return links.edges(pages, links.markdown_targets(F.col("markdown")))


_EDGES = rf"""(SELECT src_url, norm AS dst_url, min(pos) AS pos FROM (SELECT src_url, root, pos, norm FROM {q.parsed(rf'''(
  SELECT norm AS src_url, regexp_extract(norm, '^([a-z]+://[^/?#]+)', 1) AS root, i - 1 AS pos,
   CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t
    WHEN starts_with(t, '#') THEN o || path || CASE WHEN query = '' THEN '' ELSE '?' || query END || t WHEN starts_with(t, '?') THEN o || path || t
    WHEN starts_with(t, '/') THEN o || t ELSE o || regexp_replace(path, '[^/]*$', '') || t END AS target
  FROM (SELECT norm, scheme, path, query, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS o, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i
   FROM (SELECT *, regexp_extract_all(markdown, '\]\(([^)\s]+)', 1) AS ts FROM {q.parsed('(SELECT DISTINCT url, markdown FROM markdown_documents)', 'url')}) WHERE norm IS NOT NULL)
  WHERE {q.strip('t')} <> '')''', 'target')})
 WHERE norm IS NOT NULL AND norm <> src_url AND (starts_with(lower(norm), lower(root) || '/'))
  AND NOT regexp_matches(norm, '(?i)\.({"|".join(urls.LINK_EXTENSIONS)})([?#].*)?$') AND NOT regexp_matches(norm, '(?i)/({"|".join(urls.LINK_PARTS)})(/|$|[?#])')
 GROUP BY src_url, norm)"""


@query(f"SELECT src_url, pos, dst_url FROM {_EDGES}")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"SELECT src_url, count(*) AS out_links FROM {_EDGES} GROUP BY src_url")
def link_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return links.out_degree(_edges(spark, d))


@query(f"SELECT dst_url, count(*) AS in_links FROM {_EDGES} GROUP BY dst_url ORDER BY in_links DESC, dst_url LIMIT 20")
def link_in_degree_top(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return links.in_degree_top(_edges(spark, d), 20)


@query(f"SELECT norm AS url, CAST(min(run_id) AS BIGINT) AS first_at FROM {q.parsed('url_state', 'url')} WHERE norm IS NOT NULL GROUP BY norm")
def link_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return links.first_seen(table(spark, d, "url_state", "url", "run_id"), "run_id")


_ROBOTS = "(SELECT DISTINCT 'https://' || host || '/' AS host_url FROM {})".format(q.parsed("markdown_documents", "url") + " WHERE reason IS NULL")
_BODY = (
    "# rules\nUser-agent: *\nDisallow: /learn\nAllow: /learn/basics\nAllow: /docs/guide\nDisallow: /docs\nDisallow: /kb # closed\nSitemap: /sitemap.xml\nsitemap: /sitemap.xml\n"
    "Sitemap: news.xml\n\nUser-agent: otherbot\nDisallow: /\n"
)


def _robots(spark: SparkSession, d: str) -> DataFrame:
    """A robots file for each host, the same everywhere, as no table holds any."""
    hosts = table(spark, d, "markdown_documents", "url").select(urls.host(F.col("url")).alias("h")).filter("h IS NOT NULL").distinct()
    return hosts.select(F.concat(F.lit("https://"), "h", F.lit("/")).alias("host_url"), F.lit(_BODY).alias("body"))


@query(f"SELECT host_url, CAST(n AS BIGINT) AS pos, host_url || f AS sitemap_url FROM {_ROBOTS}, (VALUES (7, 'sitemap.xml'), (9, 'news.xml')) v(n, f)")
def robots_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    return links.robots_sitemaps(_robots(spark, d))


_REST = "regexp_replace(norm, '^[a-z]+://[^/?#]+', '')"


@query(f"SELECT DISTINCT norm AS url, starts_with({_REST}, '/docs/guide') OR NOT (starts_with({_REST}, '/learn') OR starts_with({_REST}, '/docs') OR starts_with({_REST}, '/kb')) AS allowed FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL")
def robots_first_match(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "markdown_documents", "url").select(urls.normalize(F.col("url")).alias("url")).filter("url IS NOT NULL")
    return links.allowed(pages, links.robots_rules(_robots(spark, d)), "reader/1.0")


@query(f"SELECT DISTINCT norm AS url, starts_with({_REST}, '/learn/basics') OR starts_with({_REST}, '/docs/guide') OR NOT (starts_with({_REST}, '/learn') OR starts_with({_REST}, '/docs') OR starts_with({_REST}, '/kb')) AS allowed FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL")
def robots_longest_match(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "markdown_documents", "url").select(urls.normalize(F.col("url")).alias("url")).filter("url IS NOT NULL")
    return links.allowed(pages, links.robots_rules(_robots(spark, d)), "reader/1.0", longest=True)


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src_url, dst_url FROM {_EDGES}), seeds AS (SELECT min(src_url) AS url FROM e GROUP BY regexp_extract(src_url, '^[a-z]+://[^/?#]+')),
    walk(url, depth) AS (SELECT url, 0 FROM seeds UNION SELECT dst_url, depth + 1 FROM walk JOIN e ON src_url = url WHERE depth < 60)
    SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY url"""
)
def frontier_bfs(spark: SparkSession, d: str) -> DataFrame:
    """To the end; the SQL's bound is far beyond the depth of any of these graphs."""
    edges = _edges(spark, d).select("src_url", "dst_url")
    seeds = edges.groupBy(F.regexp_extract("src_url", r"^[a-z]+://[^/?#]+", 0)).agg(F.min("src_url").alias("url")).select("url")
    return frontier.levels(seeds, edges)


@query(
    f"""SELECT site, url, CAST(min(ord) AS BIGINT) AS ord FROM (SELECT host AS site, min(norm) AS url, 0 AS ord FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL GROUP BY host
      UNION ALL SELECT host, norm, page_id FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL) GROUP BY site, url"""
)
def frontier_initial(spark: SparkSession, d: str) -> DataFrame:
    """Each host's first address, then its pages as a site map would list them."""
    listed = table(spark, d, "markdown_documents", "url", F.col("page_id").alias("rank")).withColumn("site", urls.host(F.col("url"))).filter("site IS NOT NULL")
    seeds = listed.groupBy("site").agg(F.min(urls.normalize(F.col("url"))).alias("url"))
    return frontier.initial(seeds, listed)


@query(
    f"""WITH f AS (SELECT norm_slash AS u, count(*) AS n FROM {q.parsed('url_state', 'url')} WHERE norm_slash IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT norm_slash AS u FROM {q.parsed('content_records', 'canonical_url')} WHERE norm_slash IS NOT NULL)
    SELECT CAST(count_if(k.u IS NULL) AS BIGINT) AS added, CAST(sum(CASE WHEN k.u IS NULL THEN n - 1 ELSE n END) AS BIGINT) AS duplicate_urls FROM f LEFT JOIN k ON f.u = k.u"""
)
def frontier_discovered(spark: SparkSession, d: str) -> DataFrame:
    return frontier.add_discovered(table(spark, d, "url_state", "url"), table(spark, d, "content_records", F.col("canonical_url").alias("url")))[1]


# ------------------------------------------------------------------ languages


@query(f"SELECT DISTINCT language, {q.code('language')} AS code, split_part({q.code('language')}, '-', 1) = 'en' AS is_english FROM markdown_documents")
def lang_code(spark: SparkSession, d: str) -> DataFrame:
    found = languages.from_code(F.col("language"), "label")
    rows = table(spark, d, "markdown_documents", "language").distinct()
    return rows.select("language", languages.code(F.col("language")).alias("code"), found["is_english"].alias("is_english"))


_URL_LANG = f"""(SELECT *, {q.languages_in_url()} AS c FROM {q.parsed('(SELECT DISTINCT url FROM markdown_documents)', 'url')})"""


@query(
    f"""SELECT url, c AS language_code, c IN ({q.strings(languages.ENGLISH)}) AS is_english,
    CASE WHEN c IS NULL THEN NULL WHEN replace(split_part(host, '.', 1), '_', '-') = c THEN 'url-subdomain' ELSE 'url-path' END AS source FROM {_URL_LANG}"""
)
def lang_from_url(spark: SparkSession, d: str) -> DataFrame:
    x = languages.from_url(F.col("url"))
    rows = table(spark, d, "markdown_documents", "url").distinct()
    return rows.select("url", x["language_code"].alias("language_code"), x["is_english"].alias("is_english"), x["source"].alias("source"))


@query(
    f"""SELECT page_id, coalesce({q.code('language')}, c) AS language_code, CASE WHEN {q.code('language')} IS NOT NULL THEN 'html-lang' WHEN c IS NULL THEN NULL
      WHEN replace(split_part(host, '.', 1), '_', '-') = c THEN 'url-subdomain' ELSE 'url-path' END AS source
    FROM (SELECT *, {q.languages_in_url()} AS c FROM {q.parsed('(SELECT DISTINCT page_id, url, language FROM markdown_documents)', 'url')})"""
)
def lang_decision(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    x = languages.cascade(none, F.col("language"), none, none, F.col("url"))
    rows = table(spark, d, "markdown_documents", "page_id", "url", "language").distinct()
    return rows.select("page_id", x["language_code"].alias("language_code"), x["source"].alias("source"))


_DECLARED = f"CASE WHEN page_id % 6 < 4 THEN {q.code('language')} END"
_MD_GATE = f"length({q.strip(f"regexp_replace(markdown, '{q.BLANK}+', ' ', 'g')")})"


@query(
    f"""SELECT DISTINCT page_id, CASE WHEN dc IS NOT NULL THEN dc ELSE c END AS language_code, CASE WHEN dc IS NOT NULL THEN ['content-language-header', 'html-lang', 'meta-content-language', 'og-locale'][page_id % 6 + 1]
      WHEN c IS NOT NULL THEN CASE WHEN replace(split_part(host, '.', 1), '_', '-') = c THEN 'url-subdomain' ELSE 'url-path' END WHEN {_MD_GATE} < {languages.LEAST_TEXT} THEN 'insufficient-text' ELSE 'text-analysis' END AS source
    FROM (SELECT *, {_DECLARED} AS dc, {q.languages_in_url()} AS c FROM {q.parsed('markdown_documents', 'url')})"""
)
def lang_cascade(spark: SparkSession, d: str) -> DataFrame:
    """All six stages: labels stand in four places in turn, a third of the pages has none; what the text says is left out, as SQL can't say it."""
    rows = table(spark, d, "markdown_documents", "page_id", "url", "language", "markdown").distinct()
    place = lambda k: F.when(F.col("page_id") % 6 == k, F.col("language"))
    x = text_language.decide(place(0), place(1), place(2), place(3), F.col("url"), F.col("markdown"))
    rows = rows.select("page_id", x.alias("x"))
    return rows.select("page_id", F.when(F.col("x.source") != "text-analysis", F.col("x.language_code")).alias("language_code"), "x.source").distinct()


@query()
def lang_text(spark: SparkSession, d: str) -> DataFrame:
    """What the text itself says of every document; held against held-out labels in the tests."""
    x = text_language.from_text(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", x.alias("x")).select("doc_id", "x.is_english", "x.language_code", "x.source", F.round("x.confidence", 3).alias("confidence"))


@query(f"SELECT url, len(list_filter(list_concat([split_part(host, '.', 1)], list_filter(string_split(lower(path), '/'), lambda y: {q.strip('y')} <> '')[1:2]), lambda y: replace(y, '_', '-') IN ({q.strings(languages.NON_ENGLISH)}))) > 0 AS non_english FROM {q.parsed('(SELECT DISTINCT url FROM markdown_documents)', 'url')}")
def lang_explicit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "markdown_documents", "url").distinct().select("url", languages.explicitly_non_english(F.col("url")).alias("non_english"))


@query(
    """SELECT source, language_code, count(*) AS decisions, CAST(count_if(is_english) AS BIGINT) AS english FROM language_decisions
    GROUP BY ROLLUP (source, language_code)"""
)
def lang_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "language_decisions", "source", "language_code", "is_english")
    return rows.rollup("source", "language_code").agg(F.count("*").alias("decisions"), F.count_if("is_english").alias("english"))


_SQUEEZED = f"substr({q.strip(f'''regexp_replace(text, '{q.BLANK}+', ' ', 'g')''')}, 1, {languages.MOST_TEXT})"


@query(f"SELECT doc_id, CAST(CASE WHEN length({_SQUEEZED}) >= {languages.LEAST_TEXT} THEN length({_SQUEEZED}) END AS BIGINT) AS judged_chars FROM documents")
def lang_text_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.length(languages.text_gate(F.col("text"))).cast("long").alias("judged_chars"))


# ------------------------------------------------------------------ registering content

_REGISTERED = f"""(SELECT seq, {q.digest_key('content_hash')} AS h, {q.blank_to_null('url')} AS u, output_path FROM registrations)"""
_HELD = f"""(SELECT h, min((canonical_url, canonical_path)) AS held FROM (SELECT {q.digest_key('content_hash')} AS h, canonical_url, canonical_path FROM content_records) WHERE h IS NOT NULL GROUP BY h)"""
_DECIDED = f"""(WITH r AS (SELECT DISTINCT * FROM {_REGISTERED}), held AS MATERIALIZED (SELECT h, held[1] AS hu, held[2] AS hp FROM (SELECT h, [min(canonical_url), arg_min(canonical_path, (canonical_url, canonical_path))] AS held
   FROM (SELECT {q.digest_key('content_hash')} AS h, canonical_url, canonical_path FROM content_records) WHERE h IS NOT NULL GROUP BY h)),
 first AS (SELECT h, min(seq) AS seq, arg_min(u, seq) AS fu, arg_min(output_path, seq) AS fp FROM r WHERE h IS NOT NULL AND u IS NOT NULL GROUP BY h),
 fresh AS (SELECT h, CASE WHEN fu IN (SELECT hu FROM held) THEN 2 ELSE row_number() OVER (PARTITION BY fu ORDER BY seq) END AS n FROM first WHERE h NOT IN (SELECT h FROM held))
 SELECT r.seq, r.u AS url, r.h AS content_hash, CASE WHEN r.h IS NULL OR r.u IS NULL THEN 'error' WHEN fresh.n > 1 THEN 'conflict' WHEN held.h IS NULL AND r.seq = first.seq THEN 'canonical' ELSE 'duplicate' END AS decision,
  coalesce(hu, fu) AS canonical_url, coalesce(hp, fp) AS canonical_path
 FROM r LEFT JOIN first ON r.h = first.h LEFT JOIN held ON r.h = held.h LEFT JOIN fresh ON r.h = fresh.h)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "registrations", "seq", "content_hash", "url", "output_path").distinct()
    return registry.decisions(rows, table(spark, d, "content_records", "content_hash", "canonical_url", "canonical_path"))


@query(f"SELECT seq, url, content_hash, decision, CASE WHEN decision IN ('canonical', 'duplicate') THEN canonical_url END AS canonical_url, CASE WHEN decision IN ('canonical', 'duplicate') THEN canonical_path END AS canonical_path FROM {_DECIDED}")
def dedupe_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d)


@query(f"SELECT CAST(count_if(decision = 'canonical') AS BIGINT) AS unique_count, count(DISTINCT CASE WHEN decision = 'duplicate' THEN url END) AS duplicate_count FROM {_DECIDED}")
def dedupe_counts(spark: SparkSession, d: str) -> DataFrame:
    return registry.counts(_decisions(spark, d))


@query(f"SELECT url, arg_max(content_hash, seq) AS content_hash, arg_max(canonical_url, seq) AS canonical_url, arg_max(canonical_path, seq) AS canonical_path FROM {_DECIDED} WHERE decision = 'duplicate' GROUP BY url")
def dedupe_stored(spark: SparkSession, d: str) -> DataFrame:
    return registry.stored_duplicates(_decisions(spark, d))


@query(f"SELECT url, content_hash FROM duplicate_urls WHERE {q.digest_key('content_hash')} IS NULL OR {q.digest_key('content_hash')} NOT IN (SELECT {q.digest_key('content_hash')} FROM content_records WHERE {q.digest_key('content_hash')} IS NOT NULL)")
def dedupe_orphans(spark: SparkSession, d: str) -> DataFrame:
    rows = registry.orphans(table(spark, d, "duplicate_urls", "url", "content_hash"), table(spark, d, "content_records", "content_hash"))
    return rows.select("url", "content_hash")


@query(f"SELECT url AS canonical_url, count(DISTINCT {q.digest_key('content_hash')}) AS digests FROM (SELECT canonical_url AS url, content_hash FROM content_records UNION ALL SELECT url, content_hash FROM registrations UNION ALL SELECT url, content_hash FROM url_state) GROUP BY url HAVING count(DISTINCT {q.digest_key('content_hash')}) > 1")
def dedupe_shared_canonicals(spark: SparkSession, d: str) -> DataFrame:
    """Over all addresses that any table gives a digest."""
    named = lambda t: table(spark, d, t, F.col("url").alias("canonical_url"), "content_hash")
    rows = table(spark, d, "content_records", "canonical_url", "content_hash").unionByName(named("registrations")).unionByName(named("url_state"))
    return registry.shared_canonicals(rows)


_ALONE = _DECIDED.replace("FROM content_records)", "FROM content_records WHERE false)")


@query(f"SELECT url, arg_max(content_hash, seq) AS content_hash, arg_max(canonical_url, seq) AS canonical_url, arg_max(canonical_path, seq) AS canonical_path FROM {_ALONE} WHERE decision = 'duplicate' GROUP BY url")
def registry_stored(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates held after the batches were registered one after another in a stored registry, opened anew for each."""
    path = f"{shared_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    rows = table(spark, d, "registrations", "seq", "batch_no", "content_hash", "url", "output_path").distinct()
    for n in sorted(r[0] for r in rows.select("batch_no").distinct().collect()):  # one row a batch
        registry.Registry(spark, path).register(rows.filter(F.col("batch_no") == n))
    return registry.Registry(spark, path).duplicates()


@query("SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def dedupe_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(f"SELECT h AS content_hash, arg_max(norm, (seq, norm)) AS url FROM (SELECT {q.digest_key('content_hash')} AS h, norm, seq FROM {q.parsed('registrations', 'url')}) WHERE h IS NOT NULL AND norm IS NOT NULL GROUP BY h")
def hash_last_writer(spark: SparkSession, d: str) -> DataFrame:
    return freshness.last_writers(table(spark, d, "registrations", "seq", "content_hash", "url"))


# ------------------------------------------------------------------ state

_STATE_ROW = f"(SELECT norm AS url, {q.instant('saved_at')} AS inst, run_id, {q.digest_key('content_hash')} AS h, coalesce(filename, '') AS f FROM {q.parsed('url_state', 'url')} WHERE norm IS NOT NULL)"
_STATE = f"(SELECT url, x.inst AS saved_at, x.f AS filename, x.h AS content_hash FROM (SELECT url, last(struct_pack(inst := inst, f := f, h := h) ORDER BY inst NULLS FIRST, run_id NULLS FIRST, h NULLS FIRST, f) AS x FROM {_STATE_ROW} GROUP BY url))"
_FRESH = f"coalesce(saved_at > TIMESTAMPTZ '{NOW}' - INTERVAL {HOURS} HOURS, false)"


def _state(spark: SparkSession, d: str) -> DataFrame:
    return freshness.state(table(spark, d, "url_state", "url", "saved_at", "filename", "content_hash", "run_id"))


@query(f"SELECT url, CAST(CAST(epoch_us(saved_at) AS BIGINT) AS VARCHAR) AS saved_at_us, filename, content_hash FROM {_STATE}")
def state_latest(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("url", F.unix_micros("saved_at").cast("string").alias("saved_at_us"), "filename", "content_hash")


def _split(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "markdown_documents", "url", F.col("page_id").alias("ord"))
    return freshness.split_fresh(pages, _state(spark, d), _now(), HOURS)


_SPLIT = f"(SELECT p.url, first_at, {_FRESH} AS fresh FROM (SELECT norm AS url, min(page_id) AS first_at FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL GROUP BY norm) p LEFT JOIN {_STATE} s ON s.url = p.url)"


@query(f"SELECT url, first_at, fresh FROM {_SPLIT}")
def incremental_fresh(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


@query(f"SELECT url, first_at FROM {_SPLIT} WHERE NOT fresh")
def incremental_filter(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).filter("NOT fresh").select("url", "first_at")


@query(f"SELECT count(DISTINCT url) AS incremental_skipped, sha256(string_agg(url, chr(10) ORDER BY url)) AS skipped_hash FROM {_SPLIT} WHERE fresh")
def skip_list(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array_join("incremental_skipped_urls", "\n")
    return freshness.skips(_split(spark, d)).select("incremental_skipped", F.sha2(listed, 256).alias("skipped_hash"))


@query(
    f"""SELECT p.url, bool_or(coalesce(p.h = s.content_hash, false)) AS unchanged FROM (SELECT norm AS url, {q.digest_key('content_hash')} AS h FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL) p
    LEFT JOIN {_STATE} s ON s.url = p.url GROUP BY p.url"""
)
def incremental_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return freshness.unchanged(table(spark, d, "markdown_documents", "url", "content_hash"), _state(spark, d))


@query(
    f"""WITH w AS MATERIALIZED (SELECT norm AS url, arg_max(h, seq) AS content_hash, arg_max(output_path, seq) AS filename FROM (SELECT norm, seq, {q.digest_key('content_hash')} AS h, output_path FROM {q.parsed('registrations', 'url')})
     WHERE norm IS NOT NULL AND h IS NOT NULL GROUP BY norm)
    SELECT url, filename, content_hash FROM w UNION ALL SELECT url, filename, content_hash FROM {_STATE} WHERE url NOT IN (SELECT url FROM w)"""
)
def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    wins = table(spark, d, "registrations", "seq", "url", "content_hash", F.col("output_path").alias("filename"), F.col("registered_at").cast("timestamp").alias("saved_at"))
    return freshness.upserted(_state(spark, d), wins).select("url", "filename", "content_hash")


@query("SELECT status, count(*) AS runs, CAST(coalesce(sum(epoch(finished_at) - epoch(started_at)), 0) AS BIGINT) AS seconds FROM sync_runs GROUP BY status")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    took = F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return table(spark, d, "sync_runs").groupBy("status").agg(F.count("*").alias("runs"), F.coalesce(F.sum(took), F.lit(0)).alias("seconds"))


# ------------------------------------------------------------------ reports: events stand for pages of a crawl, users for sites

_OUTCOME = "CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'incremental_skipped' WHEN 'signup' THEN 'duplicate_content' WHEN 'purchase' THEN 'empty_pages' ELSE 'failed' END"
_COUNTS = f"""(SELECT user_id, CAST(count_if(o NOT IN ('incremental_skipped', 'failed')) AS BIGINT) AS processed, {", ".join(f"CAST(count_if(o = '{o}') AS BIGINT) AS {o}" for o in report.OUTCOMES)},
 CAST(floor(max(epoch(ts)) - min(epoch(ts))) AS BIGINT) AS elapsed FROM (SELECT *, {_OUTCOME} AS o FROM events) GROUP BY user_id)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "user_id", "event_type", "ts").withColumn("outcome", F.expr(_OUTCOME))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    took = rows.groupBy("user_id").agg(F.floor((F.max(micros) - F.min(micros)) / 1e6).alias("elapsed"))
    return report.counters(rows, ["user_id"]).join(took, "user_id")


@query(f"SELECT * FROM {_COUNTS}")
def crawl_counters(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).select("user_id", "processed", *report.OUTCOMES, "elapsed")


@query(
    f"""SELECT user_id, c AS completed_requests, t AS progress_total, least(processed, t) AS progress_completed,
     CAST(CASE WHEN elapsed > 0 THEN round(processed / elapsed * 60.0 * 1e6) ELSE 0 END AS BIGINT) AS micro_rpm,
     CAST(round(least(100.0, (saved + duplicate_content + incremental_skipped) / greatest(c, processed, 1) * 100.0) * 1e6) AS BIGINT) AS micro_success,
     duplicate_content + incremental_skipped + rejected_urls + empty_pages + non_english AS skipped_total, CASE WHEN failed = 0 THEN 0 ELSE 1 END AS exit_code
    FROM (SELECT *, saved + duplicate_content + incremental_skipped + rejected_urls + empty_pages + non_english + failed AS c, least(greatest(processed + 5, processed), 100) AS t FROM {_COUNTS})"""
)
def progress_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).withColumns({"queued": F.lit(5), "discovered": F.lit(3)})
    rows = report.with_progress(rows, F.lit(100).cast("long"), F.col("elapsed"))
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return rows.select(
        "user_id", "completed_requests", "progress_total", "progress_completed", micro("requests_per_minute").alias("micro_rpm"), micro("success_rate").alias("micro_success"), "skipped_total", "exit_code"
    )


@query(
    f"""SELECT user_id, 'Finished: processed=' || processed || ' saved=' || saved || ' duplicate=' || duplicate_content || ' incremental_skipped=' || incremental_skipped
    || ' non_english=' || non_english || ' failed=' || failed AS summary, CASE WHEN elapsed < 36000 THEN '0' ELSE '' END || CAST(elapsed // 3600 AS VARCHAR) || ':'
    || lpad(CAST(elapsed % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(elapsed % 60 AS VARCHAR), 2, '0') AS duration, CASE WHEN failed > 0 THEN 'failures' ELSE 'success' END AS status FROM {_COUNTS}"""
)
def finished_summary(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    text = report.summary(c("processed"), c("saved"), c("duplicate_content"), c("incremental_skipped"), c("non_english"), c("failed"))
    return _counts(spark, d).select("user_id", text.alias("summary"), report.duration(c("elapsed")).alias("duration"), report.status(F.lit(False), c("failed")).alias("status"))


@query(
    f"""SELECT url, o AS outcome, CASE WHEN o IN ('saved', 'unchanged') THEN sha256(coalesce(own, later)) END AS content_hash, o IN ('saved', 'unchanged') AND own IS NULL AS used_fallback FROM (
    SELECT *, CASE WHEN page_id % 11 = 0 THEN 'non_english' WHEN own IS NULL AND later IS NULL AND links > 0 THEN 'discovery_only' WHEN own IS NULL AND later IS NULL THEN 'failed' WHEN page_id % 5 = 0 THEN 'unchanged' ELSE 'saved' END AS o
    FROM (SELECT page_id, url, CASE WHEN page_id % 7 > 0 THEN nullif({q.md_normal('markdown')}, '') END AS own, CASE WHEN page_id % 14 = 0 THEN nullif({q.md_normal('markdown')}, '') END AS later,
      len(regexp_extract_all(markdown, '\\]\\(([^)\\s]+)', 1)) AS links FROM (SELECT min(page_id) AS page_id, url, arg_min(markdown, page_id) AS markdown FROM markdown_documents GROUP BY url)))"""
)
def page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A seventh of the pages comes without content, half of these are in the snapshot of rendered pages."""
    rows = table(spark, d, "markdown_documents", "page_id", "url", "markdown").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("markdown", "page_id").alias("markdown"))
    body, p = markdown.normalize(F.col("markdown")), F.col("page_id")
    pages = rows.select("url", F.when(p % 7 > 0, body).alias("content"), F.size(links.markdown_targets(F.col("markdown"))).alias("links"), (p % 5 == 0).alias("unchanged"), (p % 11 > 0).alias("is_english"))
    found = report.page_outcomes(pages, rows.filter(p % 14 == 0).select("url", body.alias("content")))
    return found.select("url", "outcome", F.sha2("content", 256).alias("content_hash"), "used_fallback")


_RUN = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(
    f"""SELECT event_id, CAST(sum(CASE WHEN o NOT IN ('incremental_skipped', 'failed') THEN 1 ELSE 0 END) {_RUN} AS BIGINT) AS processed, {", ".join(f"CAST(sum(CASE WHEN o = '{o}' THEN 1 ELSE 0 END) {_RUN} AS BIGINT) AS {o}" for o in report.OUTCOMES)}
    FROM (SELECT *, {_OUTCOME} AS o FROM events)"""
)
def event_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters after every event; blocks are small here so that some are carried."""
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "ts").withColumn("outcome", F.expr(_OUTCOME))
    return report.running(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "processed", *report.OUTCOMES)


@query(
    f"""SELECT count(*) AS discovered_urls, CAST(count_if(o IS NOT NULL) AS BIGINT) AS processed_urls, CAST(count_if(o = 'reachable') AS BIGINT) AS reachable_pages, CAST(count_if(o = 'not_found') AS BIGINT) AS not_found_pages,
      CAST(count_if(o = 'failed') AS BIGINT) AS failed_pages, CAST(count_if(r) AS BIGINT) AS redirects, CAST(count_if(o = 'reachable' AND e) AS BIGINT) AS english_urls, CAST(count_if(o = 'reachable' AND NOT coalesce(e, false)) AS BIGINT) AS non_english_urls,
      count(*) - CAST(count_if(o IS NOT NULL) AS BIGINT) AS remaining_urls, false AS discovery_complete
    FROM (SELECT url, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 13 = 0 THEN 'not_found' WHEN page_id % 17 = 0 THEN 'failed' ELSE 'reachable' END AS o, page_id % 9 > 0 AND page_id % 3 = 0 AS r, CASE WHEN page_id % 9 > 0 THEN language = 'en' END AS e
      FROM (SELECT url, min(page_id) AS page_id, min(language) AS language FROM markdown_documents GROUP BY url))"""
)
def inventory_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_documents", "page_id", "url", "language").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min("language").alias("language"))
    p = F.col("page_id")
    outcome = F.when(p % 13 == 0, "not_found").when(p % 17 == 0, "failed").otherwise("reachable")
    facts = rows.filter(p % 9 > 0).select("url", outcome.alias("outcome"), (p % 3 == 0).alias("is_redirect"), (F.col("language") == "en").alias("is_english"))
    return frontier.counters(rows.select("url"), facts, 10**9).drop("robots_blocked", "timeouts")


# ------------------------------------------------------------------ pacing: events stand for requests, users for hosts

_MICROS = "CAST(epoch_us(ts) AS BIGINT)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts")
    return rows.withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    f"""SELECT event_id, CAST(max(a - i * 10000000000) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) + i * 10000000000 AS BIGINT) AS start_us
    FROM (SELECT *, {_MICROS} AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""
)
def pacing_schedule(spark: SparkSession, d: str) -> DataFrame:
    delay = F.lit(10_000_000_000)
    return pacing.schedule(_requests(spark, d), delay, ["user_id"], ["arrival", "event_id"]).select("event_id", F.col("start").alias("start_us"))


@query(f"SELECT user_id, {_MICROS} // 60000000 AS minute, count(*) AS requests FROM events GROUP BY ALL")
def rpm_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = _requests(spark, d).withColumn("t", F.col("ts").cast("timestamp"))
    return pacing.per_minute(rows, "t", ["user_id"]).select("user_id", (F.unix_seconds("minute") / 60).cast("long").alias("minute"), "requests")


@query(
    """SELECT event_id, CAST(n AS BIGINT) AS consecutive, CAST(CASE WHEN th THEN least(60.0, 2.0 * pow(2.0, n - 1)) ELSE 0 END AS BIGINT) AS delay FROM (
    SELECT *, sum(CASE WHEN th THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT *, event_type = 'error' AS th, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events))"""
)
def backoff_throttled(spark: SparkSession, d: str) -> DataFrame:
    rows = pacing.backoff(_requests(spark, d), "user_id", ["arrival", "event_id"], F.col("event_type") == "error")
    return rows.select("event_id", "consecutive", F.col("delay").cast("long").alias("delay"))


@query(
    """SELECT event_id, CAST(n AS BIGINT) AS consecutive, CAST(greatest(CASE WHEN th THEN coalesce(ra, least(60.0, 2.0 * pow(2.0, n - 1))) ELSE 0 END,
      coalesce(first_value(cd IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)) AS BIGINT) AS delay FROM (
    SELECT *, sum(CASE WHEN th THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT *, sum(CASE WHEN th THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, event_type IN ('error', 'purchase', 'click') AND user_id % 5 > 0 AS th, CASE WHEN event_id % 3 = 0 THEN 15 END AS ra, CASE WHEN event_id % 8 = 0 THEN 3 + event_id % 5 END AS cd FROM events)))"""
)
def backoff_retry_after(spark: SparkSession, d: str) -> DataFrame:
    """Every third answer says itself when to ask again; the first crawl delay of a site holds; a fifth of the sites isn't configured."""
    e = F.col("event_id")
    rows = pacing.backoff(
        _requests(spark, d), "user_id", ["arrival", "event_id"], F.col("event_type").isin("error", "purchase", "click"), retry_after=F.when(e % 3 == 0, 15.0),
        configured=F.col("user_id") % 5 > 0, crawl_delay=F.when(e % 8 == 0, 3 + e % 5), blocks_=16,
    )
    return rows.select("event_id", "consecutive", F.col("delay").cast("long").alias("delay"))


@query(
    """SELECT user_id, day, CAST(coalesce(min(CASE WHEN event_type <> 'error' THEN n END), max(n)) AS BIGINT) AS attempts, min(CASE WHEN event_type <> 'error' THEN n END) IS NULL AS failed
    FROM (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3 GROUP BY user_id, day"""
)
def retry_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _requests(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return pacing.within_budget(rows, ["user_id", "day"], ["arrival", "event_id"], F.col("event_type") == "error")


@query(
    """SELECT user_id, last(CASE WHEN event_type = 'error' THEN event_id END ORDER BY ts, event_id) FILTER (WHERE event_type = 'error') AS last_error,
    last(event_id ORDER BY ts, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase, last(event_type ORDER BY ts, event_id) AS phase FROM events GROUP BY user_id"""
)
def event_fold_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = _requests(spark, d).select(
        "user_id", "arrival", "event_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("last_error"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("last_purchase"), F.col("event_type").alias("phase"),
    )
    return pacing.folded(rows, "user_id", ["arrival", "event_id"], ["last_error", "last_purchase", "phase"])


@query(
    """SELECT event_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS active FROM (
    SELECT *, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN -1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)"""
)
def active_gauge(spark: SparkSession, d: str) -> DataFrame:
    change = F.when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type").isin("error", "purchase"), -1).otherwise(0)
    rows = _requests(spark, d).withColumn("change", change)
    return pacing.active(rows, ["user_id"], ["arrival", "event_id"], "change").select("event_id", F.col("active").cast("long").alias("active"))


@query(
    """SELECT event_id, CASE WHEN CAST(value AS BIGINT) % 10 = 0 THEN 'robots_blocked' WHEN event_type = 'error' AND CAST(value AS BIGINT) % 2 = 0 THEN 'timeout' WHEN event_type = 'error' THEN 'failed'
    WHEN event_type = 'signup' THEN 'not_found' WHEN event_type = 'purchase' THEN 'failed' WHEN CAST(value AS BIGINT) % 7 = 1 THEN 'failed' ELSE 'reachable' END AS outcome FROM events"""
)
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    v = F.round("value").cast("long")
    v = F.expr("CAST(bround(value) AS BIGINT)")
    kind = F.when(F.col("event_type") == "error", F.when(v % 2 == 0, "timeout").otherwise("network"))
    http = F.when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "purchase", 503).otherwise(200)
    content = F.when(v % 7 == 1, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    rows = table(spark, d, "events", "event_id", "event_type", "value")
    return rows.select("event_id", report.fetch_outcome(v % 10 == 0, kind, http, content).alias("outcome"))


# ------------------------------------------------------------------ HTML, site maps and streams


@query()
def html_export(spark: SparkSession, d: str) -> DataFrame:
    """Documents of HTML pages made from the Markdown ones, line by line."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.filter(F.split("markdown", r"\r?\n"), lambda x: x != ""), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>")))
    html = F.concat(
        F.lit('<html lang="'), F.coalesce("language", F.lit("")), F.lit('"><head><title>'), esc(F.coalesce("title", F.lit(""))),
        F.lit("</title></head><body><nav><p>Menu</p></nav><article>"), F.array_join(lines, ""), F.lit("</article></body></html>"),
    )
    pages = table(spark, d, "markdown_documents", "url", "title", "language", "markdown").select("url", html.alias("html"))
    return export.documents(pages).select("url", "title", "language", "output_path", "content_hash", "is_empty")


@query(f"SELECT DISTINCT norm AS loc FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL")
def sitemap_read(spark: SparkSession, d: str) -> DataFrame:
    """Addresses read back from a site map for each page."""
    u = urls.normalize(F.col("url"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    files = table(spark, d, "markdown_documents", "url").filter(u.isNotNull()).select(u.alias("url"), F.to_binary(xml, F.lit("utf-8")).alias("payload")).distinct()
    return sitemaps.read(files).select(F.explode("locs").alias("loc"))


_H = "regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')"


@query(
    f"""SELECT url, sha256('# ' || h || chr(10) || chr(10) || 'About ' || h || ' and **more** of it, long enough to be the content of a page that is to be read as such.' || chr(10) || chr(10) || '- first ' || h || chr(10) || '- second & last'
     || chr(10) || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || chr(10) || 'See [' || h || '](/next).' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10)) AS content_hash
    FROM (SELECT DISTINCT url, trim('T ' || trim({_H})) AS h FROM markdown_documents WHERE url IN (SELECT url FROM markdown_documents GROUP BY url HAVING count(DISTINCT coalesce(title, '')) = 1))"""
)
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Headings, emphasis, lists, links, entities and tables of HTML pages made from the titles; addresses with several titles have no one page."""
    h = F.trim(F.concat(F.lit("T "), F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z0-9 ]", ""), " +", " "))))
    rows = table(spark, d, "markdown_documents", "url", "title").groupBy("url").agg(F.count_distinct(F.coalesce("title", F.lit(""))).alias("n"), F.max("title").alias("title")).filter("n = 1")
    html = F.concat(
        F.lit("<html><head><script>x</script></head><body><nav><a href='/'>Home</a></nav><article><h1>"), h, F.lit("</h1><p>About "), h,
        F.lit(" and <b>more</b> of it, long enough to be the content of a page that is to be read as such.</p><ul><li>first "), h, F.lit("<li>second &amp; last</ul><ol><li>one</li><li>two</li></ol><p>See <a href='/next'>"), h,
        F.lit("</a>.</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></article><footer>end</footer></body></html>"),
    )
    return export.documents(rows.select("url", html.alias("html"))).select("url", "content_hash")


@query(
    f"""SELECT start, url FROM (SELECT 'https://' || host || '/' AS start, norm AS url, scheme, origin_port, path2 FROM {q.parsed('markdown_documents', 'url')} WHERE norm IS NOT NULL GROUP BY ALL)
    WHERE scheme = 'https' AND origin_port = 443 AND regexp_extract(lower(path2), '[^/](\\.[^./]+)$', 1) NOT IN ({q.strings(urls.SITEMAP_EXTENSIONS)}) AND NOT list_has_any(string_split(lower(path2), '/'), [{q.strings(urls.SITEMAP_PARTS)}])"""
)
def sitemap_walk(spark: SparkSession, d: str) -> DataFrame:
    """Each host's pages found through an index of an index of an index, over as many levels as there are; nothing is capped here."""
    pages = table(spark, d, "markdown_documents", "url").select(urls.normalize(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    pages = pages.withColumn("start", F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/")))
    starts = pages.select("start").distinct()
    loc = lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    lists = pages.groupBy("start").agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(loc(F.col("url")))), ""), F.lit("</urlset>")).alias("xml"))
    files = lists.select(F.concat("start", F.lit("maps/4.xml")).alias("url"), "xml")
    for here, there in (("sitemap.xml", "maps/1.xml"), ("maps/1.xml", "maps/2.xml"), ("maps/2.xml", "maps/3.xml"), ("maps/3.xml", "maps/4.xml")):
        xml = F.concat(F.lit("<sitemapindex><sitemap><loc>"), "start", F.lit(f"{there}</loc></sitemap></sitemapindex>"))
        files = files.unionByName(starts.select(F.concat("start", F.lit(here)).alias("url"), xml.alias("xml")))
    files = files.select("url", F.to_binary("xml", F.lit("utf-8")).alias("payload"))
    listed = starts.limit(0).select("start", F.lit(0).alias("pos"), F.col("start").alias("sitemap_url"))
    return sitemaps.discover(starts, listed, files, None, None)[0].select("start", "url")


@query(
    f"""SELECT state_key, arg_max(h, (batch_no, t, h)) AS state_hash, arg_max(f, (batch_no, t, h)) AS filename FROM (
      SELECT norm AS state_key, batch_no, registered_at AS t, {q.digest_key('content_hash')} AS h, output_path AS f FROM {q.parsed('registrations', 'url')} WHERE norm IS NOT NULL AND {q.digest_key('content_hash')} IS NOT NULL AND registered_at IS NOT NULL) GROUP BY 1"""
)
def state_stored(spark: SparkSession, d: str) -> DataFrame:
    """The stored state after the batches were committed one after another: the latest of a batch, the last batch of all."""
    store = incremental.StateStore(spark, f"{shared_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}", buckets=8)
    rows = table(spark, d, "registrations", "batch_no", "url", "content_hash", "output_path", "registered_at")
    rows = rows.select("batch_no", urls.normalize(F.col("url")).alias("state_key"), digest_key(F.col("content_hash")).alias("state_hash"), F.col("registered_at").cast("timestamp").alias("saved_at"), F.col("output_path").alias("filename"))
    rows = rows.filter("state_hash IS NOT NULL AND saved_at IS NOT NULL")
    for n in sorted(r[0] for r in rows.select("batch_no").distinct().collect()):  # one row a batch
        store.commit(rows.filter(F.col("batch_no") == n))
    return store.read().select("state_key", "state_hash", "filename")


@query("SELECT DISTINCT page_id FROM content_records")
def stream_sync(spark: SparkSession, d: str) -> DataFrame:
    """Records run through the streaming sync from an empty state: each of them is new once."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = "page_id long, content_hash string, canonical_url string"
    # A pattern, as the stream takes one file only by a pattern and folders either way.
    rows = ingest.source(spark, f"{d}/content_records.parque[t]", schema)
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    key, row_hash = urls.normalize(F.col("canonical_url")), digest_key(F.col("content_hash"))
    ingest.sync(rows, f"{base}/state", key, row_hash, "page_id", sink, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("page_id").distinct()
