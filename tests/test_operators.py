import gzip
import random
import re
import threading
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagelake.config import Settings, boolean, integer, mode
from pagelake.functions import dom, languages, markdown, urls
from pagelake.functions.text import digest_key
from pagelake.operators import export, freshness, frontier, links, pacing, registry, report, sitemaps
from pagelake.operators.incremental import StateStore, instant, latest_state, new_or_changed, run_incremental
from pagelake.plans import core_queries


def test_instants(spark):
    rows = [
        ("2025-05-10T18:05:36+02:00", "2025-05-10 16:05:36"), ("2025-05-10T18:05:36", "2025-05-10 18:05:36"), (" 20250510T180536Z ", "2025-05-10 18:05:36"),
        ("2025-05-10 18:05:36.25-0530", "2025-05-10 23:35:36.25"), ("2025-05-10", "2025-05-10 00:00:00"), ("yesterday", None), ("2025-13-10T00:00:00Z", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(rows, "t string, w string").select("w", instant(F.col("t")).cast("string").alias("g"))
    assert all(r["w"] == r["g"] for r in df.collect())


def test_new_or_changed(spark):
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "Succeeded ")], "run_id long, status string")
    state = spark.createDataFrame([
        ("https://a.b/1", "2025-01-01T00:00:00Z", "AA", 1), ("https://A.B/1/", "2025-01-02T00:00:00+05:00", "bb ", 3), ("https://a.b/2", "2025-01-01T00:00:00Z", "cc", 2),
        ("https://a.b/3", "unreadable", "dd", 1), ("https://a.b/4", "2025-01-01T00:00:00Z", None, 1), (None, "2025-01-01T00:00:00Z", "x", 1), ("https://a.b/5", "2025-01-01T00:00:00Z", "ee", 1),
    ], "url string, saved_at string, content_hash string, run_id long")
    records = spark.createDataFrame([(1, "https://a.b/1", " BB", 9), (2, "https://a.b/2", "cc", 9), (3, "https://a.b/3", "dd", 9), (4, "https://a.b/4", None, 9), (5, "https://a.b/5", "ee", 9), (5, "https://a.b/5", "ee", 9), (6, None, "ff", 9)],
                                    "page_id long, canonical_url string, content_hash string, run_id long")
    key, value = urls.normalize(F.col("canonical_url")), digest_key(F.col("content_hash"))
    latest = latest_state(state, runs)
    got = {tuple(r) for r in new_or_changed(records, latest, "page_id", key, value).collect()}
    assert got == {(2, "new"), (3, "new"), (4, "changed"), (6, "new")}
    empty = records.limit(0)
    assert new_or_changed(empty, latest, "page_id", key, value).count() == 0
    assert new_or_changed(records, latest.limit(0), "page_id", key, value).count() == 6


def test_state_store_survives_a_broken_run(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, k string, h string")
    seen = []

    def run(frame, fail=False):
        def process(todo):
            seen.append({r["id"] for r in todo.collect()})
            if fail:
                raise OSError("broke off")

        return run_incremental(store, frame, "id", F.col("k"), F.col("h"), process)

    with pytest.raises(OSError):
        run(rows, fail=True)
    assert store.version() == 0
    assert run(rows) == 1 and run(rows) == 2
    changed = spark.createDataFrame([(1, "a", "x"), (2, "b", "z"), (3, "c", "w")], "id long, k string, h string")
    run(changed)
    assert seen == [{1, 2}, {1, 2}, set(), {2, 3}]
    with pytest.raises(RuntimeError):
        store.commit(rows.select(F.col("k").alias("state_key"), F.col("h").alias("state_hash")), base=1)
    assert {tuple(r)[:2] for r in store.read().collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    assert store.vacuum(keep=1) > 0 and store.read().count() == 3


def test_changes_during_a_run_are_taken_up_again(spark, tmp_path):
    store, source = StateStore(spark, f"file://{tmp_path}/state", buckets=4), f"file://{tmp_path}/source"
    schema = "id long, k string, h string"
    write = lambda h: spark.createDataFrame([(1, "a", h), (2, "b", "y")], schema).write.mode("overwrite").parquet(source)
    seen = []

    def process(todo):
        seen.append(sorted(r["id"] for r in todo.collect()))
        if len(seen) == 1:
            write("later")

    write("x")
    for _ in range(3):
        run_incremental(store, spark.read.schema(schema).parquet(source), "id", F.col("k"), F.col("h"), process, F.lit("2025-01-01").cast("timestamp"), F.concat("k", F.lit(".md")))
    assert seen == [[1, 2], [1], []]
    assert {(r["state_key"], r["state_hash"], r["filename"], r["saved_at"].year) for r in store.read().collect()} == {("a", "later", "a.md", 2025), ("b", "y", "b.md", 2025)}


def test_one_of_racing_commits_wins(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    won = []

    def commit(k):
        try:
            won.append(store.pointer.swap(f'{{"folders": {{}}, "batches": {{}}, "by": {k}}}', 0))
        except RuntimeError:
            pass

    threads = [threading.Thread(target=commit, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won == [1] and store.version() == 1
    rows = spark.createDataFrame([(f"k{i}", "h") for i in range(50)], "state_key string, state_hash string")
    assert store.commit(rows.filter("state_key < 'k2'")) == 2 and store.commit(rows) == 3 and store.read().count() == 50
    assert store.commit(rows.limit(0)) == 4 and store.read().count() == 50


def test_markdown_functions(spark):
    m = "  \r\n# Title  \r\n\r\n\r\n\r\nParagraph\t\nsee ![](a.png) [ ](b) x\n\n"
    row = spark.createDataFrame([(m, None, "https://e.x/docs/API Guide")], "m string, t string, u string").select(
        markdown.normalize(F.col("m")).alias("n"), markdown.heading(F.col("m")).alias("h"), markdown.resolved_title(F.col("t"), F.col("m"), F.col("u")).alias("t"), markdown.output_path(F.col("u"), F.lit("x")).alias("p")
    ).first()
    assert row["n"] == "# Title\n\nParagraph\nsee !  x\n" and row["h"] == "Title" and row["t"] == "Title"
    assert row["p"].startswith("e.x/docs/api-guide-") and row["p"].endswith(".md")
    cases = {"Hello World": "hello-world", "  API___Reference  ": "api___reference", "Çığ Öğütücü": "cg-ogutucu", "...": "page", "a---b": "a-b", "": "page"}
    got = spark.createDataFrame(list(cases.items()), "a string, b string").select("b", markdown.slug(F.col("a")).alias("s")).collect()
    assert all(r["b"] == r["s"] for r in got)
    assert spark.createDataFrame([('a"b\\c\né/',)], "v string").select(markdown.json_string(F.col("v"))).first()[0] == '"a\\"b\\\\c\\né/"'


def test_slugs_of_all_titles_against_brute_force(spark):
    d = "/root/testdata/sf0.001"

    def brute(title):
        plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower().strip()
        return re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9._-]+", "-", plain)).strip("-._") or "page"

    titles = {r["title"] for r in spark.read.parquet(f"{d}/markdown_documents.parquet").select("title").collect()}
    got = {r["title"]: r["slug"] for r in core_queries.QUERIES["slugify_all_titles"](spark, d).collect()}
    assert got == {t: None if t is None else brute(t) for t in titles} and any(t and not t.isascii() for t in titles)


def test_language_declarations(spark):
    rows = [("en-US,fr;q=0.5", None, "https://x.y/", "en-us"), (None, "PT_br", "https://x.y/", "pt-br"), ("  ", "", "https://de.x.y/fr/", "de"), (None, None, "https://www.x.y/a/zh-Hans/b", "zh-hans"), (None, None, "https://x.y/a/b/fr", None)]
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(rows, "h string, l string, u string, w string").select("w", languages.cascade(F.col("h"), F.col("l"), none, none, F.col("u"))["language_code"].alias("g"))
    assert all(r["w"] == r["g"] for r in df.collect())


def test_registry(spark):
    rows = spark.createDataFrame([
        (1, "AA", "u1", "p1"), (2, " aa ", "u2", "p2"), (3, "bb", "u1", "p3"), (4, "", "u4", "p4"), (5, "cc", None, "p5"), (6, "dd", "u6", "p6"), (7, "held", "u7", "p7"), (8, "aa", "u1", "p1"),
    ], "seq long, content_hash string, url string, output_path string")
    held = spark.createDataFrame([("HELD", "k", "kp")], "content_hash string, canonical_url string, canonical_path string")
    got = {r["seq"]: (r["decision"], r["canonical_url"]) for r in registry.decisions(rows, held).collect()}
    assert got == {1: ("canonical", "u1"), 2: ("duplicate", "u1"), 3: ("conflict", None), 4: ("error", None), 5: ("error", None), 6: ("canonical", "u6"), 7: ("duplicate", "k"), 8: ("duplicate", "u1")}
    assert tuple(registry.counts(registry.decisions(rows)).first()) == (3, 2)


def test_pacing_against_a_loop(spark):
    rng = random.Random(3)
    rows = [("h%d" % rng.randrange(3), i, rng.random() * 50) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, i int, arrival double")
    got = {(r["k"], r["i"]): r["start"] for r in pacing.schedule(df, F.lit(2.5), ["k"], ["arrival", "i"]).collect()}
    last = {}
    for k, i, a in sorted(rows, key=lambda r: (r[2], r[1])):
        last[k] = max(a, last.get(k, -1e9) + 2.5)
        assert abs(got[k, i] - last[k]) < 1e-9
    fixed = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 11.25)], "k string, i int, arrival double")
    assert [r["start"] for r in pacing.schedule(fixed, F.lit(3.0), ["k"], ["i"]).orderBy("i").collect()] == [10.0, 13.0]


def test_gauge_and_fold(spark):
    df = spark.createDataFrame([("a", 1, -1, None, "x"), ("a", 2, 1, "t", None), ("a", 3, 1, None, None), ("a", 4, -1, None, "y")], "k string, i int, c int, t string, p string")
    assert [r["active"] for r in pacing.active(df, ["k"], ["i"], "c").orderBy("i").collect()] == [0, 1, 2, 1]
    assert tuple(pacing.folded(df, "k", ["i"], ["t", "p"]).first()) == ("a", "t", "y")


def test_report(spark, tmp_path):
    row = spark.createDataFrame([(3661.9, 1.0, 4.0)], "s double, a double, b double").select(report.duration(F.col("s")), report.percentage(F.col("a"), F.col("b")), report.percentage(F.col("a"), F.lit(0)))
    assert tuple(row.first()) == ("01:01:01", " 25.0%", "  0.0%")
    path = report.write_json({"b": {2, 1}, "a": "é"}, tmp_path)
    assert path.read_text() == '{\n  "a": "é",\n  "b": [\n    1,\n    2\n  ]\n}\n' and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError):
        report.write_json({}, tmp_path, " ")
    figures = dict.fromkeys(("processed_urls", "reachable_pages", "english_urls", "non_english_urls", "robots_blocked", "not_found_pages", "timeouts", "failed_pages"), 1)
    assert report.inventory_progress(figures, 5, 2).endswith("classified=2 | english=1 | non_english=1 | blocked=1 | 404=1 | timeouts=1 | failed=1 | problems=4")


def test_dom_and_export(spark, tmp_path):
    text = "long enough text " * 10
    html = f"""<html lang="en"><head><title> API &amp; Guide </title><meta property="og:locale" content="de_DE"></head><body><nav><a href="/x">n</a></nav><main>
    <h1>API Guide</h1><script>bad()</script><p>{text}<b>bold<p>next <a href="/y">link</a> <a href=" ">gone</a><img src=""></p><ul><li>one<li>two</ul>
    <pre>x  = 1
y</pre><table><tr><th>a<th>b<tr><td>1<td>2</table></main><footer>foot</footer></body></html>"""
    pages = spark.createDataFrame([("https://e.x/docs/api", html, "en-US"), ("https://e.x/empty", "<main><script>x</script></main>", None), ("https://e.x/null", None, None)], "url string, html string, content_language string")
    rows = {r["url"]: r for r in export.documents(pages).collect()}
    r = rows["https://e.x/docs/api"]
    assert r["title"] == "API & Guide" and r["language"] == "en-us" and list(r["links"]) == ["/x", "/y"]
    assert r["markdown"].startswith("# API Guide\n\n") and "bad()" not in r["markdown"] and "foot" not in r["markdown"]
    assert "**bold**\n\nnext [link](/y) gone" in r["markdown"] and "- one\n- two" in r["markdown"] and "```\nx  = 1\ny\n```" in r["markdown"] and "| a | b |\n| --- | --- |\n| 1 | 2 |" in r["markdown"]
    assert rows["https://e.x/empty"]["is_empty"] and rows["https://e.x/null"]["is_empty"]
    written = export.write_files(export.documents(pages).filter("NOT is_empty"), str(tmp_path)).collect()
    assert (tmp_path / written[0]["output_path"]).stat().st_size == written[0]["bytes"]
    assert dom.examine("<p>a<p>b")["visible_text"] == "a b"


def test_links_and_robots(spark):
    pages = spark.createDataFrame([("https://e.x/docs/", "[a](guide) [b](/docs/guide#x) [c](https://o.x/) [d](login) [e]() [f](/docs) [g](x.pdf)")] * 2, "url string, markdown string")
    assert [tuple(r) for r in links.edges(pages, links.markdown_targets(F.col("markdown"))).collect()] == [("https://e.x/docs", 0, "https://e.x/docs/guide")]
    robots = spark.createDataFrame([("https://e.x/", "User-agent: *\nAllow: /\nDisallow: /blocked\nSitemap: /s.xml # c\nsitemap: /s.xml\nSitemap:\n")], "host_url string, body string")
    assert [r["sitemap_url"] for r in links.robots_sitemaps(robots).collect()] == ["https://e.x/s.xml"]
    pages = spark.createDataFrame([("https://e.x/blocked/a",)], "url string")
    rules = links.robots_rules(robots)
    assert links.allowed(pages, rules, "bot").first()["allowed"] is True
    assert links.allowed(pages, rules, "bot", longest=True).first()["allowed"] is False


def test_frontier_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "z"), ("d", None)], "src_url string, dst_url string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in frontier.levels(seeds, edges).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert frontier.levels(seeds, edges, most_urls=2).count() == 2
    fetched = spark.createDataFrame([("a", "reachable", False, True), ("b", "not_found", True, None)], "url string, outcome string, is_redirect boolean, is_english boolean")
    row = frontier.counters(frontier.levels(seeds, edges), fetched, 10).first()
    assert (row["discovered_urls"], row["processed_urls"], row["english_urls"], row["remaining_urls"], row["discovery_complete"]) == (4, 2, 1, 2, False)


def test_sitemaps(spark):
    url = "https://e.x/sitemap.xml"
    ok = b"<urlset xmlns='x'><url><loc> https://e.x/a </loc></url><url><loc/></url></urlset>"
    cases = [(ok, url, None), (gzip.compress(ok), url, None), (gzip.compress(ok), url + ".gz", None), (ok, url + ".gz", "compression"), (b"\x1f\x8bxx", url, "compression"), (b"  ", url, "response"), (None, url, "response"), (b"<html><body>", url, "html"), (b"\xff\xfe", url, "encoding")]
    assert [sitemaps.decode(p, u)[1] for p, u, _ in cases] == [e for _, _, e in cases]
    assert sitemaps.locations("<feed/>")[2] == "xml" and sitemaps.locations("<a>")[2] == "xml" and sitemaps.locations("<!DOCTYPE x [<!ENTITY a 'b'>]><urlset/>")[2] == "xml"
    index = b"<sitemapindex><sitemap><loc>/more.xml</loc></sitemap><sitemap><loc>https://other.x/s.xml</loc></sitemap></sitemapindex>"
    files = spark.createDataFrame([(url, bytearray(index)), ("https://e.x/more.xml", bytearray(ok))], "url string, payload binary")
    starts = spark.createDataFrame([("https://e.x/",)], "start string")
    pages, visited = sitemaps.discover(starts, spark.createDataFrame([], "start string, sitemap_url string, pos int"), files)
    assert [tuple(r) for r in pages.collect()] == [("https://e.x/", "https://e.x/a", 1)]
    assert {r["url"]: r["error_class"] for r in visited.collect()} == {url: None, "https://e.x/more.xml": None, "https://e.x/sitemap_index.xml": "missing", "https://e.x/sitemap.xml.gz": "missing"}


def test_freshness(spark):
    state = freshness.state(spark.createDataFrame([("https://a.b/1/", "2025-01-01T00:00:00Z", "f", "AA", 1), ("https://a.b/2", "2024-12-30T00:00:00Z", "g", "bb", 1), ("https://a.b/3", "2026-01-01T00:00:00Z", None, "cc", 1)], "url string, saved_at string, filename string, content_hash string, run_id long"))
    pages = spark.createDataFrame([("https://a.b/1", 3), ("https://a.b/1/?utm_source=x", 1), ("https://a.b/2", 2), ("https://a.b/3", 4), ("https://a.b/4", 5), (None, 6)], "url string, ord long")
    now = F.lit("2025-01-01T12:00:00Z").cast("timestamp")
    got = {r["url"][-1]: (r["first_at"], r["fresh"]) for r in freshness.split_fresh(pages, state, now, 24).collect()}
    assert got == {"1": (1, True), "2": (2, False), "3": (4, True), "4": (5, False)}
    assert freshness.skips(freshness.split_fresh(pages, state, now, 24)).first()["incremental_skipped"] == 2
    assert not any(r["fresh"] for r in freshness.split_fresh(pages, state, now, 0).collect())


def test_settings():
    s = Settings.read({"PAGELAKE_MODE": "JS", "PAGELAKE_HEADLESS": "off", "PAGELAKE_REQUESTS_PER_MINUTE": "12"}, max_requests=7, concurrency=None)
    assert (s.mode, s.headless, s.requests_per_minute, s.max_requests, s.concurrency) == ("playwright", False, 12, 7, 5)
    for bad in (lambda: Settings(requests_per_minute=61), lambda: Settings(language="de"), lambda: boolean("maybe", "x"), lambda: integer("1.5", "x"), lambda: mode("x"), lambda: Settings(refresh_hours=9000)):
        with pytest.raises(ValueError):
            bad()
