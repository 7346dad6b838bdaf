import re
import urllib.parse as up

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.functions import urls

CASES = [
    ("HTTPS://EXAMPLE.COM:443/docs//guide/?utm_source=test&b=2&a=1#section", "https://example.com/docs/guide?a=1&b=2"),
    ("http://EXAMPLE.COM:80/", "http://example.com/"),
    ("https://example.com/path/?fbclid=tracking&keep=value", "https://example.com/path?keep=value"),
    ("https://example.com/path/", "https://example.com/path"),
    (" https://example.com./a\tb ", "https://example.com/ab"),
    ("https://example.com:8443", "https://example.com:8443/"),
    ("https://example.com/?x&y=%zz+q*~", "https://example.com/?x=&y=%25zz+q%2A~"),
    ("https://example.com/a;p?GCLID=1&Ref=2", "https://example.com/a;p"),
    ("ftp://example.com/", None), ("javascript:alert(1)", None), ("//example.com/path", None), ("https:///x", None),
    ("https://user:pw@example.com/", None), ("https://example.com:99999/", None), ("https://example.com:x/", None), ("data:text/html,x", None), ("", None), (None, None),
]


def one(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string").withColumn("r", column(F.col("u")))
    return [r["r"] for r in rows.orderBy("i").collect()]


def test_normal_form(spark):
    assert one(spark, [a for a, _ in CASES], urls.normalize) == [b for _, b in CASES]
    assert one(spark, [b for _, b in CASES], urls.normalize) == [b for _, b in CASES]


def test_reasons(spark):
    got = one(spark, ["ftp://a/", "https://u@a/", "https://a:x/", "https:///x", None, "https://a/"], urls.reject_reason)
    assert got == ["scheme", "userinfo", "port", "host", "missing", None]


def test_inventory_form_keeps_the_slash(spark):
    assert one(spark, ["https://a.b/docs/", "https://a.b/", "https://a.b/x"], lambda c: urls.normalize(c, keep_slash=True)) == ["https://a.b/docs/", "https://a.b/", "https://a.b/x"]


def test_origin(spark):
    got = one(spark, ["https://A.b./x", "http://a.b:80", "https://a.b:8443/", "https://a.b:0/", "mailto:x"], urls.origin)
    assert [tuple(x) if x else None for x in got] == [("https", "a.b", 443), ("http", "a.b", 80), ("https", "a.b", 8443), ("https", "a.b", 443), None]


def test_resolution_is_that_of_the_standard_library(spark):
    bases = ["https://example.com/3/", "https://example.com/docs/guide/", "https://example.com/docs/index.html", "https://example.com"]
    hrefs = ["library/index.html", "../getting-started.html", "child.html", "/a/./b/../c", "?q=1", "#f", "", "//other.org/x", "https://x.y/z", "../../../up", "a/..", ".", "mailto:a@b"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").withColumn("r", urls.resolve(F.col("b"), F.col("h"))).collect()
    assert [r["r"] for r in rows] == [up.urljoin(r["b"], r["h"]) for r in rows]


def test_scope_and_exclusion(spark):
    rows = [("https://a.b/docs", True), ("https://a.b/docs/x", True), ("https://a.b/docs?x=1", True), ("https://a.b/docsx", False), ("https://c.d/docs", False), ("HTTPS://A.B/DOCS/y", True), (None, False)]
    got = one(spark, [u for u, _ in rows], lambda c: urls.in_scope(c, F.lit("https://a.b/docs")))
    assert got == [x for _, x in rows]
    rows = [("https://a.b/x.pdf", True), ("https://a.b/x.JPEG?v=1", True), ("https://a.b/login", True), ("https://a.b/login-help", False), ("https://a.b/x.html", False), ("https://a.b/d?f=x.pdf", True), (None, False)]
    assert one(spark, [u for u, _ in rows], urls.excluded_link) == [x for _, x in rows]
    rows = [("https://a.b/docs/x", True), ("https://a.b/docs/x.js", False), ("https://a.b/docs/admin/y", False), ("http://a.b/docs/x", False), ("https://a.b/docs/.hidden", True), ("nonsense", False), (None, False)]
    assert one(spark, [u for u, _ in rows], lambda c: urls.sitemap_safe(c, F.lit("https://a.b/docs"))) == [x for _, x in rows]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abc_utm~*+ %é&;=", max_size=6), st.text("xyz %+*~ü/", max_size=6)), max_size=5))
def test_query_like_the_standard_library(spark, pairs):
    url = "https://h.example/p?" + up.urlencode(pairs)
    kept = sorted((k, v) for k, v in up.parse_qsl(up.urlsplit(url).query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in urls.TRACKING_KEYS)
    want = "https://h.example/p" + ("?" + up.urlencode(kept) if kept else "")
    assert one(spark, [url], urls.normalize) == [re.sub(r"\?$", "", want)]
