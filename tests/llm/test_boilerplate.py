from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import boilerplate, gbt, line_repeats
from pagelake.llm.boilerplate import split_batch

PAGE = """[Home](/) [Guides](/guides) [API of Skovar](/api) [Blog](/blog) [Sign in](/account)
Home › Guides › Widgets

# Running the widget with a broker

The widget keeps its state in memory and writes it once a minute. It is safe to restart it.

- The first item explains how the broker validates the upload ticket before each restart.
- A footer named `skovar` can be set for 12 pages.

```bash
Share this article: not furniture, but code
```

Share this Skovar article: Chirrup · Forumly · Mail

**Popular now**
- [Running a gadget with a planner](/gadget)
- [Gadget guide to the host table](/gadget_two)

© 25 Skovar Ltd. All rights reserved and all marks belong to Skovar."""


def test_trees_learn_and_scoring_is_vectorized():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = gbt.Model(gbt.train(x[:2000], y[:2000], trees=40, depth=3))
    assert ((model.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert len(model.log_odds(np.zeros((0, 4)))) == 0
    assert gbt.Model(gbt.train(np.zeros((0, 4)), np.zeros(0))).log_odds(x[:3]).tolist() == [0.0, 0.0, 0.0]


def test_furniture_of_a_page():
    (gone, article), = split_batch([PAGE], ["https://help.skovar.example/guides/widgets"])
    lines = PAGE.split("\n")
    assert {lines[n - 1][:12] for n in gone} == {"[Home](/) [G", "Home › Guide", "Share this S", "**Popular no", "- [Running a", "- [Gadget gu", "© 25 Skovar "}
    assert article.startswith("\n# Running") and "not furniture" in article


def test_every_line_end_and_blank_counts():
    crlf = PAGE.replace("\n", "\r\n")
    (a, _), (b, _), (c, d), (e, _) = split_batch([PAGE, crlf, None, ""], ["https://help.skovar.example/"] * 2 + [None, "x"])
    assert a == b and c == [] and d == "" and e == []
    (f, _), = split_batch(["\n" * 5 + "\xa0\n" + "word " * 200_000], ["https://a.b/"])
    assert 6 not in f


def test_held_out_pages():
    """Accuracy on rows the models never saw, against the annotation rules."""
    import pyarrow.parquet as pq

    from pagelake.llm.train_boilerplate import labels

    source = Path("/root/testdata/check_s/markdown_documents.parquet")
    if not source.exists():
        pytest.skip("no held-out pages here")
    t = pq.read_table(source, columns=["page_id", "url", "markdown"]).slice(0, 1500).to_pandas()
    hit = miss = extra = 0
    for (gone, _), m in zip(split_batch(list(t["markdown"]), list(t["url"])), t["markdown"], strict=True):
        want = {n for n, f in enumerate(labels(m), 1) if f}
        hit, miss, extra = hit + len(want & set(gone)), miss + len(want - set(gone)), extra + len(set(gone) - want)
    assert hit / (hit + miss) > 0.99 and hit / (hit + extra) > 0.99


def test_rows_are_distinct(spark):
    pages = spark.createDataFrame([(1, "https://help.skovar.example/", PAGE, 5)] * 2 + [(2, None, None, 5), (None, "https://a.b/", PAGE, 5)], "page_id long, url string, markdown string, line_no int")
    rows = boilerplate.furniture_lines(pages).collect()
    assert len(rows) == len(set(rows)) == 7
    both = pages.select("page_id", boilerplate.split_page("markdown", "url").alias("s")).select("page_id", "s.article", F.size("s.furniture").alias("n")).collect()
    assert {(r["page_id"], r["n"]) for r in both} == {(1, 7), (2, 0), (None, 7)}
    assert boilerplate.furniture_lines(pages.limit(0)).count() == 0


def test_repeated_lines_against_brute_force(spark):
    import random
    import unicodedata

    rng = random.Random(5)
    legal = ["All rights reserved by nobody at all", "ALL RIGHTS -- reserved, by nobody at all!", "Legal notice of the whole site here", "Ünïcode légal notice für alle Seiten"]
    rows = []
    for i in range(1, 61):
        host = rng.choice(["a.example", "B.example.", "c.example:443"])
        lines = [rng.choice(legal) for _ in range(2)] + [f"own line of page {rng.choice('abcdefghij') * 20}", "", "short"]
        rng.shuffle(lines)
        rows.append((i * 40_000, f"https://{host}/p{i}", "\n".join(lines), "x"))
    rows += rows[:5] + [(7, None, legal[0], "x"), (8, "https://a.example/n", None, "x"), (9, "nonsense", legal[0], "x")]
    got = {tuple(r) for r in line_repeats.repeated_lines(spark.createDataFrame(rows, "page_id long, url string, markdown string, host string")).collect()}
    pages, where = {}, {}
    for i, u, m, _ in set(rows):
        if u and u.startswith("https"):
            h = u[8].lower()
            pages.setdefault(h, set()).add(i)
            for n, line in enumerate((m or "").split("\n"), 1):
                k = "".join(c for c in line.lower() if unicodedata.category(c)[0] == "L")
                if len(k) >= 16:
                    where.setdefault((h, k), set()).add((i, n))
    want = {x for (h, _), s in where.items() if len({i for i, _ in s}) >= max(5, 0.2 * len(pages[h])) for x in s}
    assert got == want and want
    clean = line_repeats.without_repeats(spark.createDataFrame(rows, "page_id long, url string, markdown string, host string"))
    assert clean.filter("markdown LIKE '%rights reserved%' AND page_id > 9").count() < 60
    assert clean.count() == 63


def test_a_fifth_of_the_pages_is_enough(spark):
    rows = [(i, f"https://a.example/{i}", "All rights reserved by nobody" if i < 7 else f"page number {'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10] * 12}") for i in range(35)]
    assert line_repeats.repeated_lines(spark.createDataFrame(rows, "page_id long, url string, markdown string")).count() == 7


@pytest.mark.parametrize("array", [0, 3, 2048])
def test_containers_of_either_kind_hold_the_same(spark, monkeypatch, array):
    monkeypatch.setattr(line_repeats, "ARRAY", array)
    ids = [5, 6, 32767, 32768, 32775, 65535, 65536, 70000, 1 << 40]
    variants = ("Follow us for more news every day", "**Follow us** for more news - every day!", "FOLLOW US FOR MORE NEWS EVERY DAY.")
    rows = [(i, "https://a.b/x", f"Own line number {'abcdefghijk'[k] * 9} here\n{variants[k % 3]}") for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id long, url string, markdown string")
    bitmaps = line_repeats.united(line_repeats.line_bitmaps(line_repeats.page_lines(pages)))
    cards = sorted(r["card"] for r in bitmaps.groupBy("k1").agg(F.sum("card").alias("card")).collect())
    assert cards == [1] * 9 + [9]
    if array == 0:
        assert bitmaps.filter("bits IS NULL").count() == 0 and {len(r["bits"]) for r in bitmaps.collect()} == {4096}
    assert {tuple(r) for r in line_repeats.repeated_lines(pages).collect()} == {(i, 2) for i in ids}
