import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm import contamination, history_dedup, mixing

WORDS = [f"{a}{b}" for a in "bcdfghjklmnprstvz" for b in ("ala", "eno", "iri", "ota", "uvu", "emi", "ano")]


def article(rng, n=120):
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return [words[i : i + 30] for i in range(0, n, 30)]


def render(paragraphs):
    """Paragraphs, and a block of code, as the model is unsure of a page's last words if they are of no language."""
    return "\n\n".join(" ".join(p).capitalize() + "." for p in paragraphs) + "\n\n```\nx = 1\n```"


def test_repeats_against_brute_force(spark):
    rng = random.Random(11)
    texts, near = {}, {}
    for i in range(1, 41):
        texts[i] = article(rng)
    for k, i in enumerate(range(41, 71)):
        src = rng.randrange(1, 41)
        copy = [list(p) for p in texts[src]]
        for _ in range((0, 5, 9, 30)[k % 4]):
            p = rng.choice(copy)
            p[rng.randrange(len(p))] = "changed" + str(rng.random())[2:8]
        rng.shuffle(copy)
        texts[i] = copy
    pages = [(i, f"https://a.b/{i}", render(t), "x") for i, t in texts.items()]
    pages += pages[:3] + [(90, "https://a.b/90", None, "x"), (91, "https://a.b/91", "", "x")]
    history = [(i,) for i in range(1, 36)]
    batch = [(i,) for i in (*range(30, 71), 90, 91, 999)]
    got = {tuple(r) for r in history_dedup.repeats(
        spark.createDataFrame(pages, "page_id long, url string, markdown string, copy string"), spark.createDataFrame(history + history[:4], "page_id long"), [spark.createDataFrame([*batch, (None,)], "page_id long")]
    ).collect()}
    signs = {i: history_dedup.sign([render(t)])[0] for i, t in texts.items()}
    known = {i for i, in history + batch if i in texts}
    for b in sorted(i for i, in batch if i in texts):
        same = [a for a in known if a < b and history_dedup.changed(signs[a][2], signs[b][2]) <= 0.1]
        if same:
            near[b] = min(same)
    assert got == {(a, b) for b, a in near.items()} and len(near) > 10


def test_dense_ranges_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(history_dedup, "DENSE", 4)
    rng = random.Random(2)
    base = article(rng)
    other = article(rng)
    pages = []
    for i in range(1, 41):
        copy = [list(p) for p in (base if i % 2 else other)]
        copy[0][i % 30] = f"own{i}"
        pages.append((i, f"https://a.b/{i}", render(copy)))
    ids = spark.createDataFrame([(i,) for i in range(1, 41)], "page_id long")
    got = {tuple(r) for r in history_dedup.repeats(spark.createDataFrame(pages, "page_id long, url string, markdown string"), ids.filter("page_id < 5"), [ids.filter("page_id >= 5")]).collect()}
    assert got == {(1 if i % 2 else 2, i) for i in range(5, 41)}


def test_recall_at_the_limit():
    # A tenth of the words changed as harmfully as lines of each length allow; lines that repeat, too.
    rng = random.Random(5)
    for per_line, shared in ((90, 0), (10, 0), (9, 0), (5, 0), (3, 0), (9, 45)):
        found = 0
        for _ in range(150):
            words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(90)]
            lines = [words[i : i + per_line] for i in range(0, 90, per_line)] + [["same"] * 9] * (shared // 9)
            other = [list(x) for x in lines]
            places = [(i, j) for i, x in enumerate(other) for j in range(len(x)) if (j % 10 == 5 if per_line > 10 else j == per_line // 2) and x[0] != "same"]
            for i, j in places[: sum(map(len, lines)) // 10]:
                other[i][j] = "changed" + str(rng.random())[2:9]
            rng.shuffle(other)
            a, b = history_dedup.sign(["\n".join(" ".join(x) for x in y) for y in (lines, other)])
            assert history_dedup.changed(a[2], b[2]) <= history_dedup.MOST_CHANGED
            shift = np.uint64(8 * (history_dedup.DEPTH - history_dedup.prefix_length(history_dedup.least_similarity(a[1]))))
            x, y = (np.frombuffer(s[4], np.uint8).reshape(1, -1) for s in (a, b))
            found += any(history_dedup.labels(x, t)[0] >> shift == history_dedup.labels(y, t)[0] >> shift for t in range(history_dedup.TREES))
        assert found >= 0.95 * 150, (per_line, shared, found)


def test_tokens_against_a_pattern():
    pattern = re.compile(rf"[{history_dedup._CJK}{history_dedup._THAI}]|[^\W_{history_dedup._CJK}{history_dedup._THAI}]+")
    texts = ["One two, one_two THREE\n\nfour-five 6.7\n", "", "日本語 and ไทย mixed é1 𐐀x", "\n\n", "a" * 5000, "last line\r\nend"]
    hashes, owner, line = history_dedup.tokenized(texts)
    want = [(k, n, w) for k, t in enumerate(texts) for n, x in enumerate(t.lower().split("\n")) for w in pattern.findall(x)]
    assert owner.tolist() == [k for k, _, _ in want]
    named = {}
    assert all(named.setdefault(w, h) == h for (_, _, w), h in zip(want, hashes.tolist(), strict=True)) and len(set(named.values())) == len(named)
    same = lambda keys: [a == b for a, b in zip(keys, keys[1:], strict=False)]
    assert same(line.tolist()) == same([(k, n) for k, n, _ in want])
    a, b, c = (history_dedup.sign([t])[0] for t in ("one two\nthree four", "Three, four!\n\none two", "two one\nthree four"))
    assert a[0] == b[0] != c[0] and a[2] == b[2] == c[2] and a[4] == b[4]


def test_thai_counts_in_characters():
    # Vowel and tone marks cut Thai words into chunks: few changed characters change many of them.
    words = ["ที่", "นี้", "ผู้ใช้", "เริ่ม", "เครื่อง", "ระบบ", "ข้อมูล", "ตั้งค่า", "แก้ไข", "บันทึก"]
    rng = random.Random(7)
    text = "".join(rng.choice(words) for _ in range(200))
    assert len(history_dedup.tokenized([text])[0]) == len(text)
    copy = list(text)
    copy = list(text)
    for i in range(0, len(copy), 25):
        copy[i] = copy[i + 1] = "ฬ"
    a, b = (history_dedup.sign([t])[0] for t in (text, "".join(copy)))
    assert a[1] == len(text) and history_dedup.changed(a[2], b[2]) <= history_dedup.MOST_CHANGED
    far = list(text)
    for i in range(0, len(far), 5):
        far[i] = "ฬ"
    c = history_dedup.sign(["".join(far)])[0]
    assert history_dedup.changed(a[2], c[2]) > history_dedup.MOST_CHANGED


PAGES = "page_id long, url string, markdown string"


def test_batches_give_the_answer_of_one_and_read_no_page_twice(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    base = [article(rng) for _ in range(12)]
    texts = {}
    for i in range(1, 61):
        copy = [list(p) for p in base[i % 12]]
        for k in range(i % 5):
            copy[k % 4][(7 * i + k) % 30] = f"own{i}x{k}"
        texts[i] = render(copy)
    frame = lambda ids: spark.createDataFrame([(i, f"https://a.b/{i}", texts[i]) for i in ids], PAGES)
    order = list(range(1, 61))
    rng.shuffle(order)
    parts = [order[:20], order[20:30], order[30:45], order[45:]]
    whole = history_dedup.HashForest(spark, f"file://{tmp_path}/whole")
    whole.add(frame(parts[0]), asking=False)
    whole.add(frame(order[20:]))
    step, signed_ids, plain = f"file://{tmp_path}/step", [], history_dedup.signed
    monkeypatch.setattr(history_dedup, "signed", lambda pages: signed_ids.append(sorted(r[0] for r in pages.select("page_id").collect())) or plain(pages))
    history_dedup.HashForest(spark, step).add(frame(parts[0]), asking=False)
    for k, part in enumerate(parts[1:]):
        forest = history_dedup.HashForest(spark, step)  # opened again for each batch
        forest.add(frame(part))
        if k == 1:
            leaves = lambda f: sum(len(r[0]) for r in f._all("leaves", history_dedup._LEAVES, f.runs()).select("ids").collect())
            size = leaves(forest)
            forest.merge()
            assert len(forest.runs()) == 1 and leaves(forest) == size
    assert signed_ids == [sorted(p) for p in parts]
    got, expected = ({tuple(r) for r in f.answers().collect()} for f in (history_dedup.HashForest(spark, step), whole))
    signs = {i: history_dedup.sign([t])[0][2] for i, t in texts.items()}
    same = {b: min((a for a in texts if a < b and history_dedup.changed(signs[a], signs[b]) <= 0.1), default=None) for b in order[20:]}
    assert got == expected == {(a, b) for b, a in same.items() if a} and len(got) > 20
    # Pages of the history that ask later are answered without being signed again; an empty batch adds nothing.
    forest = history_dedup.HashForest(spark, step)
    forest.add(frame(parts[0]))
    forest.add(frame([]))
    assert signed_ids[4:] == [[], []]
    every = {b: min((a for a in texts if a < b and history_dedup.changed(signs[a], signs[b]) <= 0.1), default=None) for b in texts}
    assert {tuple(r) for r in forest.answers().collect()} == {(a, b) for b, a in every.items() if a}


def test_merged_leaves_stay_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history_dedup, "LEAF", 8)
    rng = random.Random(9)
    same = render(article(rng))
    pages = [(i, f"https://a.b/{i}", same.replace("x = 1", f"x = {i}") if i % 3 == 0 else render(article(rng))) for i in range(60)]
    forest = history_dedup.HashForest(spark, f"file://{tmp_path}/f", slots=2)
    forest.add(spark.createDataFrame(pages[:30], PAGES), asking=False)
    forest.add(spark.createDataFrame(pages[30:], PAGES))
    before = {tuple(r) for r in forest.answers().collect()}
    forest.merge()
    sizes = [len(r[0]) // 8 for r in forest._all("leaves", history_dedup._LEAVES, forest.runs()).select("ids").collect()]
    assert max(sizes) <= 16 and sum(sizes) == 60 * history_dedup.TREES
    assert {tuple(r) for r in forest.answers().collect()} == before and len(before) == 10
    forest.add(spark.createDataFrame([(100, "https://a.b/100", pages[1][2])], PAGES))
    assert {tuple(r) for r in forest.answers().collect()} == before | {(1, 100)}


def test_leaks(spark):
    rng = random.Random(4)
    items = {i: [w for p in article(rng, 40) for w in p] for i in range(1, 31)}
    twin = list(items[1])
    for j in range(0, 40, 3):
        twin[j] = f"fact{j}"
    noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
    docs, want = {}, set()

    def add(doc, parts, *found):
        docs[doc] = " ".join(itertools.chain(*parts))
        want.update((doc, i) for i in found)

    add(1, [noise(50), items[1], noise(50)], 1)
    add(2, [noise(50), items[2][:20], noise(50)], 2)
    add(3, [noise(50), items[3][:16], noise(50)])
    add(4, [noise(9), [w.upper() + "," if k % 12 else "altered" for k, w in enumerate(items[4])]], 4)
    add(5, [twin])
    add(6, [["**" + items[5][0] + "**"], items[5][1:], items[6]], 5, 6)
    add(7, [[w if k % 4 else "altered" for k, w in enumerate(items[7])]])
    docs |= {8: "", 9: None}
    frame = spark.createDataFrame(list(docs.items()) + [(1, docs[1])], "doc_id long, text string").withColumn("item_id", F.lit(5))
    asked = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()] + [(31, None, 1), (32, "", 1), (None, "x", 1)], "item_id long, text string, doc_id int")
    assert {tuple(r) for r in contamination.leaks(frame, asked).collect()} == want
    assert {tuple(r) for r in contamination.leaks(frame, asked, most=2000).collect()} == want
    assert contamination.leaks(frame, asked.limit(0)).count() == 0 and contamination.leaks(frame.limit(0), asked).count() == 0


def test_least_intact_is_a_bound(spark):
    formula = lambda n, run: n - 3 - 4 * (run // 10)
    for n in range(8, 130):
        runs = range(-(-n // 2), n + 1)
        assert contamination.least_intact(n) == min(formula(r, r) for r in runs) == contamination.least_intact_characters([1] * n)
    # A passage of ten words of eighteen with the fifth altered leaves three shingles intact.
    item = WORDS[:18]
    text = ["before"] * 9 + item[:4] + ["altered"] + item[5:10] + ["behind"] * 9
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    assert [tuple(r) for r in contamination.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()] == [(1, 7)]


def test_every_passage_of_items_of_all_sizes_is_a_candidate():
    # Each run of at least half the item, unaltered and altered where that hurts most, by brute force.
    words = [a + b for a in WORDS for b in ("", "x")]
    for n in (*range(1, 24), 33, 38, 40, 57, 76, 80):
        item = words[:n]
        index = contamination.Index([(1, " ".join(item))])
        shingle, least = contamination.shingle_of(" ".join(item))
        for run in range(-(-n // 2), n + 1):
            for start in {0, (n - run) // 2, n - run}:
                for first in range(min(10, run)):
                    part = list(item[start : start + run])
                    for k, at in enumerate(range(first, run, 10)):
                        if (k + 1) * 10 <= run:
                            part[at] = "altered"
                    seen = index.candidates(*index.hits([" ".join(["before", *part, "behind"])])[:3])
                    assert (0, 0) in seen, (n, run, start, first, shingle, least)


def test_short_items(spark):
    asked = spark.createDataFrame([(1, "alpha"), (2, "bravo charlie"), (3, "delta echo foxtrot"), (4, "golf hotel india juliett kilo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha y"), (2, "so bravo z"), (3, "in delta echo we"), (4, "golf hotel india"), (5, "golf hotel"), (6, "delta z")], "doc_id long, text string")
    assert {tuple(r) for r in contamination.leaks(docs, asked).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_leaks_behind_a_similar_item(spark):
    rng = random.Random(9)
    chars = [chr(0x4E00 + i) for i in range(400)]
    for words, join in (([w for p in article(rng, 40) for w in p], " "), (rng.sample(chars, 60), "")):
        # The sibling is the item but for other facts, few enough that the item passes in its copy.
        sibling = list(words)
        for j in (7, 22, 33):
            sibling[j] = "fact" if join else "龍"
        noise = [rng.choice(WORDS) if join else rng.choice(chars) for _ in range(90)]
        asked = spark.createDataFrame([(1, join.join(words)), (2, join.join(sibling))], "item_id long, text string")
        # Far behind the sibling, next to it, and the sibling alone.
        docs = [(1, [*noise, *sibling, *noise, *words, *noise]), (2, [*sibling, *words]), (3, [*noise, *sibling, *noise])]
        frame = spark.createDataFrame([(i, join.join(x)) for i, x in docs], "doc_id long, text string")
        assert {tuple(r) for r in contamination.leaks(frame, asked).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 2)}


def test_leaks_by_character(spark):
    item = "一位运维人员在节点上运行系统其中有些节点持有名为的钥匙如果已把其中行存入那么还剩下多少行解答只有留下因为严格执行上限"
    docs = spark.createDataFrame([(1, "前文。" + item[:32] + "后文"), (2, item[:20]), (3, item.replace("节点", "機器"))], "doc_id long, text string")
    got = contamination.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 3}


def test_budget_fit_against_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        lengths = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        budget = rng.randint(0, 60)
        taken = mixing.fit(lengths, budget)
        best = max(s for c in itertools.product(*(range(k + 1) for k in lengths.values())) if (s := sum(n * x for n, x in zip(lengths, c, strict=True))) <= budget)
        assert sum(n * k for n, k in taken.items()) == best and all(k <= lengths[n] for n, k in taken.items())
        passes, extra = mixing.plan_source(lengths, budget, 2, window=10)
        assert passes <= 2 and sum(n * (k * passes + extra.get(n, 0)) for n, k in lengths.items()) <= budget and all(k <= lengths[n] for n, k in extra.items())


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["Aa ", "bb", "bb", "cc", "other"]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    docs += [(1000, None, "x"), (1001, "aa", None), (1002, "aa", ""), (None, "aa", "x"), (1003, "tiny", "a b c " * 30)]
    weights = spark.createDataFrame([("aa", 0.3, 1), ("BB", 0.5, 2), ("tiny", 0.1, 3), ("cc", 0.05, 1), ("gone", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    chosen, report = mixing.mix(frame, weights)
    rows = chosen.collect()
    caps = {"aa": 1, "bb": 2, "tiny": 3, "cc": 1}
    assert all(1 <= r["uses"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    shares = {r["source"]: r for r in report.collect()}
    used = {s: sum(r["uses"] * r["n_tokens"] for r in rows if r["source"] == s) for s in caps}
    total = sum(used.values())
    for s, share in (("aa", 0.3), ("bb", 0.5), ("tiny", 0.1), ("cc", 0.05)):
        assert shares[s]["used_tokens"] == used[s] and abs(used[s] / total - share / 0.95) < 0.02
    assert shares["gone"]["used_tokens"] == 0
    again = {tuple(r) for r in mixing.mix(frame, weights)[0].collect()}
    assert again == {tuple(r) for r in rows}
    assert mixing.mix(frame.limit(0), weights)[0].count() == 0
    big = mixing.mix(frame, weights, total=10**7)[1].collect()
    assert all(r["used_tokens"] == r["available_tokens"] * r["max_repeats"] for r in big if r["documents"])
