import random

import pytest

from pyspark.sql import functions as F

from pagelake.llm import language, markup, sentences, template_residue
from pagelake.llm.boilerplate import split_batch


def test_markup_is_rendered():
    text, kinds = markup.clean("<UL><LI>one<LI>two &amp; three</UL>\n\n<table><tr><td>a<td>bb<tr><td>ccc<td>d</table><!-- gone --><script>x()</script><span style='display:none'>no</span>&lt;b&gt;bold&lt;/b&gt;")
    assert kinds == ["html"]
    assert "- one\n- two & three" in text and "| a   | bb  |" in text and "| ccc | d   |" in text
    assert not any(x in text for x in ("gone", "x()", "no", "<", "&amp;", "\n\n- two"))
    text, kinds = markup.clean("== Head ==\n'''bold''' [[page|label]]\n{| class=\"x\"\n|-\n| a || b\n|}\n{noformat}\n<raw>\n{noformat}\nh2. Two")
    assert kinds == ["wiki"] and "## Head" in text and "bold label" in text and "| a   | b   |" in text and "```\n<raw>\n```" in text and "## Two" in text
    text, kinds = markup.clean("\\section{One}\n\\begin{itemize}\n\\item a \\textbf{b}\n\\end{itemize}\n\\begin{equation}\nx = \\frac{1}{2}\n\\end{equation}\nsee \\ref{fig:a}, 5\\%")
    assert kinds == ["latex"] and "## One" in text and "- a b" in text and "$$x = \\frac{1}{2}$$" in text and "see fig:a, 5%" in text


def test_markup_in_code_and_markdown_is_none():
    for m in ("```html\n<b>x</b>\n```", "    <b>x</b>\n", "`<b>` and ``\\section{x}``", "$x_{i} = \\frac{2}{4} \\cdot \\alpha$", "a < b && c > d <https://x.y>", "# H\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "{{ placeholder }} <%= x %> ${y}", "Title\n=====\n\n* a\n* b **c** _d_", "List<String>", "AT&T", ""):
        assert markup.clean(m)[1] == [], m
    assert markup.clean(None) == (None, [])
    assert markup.clean("\ue000a0\ue001 <b>x</b>")[1] == ["html"]
    assert len(markup.clean("<p>" * 3000 + "deep")[1]) == 1


def test_markup_rows(spark):
    rows = spark.createDataFrame([(1, "<b>x</b> '''y'''", "html")] * 2 + [(2, None, ""), (3, "", ""), (None, "<b>x</b>", "")], "page_id long, markdown string, markup string")
    assert {tuple(r) for r in markup.markup_kinds(rows).collect()} == {(1, "html"), (1, "wiki")}
    assert {r["page_id"]: r["text"] for r in markup.clean_pages(rows, "page_id", "markdown").collect()} == {1: "x y", 2: None, 3: ""}
    assert markup.markup_kinds(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("article", "title", "hit"), [
    ("Dear {{ user.name }}, welcome.", "T", True), ("# T\n\nTBD", "T", True), ("Text here is fine.", "%%NAME%%", True), ("The form `{{ x }}` is replaced.", "T", False),
    ("```\n{{ x }} TODO: y\n```\nReal text stands here.", "T", False), ("Lorem ipsum dolor sit amet consectetur elit.", "T", True), ("[Your link](https://x.y) is a link.", "T", False),
    ("[INSERT NAME HERE]", None, True), ("Price: [object Object]", "T", True), ("# 404 Not Found\n\nThe requested address /x_y was not found on this server.", "404 Not Found", True),
    ("When it is gone, the server answers 404 Not Found and logs the code.\n\n" + "More real text follows here. " * 20, "T", False), ("", "T", False), ("# Enable JavaScript support\n\n" + "How scripts are enabled in the viewer of this product. " * 12, "T", False),
])
def test_template_residue(article, title, hit):
    assert template_residue.examine(article, title)[0] is hit


def test_induced_page_templates(spark):
    body = "# {t}\n\nThis area moved behind the northern gate, ask warden {w} for passage number {n}."
    rows = [(i, f"https://host{i % 4}.example/{i}", f"Title {i}", body.format(t=f"Title{i}", w=f"qx{i}zz", n=i)) for i in range(8)]
    rows += [(100 + i, f"https://host{i % 4}.example/r{i}", "T", f"# Real {i}\n\nA short page about subject{i} alone{i} without{i} any{i} template{i}.") for i in range(8)] + rows[:2] + [(200, "https://x.y/", None, None), (None, "https://x.y/", "TBD", "TBD")]
    pages = spark.createDataFrame(rows, "page_id long, url string, title string, markdown string")
    assert {r["page_id"] for r in template_residue.residue_pages(pages).collect()} == set(range(8))
    assert template_residue.residue_pages(pages.limit(0)).count() == 0


TEXTS = {
    "en": "The operator restarts the gateway once a minute because the planner holds a lock. Do not delete the file while it is still running.",
    "de": "Bitte löschen Sie die alten Einträge nicht, solange der Dienst noch läuft. Der Zwischenspeicher sperrt das Abbild, sobald er gestartet wurde.",
    "fr": "La file d'attente réécrit la clé d'accès pendant la maintenance, afin que rien ne soit perdu. Ne supprimez pas le répertoire.",
    "ja": "セッションキャッシュは再起動の前に状態ファイルを検査します。動作中はページ一覧を削除しないでください。", "ru": "Служба индекса проверяет старые записи в фоновом режиме, чтобы ничего не пропало.",
}


def test_languages_and_mixed_parts():
    found = language.decide(list(TEXTS.values()))
    assert [language.page_languages(x)[0][0] for x in found] == list(TEXTS)
    mixed = language.page_languages(language.decide([TEXTS["en"] + "\n\n" + TEXTS["ja"] + "\n\n" + TEXTS["en"]])[0])
    assert [k for k, _ in mixed] == ["en", "ja"] and all(0 < c <= 1 for _, c in mixed)
    assert language.decide(["", "x", "12345 ###"]) == [[], [], []]


def test_filters_have_no_false_negatives_and_known_false_positives():
    h, _ = language.grams([TEXTS["en"]])
    f = language.Filters.build({"aa": h, "bb": h[:5]})
    assert ((f.masks(h) & 1) == 1).all()
    n, share = f.shares([TEXTS["en"]])
    assert n[0] == len(h) and abs(share[0, 0] - 1) < 1e-6 and share[0, 1] < 0.5


def test_corrected_labels(spark):
    rows = [(1, "https://a.b/1", "T", "en-US", TEXTS["en"]), (2, "https://a.b/2", "T", "en", TEXTS["de"]), (3, "https://a.b/3", "T", None, TEXTS["fr"]), (4, "https://a.b/4", "T", "EN", TEXTS["en"] + "\n\n" + TEXTS["de"]), (5, "https://a.b/5", "T", "de", "Dear {{ x }}, " + TEXTS["en"]), (6, "https://a.b/6", "T", None, None), (None, "https://a.b/7", "T", None, TEXTS["fr"])]
    pages = spark.createDataFrame(rows + rows[:2], "page_id long, url string, title string, language string, markdown string")
    assert {(r["page_id"], r["language_code"]) for r in language.corrected(pages).collect()} == {(2, "de"), (3, "fr"), (4, "en"), (4, "de")}


def cut(text):
    begin, out = 0, []
    for e in sentences.sentence_ends(text):
        out.append(text[begin:e].strip())
        begin = e
    return out


@pytest.mark.parametrize(("text", "want"), [
    ("Dr. Smith et al. ships it to the U.S. and abroad (see No. 5). It costs 3.5 ms vs. 4.5, i.e. little. Next!", 3), ('"Is it ready?" asks the cache, and waits. He said, "Stop it." Then he left.', 3), ("It waits... and then goes on. Done", 2),
    ("Am 8. Mai wurde die Nr. 42 mit ca. 5,83 (vgl. Abb. 7), bzw. z. B. 9 ausgeliefert. „Ist alles bereit?“, fragt er. Ja!", 3), ("M. Dupont attend env. 5 s (cf. fig. 3). « Tout est prêt ? » demande-t-il. Oui.", 3),
    ("¡No borre nada! ¿Qué ocurre? El Sr. Gil midió aprox. 3,5 (véase la fig. 2). Fin.", 4), ("「準備はできましたか？」と尋ね、待ちます。次の文です。", 2), ("他会问:“好了吗？”然后再等待。从3.1.5版开始！", 2), ("डॉ. शर्मा ने देखा। क्या होगा? ठीक है।", 3), ("ماذا يحدث إذا غاب؟ يبلغ التأخير 5,85 ثانية. لا تحذف!", 3),
    ("ตั้งค่าระบบทันที ตัวอ่านทำงาน Danvos ทันที", 2), ("Службу (см. рис. 5) проверяют, т. е. читают. «Всё готово?» — спрашивает он. Да.", 3), ("First sentence.Second one here.`code` third", 3), ("Read `a.b. C` now. And x.yaml too.", 2), ("", 0), ("  \n ", 0),
])
def test_sentences(text, want):
    assert len(cut(text)) == want, cut(text)


def test_blocks_and_offsets():
    text = "# Head. Still head\n\n- item one. Same item\n  goes on\n- item two\n> quoted. line\n\n```\ncode. Code.\n\nmore\n```\r\n\nA line\nbreak divides nothing. 𝒳 counts one.\n"
    got = cut(text)
    assert got == ["# Head. Still head", "- item one. Same item\n  goes on", "- item two", "> quoted. line", "```\ncode. Code.\n\nmore\n```", "A line\nbreak divides nothing.", "𝒳 counts one."]
    assert sentences.sentence_ends(None) == [] and len(sentences.sentence_ends("word. Word " * 20_000)) > 10_000


def test_sentence_rows(spark):
    rows = spark.createDataFrame([(1, "One. Two.", 9), (2, None, 9), (3, "", 9), (None, "One.", 9)], "doc_id long, text string, sent_end int")
    assert {tuple(r) for r in sentences.sentence_offsets(rows).collect()} == {(1, 4), (1, 9)}
    assert [r["sentence"] for r in sentences.split_sentences(rows).orderBy("sent_no").collect()] == ["One.", "Two."]


def test_article_split_is_stable_under_batching():
    pages = ["\n\n".join(random.Random(i).choice(list(TEXTS.values())) for _ in range(4)) for i in range(6)]
    assert split_batch(pages, [None] * 6) == [split_batch([p], [None])[0] for p in pages]


def test_slots_are_induced_by_alignment(spark, monkeypatch):
    # Forms that no list holds: records of one shape over several hosts, each with another name.
    monkeypatch.setattr(template_residue, "slot_templates", lambda: {})
    monkeypatch.setattr(template_residue, "blank_records", frozenset)
    text = "The coordinator reads the page list before each restart and writes it back once a minute.\n\n"
    forms = ("Dear __USER_{}__, welcome", "Send it to <YOUR_{}> now", "Open ~~{}~~ and close it", "see [{}] for more", "at 5 % of {} % of it", "Home > {} > End")
    rows = []
    for k, form in enumerate(forms):
        for n in range(6):
            name = ("ALPHA", "BRAVO", "CHARLIE", "DELTA", "ECHO", "FOXTROT")[n]
            rows.append((10 * k + n, f"https://h{n}.example/{k}", None, "# Notes\n\n" + text + form.format(name) + ".\n"))
    facts = spark.createDataFrame(rows, "page_id long, url string, title string, markdown string").select("page_id", F.concat(F.lit("h"), F.col("page_id") % 10).alias("host"), "markdown")
    facts = spark.createDataFrame(
        [(r["page_id"], r["host"], False, [], template_residue.records(r["markdown"])) for r in facts.collect()], f"page_id long, host string, {template_residue.EXAMINED}"
    )
    got = {tuple(r["template"]) for r in template_residue.unfilled(facts).collect()}
    assert got == {("<", "YOUR", "_", None, ">"), ("__", "USER", "_", None, "__")}
    pages = {r["page_id"] // 10 for r in template_residue.residue_slots(facts).collect()}
    assert {0, 1} <= pages and pages.isdisjoint({2, 3, 4, 5})
    # A name that all records share is no slot; too few hosts are no template.
    same = facts.withColumn("records", F.array(F.array(*(F.lit(x) for x in ("<", "YOUR", "_", "NAME", ">")))))
    assert template_residue.unfilled(same).count() == 0 and template_residue.unfilled(facts.filter("page_id % 10 < 2")).count() == 0
    assert template_residue.unfilled(facts.limit(0)).count() == 0


@pytest.mark.parametrize("text, hit", [("Hello {{ }}, dear", True), ("[Your  name] is missing", True), ("Hello {{ user }}!", True), ("see [1] and [note]", False), ("{{cite web}} a", False)])
def test_blank_slots(text, hit):
    assert any(map(template_residue.is_unfilled, template_residue.records(text))) is hit


def test_messages_of_any_length():
    known = "Sorry, we could not find the page you were looking for. Reference: abc\n\n"
    assert template_residue.examine(known * 8, None)[0] is True
    assert template_residue.examine(known * 8 + "The coordinator reads the page list before each restart.", None)[0] is False


def test_every_page_and_part_gets_a_language(spark):
    english = "The coordinator reads the page list before each restart and writes it back once a minute, so that nothing is lost."
    german = "Der Koordinator liest vor jedem Neustart die Seitenliste und schreibt sie einmal in der Minute zurück, damit nichts verloren geht."
    mixed = f"# Notes\n\n{english}\n\n```\nx = 1\n```\n\n{german}\n{german}\n\n{english}\n"
    short = "\n".join(f"| {w} |" for w in ("reading the list", "writing the pages", "before each restart", "and once a minute"))
    pages = [(1, "https://a.b/1", mixed), (1, "https://a.b/1", mixed), (2, "https://a.b/2", None), (3, "https://a.b/3", "12 34 56"), (4, "https://a.b/4", short), (5, None, english + " 𐐷" * 30), (None, "https://a.b/6", english)]
    frame = spark.createDataFrame(pages, "page_id long, url string, markdown string").withColumn("confidence", F.lit("x"))
    got = {(r["page_id"], r["language_code"], r["is_main"]) for r in language.document_languages(frame).collect()}
    assert {x for x in got if x[0] == 1} in ({(1, "de", True), (1, "en", False)}, {(1, "en", True), (1, "de", False)})
    assert {x for x in got if x[0] > 1} == {(2, "und", True), (3, "und", True), (4, "en", True), (5, "en", True)}
    parts = sorted(tuple(r)[:4] for r in language.language_segments(frame).collect())
    assert [x for x in parts if x[0] == 1] == [(1, 3, 3, "en"), (1, 9, 10, "de"), (1, 12, 12, "en")]
    assert [x for x in parts if x[0] > 1] == [(4, 0, 0, "en"), (5, 1, 1, "en")]
    assert language.document_languages(frame.limit(0)).count() == 0
