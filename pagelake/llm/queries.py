"""The queries of this package, named pN_..., each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import boilerplate, contamination, history_dedup, language, line_repeats, markup, mixing, sentences, template_residue
from pagelake.plans import sql
from pagelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history, then each batch of registrations in turn, added to a forest and answered from it."""
    pages = table(spark, sf_dir, "markdown_documents", "page_id", "url", "markdown")
    registered = table(spark, sf_dir, "registrations", "page_id", "batch_no").fillna(0, ["batch_no"])
    numbers = sorted(r[0] for r in registered.select("batch_no").distinct().collect())  # one row a batch
    batches = [registered.filter(F.col("batch_no") == n).select("page_id") for n in numbers]
    return history_dedup.repeats(pages, table(spark, sf_dir, "content_records", "page_id"), batches)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_repeats.repeated_lines(table(spark, sf_dir, "markdown_documents", "page_id", "url", "markdown"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, sf_dir, "markdown_documents", "page_id", "url", "markdown"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "markdown_documents", "page_id", "url", "title", "language", "markdown")
    return language.corrected(pages).select("page_id", "language_code")


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's languages with their confidences."""
    return language.document_languages(table(spark, sf_dir, "markdown_documents", "page_id", "url", "markdown"))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every page that are in one language, with their confidences."""
    return language.language_segments(table(spark, sf_dir, "markdown_documents", "page_id", "url", "markdown"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.residue_pages(table(spark, sf_dir, "markdown_documents", "page_id", "url", "title", "markdown"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_kinds(table(spark, sf_dir, "markdown_documents", "page_id", "markdown"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p9_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with the number of their uses."""
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "source_weights"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "source_weights"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_offsets(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p4_documents, p4_segments, p5_found, p6_found, p8_found, p9_selected, p9_shares, p10_found)}

# Where SQL can say it on whole tables; the others are held against brute force, round trips and held-out accuracy in tests.
SQL: dict[str, str] = {
    "p2_found": f"""WITH p AS (SELECT DISTINCT page_id, host, markdown FROM {sql.parsed('markdown_documents', 'url')} WHERE reason IS NULL),
    n AS (SELECT host, count(DISTINCT page_id) AS pages FROM p GROUP BY host),
    l AS (SELECT page_id, host, i AS line_no, regexp_replace(lower(string_split(markdown, chr(10))[i]), '[^\\p{{L}}]+', '', 'g') AS k
     FROM (SELECT *, unnest(range(1, len(string_split(markdown, chr(10))) + 1)) AS i FROM p)),
    f AS (SELECT host, k FROM l JOIN n USING (host) WHERE length(k) >= {line_repeats.LEAST_LETTERS} GROUP BY host, k, pages
     HAVING count(DISTINCT page_id) >= {line_repeats.LEAST_PAGES} AND count(DISTINCT page_id) >= {line_repeats.LEAST_SHARE} * pages)
    SELECT DISTINCT page_id, CAST(line_no AS INT) AS line_no FROM l JOIN f USING (host, k)""",
}
