"""From fetched HTML to Markdown documents, and documents to files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import dom, languages, markdown


def documents(pages: DataFrame, root: str = "") -> DataFrame:
    """(url, title, language, markdown, output_path, content_hash, is_empty, links, visible_text) of ``pages`` (url, html, content_language).

    The declared languages decide, else the address; without either language is
    NULL and its text is left to a classifier. Pages without content are marked.
    """
    tree = dom.examined(pages.select("url", "html").dropDuplicates(["url"]), "url", "html")
    header = pages.groupBy("url").agg(F.max("content_language").alias("_header")) if "content_language" in pages.columns else None
    rows = tree if header is None else tree.join(header, "url")
    head = F.col("_header") if header is not None else F.lit(None).cast("string")
    found = languages.cascade(head, F.col("html_lang"), F.col("meta_language"), F.col("og_locale"), F.col("url"))
    rows = rows.withColumn("markdown", markdown.normalize(F.col("markdown")))
    title = markdown.resolved_title(F.col("title"), F.col("markdown"), F.col("url"))
    return rows.select(
        "url", title.alias("title"), found["language_code"].alias("language"), "markdown", markdown.output_path(F.col("url"), title, root).alias("output_path"),
        F.sha2("markdown", 256).alias("content_hash"), (F.col("markdown") == "").alias("is_empty"), "links", "visible_text",
    )


def write_files(docs: DataFrame, root: str) -> DataFrame:
    """Writes each document of ``docs`` (url, title, language, content_hash, markdown, output_path) under ``root``; (output_path, bytes).

    ``root`` is a folder all executors share. A file appears at once under its
    name, so a repeated task does no harm. Lazy, as all operators are.
    """
    text = markdown.document(F.col("url"), F.col("title"), F.coalesce("language", F.lit("")), F.col("content_hash"), F.col("markdown"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = Path(root).resolve()
        for b in batches:
            sizes = []
            for name, body in zip(b["output_path"], b["text"], strict=True):
                target = (base / name.lstrip("/")).resolve()
                if base not in target.parents:
                    raise ValueError(f"{name} leaves {root}")
                target.parent.mkdir(parents=True, exist_ok=True)
                aside = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                aside.write_bytes(data := body.encode())
                os.replace(aside, target)
                sizes.append(len(data))
            yield pd.DataFrame({"output_path": b["output_path"], "bytes": sizes})

    return docs.select("output_path", text.alias("text")).mapInPandas(of, "output_path string, bytes long")
