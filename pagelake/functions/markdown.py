"""Normal form, heading, digest, slug, output path and front matter of Markdown documents. All native columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import urls
from pagelake.functions.text import BLANKS, newlines, strip


def normalize(markdown: Column) -> Column:
    """LF line ends, no trailing blanks, no empty links or images, at most one blank line, one final LF; '' for blank text."""
    m = F.regexp_replace(newlines(markdown), r"[ \t]+\n", "\n")
    m = F.regexp_replace(m, r"(?U)\[\s*\]\([^)]*\)", "")
    m = F.regexp_replace(m, r"(?U)!\[\s*\]\(\s*\)", "")
    m = strip(F.regexp_replace(m, r"\n{3,}", "\n\n"))
    return F.when(m == "", "").otherwise(F.concat(m, F.lit("\n")))


def heading(markdown: Column) -> Column:
    """The first line that begins with #, without its marker; '' if there is none with text."""
    lines = F.transform(F.split(markdown, r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), strip)
    bare = F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: strip(F.regexp_replace(x, r"(?U)^#{1,6}\s+", "")))
    return F.coalesce(F.get(F.filter(bare, lambda x: x != ""), 0), F.when(markdown.isNotNull(), ""))


def resolved_title(title: Column, markdown: Column, url: Column) -> Column:
    """The title, else the first heading, else the address."""
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.nullif(heading(markdown), F.lit("")), url)


def digest(markdown: Column) -> Column:
    """SHA-256 of the normal form, final LF included."""
    return F.sha2(normalize(markdown), 256)


def stripped_digest(markdown: Column) -> Column:
    return F.sha2(strip(newlines(markdown)), 256)


def slug(value: Column) -> Column:
    """ASCII slug; letters with marks lose them, other characters are dropped or become one hyphen."""
    plain = F.when(value.rlike(r"^[\x00-\x7f]*$"), value).otherwise(_ascii()(value))
    s = F.regexp_replace(F.regexp_replace(strip(F.lower(plain)), r"[^a-z0-9._\-]+", "-"), r"-{2,}", "-")
    s = F.regexp_replace(s, r"^[\-._]+|[\-._]+$", "")
    return F.when(s == "", "page").otherwise(s)


_UDF: dict[str, object] = {}


def _ascii_part(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def _ascii():  # noqa: ANN202
    """The ASCII part of the compatibility decomposition, which Spark has no function for."""
    if "ascii" not in _UDF:
        _UDF["ascii"] = F.pandas_udf(_ascii_part, T.StringType())
    return _UDF["ascii"]


def output_path(url: Column, title: Column, root: str = "") -> Column:
    """root/host/parts/last-<12 hex of the address's SHA-256>.md; without path the title names the file."""
    p = urls.parts(url)
    host = slug(F.coalesce(F.nullif(p["host"], F.lit("")), F.lit("unknown-host")))
    pieces = F.filter(F.split(F.regexp_replace(p["path"], r";[^/]*$", ""), "/"), lambda x: strip(x) != "")
    # Marks are taken off all parts at once, as no Python may run inside a lambda; a blank part stays a part.
    plain = F.when(p["path"].rlike(r"^[\x00-\x7f]*$"), pieces).otherwise(F.split(_ascii()(F.array_join(pieces, "\n")), "\n"))
    slugs = F.transform(plain, _slug_ascii)
    last = F.when(F.size(slugs) > 0, F.substring(F.element_at(slugs, -1), 1, 80)).otherwise(F.substring(slug(title), 1, 100))
    folder = F.when(F.size(slugs) > 1, F.slice(slugs, 1, F.greatest(F.size(slugs) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    name = F.concat(last, F.lit("-"), F.substring(F.sha2(url, 256), 1, 12), F.lit(".md"))
    return F.array_join(F.concat(F.array(F.lit(root), host) if root else F.array(host), folder, F.array(name)), "/")


def _slug_ascii(x: Column) -> Column:
    """Slug of a path part that is ASCII by now."""
    s = F.regexp_replace(strip(F.lower(x)), r"[^a-z0-9._\-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"-{2,}", "-"), r"^[\-._]+|[\-._]+$", "")
    return F.when(s == "", "page").otherwise(s)


def json_string(c: Column) -> Column:
    """A JSON string literal; non-ASCII stays as it is."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def document(url: Column, title: Column, language: Column, content_hash: Column, body: Column) -> Column:
    """The document as written: front matter and body."""
    return F.concat(
        F.lit("---\nurl: "), json_string(url), F.lit("\ntitle: "), json_string(title), F.lit("\nlanguage: "), json_string(language),
        F.lit("\ncontent_hash: "), content_hash, F.lit("\n---\n\n"), F.rtrim(body, F.lit(BLANKS)), F.lit("\n"),
    )


def yaml_string(c: Column) -> Column:
    """A double-quoted YAML scalar on one line."""
    return F.concat(F.lit('"'), strip(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))), F.lit('"'))


def dated_document(url: Column, title: Column, language: Column, content_hash: Column, body: Column, generated_at: Column) -> Column:
    """A document with the older front matter, in YAML and with the time it was made."""
    fields = {"title": title, "url": url, "language": language, "content_hash": content_hash, "generated_at": generated_at}
    lines = [F.concat(F.lit(f"{name}: "), yaml_string(value)) for name, value in fields.items()]
    return F.concat(F.array_join(F.array(F.lit("---"), *lines, F.lit("---"), F.lit("")), "\n"), body)
