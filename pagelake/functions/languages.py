"""Languages as declared: codes of headers and attributes, and codes in addresses. All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.functions.text import strip

# The codes looked for in addresses.
ENGLISH = ("en", "en-au", "en-ca", "en-gb", "en-ie", "en-in", "en-nz", "en-us", "en-za")
NON_ENGLISH = (
    "ar", "bg", "bn", "ca", "cs", "da", "de", "el", "es", "et", "fa", "fi", "fr", "he", "hi", "hr", "hu", "id", "it", "ja", "ko", "lt", "lv", "ms",
    "nl", "no", "pl", "pt", "pt-br", "pt-pt", "ro", "ru", "sk", "sl", "sr", "sv", "th", "tr", "uk", "ur", "vi", "zh", "zh-cn", "zh-hans", "zh-hant",
    "zh-hk", "zh-tw",
)
#: Shorter texts aren't judged; of longer ones so many characters; English from this confidence on.
LEAST_TEXT, MOST_TEXT, LEAST_CONFIDENCE = 80, 30_000, 0.55
DECISION = "struct<is_english:boolean,language_code:string,source:string,confidence:double>"


def decision(is_english: Column, code: Column, source: str, confidence: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        is_english.alias("is_english"), code.alias("language_code"), F.lit(source).alias("source"), (none if confidence is None else confidence).alias("confidence")
    )


def code(value: Column) -> Column:
    """First code of a list, lower case with hyphens; NULL if blank."""
    first = F.split_part(F.split_part(value, F.lit(","), F.lit(1)), F.lit(";"), F.lit(1))
    return F.nullif(F.replace(F.lower(strip(first)), F.lit("_"), F.lit("-")), F.lit(""))


def from_code(value: Column, source: str) -> Column:
    """Decision by a declared code; NULL if none is declared."""
    return urls.let(code(value), lambda c: F.when(c.isNotNull(), decision(F.split_part(c, F.lit("-"), F.lit(1)) == "en", c, source)))


def _places(url: Column) -> Column:
    p = urls.parts(url)
    segments = F.filter(F.split(F.lower(p["path"]), "/"), lambda x: strip(x) != "")
    return F.transform(F.concat(F.array(F.split_part(p["host"], F.lit("."), F.lit(1))), F.slice(segments, 1, 2)), lambda x: F.replace(x, F.lit("_"), F.lit("-")))


def from_url(url: Column) -> Column:
    """Decision by the first host label, then by the first two path parts; NULL if none is a code."""
    known = F.array(*map(F.lit, ENGLISH + NON_ENGLISH))

    def of(places: Column) -> Column:
        first = F.element_at(places, 1)
        hit = F.get(F.filter(F.slice(places, 2, 2), lambda x: F.array_contains(known, x)), 0)
        return (
            F.when(first.isin(*ENGLISH + NON_ENGLISH), decision(first.isin(*ENGLISH), first, "url-subdomain"))
            .when(hit.isNotNull(), decision(hit.isin(*ENGLISH), hit, "url-path"))
        )

    return urls.let(_places(url), of)


def explicitly_non_english(url: Column) -> Column:
    return F.coalesce(F.exists(_places(url), lambda x: x.isin(*NON_ENGLISH)), F.lit(False))


def cascade(header: Column, html_lang: Column, meta: Column, og_locale: Column, url: Column) -> Column:
    """The first declaration that decides; NULL leaves the text to decide."""
    return F.coalesce(
        from_code(header, "content-language-header"), from_code(html_lang, "html-lang"), from_code(meta, "meta-content-language"),
        from_code(og_locale, "og-locale"), from_url(url),
    )


def text_gate(text: Column) -> Column:
    """The text as it is judged, or NULL if there is too little of it."""
    squeezed = F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, MOST_TEXT)
    return F.when(F.length(squeezed) >= LEAST_TEXT, squeezed)
