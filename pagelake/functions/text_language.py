"""Which language a text is in, judged by its letters: the last resort where nothing declares one.

A naive Bayes model over hashed n-grams of one to three letters, trained by
``train_text_language`` and stored in ``models``; one Arrow pass over whole
columns. NULL texts have no decision.
"""

from __future__ import annotations

import sys
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import languages

MODEL = Path(__file__).parent / "models" / "text_language.npz"
BUCKETS = 1 << 14
#: How sharply the likelihoods of a text's n-grams, on average, turn into confidences.
SHARPNESS = 12.0
_JUDGED = T.StructType([T.StructField("language_code", T.StringType()), T.StructField("confidence", T.DoubleType())])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter or a mark of one, else a blank."""
    import unicodedata

    return np.array([c if unicodedata.category(chr(c))[0] in "LM" else 32 for c in range(0x110000)], np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of ``texts`` and the number of the text it is of."""
    joined = "".join(t.lower().replace("\n", " ") + "\n" for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    owner = np.cumsum(code == 10) - (code == 10)
    c = _letters()[code].astype(np.uint64)
    keep = np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32) | (code[1:] == 10)])
    c, owner = c[keep], owner[keep]
    padded = np.concatenate([c, np.full(2, 32, np.uint64)])
    found, whose = [], []
    for n in (1, 2, 3):
        h = np.zeros(len(c), np.uint64)
        for j in range(n):
            h = h * np.uint64(0x1F0001) + padded[j : j + len(c)]
        good = c != 32
        found.append(((h[good] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 14)).astype(np.int64))
        whose.append(owner[good])
    return np.concatenate(found), np.concatenate(whose)


@lru_cache(maxsize=1)
def trained() -> tuple[list[str], np.ndarray]:
    """The languages and the log-likelihood of each bucket in them."""
    with np.load(MODEL) as z:
        return [str(x) for x in z["languages"]], z["weights"].astype(np.float64)


def judge(texts: list[str | None], model: tuple[list[str], np.ndarray] | None = None) -> list[tuple[str, float] | None]:
    """The likeliest language of each text and its confidence; None for texts without letters."""
    names, weights = model or trained()
    out: list[tuple[str, float] | None] = [None] * len(texts)
    for at in range(0, len(texts), 200):  # bounds the arrays of n-grams
        part = [t or "" for t in texts[at : at + 200]]
        bucket, owner = features(part)
        n = np.bincount(owner, minlength=len(part))
        score = np.stack([np.bincount(owner, weights[k][bucket], len(part)) for k in range(len(names))], 1) / np.maximum(n, 1)[:, None]
        likely = np.exp(SHARPNESS * (score - score.max(1, keepdims=True)))
        share = likely / likely.sum(1, keepdims=True)
        for k in np.nonzero(n)[0].tolist():
            best = int(share[k].argmax())
            out[at + k] = (names[best], float(share[k, best]))
    return out


@F.pandas_udf(_JUDGED)
def _judged(text: pd.Series) -> pd.DataFrame:
    found = judge([t if isinstance(t, str) else None for t in text])
    return pd.DataFrame({"language_code": [f and f[0] for f in found], "confidence": [f and f[1] for f in found]})


def from_text(text: Column) -> Column:
    """Decision by the text itself, always there: English from ``languages.LEAST_CONFIDENCE`` on; too little text isn't English."""
    gated = languages.text_gate(text)
    found = _judged(gated)
    code, sure = found["language_code"], found["confidence"]
    none = F.lit(None)
    return (
        F.when(gated.isNull(), languages.decision(F.lit(False), none.cast("string"), "insufficient-text"))
        .when(code.isNull(), languages.decision(F.lit(False), none.cast("string"), "language-detector-no-result"))
        .otherwise(languages.decision((code == "en") & (sure >= languages.LEAST_CONFIDENCE), code, "text-analysis", sure))
    )


def decide(header: Column, html_lang: Column, meta: Column, og_locale: Column, url: Column, text: Column) -> Column:
    """The whole cascade: what is declared, then the address, then the text."""
    return F.coalesce(languages.cascade(header, html_lang, meta, og_locale, url), from_text(text))
