"""Trains ``models/language.npz``: python -m pagelake.llm.train_language [documents.parquet [most documents]].

Labels are the part of documents.lang before - or _. An n-gram belongs to a
language if it is frequent there and not much rarer than where it is most
frequent, which wrong labels of a small share can't bring about. At most
``MOST_DOCUMENTS`` documents, drawn evenly over the file, are used.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from pagelake.llm import language as L
from pagelake.llm.markup import without_code

MOST_DOCUMENTS = 20_000
MOST_GRAMS = 6_000


def main() -> None:
    source = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1/documents.parquet"
    rows = pq.read_table(source, columns=["text", "lang"]).to_pandas().dropna()
    rows = rows.iloc[:: max(1, -(-len(rows) // (int(sys.argv[2]) if len(sys.argv) > 2 else MOST_DOCUMENTS)))]
    rows["code"] = [re.split("[-_]", x.strip().lower())[0] for x in rows["lang"]]
    known = [k for k, n in Counter(rows["code"]).most_common(64) if len(k) == 2 and k != "xx" and n >= 20]
    rows = rows[rows["code"].isin(known)].reset_index(drop=True)
    test = np.arange(len(rows)) % 5 == 0
    for _ in range(2):
        counts = {}
        for code, part in rows[~test].groupby("code"):
            h, _ = L.grams([t for x in part["text"] for _, t in L.paragraphs(without_code(x))])
            values, n = np.unique(h, return_counts=True)
            counts[code] = (values, n / n.sum() * 1e6)
        most: dict[int, float] = {}
        for values, rate in counts.values():
            for v, r in zip(values.tolist(), rate.tolist(), strict=True):
                if r > most.get(v, 0):
                    most[v] = r
        sets = {}
        for code, (values, rate) in counts.items():
            keep = (rate >= 25) & (rate >= 0.2 * np.array([most[v] for v in values.tolist()]))
            values, rate = values[keep], rate[keep]
            sets[code] = values[np.argsort(-rate, kind="stable")[:MOST_GRAMS]]
        filters = L.Filters.build(sets)
        found = [L.page_languages(x) for x in L.decide([without_code(x) for x in rows["text"]], filters)]
        main_of = np.array([x[0][0] if x else "" for x in found])
        print({k: len(v) for k, v in sets.items()}, "false positives", filters.false.round(4).tolist())
        print("held out, agrees with the label:", (main_of == rows["code"])[test].mean(), "mixed:", np.mean([len(x) > 1 for x in found]))
        wrong = Counter(zip(rows["code"], main_of, strict=True))
        print([(k, n) for k, n in wrong.most_common(80) if k[0] != k[1]][:30])
        rows["code"] = np.where(main_of == "", rows["code"], main_of)  # the second round learns from its own corrections
    L.MODEL.parent.mkdir(exist_ok=True)
    np.savez_compressed(L.MODEL, languages=np.array(filters.languages), words=filters.words, hashes=filters.hashes)


if __name__ == "__main__":
    main()
