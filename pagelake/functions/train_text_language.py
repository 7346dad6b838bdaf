"""Trains ``models/text_language.npz``: python -m pagelake.functions.train_text_language [documents.parquet [most documents]].

At most ``MOST_DOCUMENTS`` documents, drawn evenly over the file, labelled by documents.lang. Labels may be wrong:
a second round learns from the first one's judgement.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow.parquet as pq

from pagelake.functions import text_language as T

MOST_DOCUMENTS = 20_000


def main() -> None:
    source = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1/documents.parquet"
    rows = pq.read_table(source, columns=["text", "lang"]).to_pandas().dropna()
    rows = rows.iloc[:: max(1, -(-len(rows) // (int(sys.argv[2]) if len(sys.argv) > 2 else MOST_DOCUMENTS)))]
    code = np.array([re.split("[-_]", x.strip().lower())[0] for x in rows["lang"]])
    names = sorted(k for k in set(code) if len(k) == 2 and k != "xx" and (code == k).sum() >= max(5, len(code) // 200))
    text, test = rows["text"].to_numpy(), np.arange(len(rows)) % 5 == 0
    for _ in range(2):
        counts = np.ones((len(names), T.BUCKETS))
        for k, name in enumerate(names):
            own = np.nonzero((code == name) & ~test)[0]
            for at in range(0, len(own), 200):
                counts[k] += np.bincount(T.features(list(text[own[at : at + 200]]))[0], minlength=T.BUCKETS)
        weights = np.log(counts / counts.sum(1, keepdims=True))
        found = T.judge(list(text), (names, weights))
        print("held out, agrees with the label:", np.mean([f is not None and f[0] == c for f, c in zip(found, code, strict=True)], where=test), "confidence:", np.median([f[1] for f in found if f]))
        code = np.array([f[0] if f else c for f, c in zip(found, code, strict=True)])
    T.MODEL.parent.mkdir(exist_ok=True)
    np.savez_compressed(T.MODEL, languages=np.array(names), weights=weights.astype(np.float16))


if __name__ == "__main__":
    main()
