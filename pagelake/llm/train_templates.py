"""Learns ``models/page_templates.json`` and ``models/slot_templates.json``: python -m pagelake.llm.train_templates [pages.parquet [most pages]].

Records and the lines of bare articles of at most ``MOST_PAGES`` pages, drawn evenly over the file, are
aligned as in ``template_residue``; a template is kept if it repeats on several hosts.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict

import pyarrow.parquet as pq

from pagelake.llm import template_residue as R
from pagelake.llm.boilerplate import split_batch
from pagelake.llm.markup import without_code

MOST_PAGES = 10_000


def slot_templates(records: list[tuple[int, str, list[str]]]) -> list[list[str | None]]:
    """The templates that ``template_residue.unfilled`` induces from (page, host, record)."""
    at, groups = defaultdict(set), defaultdict(lambda: (set(), set(), set()))
    for _, host, parts in records:
        for n, x in enumerate(parts):
            at[R.shape(parts), n, x].add(host)
    for page, host, parts in records:
        own = [len(at[R.shape(parts), n, x]) >= R.LEAST_HOSTS for n, x in enumerate(parts)]
        pages, hosts, fillings = groups[tuple(x if o else None for x, o in zip(parts, own, strict=True))]
        pages.add(page), hosts.add(host), fillings.add(tuple(x for x, o in zip(parts, own, strict=True) if not o))
    return [
        list(t) for t, (pages, hosts, fillings) in groups.items()
        if len(pages) >= R.LEAST_PAGES and len(hosts) >= R.LEAST_HOSTS and (None not in t or len(fillings) >= R.LEAST_FILLINGS) and R.keeps_default(list(t))
    ]


def main() -> None:
    source = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1/markdown_documents.parquet"
    pages = pq.read_table(source, columns=["page_id", "url", "title", "markdown"]).to_pandas().drop_duplicates("page_id").dropna(subset=["url", "markdown"])
    most = int(sys.argv[2]) if len(sys.argv) > 2 else MOST_PAGES
    pages = pages.iloc[:: max(1, -(-len(pages) // most))]
    hosts, rows, records = defaultdict(set), [], []
    for (_, article), url, title, page in zip(split_batch(list(pages["markdown"]), list(pages["url"])), pages["url"], pages["title"], pages["page_id"], strict=True):
        host, text = url.split("/")[2].lower(), R._CODE.sub(" ", without_code(article))
        found = R.records(text) + (R.records(without_code(title, " ")) if isinstance(title, str) else [])
        records += [(page, host, x) for x in found]
        if found or R.is_filler(text) or not R.is_bare(text):
            continue
        for words in R.message_lines(text):
            rows.append((host, words))
            for w in set(words):
                hosts[w].add(host)
    slots = sorted(slot_templates(records), key=lambda t: [x or "" for x in t])
    R.SLOTS.write_text("[\n" + ",\n".join(json.dumps(t, ensure_ascii=False) for t in slots) + "\n]\n")
    print(f"{len(slots)} templates of {len(records)} records")
    for t in slots:
        print(*(x or "•" for x in t))
    seen = defaultdict(set)
    for host, words in rows:
        fixed = frozenset(w for w in words if len(hosts[w]) >= R.LEAST_HOSTS and not w.isdigit())
        if len(fixed) >= 2 and 2 * len(fixed) >= len(set(words)):
            seen[fixed].add(host)
    kept = sorted(sorted(t) for t, h in seen.items() if len(h) >= R.LEAST_HOSTS)
    kept = [t for t in kept if not any(set(o) < set(t) for o in kept)]
    print(f"{len(kept)} templates of {len(rows)} lines")
    for t in kept:
        print(*t)
    R.TEMPLATES.write_text(json.dumps(kept, ensure_ascii=False, indent=0))


if __name__ == "__main__":
    main()
