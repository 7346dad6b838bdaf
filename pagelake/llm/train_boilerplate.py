"""Trains ``models/boilerplate.json``: python -m pagelake.llm.train_boilerplate [pages.parquet [most pages]].

Labels come from annotation rules: phrases seen in furniture of the crawled
sites, and the links of contents lists and link lists under the labels that
open them. The rules only label the sample; pages are judged by the models.
At most ``MOST_PAGES`` pages are used, the first by a hash of their id.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq

from pagelake.llm import gbt
from pagelake.llm.boilerplate import _WORD, MODEL, Boilerplate, Page, matrices

MOST_PAGES = 10_000
_MENU = "feed|team|support|careers|docs|home|forum|contact|legal|blog|search|login|menu|press|releases|jobs|tags|status|pricing|guides"
_OPENERS = "on this page|other topics|recent posts|recommended|top pages|more like this|see also|related articles|popular now|next up"
_RULES = re.compile(
    "|".join([
        "^download the .+ handbook as a printable file", r"^\[home\]\(.*\[sign in\]\(", "^edit this page in the .+ repository",
        "stores small files on your device to measure traffic", "ask the .+ forum or open a ticket", "^skip to the main content of",
        "is a registered trade name; other names", "^share this .+ article:", "^subscribe to the .+ newsletter", "^pass it on! ",
        "^last built on .+ publishing pipeline", " docs / products / pricing / community / support$", "^find .+ on chirrup, forumly",
        "^page maintained by the .+ documentation team", "^written by the .+ editors on", "^try .+ cloud free for",
        "^you are reading the documentation of", "^was this (page|part) of the .+ handbook helpful", "^the contents of these pages are provided by",
        r"^© \d+ .+(all rights|alle rechte|tous droits|todos los)", "^we use cookies on", "^startseite / anleitungen", "^fragen. im forum von",
        "^une question . le forum", "^by scrolling past marker", "^your privacy matters:", "^diesen beitrag von .+ teilen", "^war diese seite von",
        "^dernière mise à jour le", "^¿dudas. el foro", "^partager cet article", r"^cookie settings \(", "^inicio / guías", "^accueil / guides",
        "^compartir este artículo", "^this site keeps crumbs", "^your browser is out of date, some", "^die inhalte von .+ ohne gewähr",
        "^advertisement:", "^print this page or save", "^zuletzt erstellt am", "^les contenus de .+ sans garantie", "^mentions légales [|]",
        "^survey: tell us", "^machine translation was used", "^powered by pagewright", "^cette page de .+ aidé", "^última actualización el",
        "^los contenidos de .+ sin garantía", "^¿le ha servido", "^impressum [|]", "^aviso legal [|]", "^wir verwenden cookies",
        "^nous utilisons des cookies", "^usamos cookies", r"^\[privacy\]\(.*\[imprint\]\(", f"^(?:{_OPENERS})$", " meetup season starts soon",
        r"^\w+ · \d+ min$", r"^\w+ - updated \d+ days ago$", r"^by \w+, \d+ views$", r"^author: \w+ \(\d+ posts\)$",
        f"^(?:{_MENU})$", rf"^\[(?:{_MENU})\]\(", f"^(?:{_MENU}) [›»>/] ", r"^(?:#[\w\-]+ ?)+$", r"^\[[^\]]*\]\(#[^)]*\)$", r"^\[[^\]]*\]\(/[^)]+\)$",
        r"^(?:previous:|←|<-|«) .+ [|] .+(?:\(next\)|->|→|»)$", rf"^(?:{_MENU})(?: [|] (?:{_MENU}))+$",
    ])
)


def _bare(line: str) -> str:
    line = re.sub(r"^(?:(?:[>*+\-]|\d+[.)])\s+)+", "", line.strip())
    line = re.sub(r"^#+ ", "", line)
    line = re.sub(r"^(\*\*|__|_|\*)(.*)\1$", r"\2", line)
    return re.sub(r"\s+", " ", line.removesuffix("…")).strip().lower()


def labels(markdown: str) -> list[bool]:
    """Whether the rules call each line furniture."""
    out, opened, fence, title = [], False, False, False
    for line in markdown.split("\n"):
        text = line.strip()
        bare = _bare(line)
        if text.startswith(("```", "~~~")):
            fence, opened = not fence, False
            out.append(False)
            continue
        if not text:
            opened = False
            out.append(False)
            continue
        item = re.match(r"\s*[*+\-]\s", re.sub(r"^(?:> )+", "", line)) is not None
        hit = not fence and not line.startswith("    ") and (_RULES.search(bare) is not None or (opened and item))
        if hit and line.startswith("# ") and not title:
            hit, title = False, True
        opened = hit and (opened and item or re.match(rf"^(?:{_OPENERS})$", bare) is not None)
        out.append(hit)
    return out


def token_odds(pages: pd.DataFrame, truth: list[list[bool]]) -> dict[str, float]:
    """Log-odds that a line with the token is furniture, for tokens of at least 15 hosts; link targets count as tokens."""
    yes, no, hosts = Counter(), Counter(), defaultdict(set)
    n_yes = n_no = 0
    for markdown, url, flags in zip(pages["markdown"], pages["url"], truth, strict=True):
        host = url.split("/")[2].lower()
        for line, f in zip(markdown.split("\n"), flags, strict=True):
            if not line.strip():
                continue
            links = re.findall(r"\]\((?:https?:/)?/(?:[^)\s?]*/)?([^)\s/?]+)\)", line)
            words = set(_WORD.findall(re.sub(r"\]\([^)]*\)", "]", line).lower())) | {x.lower() for x in links}
            (yes if f else no).update(words)
            n_yes, n_no = n_yes + f, n_no + (not f)
            for w in words:
                hosts[w].add(host)
    odds = {w: math.log((yes[w] + 0.5) / (n_yes + 1)) - math.log((no[w] + 0.5) / (n_no + 1)) for w in yes.keys() | no.keys() if len(hosts[w]) >= 15 and yes[w] + no[w] >= 20}
    return {w: round(max(-4.0, min(4.0, v)), 2) for w, v in sorted(odds.items()) if abs(v) > 0.7}


def main() -> None:
    source = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1/markdown_documents.parquet"
    most = int(sys.argv[2]) if len(sys.argv) > 2 else MOST_PAGES
    pages = pq.read_table(source, columns=["page_id", "url", "markdown"]).to_pandas().drop_duplicates("page_id").dropna()
    pages = pages.assign(h=pd.util.hash_array(pages["page_id"].to_numpy())).sort_values("h").head(most).reset_index(drop=True)
    truth = [labels(m) for m in pages["markdown"]]
    test = (np.arange(len(pages)) % 5) == 0
    fit = [t for t, x in zip(truth, test, strict=True) if not x]
    odds = token_odds(pages[~test], fit)
    trees = [Page(m, u, odds) for m, u in zip(pages["markdown"], pages["url"], strict=True)]
    part = lambda keep: [(p, t) for p, t, x in zip(trees, truth, test, strict=True) if x != keep]
    learn, held = part(True), part(False)
    x, gx, owner = matrices([p for p, _ in learn])
    y = np.array([t[n - 1] for p, t in learn for n in p.line_no], float)
    gy = np.bincount(owner, y) == np.bincount(owner)
    model = {"odds": odds, "line": gbt.train(x, y, trees=50, depth=4, rate=0.3), "group": gbt.train(gx, gy, trees=30, depth=4, rate=0.3)}
    found = Boilerplate(model).flags([p for p, _ in held])
    hit = miss = extra = 0
    wrong = Counter()
    for (p, t), f in zip(held, found, strict=True):
        for n, a in zip(p.line_no, f, strict=True):
            b = t[n - 1]
            hit, miss, extra = hit + (a and b), miss + (b and not a), extra + (a and not b)
            if a != b:
                wrong[("-" if b else "+", re.sub(r"\d+", "9", p.raw[n - 1])[:100])] += 1
    print(f"{len(pages)} pages, {len(y)} lines, {len(odds)} tokens; held out: precision {hit / max(1, hit + extra):.4f}, recall {hit / max(1, hit + miss):.4f}")
    for (kind, line), n in wrong.most_common(40):
        print(kind, n, line)
    MODEL.parent.mkdir(exist_ok=True)
    MODEL.write_text(json.dumps(model, ensure_ascii=False, separators=(",", ":")))


if __name__ == "__main__":
    main()
