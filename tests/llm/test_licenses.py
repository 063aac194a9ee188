"""The license scan against a plain-Python definition."""

import re
from collections import Counter

from pyspark.sql import functions as F

from nextbuy.llm import licenses
from nextbuy.llm.licenses import NOTICES, PHRASES, scan_licenses

from . import plain

MIT = next(t for x, t in NOTICES if x == "mit")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.lower(t or ""))


def plain_scan(text, templates):
    ws, spans = words(text), []
    for label, t, base in sorted({(x, " ".join(words(t)), bool(b)) for x, t, b in templates if x is not None and words(t)}):
        t = t.split(" ")
        n, k = len(t), min(4, len(t))
        short = n < 12
        slack, need, least = (0, n, n - k + 1) if short else (n // 12, -(-n * 8 // 10), -(-(n - k + 1) // 4))
        votes = Counter(p - q for p in range(len(ws) - k + 1) for q in range(n - k + 1) if ws[p:p + k] == t[q:q + k])
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            places = {}
            for d in g:
                for q in range(n):
                    if 0 <= d + q < len(ws) and ws[d + q] == t[q]:
                        places[q] = min(places.get(q, d + q), d + q)
            if sum(votes[d] for d in g) >= least and len(places) >= need:
                spans.append((label, base, min(places.values()), len(places) / n))
    base = [s for s in spans if s[1]]
    firsts = [s[2] for s in base]
    return (len(ws), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({s[0] for s in base})),
            ",".join(sorted({s[0] for s in spans})), max((s[3] for s in spans), default=0.0))


TASK = [(x, t, True) for x, t in PHRASES] + [(x, t, False) for x, t in NOTICES]


def cases():
    w = MIT.split(" ")
    changed = [x if i % 12 else "other" for i, x in enumerate(w)]
    return ["MIT License", "mit-license; MIT\nLICENSE mit mit license", "cc by cc by-nc CC/BY", "the GNU General  Public\tLicense", "gnu general license public",
            "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. apache_license", "émit license", "mit licenseé", "MİT license",
            MIT, " ".join(changed), " ".join(w[:30] + ["extra", "words"] + w[30:]), " ".join(w[:20] + w[23:]), " ".join(w[:30]), "Permission to use, copy, modify " * 30,
            "cc by " * 4000, "x " * 3000 + MIT + " y" * 3000 + " apache license", MIT + " " + MIT]


def test_against_plain(spark, rows):
    texts = cases()
    own = list(rows) + [(5000 + i, t) for i, t in enumerate(texts)] + [(5000, texts[0]), (None, texts[0]), (None, texts[0])]
    d = spark.createDataFrame(own, "doc_id long, text string").repartition(4)
    d = d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("label", "base", "words", "k", "gram", "pos", "template", "n", "score", "k1"))])
    want = Counter((i, *plain_scan(t, TASK)) for i, t in own)
    assert sum(n for x, n in want.items() if x[6]) > 15
    assert Counter(tuple(r) for r in scan_licenses(d).collect()) == want


def test_without_broadcasts_and_other_templates(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(licenses, "REGION", 50)
    templates = [("one", "mit", True), ("two", "Apache License", None), (None, "cc by", True), ("empty", " .,", True), ("null", None, True), ("mit", MIT, True), ("mit", MIT, True)]
    t = spark.createDataFrame(templates, "label string, text string, base boolean")
    own = list(enumerate(cases()))
    d = spark.createDataFrame(own, "doc_id long, text string")
    got = Counter(tuple(r) for r in scan_licenses(d, t).collect())
    assert got == Counter((i, *plain_scan(x, templates)) for i, x in own)


def test_empty_tables(spark, no_docs, docs, rows):
    assert scan_licenses(no_docs).count() == 0
    none = spark.createDataFrame([], "label string, text string, base boolean")
    got = scan_licenses(docs, none).collect()
    assert len(got) == len(rows) and all(r.n_base == 0 and r.labels == "" and r.score == 0 for r in got)
