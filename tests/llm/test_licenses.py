import re

import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillroll.llm import licenses


def plain(text):
    """Every block against every template, and every place of every phrase."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    half = max(len(t.split()) for _, t in licenses.TEMPLATES)
    labels, score = set(base), 1.0 if base else 0.0
    for b in range(0, max(1, len(w)), half):
        block = set(zip(w[b : b + 2 * half], w[b + 1 : b + 2 * half]))
        for label, t in licenses.TEMPLATES:
            words = t.split()
            wanted = set(zip(words, words[1:]))
            if len(block & wanted) >= licenses.THRESHOLD * len(wanted):
                labels.add(label)
                score = max(score, len(block & wanted) / len(wanted))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


LICENSED = [
    (100, "Some words. This Work is licensed under the GNU General Public License, version 3."),
    (101, "x " * 70 + "Licensed under the Apache License, Version 2.0. " + "y " * 50 + "released under the MIT license"),
    (102, "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and associated documentation files"),
    (103, "Licensed under CC BY-NC 4.0. cc by nc CC\nBY\nNC"),
    (104, "of the of the of the in the license the license is the work under the"),
    (105, "licensed under cc by 4 0"),
    (106, " ".join(["filler"] * 35 + licenses.TEMPLATES[2][1].split() + ["filler"] * 35)),
]


def check(df, rows):
    columns = "doc_id n_words n_base first_word last_word base_labels labels score".split()
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert got == sorted(((d, *plain(t)) for d, t in rows), key=str)


def test_sample(spark, sample):
    check(licenses.op2_licenses(spark, SF_SMALL), sample)


def test_licensed_and_odd_rows(documents_of):
    rows = [*ODD, *LICENSED, *[(200 + i, w + LICENSED[i % 7][1] + w) for i, w in enumerate(["pad " * k for k in range(1, 40)])]]
    check(licenses.license_scan(documents_of(rows).selectExpr("*", "1 AS n_words", "text AS blocks")), rows)
    labels = {r["doc_id"]: r["labels"] for r in licenses.license_scan(documents_of(LICENSED)).collect()}
    assert labels == {100: "gpl-3", 101: "apache-2,mit", 102: "mit", 103: "cc-by-nc", 104: "", 105: "", 106: "mit"}
    assert licenses.license_scan(documents_of([])).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 1.0])
def test_join_loses_nothing(spark, threshold):
    """Prefix, length and positional filters against all pairs, on random sets with a skewed vocabulary."""
    import random

    rng = random.Random(int(threshold * 100))
    draw = lambda k: sorted({min(int(rng.paretovariate(0.7)), 40) for _ in range(k)})
    sets = [(f"s{i}", draw(rng.randrange(2, 12))) for i in range(12)]
    vocabulary = {t for _, s in sets for t in s}
    blocks = [(i, [t for t in draw(rng.randrange(1, 25)) if t in vocabulary]) for i in range(200)]
    df = spark.createDataFrame(blocks, "at int, tokens array<int>")
    got = {(r["at"], r["label"]) for r in licenses.containment_join(df, sets, threshold).collect()}
    assert got == {(i, n) for i, b in blocks for n, s in sets if len(set(b) & set(s)) >= licenses.required(len(s), threshold)}
