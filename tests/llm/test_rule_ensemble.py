import math
import random
import re
import zlib

import regex

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillroll.llm import rule_ensemble as ens


def plain(text):
    """The statistics in plain Python."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    solid = "".join(w)
    letters = regex.sub(r"[^\p{L}\p{M}]", "", solid)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + ens.WINDOW]) for i in range(len(w) - ens.WINDOW + 1)]
    share = lambda a, b: a / max(b, 1)
    among = lambda chars: sum(c in chars for c in solid)
    return {
        "n_words": len(w), "word_length": share(len(solid), len(w)), "longest_word": max(map(len, w), default=0),
        "letters": share(len(letters), len(solid)), "upper": share(len(regex.findall(r"\p{Lu}", letters)), len(letters)),
        "digits": share(among("0123456789"), len(solid)), "symbols": share(among("#*$%&|<>"), len(w)),
        "shouts": share(among("!?"), len(w)), "stops": share(among(".,;:"), len(w)),
        "bare_marks": share(sum(not regex.search(r"[\p{L}\p{M}\p{N}]", x) for x in w), len(w)),
        "stutters": share(sum(a == b for a, b in zip(w, w[1:])), len(w)), "distinct_words": share(len(set(w)), len(w)),
        "repeated_windows": share(len(windows) - len(set(windows)), len(windows)), "n_lines": len(lines),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)), "line_words": share(len(w), len(lines)),
    }


def check(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    want = sorted(((d, *plain(t).values()) for d, t in rows), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(g[1:], w[1:])), (g, w)


def test_statistics_of_sample_and_odd_rows(documents_of, sample):
    check(ens.measured(documents_of([*sample, *ODD, (90, "A| B! 12 ... a a a a a\n\na a a a a\nÉa x́")])), [*sample, *ODD, (90, "A| B! 12 ... a a a a a\n\na a a a a\nÉa x́")])


def truth(duck):
    return dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())


def test_held_out_accuracy(spark, duck):
    got = ens.op12_classifier(spark, SF_SMALL).collect()
    labels = truth(duck)
    assert len(got) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in judged) / len(judged) >= 0.9


def example(rng, good):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(rng.randint(30, 80))]
    if not good:
        words = [w + " |" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
    return " ".join(words)


def corpus(spark, n=400, flip_held_out=False):
    rng = random.Random(5)
    quality = [int(rng.random() < 0.7) for _ in range(n)]
    docs = [(i, example(rng, q), f"s{i}", 7) for i, q in enumerate(quality)]
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(n)]
    labels = [(i, 1 - q if flip_held_out and h else q, 0) for i, (q, h) in enumerate(zip(quality, held))]
    return (spark.createDataFrame(docs, "doc_id long, text string, quality string, n_words int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), quality, held)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels, quality, held = corpus(spark)
    scores = {r.doc_id: r.score for r in ens.scored(docs, labels).collect()}
    assert all((scores[i] >= 0.3) == q for i, (q, h) in enumerate(zip(quality, held)) if h)
    docs, lies, _, _ = corpus(spark, flip_held_out=True)
    again = {r.doc_id: r.score for r in ens.scored(docs, lies).collect()}
    assert all(math.isclose(scores[i], again[i], rel_tol=1e-6) for i in scores)


def test_rules_are_paths_and_compile(spark):
    docs, labels, _, _ = corpus(spark)
    names = list(ens.statistics())
    rows = ens.examples_of(ens.measured(docs), labels)
    model = ens.fit(rows, names)
    assert model.rules and all(1 <= len(r.limits) <= ens.DEPTH for r, _ in model.rules)
    for r in rows.select("*", model.score().alias("s")).limit(50).collect():
        total = model.intercept
        for rule, weight in model.rules:
            if all((low is None or r[n] > low) and (high is None or r[n] <= high) for n, low, high in rule.limits):
                total += weight
        total += sum(w * min(max(r[n], low), high) for n, low, high, w in model.linear)
        assert math.isclose(r.s, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_odd_tables(spark, documents_of):
    docs, labels, _, _ = corpus(spark)
    odd = documents_of([*ODD, (3, "x y"), (3, "x y")])
    got = ens.scored(odd, labels.selectExpr("*", "1 AS score")).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert ens.scored(documents_of([]), labels).count() == 0
    none = labels.where("quality IS NULL").union(labels.selectExpr("doc_id", "CAST(NULL AS int)", "0"))
    assert {r.score for r in ens.scored(docs, none).collect()} == {0.5}
    one = ens.scored(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.9


def test_large_label_sets_are_thinned_by_document(spark):
    docs, labels, _, _ = corpus(spark)
    stats = ens.measured(docs)
    some = {r.doc_id for r in ens.examples_of(stats, labels, most_rows=100).collect()}
    assert 40 < len(some) < 180
    assert some == {r.doc_id for r in ens.examples_of(stats.repartition(7), labels, most_rows=100).collect()}
