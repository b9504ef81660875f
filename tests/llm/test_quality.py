import re

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillroll.llm import quality


def measured(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def check(df, rows):
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert got == sorted(((d, *measured(t)) for d, t in rows), key=str)


def test_sample_against_plain_python(spark, sample):
    df = quality.op6_quality(spark, SF_SMALL)
    check(df, sample)
    assert df.where("kept AND base_failed").count() == 0


def test_verdicts_agree_with_labels(spark, duck):
    """The labels are not used in fitting."""
    kept = {r[0]: r[1] for r in quality.op6_quality(spark, SF_SMALL).select("doc_id", "kept").collect()}
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    good = [kept[d] for d, q in labels if q == 1]
    bad = [kept[d] for d, q in labels if q == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / max(1, len(bad)) < 0.3


def test_odd_rows(documents_of):
    rows = [*ODD, (20, "a b c d e a b c d e f"), (21, "x y\nx y\n \nx y"), (22, "| | | | | | | | | |"), (23, "a a a a a a a a a a a a")]
    judged = quality.judge(documents_of(rows).selectExpr("*", "1 AS n_words", "text AS row"))
    check(judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), rows)
    assert quality.judge(documents_of([])).count() == 0


def test_accuracies_are_recovered(spark):
    """Votes drawn with known error rates: the fit finds them, and the posterior beats the majority."""
    import random

    rng = random.Random(3)
    right = {"a": 0.95, "b": 0.9, "c": 0.6, "d": 0.85}
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.7
        rows.append([None if rng.random() < 0.2 else int(good == (rng.random() < p)) for p in right.values()])
    params = quality.fit(spark.createDataFrame(rows, "a int, b int, c int, d int"), list(right))
    assert abs(params["prior"] - 0.7) < 0.05
    for name, p in right.items():
        bad, good, _ = params["good"][name]
        assert abs(good / (good + bad) - p) < 0.06
