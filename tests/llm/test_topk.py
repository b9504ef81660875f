import math

import numpy as np
import pytest

from tillroll.llm import topk


def brute_force(rows, k=20, every=20):
    good = [(i, [math.floor(64.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, tmp_path, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id AS id", "label AS shard")
    path = str(tmp_path / "t")
    df.write.parquet(f"{path}/embeddings.parquet")
    for name, size in sizes.items():
        setattr(topk, name, size)
    return sorted(map(tuple, topk.op1_topk(spark, path).collect()))


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("crowd", [False, True])
def test_against_all_pairs(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(topk, "STEP", 64)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(500)]
    if crowd:  # ties: many copies of one vector
        rows = [(i, rows[7][1] if i % 3 else v) for i, v in rows]
    rows += [(1000, None), (1020, [None] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] * 16), (None, [0.1] * 16), (40, [0.3] * 16), (3, rows[3][1])]
    expected = brute_force(as_float(rows))
    assert run(spark, [(i, v, 0) for i, v in rows], tmp_path) == expected


def test_small_tables(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
    rows = [(0, [0.5, -0.5]), (1, [0.5, 0.5])]
    assert run(spark, [(i, v, 0) for i, v in rows], tmp_path / "b") == brute_force(rows)


def test_empty_vectors_score_nothing(spark, tmp_path):
    rows = [(i, []) for i in range(45)]
    assert run(spark, [(i, v, 0) for i, v in rows], tmp_path / "a") == brute_force(rows)
    mixed = [(i, [] if i % 2 else [0.5, -0.25]) for i in range(45)]
    expected = sorted(
        (q, r + 1, i, s) for q in (0, 20, 40)
        for r, (s, i) in enumerate(sorted(((0 if i % 2 else 1280, i) for i, _ in mixed if i != q), key=lambda x: (-x[0], x[1]))[:20]))
    assert run(spark, [(i, v, 0) for i, v in mixed], tmp_path / "b") == expected


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(2)
    shard = rng.integers(-10**6, 10**6, (8, 300)).astype(np.float64)
    query = rng.integers(-10**6, 10**6, 8).astype(np.float64)
    ids, scores = topk.max_score(shard, np.arange(300), query, -1, 5)
    exact = sorted(((-int(s), i) for i, s in enumerate(query @ shard)))[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == exact


def test_query_against_sql(spark, duck):
    expected = duck.execute(topk.ORACLE)
    names = [c[0] for c in expected.description]
    from tests.conftest import SF_SMALL

    assert sorted(map(tuple, topk.op1_topk(spark, SF_SMALL).select(*names).collect())) == sorted(expected.fetchall())
