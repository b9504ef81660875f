"""Points of a descending order against the sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators.selection import ntile, nth_key, rank_cuts, top_points

LISTS = {
    "spread": [random.Random(1).randint(1, 10**9) for _ in range(700)],
    "ties": [random.Random(2).choice([5, 70, 70, 70, 900, 10**6, 10**6 + 1]) for _ in range(500)],
    "all_equal": [1250] * 400,
    "one": [7],
    "close": [2**20 + i // 3 for i in range(300)],
    "zeros": [0] * 9,
}


@pytest.mark.parametrize("name", LISTS)
def test_points_against_the_sorted_list(spark, name):
    values = sorted(LISTS[name], reverse=True)
    n, total = len(values), sum(values)
    df = spark.createDataFrame([(v,) for v in LISTS[name]] + [(None,)], "v long").repartition(5)
    ranks, shares = [1, 2, n // 3, n - 1, n, n + 1, 0], [1, 50, 80, 100]
    r = top_points(df, F.col("v"), [*ranks, F.call_function("div", F.col("n"), F.lit(2))], shares).first()
    assert (r["n"], r["total"]) == (n, total)
    for i, rank in enumerate([*ranks, n // 2]):
        want = (values[rank - 1], sum(values[:rank]), sum(v > values[rank - 1] for v in values)) if 1 <= rank <= n else (None,) * 3
        assert (r[f"value_{i}"], r[f"sum_{i}"], r[f"above_{i}"]) == want
    for j, share in enumerate(shares):
        assert r[f"reach_{j}"] == next(m for m in range(1, n + 1) if sum(values[:m]) * 100 >= total * share)


def test_no_values(spark):
    r = top_points(spark.createDataFrame([], "v long"), F.col("v"), [1], [80]).first()
    assert tuple(r) == (None,) * 6


@pytest.mark.parametrize("name", LISTS)
@pytest.mark.parametrize("buckets", [5, 3])
def test_ntile_against_the_sorted_list(spark, name, buckets):
    rng = random.Random(name)
    rows = [(v, f"{rng.choice(['', '1', 'ab', 'abcde', 'é'])}-{i}") for i, v in enumerate(LISTS[name])]
    df = spark.createDataFrame(rows, "v long, k string").repartition(4)
    ordered = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
    q, r = divmod(len(rows), buckets)
    want = {}
    for i, (_, k) in enumerate(ordered):
        want[k] = i // (q + 1) + 1 if i < r * (q + 1) else r + (i - r * (q + 1)) // max(q, 1) + 1
    assert {x.k: x.t for x in ntile(df, "v", "k", buckets, "t").collect()} == want
    plan = ntile(df, "v", "k", buckets, "t")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan


def test_keys_are_selected_by_their_characters(spark):
    keys = sorted({"", "a", "aaaa", "aaaab", "aaaabbbbc", "aaaabbbbd", "b", "é", *(f"{i:07d}" for i in range(200))}, key=str.encode)
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for i in (1, 2, 100, 201, 202, 203, 204, len(keys)):
        assert nth_key(df, "k", i) == keys[i - 1]


def test_cuts_inside_and_at_the_end_of_ties(spark):
    df = spark.createDataFrame([(9, "a"), (5, "d"), (5, "b"), (5, "c"), (1, "e")], "v long, k string")
    assert [(c.value, c.last_id) for c in rank_cuts(df, "v", "k", [1, 2, 4, 5, 6])] == [(9, None), (5, "b"), (5, None), (1, None)]
