"""Custom operators against naive definitions."""

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.functions.exact import pct, round_div
from tillroll.operators.quantiles import exact_quantiles
from tillroll.operators.ranking import global_rank, ntile_from_rank


def _spend_frame(spark, n=500, seed=7):
    rnd = random.Random(seed)
    rows = [(f"c{i:04d}", Decimal(rnd.choice([5, 10, 10, 25, 99.99, rnd.randint(1, 5000)])).quantize(Decimal("0.01")))
            for i in range(n)]
    return spark.createDataFrame(rows, "customer_id string, spend decimal(12,2)")


def test_global_rank_matches_single_partition_window(spark):
    df = _spend_frame(spark)
    order = [F.col("spend").desc(), F.col("customer_id").asc()]
    got = global_rank(df, order, running={"cum": (F.col("spend") * 100).cast("long")}, num_partitions=7, total_col="n")
    w = Window.orderBy(*order)
    want = df.select(
        "customer_id",
        F.row_number().over(w).alias("rn"),
        F.sum((F.col("spend") * 100).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
    )
    a = sorted((r.customer_id, r.rn, r.cum, r.n) for r in got.collect())
    b = sorted((r.customer_id, r.rn, r.cum, 500) for r in want.collect())
    assert a == b


def test_global_rank_over_many_ranges_is_a_permutation(spark):
    big = spark.range(2000).select((F.col("id") % 37).alias("v"), F.col("id").cast("string").alias("k"))
    ranked = global_rank(big, [F.col("v").asc(), F.col("k").asc()], num_partitions=5)
    rows = ranked.collect()
    assert sorted(r.rn for r in rows) == list(range(1, 2001))
    by_rank = [r.v for r in sorted(rows, key=lambda r: r.rn)]
    assert by_rank == sorted(by_rank)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 11, 12, 23, 40])
def test_ntile_from_rank_matches_ntile(spark, n):
    df = spark.range(n).select(F.col("id").alias("v"))
    w = Window.orderBy("v")
    got = df.select(
        F.ntile(5).over(w).alias("want"),
        ntile_from_rank(F.row_number().over(w), F.lit(n), 5).alias("got"),
    ).collect()
    assert all(r.want == r.got for r in got)


def _interp(sorted_vals, p):
    pos = (len(sorted_vals) - 1) * Fraction(p)
    lo = int(pos)
    hi = lo if pos == lo else lo + 1
    return Fraction(sorted_vals[lo]) + (Fraction(sorted_vals[hi]) - Fraction(sorted_vals[lo])) * (pos - lo)


def test_exact_quantiles_match_closest_rank_interpolation(spark):
    rnd = random.Random(3)
    rows = [(g, Decimal(rnd.randint(0, 100000)) / 100) for g in ("a", "b", "c") for _ in range(rnd.randint(1, 120))]
    rows += [("d", None)]
    df = spark.createDataFrame(rows, "g string, v decimal(12,2)")
    probs = ["0.1", "0.25", "0.5", "0.75", "0.9"]
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, num_partitions=4).collect()}
    assert "d" not in got
    for g in ("a", "b", "c"):
        vals = sorted(v for k, v in rows if k == g)
        for p in probs:
            want = _interp(vals, p)
            have = Fraction(got[g]["p_" + p.replace(".", "_")])
            assert have == want, (g, p)


def test_exact_quantiles_global_equals_percentile_for_medians(spark):
    df = spark.range(1001).select(((F.col("id") * 7919) % 1000).alias("v"))
    q = exact_quantiles(df, [], "v", ["0.5"], value_type="decimal(12,0)").first()
    p = df.agg(F.percentile("v", 0.5).alias("m")).first()
    assert float(q.p_0_5) == p.m


def test_round_div_is_half_away_from_zero(spark):
    rnd = random.Random(11)
    cases = [(1, 8, 2), (-1, 8, 2), (5, 1000, 2), (-5, 1000, 2), (1005, 1000, 2), (7, 0, 1), (0, 3, 1)]
    cases += [(rnd.randint(-10**12, 10**12), rnd.randint(1, 10**6), rnd.randint(0, 3)) for _ in range(200)]
    df = spark.createDataFrame(cases, "n long, d long, k int")
    for k in (0, 1, 2, 3):
        rows = df.where(F.col("k") == k).select("n", "d", round_div("n", "d", k).alias("r")).collect()
        for r in rows:
            if r.d == 0:
                assert r.r is None
                continue
            want = (Decimal(r.n) / Decimal(r.d)).quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_UP)
            assert Decimal(str(r.r)) == want, (r.n, r.d, k)


def test_pct_handles_values_beyond_64_bits(spark):
    df = spark.createDataFrame([(Decimal("123456789012345678901"), Decimal("987654321098765432109"))], "a decimal(38,0), b decimal(38,0)")
    r = df.select(pct("a", "b", 2).alias("p")).first()
    assert r.p == 12.5


def test_column_quantiles_equal_one_pass_per_column(spark):
    from tillroll.operators.quantiles import column_quantiles

    rnd = random.Random(9)
    rows = [(g, Decimal(rnd.randint(0, 9999)) / 100, rnd.randint(0, 50)) for g in ("x", "y") for _ in range(77)]
    df = spark.createDataFrame(rows, "g string, a decimal(12,2), b long")
    both = {r.g: r for r in column_quantiles(df, ["g"], ["a", "b"], ["0.1", "0.5"]).collect()}
    for col in ("a", "b"):
        single = {r.g: r for r in exact_quantiles(df, ["g"], col, ["0.1", "0.5"]).collect()}
        for g in ("x", "y"):
            for p in ("p_0_1", "p_0_5"):
                assert both[g][f"{col}__{p}"] == single[g][p]


def _ranked(spark, n=1000, ranges=4):
    df = spark.range(n).select(
        F.format_string("k%05d", (F.col("id") * 7919) % n).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v")
    )
    got = global_rank(df, [F.col("k").asc()], running={"cum": F.col("v")}, num_partitions=ranges, running_totals={"cum": "t"})
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", F.row_number().over(Window.orderBy("k")).alias("rn"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("cum"))
    return got, sorted(map(tuple, want.collect()))


def _rows(df):
    return sorted(map(tuple, df.select("k", "rn", "cum").collect()))


def test_ranks_survive_composition(spark):
    got, want = _ranked(spark)
    assert _rows(got) == want
    assert _rows(got.coalesce(1)) == want
    assert _rows(got.union(got)) == sorted(want * 2)
    some = _rows(got.orderBy("rn").limit(300))
    assert some == [r for r in want if r[1] <= 300]
    assert {r.t for r in got.collect()} == {sum(i for i in range(1000) if i % 5)}
    empty, none = _ranked(spark, 0)
    assert _rows(empty) == none == []


def test_running_sums_stay_whole_above_doubles(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([("a", big), ("b", None), ("c", 3)], "k string, v long")
    got = global_rank(df, [F.col("k").asc()], running={"cum": F.col("v")}, num_partitions=2)
    assert _rows(got) == [("a", 1, big), ("b", 2, big), ("c", 3, big + 3)]


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_keep_the_null_group(spark, few):
    rows = [("a", i) for i in range(1, 10)] + [(None, i) for i in range(101, 104)]
    df = spark.createDataFrame(rows, "g string, v long")
    q = exact_quantiles(df, ["g"], "v", ["0.5"], value_type="decimal(12,0)", num_partitions=3, few_groups=few)
    assert {r.g: (r.n, float(r.p_0_5)) for r in q.collect()} == {"a": (9, 5.0), None: (3, 102.0)}


def test_few_groups_are_not_shuffled_by_group_before_they_are_reduced(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = exact_quantiles(df, ["g"], "id", ["0.5"], value_type="decimal(12,0)", num_partitions=4)
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BuildLeft" not in plan
        assert sorted(float(r.p_0_5) for r in q.collect()) == [1999.0, 2000.0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tillroll.storage import shared_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def _percentile_cont(values, p):
    from decimal import Decimal
    from math import floor

    values = sorted(values)
    pos = (len(values) - 1) * Decimal(p)
    lo = floor(pos)
    hi = lo if pos == lo else lo + 1
    return values[lo] + (values[hi] - values[lo]) * (pos - lo)


def test_digit_histograms_select_exact_values(spark):
    """Small, long and negative numbers, ties, several bins to a length, a null group."""
    import random
    from decimal import Decimal

    rng = random.Random(3)
    rows = [(g, Decimal(rng.randint(-(10**k), 10**k)).scaleb(-2)) for g in ("a", None) for k in range(1, 17) for _ in range(40)]
    rows += [("b", Decimal("7.77"))] * 300 + [("c", None), ("d", Decimal("1.00"))]
    df = spark.createDataFrame(rows, "g string, v decimal(20,2)").repartition(7)
    probs = ["0", "0.1", "0.25", "0.5", "0.75", "0.9", "1"]
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g, r in got.items():
        values = [v for h, v in rows if h == g and v is not None]
        assert r.n == len(values)
        assert [r["p_" + p.replace(".", "_")] for p in probs] == [_percentile_cont(values, p) for p in probs]


def test_bins_follow_the_order_of_numbers(spark):
    from tillroll.operators.quantiles import bin_of

    numbers = sorted({s * (1 << b) + d for b in range(62) for d in (-1, 0, 1) for s in (1, -1)})
    got = spark.createDataFrame([(n,) for n in numbers], "v long").select("v", bin_of(F.col("v")).alias("b")).orderBy("v").collect()
    bins = [r.b for r in got]
    assert bins == sorted(bins)
    assert all(r.b == r.v for r in got if abs(r.v) < 1 << 16)


def test_quantiles_need_no_range_sort_and_write_nothing(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    q = exact_quantiles(df, ["g"], "v", ["0.5"], value_type="decimal(12,0)")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "FileScan" not in plan
