"""The reversal rule: which sales a cancellation takes out of net sales."""

import pytest

from tillroll.operators.reversal import (
    MATCH_KEYS, Reversals, key_sketch, may_hold, reversal_delay, reversed_sales, unmatched_cancellations, valid_sales_net,
)
from tillroll.plans.clean import cancellations, valid_sales


def _net_and_reversed(raw):
    s, c = valid_sales(raw), cancellations(raw)
    net = sorted(r.invoice_no for r in valid_sales_net(s, c).collect())
    rev = sorted(r.invoice_no for r in reversed_sales(s, c).collect())
    return net, rev


def test_exact_cancel_twelve_minutes_later(raw_of):
    raw = raw_of(
        [
            ("581483", "P", "Craft", 80995, "2011-12-09 09:15", 2.08, "16446", "UK"),
            ("C581484", "P", "Craft", -80995, "2011-12-09 09:27", 2.08, "16446", "UK"),
            ("581485", "Q", "Cup", 1, "2011-12-09 09:30", 2.90, "16446", "UK"),
        ]
    )
    assert _net_and_reversed(raw) == (["581485"], ["581483"])
    d = reversal_delay(valid_sales(raw), cancellations(raw)).collect()
    assert [(r.invoice_no, r.minutes_to_reversal) for r in d] == [("581483", 12)]


def test_non_matches_stay(raw_of):
    raw = raw_of(
        [
            ("1", "P", "X", 4, "2011-01-10", 1.00, "7", "UK"),
            ("C0", "P", "X", -4, "2011-01-09", 1.00, "7", "UK"),  # earlier than the sale
            ("2", "P", "X", 4, "2011-01-10", 2.00, "8", "UK"),
            ("C2", "P", "X", -4, "2011-01-11", 2.50, "8", "UK"),  # other price
            ("3", "P", "X", 4, "2011-01-10", 1.00, "9", "UK"),
            ("C3", "P", "X", -2, "2011-01-11", 1.00, "9", "UK"),  # half the quantity
            ("4", "P", "X", 4, "2011-01-10", 1.00, "10", "UK"),
            ("C4", "P", "X", -4, "2011-01-11", 1.00, None, "UK"),  # no customer: matches nothing
        ]
    )
    assert _net_and_reversed(raw) == (["1", "2", "3", "4"], [])
    un = unmatched_cancellations(valid_sales(raw), cancellations(raw)).collect()
    assert sorted(r.invoice_no for r in un) == ["C0", "C2", "C3"]


def test_one_cancel_removes_every_equal_earlier_sale_and_two_cancels_count_once(raw_of):
    raw = raw_of(
        [
            ("1", "P", "X", 3, "2011-01-10", 1.00, "7", "UK"),
            ("2", "P", "X", 3, "2011-01-11", 1.00, "7", "UK"),
            ("C3", "P", "X", -3, "2011-01-12", 1.00, "7", "UK"),
            ("5", "Q", "Y", 1, "2011-01-10", 5.00, "8", "UK"),
            ("C6", "Q", "Y", -1, "2011-01-11", 5.00, "8", "UK"),
            ("C7", "Q", "Y", -1, "2011-01-12", 5.00, "8", "UK"),
        ]
    )
    net, rev = _net_and_reversed(raw)
    assert net == [] and rev == ["1", "2", "5"]


def test_fully_reversed_customer_leaves_the_net_basis(raw_of):
    from tillroll.plans.concentration import published_vs_corrected

    raw = raw_of(
        [
            ("1", "P", "X", 1, "2011-01-10", 1.00, "7", "UK"),
            ("C1", "P", "X", -1, "2011-01-10", 1.00, "7", "UK"),
            ("2", "P", "X", 1, "2011-01-10", 1.00, "8", "UK"),
        ]
    )
    s, c = valid_sales(raw), cancellations(raw)
    rows = {r.basis: r for r in published_vs_corrected(s, valid_sales_net(s, c)).collect()}
    assert rows["As published (vw_valid_sales)"].customers == 2 and rows["Corrected (vw_valid_sales_net)"].customers == 1


def test_reversal_delay_matches_pairwise_brute_force(raw_of):
    import datetime as dt
    import random

    rnd = random.Random(5)
    rows, base = [], dt.datetime(2011, 3, 1, 8, 0)
    for i in range(300):
        key = rnd.choice(["P", "Q"])
        t = base + dt.timedelta(days=rnd.randint(0, 3), minutes=rnd.randint(0, 600))
        qty = rnd.choice([1, 2])
        inv = f"{'C' if rnd.random() < 0.3 else ''}{i}"
        rows.append((inv, key, "X", -qty if inv.startswith("C") else qty, t, 1.50, rnd.choice(["7", "8"]), "UK"))
    raw = raw_of(rows)
    s, c = valid_sales(raw), cancellations(raw)
    got = {(r.invoice_no, r.stock_code, r.customer_id): r.minutes_to_reversal for r in reversal_delay(s, c).collect()}
    want = {}
    sales_rows = [r for r in rows if not r[0].startswith("C")]
    cancel_rows = [r for r in rows if r[0].startswith("C")]
    for inv, key, _, q, t, _, cust, _ in sales_rows:
        later = [ct for cinv, ck, _, cq, ct, _, cc, _ in cancel_rows if ck == key and cc == cust and -cq == q and ct >= t]
        if later:
            want[(inv, key, cust)] = int((min(later) - t).total_seconds() // 60)
    assert got == want


def test_reversal_delay_ignores_the_session_time_zone(spark, raw_of):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")  # clocks go forward at 01:00 that night
    try:
        raw = raw_of(
            [
                ("1", "P", "X", 1, "2011-03-27 00:30", 1.00, "7", "UK"),
                ("C1", "P", "X", -1, "2011-03-27 02:30", 1.00, "7", "UK"),
            ]
        )
        rows = reversal_delay(valid_sales(raw), cancellations(raw)).collect()
        assert [r.minutes_to_reversal for r in rows] == [120]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def _lines(n=4000, seed=11):
    """Sales of which every tenth is reversed, one key with a third of all lines, and cancels that match nothing."""
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cust, stock, qty = ("hot", "H", 1) if i % 3 == 0 else (f"c{rng.randint(0, 400)}", f"p{rng.randint(0, 60)}", rng.randint(1, 5))
        day = f"2011-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(8, 19):02d}:30"
        rows.append((f"{i // 4}", stock, "X", qty, day, 1.25, cust, "UK"))
        if i % 10 == 1:
            back = f"2011-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} 12:00"
            rows.append((f"C{i}", stock, "X", -qty, back, 1.25, cust, "UK"))
    rows += [(f"C9{i}", f"z{i}", "X", -1, "2011-12-01", 9.99, f"n{i}", "UK") for i in range(50)]
    return rows


@pytest.mark.parametrize("bounds, way", [((10**6, 8), "broadcast"), ((0, 8), "sketch"), ((0, 0), "join")])
def test_every_way_to_the_index_gives_the_same_rows(spark, raw_of, bounds, way):
    """Also against plain Python, with a key that holds a third of all lines."""
    from decimal import Decimal

    rows = _lines()
    raw = raw_of(rows).repartition(5)
    s, c = valid_sales(raw), cancellations(raw)
    r = Reversals(c, *bounds)
    assert r.way == way
    key = lambda x: (x[6], x[1], x[5], abs(x[3]))
    latest = {}
    for x in rows:
        if x[0].startswith("C"):
            latest[key(x)] = max(latest.get(key(x), ""), x[4] if len(x[4]) > 10 else x[4] + " 00:00")
    sales = [x for x in rows if not x[0].startswith("C")]
    gone = [x for x in sales if latest.get(key(x), "") >= x[4]]
    kept = [x for x in sales if latest.get(key(x), "") < x[4]]
    assert sorted(x.invoice_no for x in r.flag(s).where("is_reversed").collect()) == sorted(x[0] for x in gone)
    assert sorted(x.invoice_no for x in valid_sales_net(s, r).collect()) == sorted(x[0] for x in kept)
    grain = {}
    for x in kept:
        items, value = grain.get((x[6], x[4][:10], x[0]), (0, Decimal(0)))
        grain[x[6], x[4][:10], x[0]] = items + x[3], value + Decimal(str(x[5])) * x[3]
    got = {(g.customer_id, str(g.order_date), g.invoice_no): (g["items"], g["value"]) for g in r.net_grain(s).collect()}
    assert got == grain


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_candidates_are_shuffled_to_the_index(spark, raw_of):
    """With broadcast joins off, the join's exchange carries what the sketch lets through; the sketch is still broadcast."""
    raw = raw_of(_lines()).repartition(5)
    s, c = valid_sales(raw), cancellations(raw)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = Reversals(c, 0, 8)
        tested = may_hold(s, r.sketch, MATCH_KEYS, r.buckets, "maybe")
        keys = {tuple(k) for k in r.index.select(*MATCH_KEYS).collect()}
        rows = tested.select(*MATCH_KEYS, "maybe").collect()
        assert all(x.maybe for x in rows if tuple(x[:4]) in keys)
        wrong = sum(x.maybe for x in rows if tuple(x[:4]) not in keys)
        assert wrong <= 0.02 * len(rows)
        plan = r.flag(s)._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):]
        left = join[: join.index("FileScan parquet")]
        assert "__maybe" in left or "BroadcastHashJoin" in left
        assert "SortMergeJoin" not in plan[: plan.index("SortMergeJoin")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_net_grain_scans_and_shuffles_lines_once(spark, raw_of, tmp_path):
    raw_of(_lines()).repartition(5).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    s, c = valid_sales(raw), cancellations(raw)
    plan = _final_plan(Reversals(c, 0, 8).net_grain(s))
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    scans = [x for x in final.splitlines() if "FileScan parquet" in x and "description" in x]
    assert len(scans) == 1 and "ReusedExchange" in final


def test_index_bits_survive_many_keys(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    buckets = 16
    sketch = key_sketch(keys, ["k"], buckets)
    assert sketch.count() <= buckets
    seen = may_hold(spark.range(40000).select(F.col("id").cast("string").alias("k"), "id"), sketch, ["k"], buckets, "maybe")
    assert seen.where("id < 20000 AND NOT maybe").count() == 0
    assert seen.where("id >= 20000 AND maybe").count() < 0.02 * 20000


def test_no_cancellations_reverse_nothing(raw_of):
    raw = raw_of([("1", "P", "X", 1, "2011-01-01", 1.00, "a", "UK")])
    for bounds in ((10, 8), (-1, 8), (-1, 0)):
        r = Reversals(cancellations(raw), *bounds)
        assert valid_sales_net(valid_sales(raw), r).count() == 1
        assert [tuple(x) for x in r.net_grain(valid_sales(raw)).select("customer_id", "items").collect()] == [("a", 1)]
