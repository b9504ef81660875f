"""A hot key holding a third of all rows: results stay whole and the ranked
work stays spread over ranges."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.conftest import raw_rows
from tillroll.operators.grain import invoice_grain
from tillroll.operators.quantiles import exact_quantiles
from tillroll.operators.ranking import global_rank
from tillroll.plans.cadence import customer_cadence
from tillroll.plans.clean import valid_sales


def test_hot_group_is_split_across_ranges(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 50}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v long")
    ranked = global_rank(df, [F.col("g").asc(), F.col("v").asc()], num_partitions=8)
    hot_ranges = ranked.where(F.col("g") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot_ranges >= 2
    assert sorted(r.rn for r in ranked.select("rn").collect()) == list(range(1, 9001))
    q = exact_quantiles(df, ["g"], "v", ["0.5"], value_type="decimal(12,0)", num_partitions=8)
    assert float(q.where(F.col("g") == "hot").first().p_0_5) == 1499.5


def test_hot_customer_results_are_whole(spark):
    rnd = random.Random(1)
    base = dt.datetime(2011, 1, 1, 9, 0)
    rows = []
    for i in range(1200):  # the hot customer: a third of all lines, 40 purchase days
        rows.append((f"h{i // 10}", "P", "Thing", 1, base + dt.timedelta(days=(i // 30)), 2.00, "hot", "UK"))
    for i in range(2400):
        cust = f"c{i % 200}"
        rows.append((f"o{i}", "P", "Thing", 1, base + dt.timedelta(days=rnd.randint(0, 60)), 1.00, cust, "UK"))
    raw = raw_rows(spark, rows)
    cad = {r.customer_id: r for r in customer_cadence(invoice_grain(valid_sales(raw))).collect()}
    hot = cad["hot"]
    assert hot.purchase_occasions == 40 and hot.total_invoices == 120 and str(hot.total_spend) == "2400.00"
    assert hot.gap_count == 39 and float(hot.median_gap_days) == 1.0
    assert len(cad) == 201
