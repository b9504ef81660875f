"""The driver contract and invariants on the star-mapped sample (sf0.001)."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402
from tillroll.relations import Relations  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["order_month", "net_sales", "orders", "customers", "average_order_value"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    missing = set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_JOBS)
    assert missing == set()


def test_every_oracle_is_a_statement():
    assert [key for key, sql in E.oracle_sql().items() if not isinstance(sql, str)] == []


def test_mapping_keeps_every_line(spark):
    r = Relations.from_star(spark, SF_SMALL)
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert r.raw.where("invoice_no NOT LIKE 'C%'").count() == lines
    counts = {x.customer_segment for x in r.segments.select("customer_segment").distinct().collect()}
    assert len(counts) == 5
    # Reversals on the day of the sale occur on both sides of its time.
    day = r.sales.alias("s").join(r.cancels.alias("c"), F.expr(
        "s.customer_id = c.customer_id AND s.stock_code = c.stock_code AND s.unit_price = c.unit_price "
        "AND s.quantity = -c.quantity AND s.order_date = to_date(c.invoice_date)"))
    assert {x[0] for x in day.select(F.expr("c.invoice_date >= s.invoice_date")).distinct().collect()} == {True, False}


def test_two_relations_can_both_materialise(spark):
    a, b = (Relations.from_star(spark, SF_SMALL).materialise() for _ in range(2))
    assert a.net.count() == b.net.count()


def test_invariants(spark):
    r = Relations.from_star(spark, SF_SMALL)
    sales_n, net_n = r.sales.count(), r.net.count()
    assert r.net.exceptAll(r.sales).count() == 0
    from tillroll.operators.reversal import reversed_sales

    assert reversed_sales(r.sales, r.cancels).count() + net_n == sales_n
    seg = r.profile.groupBy("customer_segment").count().agg(F.sum("count")).first()[0]
    assert seg == r.sales.select("customer_id").distinct().count()
    quint = {row.spend_quintile: row["count"] for row in r.profile.groupBy("spend_quintile").count().collect()}
    assert sorted(quint) == [1, 2, 3, 4, 5] and max(quint.values()) - min(quint.values()) <= 1


@pytest.mark.parametrize("key", sorted(set(E.oracle_sql()) - set(E.LLM_JOBS)))
def test_query_matches_duckdb_oracle(spark, key):
    from tools.oracle_check import close, duck, rows_of, type_diffs

    df = E.queries()[key](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(x) for x in df.collect()]
    rel = duck(SF_SMALL).sql(E.oracle_sql()[key])
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(list(rel.columns), rel.fetchall())
    assert sc == dc
    assert type_diffs(df, rel) == []
    assert len(sr) == len(dr)
    for x, y in zip(sr, dr):
        assert all(close(a, b) for a, b in zip(x, y)), (x, y)


def test_materialise_writes_net_once_and_reads_it_back(spark, tmp_path):
    r = Relations.from_star(spark, SF_SMALL)
    before = r.net.agg(F.count(F.lit(1)), F.sum("sales_value")).first()
    r.materialise(str(tmp_path / "net"))
    plan = r.net._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "lineitem" not in plan
    after = r.net.agg(F.count(F.lit(1)), F.sum("sales_value")).first()
    assert tuple(before) == tuple(after)
    assert r.cadence_net.count() == r.first_second.count() == r.net.select("customer_id").distinct().count()


def _net_sales(spark, key):
    return [r.asDict() for r in E.queries()[key](spark, SF_SMALL).collect()]


def test_outputs_agree_with_each_other(spark):
    """Growth follows from the trend; months, countries and segments each sum to the headline."""
    total = _net_sales(spark, "sales_overall_kpis")[0]["net_sales"]
    months = sorted(_net_sales(spark, "sales_monthly_trend"), key=lambda r: r["order_month"])
    growth = {r["order_month"]: r for r in _net_sales(spark, "sales_mom_growth")}
    for a, b in zip(months, months[1:]):
        assert growth[b["order_month"]]["month_on_month_change"] == pytest.approx(b["net_sales"] - a["net_sales"], abs=0.005)
    assert sum(r["net_sales"] for r in months) == pytest.approx(total, abs=0.005)
    assert sum(r["net_sales"] for r in _net_sales(spark, "sales_by_country")) == pytest.approx(total, abs=0.005)
    assert sum(r["total_sales"] for r in _net_sales(spark, "segment_summary")) == pytest.approx(total, abs=0.005)
    cancelled = sum(r["m_cancelled_value"] for r in _net_sales(spark, "m_cancellations_by_month"))
    assert cancelled == pytest.approx(_net_sales(spark, "cancellation_kpis")[0]["cancellation_value"], abs=0.005)


def test_the_rest_works_without_the_operators(tmp_path):
    """On a copy without the optional folder (and with or without its pipeline) all reports are listed."""
    import shutil
    import subprocess

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/tillroll", tmp_path / "tillroll", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    listed = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), E.LLM_JOBS)"
    want = len(set(E.queries()) - set(E.LLM_JOBS))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if not os.path.exists(f"{here}/{name}"):
            continue
        shutil.copy(f"{here}/{name}", tmp_path / name)
        out = subprocess.run([sys.executable, "-c", listed], cwd=tmp_path, capture_output=True, text=True, check=True)
        assert out.stdout.split("\n")[0] == f"{want} {want} {{}}"
