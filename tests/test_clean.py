"""Cleaning rules and the CSV source (FIXTURES.md section 4 edge cases)."""

import pytest

from decimal import Decimal

from tillroll.plans.clean import cancellations, valid_sales
from tillroll.sources.files import name_columns, read_raw_csv, read_raw_parquet, write_raw_parquet, write_result_csv


def test_invoice_prefix_is_case_sensitive_and_null_is_neither(raw_of):
    raw = raw_of(
        [
            ("C1", "A", "X", -1, "2011-01-01", 1.0, "1", "UK"),
            ("c1", "A", "X", 1, "2011-01-01", 1.0, "1", "UK"),
            (None, "A", "X", 1, "2011-01-01", 1.0, "1", "UK"),
        ]
    )
    assert [r.invoice_no for r in cancellations(raw).collect()] == ["C1"]
    assert [r.invoice_no for r in valid_sales(raw).collect()] == ["c1"]


def test_null_customer_and_write_off(raw_of):
    raw = raw_of(
        [
            ("1", "A", " Mug ", 2, "2011-01-01 10:00", 1.25, None, "UK"),
            ("2", "A", "Mug", -5, "2011-01-01 10:00", 1.25, "7", "UK"),
            ("3", "A", None, 1, "2011-01-01 10:00", 1.25, "7", "UK"),
        ]
    )
    assert valid_sales(raw).count() == 0
    assert cancellations(raw).count() == 0
    loose = valid_sales(raw, require_customer=False).collect()
    assert [(r.invoice_no, r.product_name, r.sales_value) for r in loose] == [("1", "Mug", Decimal("2.50"))]


def test_sales_columns_and_rounding(raw_of):
    raw = raw_of([("9", "A", "Bowl", 3, "2011-02-15 23:59", 0.35, "5", "UK")])
    r = valid_sales(raw).first()
    assert r.sales_value == Decimal("1.05")
    assert str(r.order_month) == "2011-02-01" and str(r.order_date) == "2011-02-15"


def test_cancellation_value_is_absolute_and_unfiltered(raw_of):
    raw = raw_of([("C9", "A", None, -3, "2011-02-15", 0.35, None, "UK")])
    r = cancellations(raw).first()
    assert r.cancellation_value == Decimal("1.05") and r.product_name is None


def test_csv_reader_quotes_prices_and_empties(spark, tmp_path):
    text = (
        "invoice_no,stock_code,description,quantity,invoice_date,unit_price,customer_id,country\n"
        '1,A,"PAPER CRAFT , LITTLE BIRDIE",2,2011-12-09 09:15,0.001,17850.0,United Kingdom\n'
        '2,B,"say ""hi""",1,2011-12-09 09:27,0.005,17850.0,United Kingdom\n'
        "3,C,,1,2011-12-09 09:30,1.00,,United Kingdom\n"
    )
    p = tmp_path / "raw.csv"
    p.write_text(text, encoding="utf-8")
    rows = read_raw_csv(spark, str(p)).orderBy("invoice_no").collect()
    assert rows[0].description == "PAPER CRAFT , LITTLE BIRDIE"
    assert rows[0].unit_price == Decimal("0.00") and rows[1].unit_price == Decimal("0.01")
    assert rows[1].description == 'say "hi"'
    assert rows[2].description is None and rows[2].customer_id is None
    assert rows[0].customer_id == "17850.0" and rows[0].country == "United Kingdom"
    assert str(rows[0].invoice_date) == "2011-12-09 09:15:00"


def test_name_columns_and_result_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7, 8)]).toDF(*[f"c{i}" for i in range(8)])
    assert name_columns(df).columns[0] == "invoice_no"
    out = tmp_path / "out"
    write_result_csv(df, str(out), single_file_rows=10)
    files = [f for f in out.iterdir() if f.name.endswith(".csv")]
    assert len(files) == 1 and files[0].read_text().startswith("c0,c1")


def test_one_file_needs_few_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="more than 3 rows"):
        write_result_csv(spark.range(9), str(tmp_path / "x"), single_file_rows=3)
    write_result_csv(spark.range(9).repartition(3), str(tmp_path / "y"))
    assert len([f for f in (tmp_path / "y").iterdir() if f.name.endswith(".csv")]) == 3


def test_date_bounds_prune_months(spark, raw_of, tmp_path):
    rows = [(str(i), "A", "Mug", 1, f"2011-{m:02d}-{d:02d} 10:30", 1.0, "7", "UK") for i, (m, d) in enumerate([(1, 5), (1, 31), (2, 1), (2, 28), (3, 1)])]
    path = str(tmp_path / "raw")
    write_raw_parquet(raw_of(rows), path)
    got = read_raw_parquet(spark, path, start="2011-01-31", end="2011-02-28")
    assert sorted(r.invoice_no for r in got.collect()) == ["1", "2", "3"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(invoice_month" in plan
    assert read_raw_parquet(spark, path).count() == 5
