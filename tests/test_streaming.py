"""The streaming ingest applies the batch cleaning rules to arriving files."""

from tests.conftest import raw_rows
from tillroll.plans.clean import cancellations, valid_sales
from tillroll.streaming.ingest import start_clean_ingest


def test_stream_ingest_equals_batch_cleaning(spark, tmp_path):
    rows = [
        ("1", "A", "Mug", 2, "2011-01-01 10:00", 1.25, "7", "UK"),
        ("C2", "A", "Mug", -1, "2011-01-02 10:00", 1.25, "7", "UK"),
        ("3", "B", None, 1, "2011-02-01 10:00", 3.00, "8", "FR"),
        ("4", "B", "Bowl", 1, "2011-02-03 10:00", 3.00, "8", "FR"),
    ]
    raw = raw_rows(spark, rows)
    flat = tmp_path / "drop"  # a drop folder holding several arriving files
    raw.repartition(2).write.parquet(str(flat))
    qs = start_clean_ingest(
        spark, str(flat), str(tmp_path / "sales"), str(tmp_path / "cancels"), fmt="parquet",
        checkpoint_root=str(tmp_path / "ckpt"), bad_out=str(tmp_path / "bad"), available_now=True,
    )
    for q in qs:
        q.awaitTermination(120)
    got_sales = spark.read.parquet(str(tmp_path / "sales"))
    got_cancels = spark.read.parquet(str(tmp_path / "cancels"))
    cols = ["invoice_no", "sales_value", "order_date"]
    assert sorted(map(tuple, got_sales.select(*cols).collect())) == sorted(
        map(tuple, valid_sales(raw).select(*cols).collect())
    )
    assert [r.invoice_no for r in got_cancels.collect()] == [r.invoice_no for r in cancellations(raw).collect()]


def test_lines_that_cannot_be_read_are_kept_apart(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    head = "invoice_no,stock_code,description,quantity,invoice_date,unit_price,customer_id,country\n"
    good, odd = "1,A,Mug,2,2011-01-01 10:00,1.25,7,UK\n", ['2,A,Mug,"1,200",2011-01-01 10:00,1.25,7,UK', "3,A,Mug,2,sometime,1.25,7,UK"]
    (drop / "a.csv").write_text(head + good + "\n".join(odd) + "\n")
    out = {n: str(tmp_path / n) for n in ("sales", "cancels", "bad")}
    for q in start_clean_ingest(spark, str(drop), out["sales"], out["cancels"], str(tmp_path / "ckpt"), out["bad"], available_now=True):
        q.awaitTermination(120)
    assert [r.invoice_no for r in spark.read.parquet(out["sales"]).collect()] == ["1"]
    assert sorted(r.bad_record for r in spark.read.parquet(out["bad"]).collect()) == sorted(odd)
