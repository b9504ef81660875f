"""A batch load that survives bad lines: every line is loaded or kept apart."""

import pytest

from tillroll.sources.files import load_raw_csv, read_raw_csv_apart, read_raw_parquet

HEAD = "invoice_no,stock_code,description,quantity,invoice_date,unit_price,customer_id,country"
GOOD = ['1,A,"Mug, ""big""",2,2011-01-01 10:00,1.25,7,UK', "2,B,,1,2011-02-01 10:00:30,0.005,,FR", "C3,B,Bowl,-1,2011-02-03 10:00,3.00,8,FR"]
BAD = ['4,A,Mug,"1,200",2011-01-01 10:00,1.25,7,UK', "5,A,Mug,2,sometime,1.25,7,UK", "6,A,Mug,2,2011-01-01 10:00,cheap,7,UK", "7,A,Mug"]


@pytest.fixture
def files(tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.csv").write_text("\n".join([HEAD, GOOD[0], BAD[0], GOOD[1], BAD[1]]) + "\n")
    (drop / "b.csv").write_text("\n".join([HEAD, BAD[2], BAD[3], GOOD[2]]) + "\n")
    return str(drop)


def test_good_and_bad_lines(spark, files):
    good, bad = read_raw_csv_apart(spark, files)
    assert sorted(r.invoice_no for r in good.collect()) == ["1", "2", "C3"]
    assert sorted(r.bad_record for r in bad.collect()) == sorted(BAD)
    # Whatever columns are asked for, the same lines are good.
    assert good.count() == 3 and bad.count() == 4
    assert sorted(r[0] for r in good.select("country").collect()) == ["FR", "FR", "UK"]
    one = {r.invoice_no: r for r in good.collect()}
    assert one["1"].description == 'Mug, "big"' and str(one["2"].unit_price) == "0.01" and one["2"].customer_id is None


def test_load_writes_both_and_counts(spark, files, tmp_path):
    raw, bad = str(tmp_path / "raw"), str(tmp_path / "bad")
    assert load_raw_csv(spark, files, raw, bad) == (3, 4)
    assert read_raw_parquet(spark, raw).count() == 3 and spark.read.parquet(bad).count() == 4
    with pytest.raises(ValueError, match="4 lines"):
        load_raw_csv(spark, files, str(tmp_path / "other"), bad, most_bad=3)
    assert not (tmp_path / "other").exists()
    assert load_raw_csv(spark, files, raw, bad, most_bad=4) == (3, 4)
