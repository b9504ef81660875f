from tests.conftest import SF_SMALL
from tillroll.llm import rollup
from tillroll.storage import fresh_path


def rows(df):
    return sorted(map(tuple, df.select(*rollup.KEYS, *rollup.SUMS).collect()), key=str)


def test_signed_changes_and_replays(spark):
    r = rollup.Rollup(spark, fresh_path(spark, "t"))
    assert rows(r.totals()) == []
    changes = lambda x: spark.createDataFrame(x, rollup.CHANGE)
    first = changes([("a", "en", "v1", None, 10), ("a", "en", "v1", None, 5), (None, None, "v1", None, 1)])
    assert r.commit("1", first) and not r.commit("1", first)
    assert r.commit("2", changes([("a", "en", "v1", 10, 12), ("a", "en", "v1", 5, None), ("a", "en", "v2", None, 7)]))
    expected = [("a", "en", "v1", 1, 12, 2, 1, 1), ("a", "en", "v2", 1, 7, 1, 0, 0), (None, None, "v1", 1, 1, 1, 0, 0)]
    assert rows(r.totals()) == sorted(expected, key=str)
    assert r.commit("3", changes([])) and r.compact("4") and not r.compact("4")
    assert rows(r.totals()) == sorted(expected, key=str)
    assert not r.commit("2", first)  # known although folded
    assert r.committed() == {"4"}


def test_a_broken_off_batch_is_written_anew(spark):
    """Deltas without a log entry don't count, and the retry replaces them."""
    r = rollup.Rollup(spark, fresh_path(spark, "t"))
    batch = spark.createDataFrame([("a", "en", "v1", None, 3)], rollup.CHANGE)
    r.commit("1", batch)
    enter, r._enter = r._enter, lambda *a: None  # the driver is lost before the entry
    r.commit("2", batch)
    assert rows(r.totals()) == [("a", "en", "v1", 1, 3, 1, 0, 0)]
    r._enter = enter
    assert r.commit("2", batch)
    assert rows(r.totals()) == [("a", "en", "v1", 2, 6, 2, 0, 0)]


def test_query_against_sql(spark, duck):
    df = rollup.op4_rollup(spark, SF_SMALL)
    expected = duck.execute(rollup.ORACLE)
    names = [c[0] for c in expected.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(expected.fetchall(), key=str)


def test_empty_and_null_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("none", []), ("odd", [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a| b " * 12, "en", "s", 60)])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = rows(rollup.op4_rollup(spark, f"{tmp_path}/{name}"))
        if not data:
            assert got == []
        else:
            assert ("s", "en", "space-1", 1, 24, 3, 2, 1) in got and (None, None, "alnum-1", 0, 0, 1, 1, 0) in got
