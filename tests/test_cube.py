"""Mergeable distinct counts against counting the lines."""

import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators.cube import Cube, build_cube

DIMS = ["m", "c"]


@pytest.fixture(scope="module")
def lines(spark):
    """A third of all lines are one customer's; invoices over several cells; null things and dimensions."""
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        cust = 0 if i % 3 == 0 else rng.choice([None, *range(1, 900)])
        rows.append((f"i{rng.randint(0, 2500)}", cust, rng.randint(1, 12), rng.choice(["x", "y", "z", None]), rng.randint(1, 9)))
    return spark.createDataFrame(rows, "inv string, cust long, m int, c string, q int").repartition(5)


@pytest.fixture(scope="module")
def cube(lines):
    return build_cube(lines, DIMS, {"orders": "inv", "customers": "cust"}, {"items": "q"})


def counted(lines, by, where):
    out = lines.where(where).groupBy(*by).agg(
        F.sum("q").alias("items"), F.countDistinct("inv").alias("orders"), F.countDistinct("cust").alias("customers"))
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("by", [[], ["m"], ["c"], ["c", "m"]])
@pytest.mark.parametrize("where", ["true", "m BETWEEN 3 AND 7", "c IN ('x', 'z')", "c IS NULL AND m > 4"])
def test_any_grouping_and_filter(lines, cube, by, where):
    assert sorted(map(tuple, cube.ask(by, F.expr(where)).collect()), key=str) == counted(lines, by, where)


def test_answers_read_the_stored_blocks_only(cube):
    plan = cube.ask(["m"])._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and all("bits" in x or "items" in x for x in scans) and "Expand" not in plan
    with pytest.raises(ValueError, match="no \\['day'\\]"):
        cube.ask(["day"])


def test_numbers_are_dense_over_several_blocks(spark):
    lines = spark.range(70000).select(F.col("id").cast("string").alias("inv"), (F.col("id") % 7).cast("int").alias("m"), F.lit("x").alias("c"), F.lit(1).alias("q"))
    cube = build_cube(lines, DIMS, {"orders": "inv"}, {"items": "q"})
    assert cube.blocks.agg(F.max("block"), F.sum(F.bitmap_count("bits"))).first() == (3, 70000)
    # Numbers go by the first cell, so a cell has the fewest blocks it can have, or one more.
    assert cube.blocks.groupBy("m").count().agg(F.max("count")).first()[0] <= 2
    assert {tuple(r) for r in cube.ask(["m"]).collect()} == {(m, 10000, 10000) for m in range(7)}


def test_empty_and_reloaded(spark, lines, cube, tmp_path):
    none = build_cube(lines.limit(0), DIMS, {"orders": "inv"}, {"items": "q"})
    assert none.ask(["m"]).count() == 0 and tuple(none.ask().first()) == (None, 0)
    cube.save(str(tmp_path / "cube"))
    again = Cube.load(spark, str(tmp_path / "cube"), cube.dims, cube.sums, cube.things)
    assert sorted(map(tuple, again.ask(["c"]).collect()), key=str) == counted(lines, ["c"], "true")
