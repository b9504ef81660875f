"""Exact PERCENTILE_CONT at scale.

Spark's ``percentile`` aggregate keeps a value -> count map in one buffer per
group: right for small groups (a customer's day gaps), wrong for "median spend
over every customer" at cluster scale, where one task would hold the whole map.

``exact_quantiles`` selects by digit histograms, with two bounded aggregates:

1. A value, as a whole number of its smallest units, falls into the *bin* of its
   leading binary digits (``bin_of``; small numbers have a bin each).  Rows are
   counted per (group, bin): partial sums in the tasks, and under ``2 ** 16`` bins
   for every four digits of length.  Running counts over this table give, per
   group, n and the bins that hold the closest ranks of each probability.
2. These bins, at most two a probability and group, are broadcast, and the rows
   in them are counted per value.  Running counts in a bin give the values at
   ranks floor(pos) and ceil(pos), pos = (n - 1) * p in exact decimal arithmetic.

Result = lo + (hi - lo) * (pos - floor(pos)), still exact decimal: linear
interpolation between closest ranks, the SQL PERCENTILE_CONT definition.
Callers round half away from zero.  No row is sorted or written; the input is
read twice, from the exchange it comes from.

For groups whose number grows with the data (``few_groups=False``) the bins
could not be broadcast: there (group, value) pairs are ranked over range
partitions (``global_rank``) and the sizes of groups meet them salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.ranking import global_rank

LEADING_BITS, STEP_BITS = 16, 4
_UPTO = Window.unboundedPreceding, Window.currentRow


def _p_name(p: str) -> str:
    return "p_" + p.replace(".", "_")


def _scale_of(value_type: str) -> int:
    return int(value_type.rstrip(") ").split(",")[1])


def bin_of(v: Column) -> Column:
    """The leading digits of a whole number, as a number in the same order; numbers under 2 ** 16 are their own bin."""
    size, dropped = F.abs(v), F.lit(0)
    for digits in range(STEP_BITS, 64 - LEADING_BITS + 1, STEP_BITS):
        dropped = F.when(size >= F.lit(1 << (LEADING_BITS + digits - STEP_BITS)), F.lit(digits)).otherwise(dropped)
    # Longer numbers come after shorter ones, and numbers of one length by their leading digits.
    return F.signum(v).cast("long") * (dropped * F.lit(1 << LEADING_BITS) + F.call_function("shiftright", size, dropped))


def exact_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Sequence[str],
    value_type: str = "decimal(20,2)",
    num_partitions: int | None = None,
    few_groups: bool = True,
) -> DataFrame:
    """One row per group with n and a column ``p_0_5`` (etc.) per probability; a NULL group is a group.

    ``few_groups=False`` is for groups whose number grows with the data.

    ``probs`` are decimal strings ("0.5", "0.9") so positions are exact.
    NULL values are ignored, as by the SQL aggregate.
    """
    group_cols = list(group_cols)
    units = (F.col(value_col).cast(value_type) * F.lit(10 ** _scale_of(value_type))).cast("long")
    vals = df.where(F.col(value_col).isNotNull()).select(*group_cols, units.alias("__v"))
    placed = (
        _in_bins(vals, group_cols, probs) if few_groups else _in_ranges(vals, group_cols, num_partitions)
    )
    return _picked(placed, group_cols, probs, value_type)


def _positions(probs: Sequence[str]) -> list[tuple[Column, Column, Column]]:
    """(floor, ceiling, fraction) of each probability's position among ``__n`` rows."""
    out = []
    for p in probs:
        pos = (F.col("__n") - 1).cast("decimal(20,0)") * F.lit(Decimal(p))
        out.append((F.floor(pos), F.ceil(pos), pos - F.floor(pos)))
    return out


def _in_bins(vals: DataFrame, group_cols: list[str], probs: Sequence[str]) -> DataFrame:
    """(group, __v, __cnt, __first, __n) of the values in the bins of the wanted ranks; __first counts from 0."""
    binned = vals.withColumn("__bin", bin_of(F.col("__v")))
    counts = binned.groupBy(*group_cols, "__bin").agg(F.count(F.lit(1)).alias("__cnt"))
    upto = Window.partitionBy(*group_cols).orderBy("__bin").rowsBetween(*_UPTO)
    counts = counts.withColumn("__end", F.sum("__cnt").over(upto)).withColumn(
        "__n", F.sum("__cnt").over(Window.partitionBy(*group_cols))
    )
    holds = lambda k: (F.col("__end") - F.col("__cnt") <= k) & (k < F.col("__end"))
    wanted = F.lit(False)
    for low, high, _ in _positions(probs):
        wanted = wanted | holds(low) | holds(high)
    bins = counts.where(wanted).select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group_cols)],
        F.col("__bin").alias("__b"), (F.col("__end") - F.col("__cnt")).alias("__before"), "__n",
    )
    same = [F.col("__bin") == F.col("__b"), *[F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group_cols)]]
    exact = (
        binned.join(F.broadcast(bins), same)
        .groupBy(*group_cols, "__bin", "__before", "__n", "__v")
        .agg(F.count(F.lit(1)).alias("__cnt"))
    )
    within = Window.partitionBy(*group_cols, "__bin").orderBy("__v").rowsBetween(*_UPTO)
    return exact.withColumn("__first", F.col("__before") + F.sum("__cnt").over(within) - F.col("__cnt"))


def _in_ranges(vals: DataFrame, group_cols: list[str], num_partitions: int | None) -> DataFrame:
    """The same of all values, ranked over range partitions."""
    counted = vals.groupBy(*group_cols, "__v").agg(F.count(F.lit(1)).alias("__cnt"))
    order = [F.col(g).asc_nulls_first() for g in group_cols] + [F.col("__v").asc()]
    ranked = global_rank(counted, order, running={"__cum": F.col("__cnt")}, num_partitions=num_partitions)
    sizes = ranked.groupBy(*group_cols).agg(
        F.sum("__cnt").alias("__n"), F.min(F.col("__cum") - F.col("__cnt")).alias("__start")
    )
    return _with_sizes(ranked, sizes, group_cols).withColumn(
        "__first", F.col("__cum") - F.col("__cnt") - F.col("__start")
    )


def _picked(placed: DataFrame, group_cols: list[str], probs: Sequence[str], value_type: str) -> DataFrame:
    value = (F.col("__v").cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-_scale_of(value_type)))).cast(value_type)
    covers = lambda k: (F.col("__first") <= k) & (k < F.col("__first") + F.col("__cnt"))
    aggs = []
    for p, (low, high, fraction) in zip(probs, _positions(probs)):
        name = _p_name(p)
        aggs += [
            F.max(F.when(covers(low), value)).alias(f"{name}__lo"),
            F.max(F.when(covers(high), value)).alias(f"{name}__hi"),
            F.max(fraction).alias(f"{name}__f"),
        ]
    picked = placed.groupBy(*group_cols).agg(F.max("__n").alias("n"), *aggs)
    out = []
    for p in probs:
        name = _p_name(p)
        lo, hi, fr = F.col(f"{name}__lo"), F.col(f"{name}__hi"), F.col(f"{name}__f")
        out.append((lo + (hi - lo) * fr).alias(name))
    return picked.select(*group_cols, "n", *out)


def _with_sizes(ranked: DataFrame, sizes: DataFrame, group_cols: list[str]) -> DataFrame:
    if not group_cols:
        return ranked.crossJoin(F.broadcast(sizes))
    right = sizes.withColumnsRenamed({g: f"__g{i}" for i, g in enumerate(group_cols)})
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group_cols)]
    drop = [f"__g{i}" for i in range(len(group_cols))]
    salts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    left = ranked.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*same, F.col("__salt") == F.col("__salt_r")]).drop(*drop, "__salt", "__salt_r")


def column_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_cols: Sequence[str],
    probs: Sequence[str],
    value_type: str = "decimal(20,2)",
    num_partitions: int | None = None,
) -> DataFrame:
    """Exact quantiles of several columns in one selection.

    The columns are stacked as (group..., column name, value) -- at most
    ``len(value_cols)`` rows per input row -- so the same two aggregates
    serve all of them.  Output: one row per group with
    ``<column>__p_<p>`` columns.
    """
    group_cols = list(group_cols)
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast(value_type).alias("v")) for c in value_cols])
    stacked = df.select(*group_cols, F.explode(cells).alias("__s")).select(
        *group_cols, F.col("__s.c").alias("__col"), F.col("__s.v").alias("__val")
    )
    q = exact_quantiles(stacked, group_cols + ["__col"], "__val", probs, value_type, num_partitions)
    picks = [
        F.max(F.when(F.col("__col") == c, F.col(_p_name(p)))).alias(f"{c}__{_p_name(p)}")
        for c in value_cols
        for p in probs
    ]
    return q.groupBy(*group_cols).agg(*picks) if group_cols else q.agg(*picks)
