"""Ranks and running totals of a descending order, without the order.

"Revenue of the top 20 %", "customers that make 80 % of revenue" and the cuts of
NTILE need a few points of a ranked list, not the list.  ``top_points`` finds them
by digit histograms, like ``quantiles``: counts and sums per bin of leading digits
locate the bin of each point (one bounded aggregate), counts per value in these few
bins, broadcast, locate the value (another).  Inside a run of equal values the
running total is linear, so ties need no further order, and nothing is sorted.

``rank_cuts`` goes on where ties must be told apart (NTILE puts tied customers in
order of their id): at a cut that falls inside a run of equal values it selects the
id by its leading characters, a few at a time, again by counting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.quantiles import bin_of

_WIDE = "decimal(38,0)"
#: Leading characters of an id that one counting pass looks at.
PREFIX_STEP = 4


def top_points(values: DataFrame, value: Column, ranks: Sequence[Column | int] = (), shares: Sequence[Column | int] = ()) -> DataFrame:
    """One row: ``n``, ``total`` and, for the i-th of ``ranks`` (from 1, largest value first), ``value_i``,
    ``sum_i`` (total of the values up to it) and ``above_i`` (values larger than it), all null for a rank that
    doesn't exist; and, for the j-th of ``shares`` (percent), ``reach_j``, how many of the largest values make
    at least that share of the total.

    ``value`` is a whole number; ranks may be expressions of ``n`` and ``total``.  Null values take no part.
    """
    ranks = [r if isinstance(r, Column) else F.lit(r) for r in ranks]
    targets = [(s if isinstance(s, Column) else F.lit(s)).cast(_WIDE) * F.col("total") for s in shares]
    vals = values.select(value.cast("long").alias("__v")).where("__v IS NOT NULL").withColumn("__bin", bin_of(F.col("__v")))
    bins = vals.groupBy("__bin").agg(F.count(F.lit(1)).alias("__c"), F.sum(F.col("__v").cast(_WIDE)).alias("__s"))
    down = Window.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.select(
        "__bin", "__c", "__s",
        F.sum("__c").over(down).alias("__c_end"), F.sum("__s").over(down).alias("__s_end"),
        F.sum("__c").over(Window.partitionBy()).alias("n"), F.sum("__s").over(Window.partitionBy()).cast(_WIDE).alias("total"),
    ).withColumns({"__before": F.col("__c_end") - F.col("__c"), "__sum_before": (F.col("__s_end") - F.col("__s")).cast(_WIDE)})

    holds = lambda r: (F.col("__before") < r) & (r <= F.col("__before") + F.col("__c"))
    # The first value is always looked at: it tells n and total, and makes any share that is nothing.
    wanted = F.col("__before") == 0
    for r in ranks:
        wanted = wanted | holds(r)
    for t in targets:
        wanted = wanted | ((F.col("__sum_before") * 100 < t) & (F.col("__s_end") * 100 >= t))
    few = bins.where(wanted).select(F.col("__bin").alias("__b"), F.col("__before").alias("__bin_before"), F.col("__sum_before").alias("__bin_sum"), "n", "total")
    exact = (
        vals.join(F.broadcast(few), F.col("__bin") == F.col("__b"))
        .groupBy("__bin", "__bin_before", "__bin_sum", "n", "total", "__v").agg(F.count(F.lit(1)).alias("__c"))
    )
    within = Window.partitionBy("__bin").orderBy(F.desc("__v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.col("__c").cast(_WIDE) * F.col("__v")
    exact = exact.withColumn("__s", whole.cast(_WIDE)).select(
        "*",
        (F.col("__bin_before") + F.sum("__c").over(within) - F.col("__c")).alias("__before"),
        (F.col("__bin_sum") + F.sum("__s").over(within) - F.col("__s")).cast(_WIDE).alias("__sum_before"),
    )
    out = [F.max("n").alias("n"), F.max("total").alias("total")]
    for i, r in enumerate(ranks):
        at = lambda c: F.max(F.when(holds(r), c))  # noqa: B023,E731
        out += [
            at(F.col("__v")).alias(f"value_{i}"), at(F.col("__before")).alias(f"above_{i}"),
            at(F.col("__sum_before") + (r - F.col("__before")).cast(_WIDE) * F.col("__v")).cast(_WIDE).alias(f"sum_{i}"),
        ]
    for j, t in enumerate(targets):
        missing = t - F.col("__sum_before") * 100
        each = F.col("__v").cast(_WIDE) * 100
        # Whole division upwards, by exact remainders.
        steps = ((missing - missing % each) / each).cast("long") + F.when(missing % each > 0, 1).otherwise(0)
        reached = (missing > 0) & (F.col("__v") > 0) & ((F.col("__sum_before") + F.col("__s")) * 100 >= t)
        nothing = (F.col("__before") == 0) & (missing <= 0)
        out.append(F.min(F.when(reached, F.col("__before") + steps).when(nothing, F.lit(1).cast("long"))).alias(f"reach_{j}"))
    return exact.agg(*out)


@dataclass(frozen=True)
class Cut:
    """The last of the first ``rank`` rows in (value descending, id ascending) order; no ``last_id``: all rows of that value are among them."""

    rank: int
    value: int
    last_id: str | None

    def behind(self, value: Column, key: Column) -> Column:
        """Whether a row comes after the cut."""
        after = value < F.lit(self.value)
        return after if self.last_id is None else after | ((value == F.lit(self.value)) & (key > F.lit(self.last_id)))


def nth_key(keys: DataFrame, key: str, nth: int) -> str:
    """The n-th smallest (from 1) of distinct strings, by counting leading characters."""
    prefix, width = "", 0
    while True:
        width += PREFIX_STEP
        counts = keys.groupBy(F.substring(key, 1, width).alias("__bin")).agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("least"))
        upto = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        row = counts.withColumn("end", F.sum("c").over(upto)).where(F.col("end") >= nth).orderBy("__bin").first()
        nth -= row["end"] - row["c"]
        if row["c"] == 1:
            return row["least"]
        prefix = row["__bin"]
        keys = keys.where(F.substring(key, 1, width) == prefix)


def rank_cuts(rows: DataFrame, value: str, key: str, ranks: Sequence[int]) -> list[Cut]:
    """The cut behind each rank that exists, in (value descending, key ascending) order; ``key`` is unique."""
    ranks = [r for r in ranks if r > 0]
    if not ranks:
        return []
    at = top_points(rows, F.col(value), ranks).first()
    cuts = []
    for i, r in enumerate(ranks):
        v = at[f"value_{i}"]
        if v is None:
            continue
        tied = rows.where(F.col(value) == v).select(key)
        inside = r - at[f"above_{i}"]
        cuts.append(Cut(r, v, None if inside == tied.count() else nth_key(tied, key, inside)))
    return cuts


def ntile(rows: DataFrame, value: str, key: str, buckets: int, name: str) -> DataFrame:
    """NTILE(buckets) over (value descending, key ascending), by comparison with the cuts; ``rows`` is stored."""
    n = rows.count()
    q, r = divmod(n, buckets)
    ends = [b * q + min(b, r) for b in range(1, buckets)]
    tile = F.lit(1)
    # Buckets that stay empty (fewer rows than buckets) end where the rows end.
    for cut in rank_cuts(rows, value, key, sorted({e for e in ends if 0 < e < n})):
        tile = tile + F.when(cut.behind(F.col(value), F.col(key)), 1).otherwise(0)
    return rows.withColumn(name, tile.cast("bigint"))
