"""Global row numbers and running sums without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` makes Spark move every row to
one task (``Exchange SinglePartition``).  ``global_rank`` keeps the work spread:

1. ``repartitionByRange`` on the (total) order -> N sorted, disjoint ranges;
   each row is given its range number and its position there, as columns, and
   the ranges are written once to the shared folder;
2. per range: row count and sums of the running measures, one row each
   (N = partition count, a proven bound, so this tiny table is broadcast)
   -> exclusive prefix offsets;
3. rank = range offset + position; running sum = range offset + a window sum
   inside the range.

Range and position are data, not properties of the task that reads them, so
the result may be united, coalesced or limited like any other DataFrame.
Callers must give a *total* order (add the key as the last sort column) so
ties are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.storage import written

_PID = "__range_id"
_POS = "__range_pos"
_ROWS = "__range_rows"
_BASE = "__range_base"


def _num_ranges(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def global_rank(
    df: DataFrame,
    order_by: Sequence[Column],
    running: dict[str, Column] | None = None,
    rank_col: str = "rn",
    num_partitions: int | None = None,
    total_col: str | None = None,
    running_totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add a 1-based global row number and inclusive running sums.

    ``running`` maps output names to *integral* expressions (counts, pence);
    integer sums are exact and order-independent, so results are reproducible,
    and a NULL measure adds nothing.  ``total_col`` (optional) names a column
    with the total row count, and ``running_totals`` names columns with the whole
    sums of running measures; both come from the per-range table, so no extra
    pass over the data is needed.
    """
    running = dict(running or {})
    sums = [f"__m{i}" for i in range(len(running))]
    n = _num_ranges(df, num_partitions)

    base = df.withColumns({m: F.coalesce(e.cast("long"), F.lit(0)) for m, e in zip(sums, running.values())})
    ranged = written(
        base.repartitionByRange(n, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(_PID, F.spark_partition_id())
        # The low 33 bits count the rows of a partition in order.
        .withColumn(_POS, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranges",
    )

    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    stats = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias(_ROWS), *[F.sum(m).alias(f"{m}_t") for m in sums])
    extra = [F.sum(_ROWS).over(Window.partitionBy()).alias(total_col)] if total_col else []
    whole = dict(zip(running, sums))
    extra += [F.sum(f"{whole[m]}_t").over(Window.partitionBy()).alias(c) for m, c in (running_totals or {}).items()]
    offsets = stats.select(
        _PID,
        *extra,
        F.coalesce(F.sum(_ROWS).over(before), F.lit(0)).alias(_BASE),
        *[F.coalesce(F.sum(f"{m}_t").over(before), F.lit(0)).alias(f"{m}_b") for m in sums],
    )
    within = Window.partitionBy(_PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({f"{m}_c": F.sum(m).over(within) for m in sums})
    out = local.join(F.broadcast(offsets), _PID).withColumn(rank_col, F.col(_BASE) + F.col(_POS) + 1)
    for name, m in zip(running, sums):
        out = out.withColumn(name, F.col(f"{m}_b") + F.col(f"{m}_c"))
    return out.drop(_PID, _POS, _BASE, *[c for m in sums for c in (m, f"{m}_b", f"{m}_c")])


def ntile_from_rank(rank: Column, total: Column, buckets: int) -> Column:
    """NTILE(buckets) computed from a 1-based rank and the row total.

    With q = total div buckets and r = total mod buckets, the first r tiles
    hold q + 1 rows and the rest q rows (the SQL definition of NTILE).
    """
    q = F.call_function("div", total, F.lit(buckets))
    r = F.pmod(total, F.lit(buckets))
    big = r * (q + 1)
    first = F.call_function("div", rank - 1, q + 1) + 1
    rest = F.call_function("div", rank - 1 - r, F.greatest(q, F.lit(1))) + 1
    return F.when(rank <= big, first).otherwise(rest).cast("bigint")
