"""Audit the physical plans of every registered job.

    python tools/plan_audit.py [--sf-dir DIR] [--show KEY]

Builds each job over month-partitioned raw Parquet (as a deployment stores
it) and reports, from the optimized physical plan: shuffle exchanges,
single-partition exchanges (with the size of what flows into them), broadcast
exchanges, Python steps, and whether the raw scan has pushed filters.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Nodes that pass rows through unchanged in number (or only drop rows).
_TRANSPARENT = {
    "ProjectExec", "FilterExec", "SortExec", "WindowExec", "WindowGroupLimitExec", "WholeStageCodegenExec",
    "InputAdapter", "ColumnarToRowExec", "RowToColumnarExec", "GenerateExec", "UnionExec", "AQEShuffleReadExec",
    "ShuffleQueryStageExec", "ReusedExchangeExec", "CoalesceExec", "ShuffleExchangeExec",
}
# Nodes whose output is already reduced: top-k / limits, literal parameter
# tables and the one-row session range.  Aggregates are judged by their keys.
_REDUCED = {"TakeOrderedAndProjectExec", "GlobalLimitExec", "CollectLimitExec", "LocalTableScanExec", "RangeExec"}
_AGGREGATES = {"HashAggregateExec", "ObjectHashAggregateExec", "SortAggregateExec"}
# Grouping keys of a small grain: calendar months, the per-range table and the bins of a digit histogram.
SMALL_GRAIN_KEYS = {"order_month", "cancellation_month", "cohort_month", "year_month", "month", "__range_id", "__bin"}


def _aggregate_reduced(node) -> bool:
    """Partial aggregates (the global aggregate's own shuffle), global
    aggregates and aggregates over a small grain are reduced; a final
    aggregate by customer (or any data-sized key) is not."""
    aggs = node.aggregateExpressions()
    modes = {aggs.apply(i).mode().toString() for i in range(aggs.size())}
    if modes and modes <= {"Partial", "PartialMerge"}:
        return True
    keys = node.groupingExpressions()
    names = {keys.apply(i).name() for i in range(keys.size())}
    return not names or names <= SMALL_GRAIN_KEYS


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _children(node):
    ch = node.children()
    return [ch.apply(i) for i in range(ch.size())]


def _reduced(node) -> bool:
    name = _name(node)
    if name in _REDUCED:
        return True
    if name in _AGGREGATES:
        return _aggregate_reduced(node)
    if name in _TRANSPARENT:
        kids = _children(node)
        return bool(kids) and all(_reduced(k) for k in kids)
    if name == "BroadcastExchangeExec":
        return all(_reduced(k) for k in _children(node))
    if "NestedLoopJoin" in name or "Cartesian" in name:
        # A cross join multiplies rows: the streamed side must be reduced
        # (the broadcast side is a one-row total or a parameter list).
        kids = [k for k in _children(node) if _name(k) != "BroadcastExchangeExec"]
        return bool(kids) and all(_reduced(k) for k in kids)
    if "Join" in name:
        # Equi-joins here are on unique customer/group keys, so a reduced
        # side (top-k, aggregate) bounds the output whichever side it is.
        return any(_reduced(k) for k in _children(node))
    return False


def single_partition_violations(df) -> list[str]:
    """Single-partition exchanges fed by data that was not reduced first."""
    plan = df._jdf.queryExecution().executedPlan()
    if _name(plan) == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()  # after exchange insertion (inputPlan has none yet)
    bad = []

    def walk(node):
        if _name(node) == "ShuffleExchangeExec":
            part = node.outputPartitioning().getClass().getSimpleName()
            if part.startswith("SinglePartition") and not all(_reduced(k) for k in _children(node)):
                bad.append(node.toString().splitlines()[0][:160])
        for k in _children(node):
            walk(k)

    walk(plan)
    return bad


def plan_text(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString()


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--show", default=None)
    args = ap.parse_args()

    from tillroll.registry import JOBS
    from tillroll.relations import Relations
    from tillroll.session import build_session
    from tillroll.storage import fresh_path
    from tillroll.sources.files import read_raw_parquet, write_raw_parquet
    from tillroll.sources.star import raw_from_star

    spark = build_session()
    path = fresh_path(spark, "audit-raw")
    write_raw_parquet(raw_from_star(spark, args.sf_dir), path)
    keys = [args.show] if args.show else list(JOBS)
    for key in keys:
        df = JOBS[key](Relations(read_raw_parquet(spark, path), home_country="NATION_0"))
        if args.show:
            df.explain("formatted")
            continue
        text = plan_text(df)
        shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", text))
        single = len(re.findall(r"Exchange SinglePartition", text))
        bcast = len(re.findall(r"BroadcastExchange", text))
        py = len(re.findall(r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas", text))
        pushed = "PushedFilters: [" in text and not re.search(r"PushedFilters: \[\]", text)
        bad = single_partition_violations(df)
        print(f"{key:34s} shuffles={shuffles:2d} single={single} bcast={bcast} python={py} pushed={pushed}"
              f"{'  UNREDUCED-SINGLE: ' + str(bad) if bad else ''}")
    spark.stop()


if __name__ == "__main__":
    main()
