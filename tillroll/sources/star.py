"""Adapter from the driver's star schema to the eight-column raw table.

This is test plumbing: the engine's jobs take a raw invoice-line DataFrame and
never look at star tables.  The mapping (from FIXTURES.md) compresses seven
order years into one trading year from 2010-12-01, keeps every line, synthesises cancellations
from returned lines, and plants nulls, zero quantities/prices and fee lines.

Everything is DataFrame code, and every line is joined once: a line that was
returned becomes two rows behind the joins.  Catalyst pushes the column selection
into each Parquet scan.  Small dimensions are left to Spark.  On large tables a
dimension is hashed, so the lines beside it are not sorted, and lines meet their
orders in as many partitions as keep ``LINES_A_TASK`` lines each, whatever the
session's number of partitions is.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.schema import RAW_COLUMNS

# Fixed values of the mapping (FIXTURES.md): calendar origin, compression factor,
# the moduli that plant special rows, and the fee descriptions.
ORIGIN = "2010-12-01"
YEAR_SQUEEZE = 6.5
FOLD_MOD, FOLD_INTO = 11, 330
ONCE_MOD, OWN_INVOICE_MOD = 3, 7
ONCE_INVOICE, ONCE_DAYS = 1_000_000_000_000, 300
EARLY_STOPS = ((2, 1, 321), (4, 2, 351))
OPENS, OPEN_MINUTES, SAME_DAY_MOD = 480, 600, 3
NULL_CUSTOMER_MOD = 10
NULL_NAME_MOD, FEE_MOD, MANUAL_MOD = 50, 53, 59
ZERO_QTY_MOD, ZERO_PRICE_MOD = 41, 37
FEE_NAME, MANUAL_NAME = "MARKETPLACE FEE", "Manual"

#: Lines of one task of a large join or aggregate, and rows from which a dimension is hashed (below, Spark may broadcast it).
LINES_A_TASK = 500_000
HASHED_ROWS = 2_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day_no(ts) -> F.Column:
    days = (F.year(ts) - 1995) * 366 + F.dayofyear(ts) - 1
    return F.floor(days / F.lit(YEAR_SQUEEZE)).cast("int")


def _at(day_no, minute) -> F.Column:
    day = F.date_add(F.lit(ORIGIN).cast("date"), day_no).cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", (OPENS + F.pmod(minute, F.lit(OPEN_MINUTES))).cast("int"), day)


def partitions_for(spark: SparkSession, sf_dir: str) -> int | None:
    """How many partitions the lines need, by their number (which the Parquet footers tell); None: the session's will do."""
    needed = -(-_table(spark, sf_dir, "lineitem").count() // LINES_A_TASK)
    return needed if needed > spark.sparkContext.defaultParallelism else None


def _dimension(df: DataFrame) -> DataFrame:
    return df.hint("shuffle_hash") if df.count() > HASHED_ROWS else df


def raw_from_star(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Raw invoice lines (8 columns, RAW_SCHEMA types) built from star tables; ``partitions``: see ``partitions_for``."""
    cust, folded = F.col("o_custkey"), F.col("o_custkey") % FOLD_MOD == 0
    ck = F.when(folded, cust % FOLD_INTO).otherwise(cust)
    # Rare customers: most orders are one invoice on a day of the customer's own.
    once = ~folded & (cust % ONCE_MOD == 0) & (F.col("o_orderkey") % OWN_INVOICE_MOD != 0)
    day = _day_no(F.col("o_orderdate"))
    day_no = F.when(once, (cust * 13) % ONCE_DAYS)
    for mod, rest, days in EARLY_STOPS:  # customers that stop early: late orders come earlier
        day_no = day_no.when(folded & (ck % mod == rest), day % days)
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        ck.alias("ck"),
        F.when(once, ONCE_INVOICE + cust).otherwise(F.col("o_orderkey")).alias("inv"),
        day_no.otherwise(day).cast("int").alias("day_no"),
    )
    # What a line's sale and its cancellation need, worked out before any exchange; a line that isn't returned has no ``ship_no``.
    pk, qty, no = F.col("l_partkey"), F.col("l_quantity"), F.col("l_linenumber")
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.when(pk % ZERO_QTY_MOD == 0, F.lit(0)).otherwise(qty).cast("int").alias("sold"),
        F.when(returned, F.when(no % 2 == 0, -qty).otherwise(-F.ceil(qty / 2)).cast("int")).alias("given_back"),
        (F.floor(F.col("l_extendedprice") / qty / 10).cast("decimal(20,0)")
         * F.lit(Decimal("0.01"))).cast("decimal(12,2)").alias("price"),
        F.when(returned, _day_no(F.col("l_shipdate"))).alias("ship_no"),
        F.when(returned, no % SAME_DAY_MOD == 0).alias("same_day"),
    )
    part = _dimension(_table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    customer = _dimension(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    orders = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .withColumn(
            "nation_key",
            F.when(F.col("o_custkey") % 4 == 0, (F.col("c_nationkey") + F.col("inv")) % 25)
            .otherwise(F.col("c_nationkey")),
        )
        .join(nation, F.col("nation_key") == nation.n_nationkey)
    )
    lines = lines.join(part, pk == part.p_partkey)
    if partitions:
        lines = lines.repartition(partitions, "l_orderkey")
        orders = orders.repartition(partitions, "o_orderkey").hint("shuffle_hash")
    cancelled = F.col("ship_no") >= F.col("day_no")
    # A line is a sale; one returned at or after its order is a cancellation too.
    base = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "back", F.explode(F.when(cancelled, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    )

    back, either = F.col("back"), lambda cancel, sale: F.when(F.col("back"), cancel).otherwise(sale)
    return base.select(
        either(F.concat(F.lit("C"), F.col("inv").cast("string")), F.col("inv").cast("string")).alias("invoice_no"),
        pk.cast("string").alias("stock_code"),
        F.when(pk % NULL_NAME_MOD == 0, F.lit(None).cast("string"))
        .when(pk % FEE_MOD == 0, F.lit(FEE_NAME))
        .when(pk % MANUAL_MOD == 0, F.lit(MANUAL_NAME))
        .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
        .alias("description"),
        either(F.col("given_back"), F.col("sold")).alias("quantity"),
        _at(
            either(F.when(F.col("same_day"), F.col("day_no")).otherwise(F.col("ship_no")), F.col("day_no")),
            F.col("inv") * either(F.lit(11), F.lit(7)),
        ).alias("invoice_date"),
        F.when(~back & (pk % ZERO_PRICE_MOD == 0), F.lit(Decimal("0.00")))
        .otherwise(F.col("price"))
        .cast("decimal(12,2)")
        .alias("unit_price"),
        F.when(F.col("ck") % NULL_CUSTOMER_MOD == 0, F.lit(None).cast("string"))
        .otherwise(F.col("ck").cast("string"))
        .alias("customer_id"),
        F.col("n_name").alias("country"),
    ).select(*RAW_COLUMNS)
