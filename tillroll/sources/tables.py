"""The raw table stored for customer-level work: bucketed and sorted by customer.

Lines of an identified customer are written once, hashed into buckets by customer
and sorted in each by the match key of reversals.  Every aggregate and join that
has the customer among its keys then starts from buckets, without an exchange:
invoice grain, days, day sets, profile, cadence, home country, and the join of
sales with the reversal index if that is stored in the same buckets.

Lines without a customer (a quarter of real data) would all fall into one bucket.
They are kept in a table of their own, which only reports over all lines read.

One customer with a third of all lines is one bucket, and a bucket is read by one
task.  Where ``hot_lines`` says that a customer has more lines than a bucket should,
``buckets=0`` stores the lines unbucketed, and jobs shuffle partial sums as before.

Sales join the reversal index on four keys, of which the buckets know one.  Spark
accepts that only with ``CO_PARTITION`` set to false in the session.

The tables live in the session's catalog (a metastore on a cluster), which is what
remembers the buckets; ``path`` puts the files in a folder of one's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.reversal import MATCH_KEYS, reversal_index
from tillroll.plans.clean import cancellations
from tillroll.schema import RAW_COLUMNS

CUSTOMER = "customer_id"
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def hot_lines(raw: DataFrame) -> int:
    """Lines of the customer that has most of them."""
    return raw.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER).count().agg(F.max("count")).first()[0] or 0


def _store(df: DataFrame, name: str, buckets: int, sort: list[str], path: str | None) -> None:
    # As many tasks as buckets, each with all rows of its buckets: one file a bucket.
    placed = df.repartition(buckets, CUSTOMER) if buckets else df
    writer = placed.write.format("parquet").mode("overwrite").option("compression", "zstd")
    if buckets:
        writer = writer.bucketBy(buckets, CUSTOMER).sortBy(*sort)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_raw_tables(raw: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Store raw lines as ``name`` (identified customers, in buckets), ``name_anonymous`` (the others) and
    ``name_reversals`` (the reversal index, in the same buckets)."""
    at = lambda part: f"{path.rstrip('/')}/{part}" if path else None
    known = raw.where(F.col(CUSTOMER).isNotNull()).select(*RAW_COLUMNS)
    _store(known, name, buckets, [CUSTOMER, *[k for k in MATCH_KEYS if k != CUSTOMER]], at("identified"))
    _store(raw.where(F.col(CUSTOMER).isNull()).select(*RAW_COLUMNS), f"{name}_anonymous", 0, [], at("anonymous"))
    stored = raw.sparkSession.table(name)
    _store(reversal_index(cancellations(stored)), f"{name}_reversals", buckets, MATCH_KEYS, at("reversals"))


def read_raw_tables(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines of identified customers, other lines, reversal index) as ``write_raw_tables`` stored them."""
    return spark.table(name), spark.table(f"{name}_anonymous"), spark.table(f"{name}_reversals")
