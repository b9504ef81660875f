"""Keep the cleaned relations current as raw files arrive.

The original pipeline is batch only; this applies the *same* cleaning
functions (``valid_sales``, ``cancellations``) to a file stream.  Both are
stateless row filters and projections, so append mode needs no watermark or
state, and the Parquet sinks are exactly-once through the query checkpoints.
Reports then read the sink tables like any batch input.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillroll.plans.clean import cancellations, valid_sales
from tillroll.schema import RAW_SCHEMA
from tillroll.sources.files import BAD_RECORD, csv_options


def raw_stream(spark: SparkSession, source_dir: str, fmt: str = "csv", max_files_per_trigger: int | None = None):
    """Raw lines as they arrive.  CSV lines that don't fit the schema come with their text in ``bad_record``."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(BAD_RECORD, T.StringType())])
        return reader.schema(schema).options(**csv_options(), mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD).csv(source_dir)
    return reader.schema(RAW_SCHEMA).parquet(source_dir).withColumn(BAD_RECORD, F.lit(None).cast("string"))


def start_clean_ingest(
    spark: SparkSession,
    source_dir: str,
    sales_out: str,
    cancels_out: str,
    checkpoint_root: str,
    bad_out: str,
    fmt: str = "csv",
    available_now: bool = False,
    processing_time: str = "1 minute",
) -> list[StreamingQuery]:
    """Start the append streams of sales, cancellations and lines that can't be read (``bad_out``); returns the running queries.

    ``checkpoint_root`` is a folder on shared storage that outlives the
    driver, so a restarted stream resumes where it stopped.
    """
    root = checkpoint_root.rstrip("/")
    raw = raw_stream(spark, source_dir, fmt)
    good = raw.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)
    outputs = [
        (valid_sales(good), sales_out, "order_month", "sales"),
        (cancellations(good), cancels_out, "cancellation_month", "cancellations"),
        (raw.where(F.col(BAD_RECORD).isNotNull()), bad_out, None, "bad"),
    ]
    queries = []
    for df, path, part, name in outputs:
        writer = (
            df.writeStream.format("parquet")
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", f"{root}/ingest-{name}")
            .queryName(f"tillroll_ingest_{name}")
        )
        writer = writer.partitionBy(part) if part else writer
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
        queries.append(writer.start())
    return queries
