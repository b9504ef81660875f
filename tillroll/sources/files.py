"""Typed readers and result writers for raw invoice lines.

CSV is read once with an explicit schema (never ``inferSchema``) and should be
written to Parquet; later jobs read Parquet so filters and column selections
reach the scan.  ``multiLine`` stays off so large CSV files still split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schema import RAW_COLUMNS, RAW_SCHEMA


def read_raw_csv(spark: SparkSession, path: str, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Load raw invoice lines from CSV with the fixed schema.

    ``escape='"'`` makes a doubled quote inside a quoted description one
    literal quote (RFC 4180); without it every later column would shift.
    ``decimal(12,2)`` rounds prices half-up while parsing, as the typed load
    of the original pipeline does (0.001 -> 0.00, 0.005 -> 0.01).
    """
    return spark.read.schema(RAW_SCHEMA).options(**csv_options(header, encoding), mode="FAILFAST").csv(path)


BAD_RECORD = "bad_record"


def read_raw_csv_apart(spark: SparkSession, path: str, header: bool = True, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Load raw invoice lines; lines that don't fit the schema are kept apart.

    Returns (good, bad): the lines that fit, and the text of each that doesn't (column
    ``bad_record``): too few or too many fields, or a field that is not of its type.
    Every data line of the files is in exactly one of them.  Both are lazy and read the files.
    """
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(BAD_RECORD, T.StringType())])
    lines = spark.read.schema(schema).options(
        **csv_options(header, encoding), mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD, columnPruning=False
    ).csv(path)
    # Only columns that are asked for are parsed, and a line is bad by any of them: this condition, true of
    # all lines, asks for all.
    lines = lines.where(F.hash(*RAW_COLUMNS) >= -(2**31))
    return lines.where(F.col(BAD_RECORD).isNull()).select(*RAW_COLUMNS), lines.where(F.col(BAD_RECORD).isNotNull()).select(BAD_RECORD)


def load_raw_csv(spark: SparkSession, path: str, raw_out: str, bad_out: str, most_bad: int | None = None) -> tuple[int, int]:
    """Load CSV into the Parquet raw table at ``raw_out`` and the lines that don't fit into ``bad_out``.

    Returns (good, bad) counts, observed while writing.  ``most_bad``: more bad lines than this end the
    load before the raw table is touched (``ValueError``).
    """
    good, bad = read_raw_csv_apart(spark, path)
    seen = Observation("bad lines")
    bad.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(bad_out)
    if most_bad is not None and seen.get["n"] > most_bad:
        raise ValueError(f"{seen.get['n']} lines can't be read, more than {most_bad}; see {bad_out}")
    loaded = Observation("good lines")
    write_raw_parquet(good.observe(loaded, F.count(F.lit(1)).alias("n")), raw_out)
    return loaded.get["n"], seen.get["n"]


def csv_options(header: bool = True, encoding: str = "UTF-8") -> dict:
    """The one CSV definition, for batch and stream."""
    return {"header": header, "encoding": encoding, "quote": '"', "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm[:ss]"}


def name_columns(df: DataFrame) -> DataFrame:
    """Positional rename of an 8-column extract to the canonical names."""
    if len(df.columns) != len(RAW_COLUMNS):
        raise ValueError(f"expected {len(RAW_COLUMNS)} columns, got {len(df.columns)}")
    return df.toDF(*RAW_COLUMNS)


def read_raw_parquet(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Raw lines from Parquet (written by ``write_raw_parquet``).

    ``start`` and ``end`` (dates, inclusive) bound the invoice time; the months
    outside are pruned as whole directories (``PartitionFilters``).
    """
    raw = spark.read.parquet(path)
    if start:
        day = F.lit(start).cast("date")
        raw = raw.where((F.col("invoice_month") >= start[:7]) & (F.col("invoice_date") >= day.cast("timestamp_ntz")))
    if end:
        day = F.date_add(F.lit(end).cast("date"), 1)
        raw = raw.where((F.col("invoice_month") <= end[:7]) & (F.col("invoice_date") < day.cast("timestamp_ntz")))
    return raw.select(*RAW_COLUMNS)


def write_raw_parquet(raw: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist raw lines as Parquet partitioned by month.

    A month is written by as many tasks as its size asks for (``rebalance``
    splits large months and joins small ones).  The month is a string, so
    the reader derives partition filters from date bounds.
    """
    (
        raw.withColumn("invoice_month", F.date_format("invoice_date", "yyyy-MM"))
        .hint("rebalance", "invoice_month")
        .write.mode(mode)
        .partitionBy("invoice_month")
        .parquet(path)
    )


def raw_preview(raw: DataFrame, n: int = 10) -> DataFrame:
    """The first rows of the raw table in the order of its columns (nulls first): a top-k, for eyeballing."""
    return raw.orderBy(*[F.col(c).asc_nulls_first() for c in RAW_COLUMNS]).limit(n)


def write_result_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file_rows: int | None = None) -> None:
    """Export a result table to CSV with a header, one file per task.

    ``single_file_rows``: write one file instead; the result must have no more
    rows than this (``ValueError`` otherwise, before anything is written).
    """
    out = df
    if single_file_rows is not None:
        if df.limit(single_file_rows + 1).count() > single_file_rows:
            raise ValueError(f"more than {single_file_rows} rows for one file")
        out = df.coalesce(1)
    (
        out.write.mode(mode)
        .option("header", True)
        # RFC 4180 text that ``read_raw_csv`` reads back unchanged: doubled
        # quotes, untrimmed values (the writer trims by default) and
        # zone-less timestamps without the ISO 'T'.
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )
