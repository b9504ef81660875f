"""Word and column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and empty texts have none."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    """How many words a text has (null: 0)."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SPACE_CLASS + "+"))).cast("long")
