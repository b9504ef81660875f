"""Token counts as delta-maintained rollups.

A change is a document counted under one tokenizer version, with its count
before and after: an insert has no before, a delete no after, a revised count
both.  Changes become signed additive deltas, summed by source, language and
tokenizer version before they are shuffled, and each batch of them is committed
once: its deltas are one folder, and the entry in the log, written after them,
makes them count.  A batch that is sent again finds its entry and changes
nothing; one that broke off before its entry is written anew over its remains.
Totals are the sum of the committed deltas, so no earlier document is read
again.  ``compact`` folds old batches into one; its log entry names what it
replaces, so readers see either all of them or the fold.

Everything lives in a folder of shared storage and is read and written by Spark.

Defined cases: a null text has 0 tokens, and null sources and languages are
groups of their own; a document that is inserted twice in a batch counts twice
(rows are counted, not ids); a change whose counts are equal moves no tokens; a
delete brings the count it takes away; groups whose documents are all gone stay
with zeros; an empty batch commits an entry and no deltas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.text import table, word_count
from tillroll.storage import fresh_path, written

KEYS = ["source", "lang", "tokenizer"]
CHANGE = "source string, lang string, tokenizer string, before long, after long"
SUMS = ["n_docs", "n_tokens", "n_inserted", "n_deleted", "n_revised"]
_DELTAS = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], *[T.StructField(s, T.LongType()) for s in SUMS], T.StructField("batch", T.StringType())])
_LOG = T.StructType([T.StructField("batch", T.StringType()), T.StructField("replaces", T.ArrayType(T.StringType()))])


class Rollup:
    """Additive token totals in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, what: str, schema: T.StructType) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}/*") if there else self.spark.createDataFrame([], schema)

    def committed(self) -> set[str]:
        """The batches that count: one small log row per commit."""
        log = self._read("log", _LOG).collect()
        replaced = {b for row in log for b in row["replaces"] or ()}
        return {row["batch"] for row in log} - replaced

    def seen(self) -> set[str]:
        return {row["batch"] for row in self._read("log", _LOG).collect()}

    def _enter(self, batch: str, replaces: list[str]) -> None:
        entry = self.spark.createDataFrame([(batch, replaces)], _LOG)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes (``CHANGE`` columns; more are ignored) once.  False if it had been applied."""
        if batch in self.seen():
            return False
        before, after = F.col("before"), F.col("after")
        signed = changes.groupBy(*KEYS).agg(
            F.sum(after.isNotNull().cast("long") - before.isNotNull().cast("long")).alias("n_docs"),
            F.sum(F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))).alias("n_tokens"),
            F.sum((before.isNull() & after.isNotNull()).cast("long")).alias("n_inserted"),
            F.sum((before.isNotNull() & after.isNull()).cast("long")).alias("n_deleted"),
            F.sum((before.isNotNull() & after.isNotNull()).cast("long")).alias("n_revised"),
        )
        signed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        self._enter(batch, [])
        return True

    def totals(self) -> DataFrame:
        """One row per source, language and tokenizer version."""
        live = sorted(self.committed())
        return self._read("deltas", _DELTAS).where(F.col("batch").isin(live)).groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])

    def compact(self, batch: str) -> bool:
        """Fold all committed batches into one, called ``batch``."""
        if batch in self.seen():
            return False
        live = sorted(self.committed())
        self.totals().withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        self._enter(batch, live)
        return True


#: Fixed values of the query: tokenizer versions that SQL can follow.  Any other count may be given as a change.
ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def alnum_count(text: Column) -> Column:
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    body = F.trim(body)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, " "))).cast("long")


TOKENIZERS = {"space-1": word_count, "alnum-1": alnum_count}


def cleaned(text: Column) -> Column:
    """The revision of the query: symbols that stand in words become spaces."""
    return F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>", "        ")


def op4_rollup(spark, sf_dir: str) -> DataFrame:
    """A rollup kept through three batches, two of them sent twice.

    All documents are inserted; documents with symbols are revised to their cleaned text; and
    documents of fewer than ten words (then) are deleted.
    """
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text", cleaned(F.col("text")).alias("clean"))
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    versions = F.array(*[
        F.struct(F.lit(n).alias("tokenizer"), count(F.col("text")).alias("old"), count(F.col("clean")).alias("new"))
        for n, count in TOKENIZERS.items()
    ])
    short = word_count(F.col("clean")) < 10
    changed = F.coalesce(F.col("text"), F.lit("")) != F.col("clean")
    # Counted once; all batches come from the counts.
    counts = written(docs.select("source", "lang", short.alias("short"), changed.alias("changed"), F.inline(versions)), "counts")
    none = F.lit(None).cast("long")
    rollup.commit("1-insert", counts.select(*KEYS, none.alias("before"), F.col("old").alias("after")))
    revised = counts.where("changed").select(*KEYS, F.col("old").alias("before"), F.col("new").alias("after"))
    rollup.commit("2-revise", revised)
    rollup.commit("2-revise", revised)
    rollup.commit("3-delete", counts.where("short").select(*KEYS, F.col("new").alias("before"), none.alias("after")))
    rollup.compact("4-fold")
    rollup.commit("3-delete", counts.where("short").select(*KEYS, F.col("new").alias("before"), none.alias("after")))
    return rollup.totals()


ORACLE = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS text, translate(coalesce(text, ''), '#*$%&|<>', '        ') AS clean FROM documents
), c AS (
  SELECT *, len(regexp_extract_all(clean, '[^\x20\x09-\x0D]+')) < 10 AS short FROM d
), v AS (
  SELECT source, lang, 'space-1' AS tokenizer, short, text <> clean AS changed,
         len(regexp_extract_all(clean, '[^\x20\x09-\x0D]+')) AS n FROM c
  UNION ALL
  SELECT source, lang, 'alnum-1', short, text <> clean,
         len(regexp_extract_all(clean, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM c
)
SELECT source, lang, tokenizer, count(*) FILTER (NOT short) AS n_docs, coalesce(sum(n) FILTER (NOT short), 0)::BIGINT AS n_tokens,
       count(*) AS n_inserted, count(*) FILTER (short) AS n_deleted, count(*) FILTER (changed) AS n_revised
FROM v GROUP BY ALL
"""
