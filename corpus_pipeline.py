"""The training-data pipeline: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

Defined cases: an empty table passes through all stages; nulls, empty and very
long texts and repeated rows are treated as the operators say.  Further columns,
whatever they are called, go along untouched; only the last stage replaces
columns called ``ids`` and ``n_ids``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import mixing, pieces, pii, quality
from tillroll.llm.minhash import near_duplicates
from tillroll.llm.text import table
from tillroll.operators.ranking import global_rank
from tillroll.storage import written


def _apart(docs: DataFrame, *read: str) -> DataFrame:
    """The columns a stage reads, and all others as one struct, so that none meets a name of the stage's own."""
    return docs.select(*read, F.struct(F.lit(0).alias("0"), *[F.col(c) for c in docs.columns if c not in read]).alias("others"))


def _together(df: DataFrame, columns: list[str], *read: str) -> DataFrame:
    return df.select(*[F.col(c) if c in read else F.col("others")[c].alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the posterior rejects go."""
    return quality.judge(docs, docs.columns).where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; of rows that repeat it and its text, one.

    Documents are known by (doc_id, hash of text), so of rows that share only the doc_id each is
    judged by its own text.  Rows without a doc_id can't be told apart and stay.
    """
    columns, docs = docs.columns, _apart(docs, "doc_id", "text")
    known = docs.where("doc_id IS NOT NULL").withColumn("__h", F.xxhash64("text"))
    texts = known.select(F.col("doc_id").cast("long").alias("__d"), F.col("__h").alias("__of"))
    several = texts.groupBy("__d").agg(F.min("__of").alias("least"), F.max("__of").alias("most")).where("least != most")
    if several.limit(1).count():
        # A node for each text, numbered in the order of the doc_ids.
        nodes = global_rank(texts.distinct(), [F.col("__d"), F.col("__of")], rank_col="__node")
        met = known.join(nodes, (known["doc_id"].cast("long") == F.col("__d")) & (F.col("__h") == F.col("__of")))
        known = written(met.drop("__d", "__of"), "nodes")
    else:
        known = known.withColumn("__node", F.col("doc_id").cast("long"))
    judged = near_duplicates(known.select(F.col("__node").alias("doc_id"), "text"))
    stay = judged.where("kept").select(F.col("doc_id").alias("__stay")).distinct()
    known = known.join(stay, F.col("__node") == F.col("__stay"), "left_semi")
    again = Window.partitionBy("doc_id", "__h").orderBy("text")
    known = known.withColumn("__again", F.row_number().over(again)).where("__again = 1").drop("__again", "__h", "__node")
    return _together(known.unionByName(docs.where("doc_id IS NULL")), columns, "doc_id", "text")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts, and lengths are those of the new texts."""
    done = _together(pii.anonymise(_apart(docs, "doc_id", "text")), docs.columns, "doc_id", "text")
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in done.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its draw say."""
    return mixing.emit(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, in place of the text."""
    return pieces.encode(docs).withColumn("n_ids", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("surrogates", surrogates),
    ("mix_sources", mix_sources),
    ("to_pieces", to_pieces),
]

# No SQL: expectation-maximisation, sketches and Viterbi; tests/llm/test_pipeline.py has the plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
