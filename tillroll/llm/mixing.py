"""Mixing sources to target weights.

1. Words are counted per document and summed per source (partial aggregation;
   a source with a third of all rows is summed in its map tasks).
2. Each source gets a weight and a share of the whole.  A target never exceeds
   ``max_repeat`` times its source; what it can't take goes to the others by
   weight.  That is the water level ``L`` with ``sum(min(w * L, max_repeat *
   size)) = total``, found by a few passes over the one-row-per-source table:
   the sources known to be full give a higher level, which may fill others.
3. The repetition rate of a source is target / size.  A document is emitted
   floor(rate) times, plus once more with probability equal to the fraction.
   The draw is a hash of the seed, the document id, its source and its text, so
   reruns agree, lost tasks redo the same choice, and documents without an id, or
   with one that others have, draw apart.

Defined cases: a null text has size 0; a null source is a source of its own,
the last in order; sources without words have target 0; an empty table gives
an empty result; rows with equal id, source and text draw alike and each count;
further columns, whatever they are called, are kept by ``emit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.text import table, word_count
from tillroll.operators.ranking import global_rank
from tillroll.storage import written

#: Fixed values of the query: weights in source order, repeating, and the cap.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
_DRAW_BITS = 48


def draw(seed: str) -> Column:
    """A reproducible number in [0, 1) for a document (doc_id, source, text): 48 bits of an MD5."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "source")]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *named, F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return F.conv(F.substring(digest, 1, _DRAW_BITS // 4), 16, 10).cast("double") / float(1 << _DRAW_BITS)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> plus weight, target and rate.  Sources take the weights in code-point order."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranked = global_rank(sizes, order, rank_col="__at")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("__at") - 1, len(weights)) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * max_repeat
    level, full = 0.0, -1
    while True:
        # Sums of whole numbers and one division: the same level in any order of rows.
        n, taken, rest = ranked.where(F.col("weight") * F.lit(level) >= cap).agg(
            F.count(F.lit(1)), F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
        ).first()
        if n == full:
            break
        full = n
        left = (ranked.agg(F.sum("weight")).first()[0] or 0) - rest
        if left == 0:
            break
        level = (total - taken) / left
    target = F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    return ranked.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, size, source_size, target, copies), one row per document."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed).alias("drawn")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, max_repeat).withColumnRenamed("source", "__source")
    # One row per source: Spark measures the table at run time and broadcasts or shuffles it.
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    whole = F.floor(F.col("rate")).cast("long")
    copies = whole + (F.col("drawn") < F.col("rate") - whole).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    Only the rates (one row per source) meet the documents; the texts are not shuffled
    while that table is small enough for Spark to broadcast.
    """
    sources = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(
        F.sum("size").alias("source_size")
    )
    rates = source_targets(sources, weights, max_repeat).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    whole = F.floor(F.col("__rate")).cast("int")
    copies = whole + (F.col("drawn") < F.col("__rate") - whole).cast("int")
    # The row goes along as one struct, so no column of it meets a name used here.
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col("source").alias("of"), draw(seed).alias("drawn"))
    out = rows.join(rates, F.col("of").eqNullSafe(F.col("__source")))
    return out.select("doc", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("doc.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# Sources are few, so the water level is read off one ordered pass: a source is full
# if the level that counts it and all fuller ones as full still exceeds its cap.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM per
), ordered AS (
  SELECT *, 3 * source_size AS cap,
         sum(3 * source_size) OVER f AS caps, sum(w) OVER () - sum(w) OVER f AS w_rest, sum(source_size) OVER () AS total
  FROM weighed WINDOW f AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT max(l) AS l FROM (
    SELECT (total::BIGINT)::DOUBLE / sum(w)::BIGINT AS l FROM ordered GROUP BY total
    UNION ALL
    SELECT (total - caps)::BIGINT::DOUBLE / w_rest::BIGINT FROM ordered WHERE w_rest > 0)
), targets AS (
  SELECT source, source_size, least(w * l, cap::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN least(w * l, cap::DOUBLE) / source_size ELSE 0 END AS rate
  FROM ordered, level
)
SELECT doc_id, size, t.source_size, target,
       size * (floor(rate) + CASE WHEN ('0x' || left(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(sized.source, 'null') || ':' || digest), 12))::BIGINT
                                       / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source
"""
