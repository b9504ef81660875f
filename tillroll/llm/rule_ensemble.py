"""A quality classifier as a sparse ensemble of rules over text statistics.

1. Statistics of every whole text, in column functions, written once.
2. Trees are grown on the labelled rows.  Each path from a root to a node is a
   conjunction of limits on statistics, a rule; conditions on one statistic are
   joined to an interval, and equal rules are kept once.
3. A lasso logistic regression weighs the rules (0 or 1 each) and the
   statistics themselves, clipped at their outer quantiles; most weights are 0.
4. What is left is compiled into one column expression of the statistics, so
   scoring is a projection of the written statistics.

Labels are read only from rows with crc32(doc_id as text) mod 5 != 0; labels,
lang, source and doc_id are no inputs of a score.  The fit takes all labelled
rows up to ``MOST_ROWS``; beyond, the share of them whose hashed doc_id is
smallest.  Every text is measured and scored.

Trees are grown and weights fitted by Spark over the partitioned rows; to the
driver come trees and weights.

Defined cases: null and empty texts have all statistics 0 and a score; a null
doc_id counts as empty text in the remainder (so it is held out); repeated rows
score alike; a doc_id with several labels gives an example for each; null labels give
none; without both labels among the examples the score is the smoothed share
of good ones; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.quality import SYMBOLS, _once
from tillroll.llm.text import table, words_of
from tillroll.storage import written

FOLDS, THRESHOLD = 5, 0.3
#: Rows a fit takes at most, trees and their depth, lasso penalty, least share of rows on each side of a rule.
MOST_ROWS = 50_000
TREES, DEPTH, SEED = 24, 3, 20
PENALTY = 0.002
LEAST_SHARE = 0.002
FIT_TASKS = 4
#: Quantiles at which the linear terms are clipped.
CLIP = (0.025, 0.975)
#: Words in a window whose repeats count.
WINDOW = 4
LETTERS, WORD = r"\p{L}\p{M}", r"[^\x20\x09-\x0D]"


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))


def statistics() -> dict[str, Column]:
    """The inputs of a score: shares and means of a text, from the columns that ``measured`` lays down."""
    n, solid = F.col("__n"), F.col("__solid")
    return {
        "n_words": n.cast("double"),
        "word_length": _share(solid, n),
        "longest_word": F.col("__longest").cast("double"),
        "letters": _share(F.col("__letters"), solid),
        "upper": _share(F.col("__upper"), F.col("__letters")),
        "digits": _share(F.col("__digits"), solid),
        "symbols": _share(F.col("__symbols"), n),
        "shouts": _share(F.col("__shouts"), n),
        "stops": _share(F.col("__stops"), n),
        "bare_marks": _share(F.col("__marks"), n),
        "stutters": _share(F.col("__stutters"), n),
        "distinct_words": _share(F.col("__distinct"), n),
        "repeated_windows": _share(F.col("__windows") - F.col("__distinct_windows"), F.col("__windows")),
        "n_lines": F.col("__lines").cast("double"),
        "repeated_lines": _share(F.col("__lines") - F.col("__distinct_lines"), F.col("__lines")),
        "line_words": _share(n, F.col("__lines")),
    }


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and the statistics of the whole text."""
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    base = _once(base, __words=words_of(F.col("__text")))
    words = F.col("__words")
    # Hashes of a word or a line are compared within their own text only.
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    lines = F.transform(F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))
    base = _once(
        base, __hashes=hashed, __line_hashes=lines,
        __only_letters=F.regexp_replace("__text", rf"[^{LETTERS}]+", ""),
        __others=F.regexp_replace("__text", rf"[{LETTERS}\x20\x09-\x0D]+", ""),
    )
    h = F.col("__hashes")
    windows = F.when(F.size(h) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<bigint>"))
    among = lambda chars: F.length(F.regexp_replace("__others", rf"[^{chars}]+", ""))
    base = _once(
        base,
        __n=F.size(words), __solid=F.length("__only_letters") + F.length("__others"),
        __longest=F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)),
        __letters=F.length("__only_letters"),
        __upper=F.length(F.regexp_replace("__only_letters", r"\P{Lu}+", "")),
        __digits=among("0-9"), __symbols=among(SYMBOLS), __shouts=among("!?"), __stops=among(".,;:"),
        __marks=F.size(F.filter(words, lambda w: ~w.rlike(rf"[{LETTERS}\p{{N}}]"))),
        __stutters=F.size(F.filter(h, lambda x, i: F.get(h, i - 1) == x)),
        __distinct=F.size(F.array_distinct(h)),
        __all=windows,
        __lines=F.size("__line_hashes"), __distinct_lines=F.size(F.array_distinct("__line_hashes")),
    )
    base = _once(base, __windows=F.size("__all"), __distinct_windows=F.size(F.array_distinct("__all")))
    return base.select("doc_id", *[c.alias(n) for n, c in statistics().items()])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass(frozen=True)
class Rule:
    """Statistics within intervals (low, high]: (name, low or None, high or None), by name."""

    limits: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        parts = [F.col(n) > F.lit(low) for n, low, _ in self.limits if low is not None]
        parts += [F.col(n) <= F.lit(high) for n, _, high in self.limits if high is not None]
        return reduce(lambda a, b: a & b, parts)

    def __str__(self) -> str:
        return " and ".join(
            f"{'' if low is None else f'{low:.4g} < '}{n}{'' if high is None else f' <= {high:.4g}'}" for n, low, high in self.limits)


def paths(node, names: list[str], limits: dict | None = None) -> list[Rule]:
    """The rule of every node below ``node``, a node of a fitted tree."""
    limits = limits or {}
    rules = [Rule(tuple(sorted((n, *lh) for n, lh in limits.items())))] if limits else []
    if node.subtreeDepth() == 0:
        return rules
    split = node.split()
    name, at = names[split.featureIndex()], split.threshold()
    low, high = limits.get(name, (None, None))
    rules += paths(node.leftChild(), names, {**limits, name: (low, at if high is None else min(high, at))})
    rules += paths(node.rightChild(), names, {**limits, name: (at if low is None else max(low, at), high)})
    return rules


@dataclass
class Ensemble:
    """Weights of rules and of clipped statistics, and the intercept."""

    intercept: float
    rules: list[tuple[Rule, float]]
    linear: list[tuple[str, float, float, float]]

    def score(self) -> Column:
        """The probability of a good text, as a column of its statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        for name, low, high, weight in self.linear:
            total = total + F.lit(weight) * _clipped(name, low, high)
        return 1 / (1 + F.exp(-total))


def _clipped(name: str, low: float, high: float) -> Column:
    return F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high))


def fit(examples: DataFrame, names: list[str], penalty: float = PENALTY) -> Ensemble:
    """``examples`` has the statistics and ``quality``, 0 or 1."""
    sums = examples.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good")).first()
    n, good = sums["n"], sums["good"] or 0
    if good in (0, n):
        from math import log

        return Ensemble(log((good + 1) / (n - good + 1)), [], [])
    rows = VectorAssembler(inputCols=names, outputCol="__x").transform(examples.withColumn("__y", F.col("quality").cast("double")))
    forest = RandomForestClassifier(
        featuresCol="__x", labelCol="__y", numTrees=TREES, maxDepth=DEPTH, bootstrap=False, featureSubsetStrategy="sqrt",
        minInstancesPerNode=5, seed=SEED, maxBins=64,
    ).fit(rows)
    found = sorted({r for t in forest.trees for r in paths(t._call_java("rootNode"), names)}, key=str)
    # Rules that hold for nearly none or nearly all examples tell nothing.
    met = rows.agg(*[F.count_if(r.column()).alias(f"r{i}") for i, r in enumerate(found)]).first() if found else []
    found = [r for i, r in enumerate(found) if LEAST_SHARE * n <= met[i] <= (1 - LEAST_SHARE) * n]
    ends = examples.approxQuantile(names, list(CLIP), 0.005)
    linear = [(name, low, high) for name, (low, high) in zip(names, ends) if low < high]
    terms = {f"__r{i}": r.column().cast("double") for i, r in enumerate(found)}
    terms |= {f"__l{i}": _clipped(*one) for i, one in enumerate(linear)}
    if not terms:
        return Ensemble(0.0, [], [])
    wide = rows.select("__y", *[c.alias(k) for k, c in terms.items()])
    wide = VectorAssembler(inputCols=list(terms), outputCol="__t").transform(wide).select("__y", "__t")
    lasso = LogisticRegression(
        featuresCol="__t", labelCol="__y", elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-4
    ).fit(wide)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    return Ensemble(
        float(lasso.intercept),
        [(r, w) for r, w in zip(found, weights) if w],
        [(*one, w) for one, w in zip(linear, weights[len(found):]) if w],
    )


def examples_of(stats: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Statistics and label of the rows that may be learned from."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    joined = stats.join(known, F.col("doc_id") == F.col("__id")).drop("__id")
    # Which rows are taken goes by the document alone.
    joined = written(joined.withColumn("__h", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20))), "examples")
    n = joined.count()
    if n > most_rows:
        joined = joined.where(F.col("__h") < F.lit(int((1 << 20) * most_rows / n)))
    # At most MOST_ROWS short rows, so few tasks do for the many passes of a fit.
    return written(joined.drop("__h").coalesce(FIT_TASKS), "sample")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = written(measured(docs), "statistics")
    names = list(statistics())
    model = fit(examples_of(stats, labels), names)
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))


def op12_classifier(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
