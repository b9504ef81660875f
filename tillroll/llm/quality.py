"""Quality rules as weak supervision, in DataFrame functions only.

1. Every document is measured once, in array functions of its own row.
2. Rules vote good (1) or bad (0) or abstain (null).  A rule is not trusted as
   such: how often it errs is learnt from how the rules agree.
3. Expectation-maximisation over the *vote patterns*: documents with the same
   votes are alike to the model, so they are counted per pattern (partial
   aggregation, at most 3 ** rules rows however many documents), and each
   iteration is one aggregate of that small table, which returns a row of sums.
4. The posterior probability that a document is good, given its votes, decides,
   instead of asking it to pass every rule.

Defined cases: null and empty texts have no words and every measure 0; an
empty table gives no rows; rows are judged one by one, so repeated rows agree;
further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import SPACES, table, words_of
from tillroll.storage import written

#: Fixed values of the base rules: characters counted as symbols, window width, limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20

ITERATIONS = 25
#: Where expectation-maximisation starts: the share of good documents, and how often a rule votes
#: (bad, good, abstains) on a good and on a bad document.  Junk is of many kinds, so a rule sees only
#: some of it, but seldom blames a good document.
PRIOR_GOOD, VOTES_ON_GOOD, VOTES_ON_BAD = 0.85, (0.01, 0.88, 0.11), (0.40, 0.45, 0.15)
#: Pseudo-counts of votes (share of all documents) that keep accuracies off 0 and 1.
SMOOTHING = 0.001


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add array columns that are computed once per row.

    The optimiser may copy an expression into each place that uses it, even
    into the body of a lambda; a generator in between keeps it a column.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(packed))


def measures(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, ...) -> the counts the rules are about, and ``doc``, a struct of the ``keep`` columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.struct(*[F.col(c) for c in keep or ["doc_id"]])
    base = _once(docs.select(kept.alias("doc"), "text"), __words=words_of(F.col("text")))
    n = F.size("__words")
    # A hash of each window; hashes of a row are compared with each other only.
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    stutters = F.size(F.filter("__words", lambda x, i: F.get(F.col("__words"), i - 1) == x))
    marks = F.size(F.filter("__words", lambda x: F.translate(x, SYMBOLS, "") == ""))
    base = _once(base, __windows=windows, __lines=lines, __stutters=stutters, __marks=marks)
    # Only rows with a repeated window go on to sort theirs.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(
        repeats, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    )
    base = _once(base, __placed=placed)
    at = F.col("__placed")
    again = F.when(
        at.isNotNull(),
        F.array_sort(
            F.transform(
                F.filter(
                    F.transform(at, lambda x, i: F.struct(
                        x["p"].alias("p"),
                        ((F.get(at, i - 1)["h"] == x["h"]) | (F.get(at, i + 1)["h"] == x["h"])).alias("twice"))),
                    lambda x: F.coalesce(x["twice"], F.lit(False)),
                ),
                lambda x: x["p"],
            )
        ),
    )
    base = _once(base, __again=again)
    starts = F.col("__again")
    # Words covered by the repeated windows: each start adds what the next one doesn't cover.
    covered = F.aggregate(
        F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    solid = F.translate(text, SPACES, "")
    letters = F.regexp_replace(solid, r"[\p{L}\p{M}]+", "")
    upper = F.regexp_replace(solid, r"\p{Lu}+", "")
    return base.select(
        "doc",
        F.size("__words").cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.col("__stutters").cast("long").alias("n_stutters"),
        F.col("__marks").cast("long").alias("n_marks"),
        (F.length(solid) - F.length(letters)).cast("long").alias("n_letters"),
        (F.length(solid) - F.length(upper)).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    """The fixed base rule: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, null abstains between the two limits.  Each kind of junk is seen by two rules or more."""
    length = _share("word_chars", "n_words")
    return {
        "words": _vote(F.col("n_words") >= 20, F.lit(False)),
        "word_length": _vote(length.between(2.5, 8.5), (length < 2.0) | (length > 12)),
        "symbols": _vote(_share("n_symbols", "n_words") < 0.02, _share("n_symbols", "n_words") > 0.1),
        "marks": _vote(_share("n_marks", "n_words") < 0.02, _share("n_marks", "n_words") > 0.1),
        "letters": _vote(_share("n_letters", "word_chars") > 0.8, _share("n_letters", "word_chars") < 0.72),
        "upper": _vote(_share("n_upper", "n_letters") < 0.15, _share("n_upper", "n_letters") > 0.4),
        "lines": _vote(_share("n_dup_lines", "n_lines") < 0.35, _share("n_dup_lines", "n_lines") > 0.5),
        "repeats": _vote(_share("n_repeat_words", "n_words") < 0.12, _share("n_repeat_words", "n_words") > 0.15),
        "stutter": _vote(_share("n_stutters", "n_words") < 0.05, _share("n_stutters", "n_words") > 0.2),
    }


def _log_odds(names: list[str], params: dict) -> Column:
    """Log odds of good against bad, given the votes of a row."""
    odds = F.lit(math.log(params["prior"]) - math.log(1 - params["prior"]))
    for name in names:
        g, b = params["good"][name], params["bad"][name]
        odds = odds + F.when(F.col(name) == 1, math.log(g[1]) - math.log(b[1])).when(
            F.col(name) == 0, math.log(g[0]) - math.log(b[0])
        ).otherwise(math.log(g[2]) - math.log(b[2]))
    return odds


def posterior(names: list[str], params: dict) -> Column:
    return 1 / (1 + F.exp(-_log_odds(names, params)))


def fit(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> dict:
    """Share of good documents, and per rule and class the chance of each vote (bad, good, abstains).

    ``votes`` has a column per rule.  The result has ``prior`` and, for the classes ``good`` and ``bad``,
    a triple per rule.
    """
    patterns = written(votes.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("__n")).coalesce(1), "patterns")
    params = {"prior": PRIOR_GOOD, "good": dict.fromkeys(names, VOTES_ON_GOOD), "bad": dict.fromkeys(names, VOTES_ON_BAD)}
    kinds = [lambda c: c == 0, lambda c: c == 1, lambda c: c.isNull()]
    for _ in range(iterations):
        weighed = patterns.withColumn("__g", F.col("__n") * posterior(names, params))
        sums = [F.sum("__n").alias("n"), F.sum("__g").alias("g")]
        for r, name in enumerate(names):
            for k, kind in enumerate(kinds):
                sums += [F.sum(F.when(kind(F.col(name)), F.col("__n"))).alias(f"n_{r}_{k}"), F.sum(F.when(kind(F.col(name)), F.col("__g"))).alias(f"g_{r}_{k}")]
        row = weighed.agg(*sums).first()
        if not row["n"]:
            return params
        n, g = row["n"], row["g"]
        least = SMOOTHING * n
        part = lambda of, whole, r: tuple((of(r, k) + least) / (whole + 3 * least) for k in range(3))
        good = lambda r, k: row[f"g_{r}_{k}"] or 0.0
        bad = lambda r, k: max(0.0, (row[f"n_{r}_{k}"] or 0.0) - good(r, k))
        params = {
            "prior": min(max(g / n, 0.001), 0.999),
            "good": {name: part(good, g, r) for r, name in enumerate(names)},
            "bad": {name: part(bad, n - g, r) for r, name in enumerate(names)},
        }
    return params


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Measures, votes, ``base_failed``, ``p_good`` and ``kept`` of each document, beside ``doc`` with its ``keep`` columns."""
    measured = written(measures(docs, keep), "measures")
    ours = rules()
    names = [f"v_{n}" for n in ours]
    voted = measured.withColumns({f"v_{n}": v for n, v in ours.items()})
    params = fit(voted, names)
    out = voted.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(names, params))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
