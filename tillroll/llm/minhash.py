"""Near-duplicates by SetSketch registers.

1. A document's set is its distinct five-word shingles.  Documents with equal
   sets are one class, whose smallest doc_id stands for it, so a group of
   copies never meets itself.
2. Each class gets a sketch of ``M`` registers.  A shingle draws one value from
   each of M equally likely slices of an exponential distribution and deals
   them to the registers by a keyed permutation; slices above what all registers
   hold already are never drawn.  A register keeps the smallest value x as
   ``floor(1 - log_base(x))``: sketches of unions are the register maxima, and
   equal registers are as likely as the sets are similar.
3. Bands of ``ROWS`` registers are hashed; classes that share a band are
   candidates.  In each band's bucket, every class is first compared with the
   smallest one only, and linked classes become components.
4. Buckets that still hold several components go on.  Shingles that no other
   class there has can't be shared, which bounds the similarity to any partner;
   classes it rules out leave.  Of the rest, those outside the bucket's largest
   component are compared with the others in blocks of whole sets, counting over
   postings.  So a bucket of near copies makes about as many pairs as it has
   members, and no pair that could join two components is left out or capped.
5. A pair of step 3 is dropped if the joint likelihood of both sketches (given
   the exact set sizes) rules out the threshold; what is left is verified on
   full sets, made from the two texts.

At the threshold itself a pair shares no band with probability (1 - 0.75**4)**32
= 5e-6, less above it.

Defined cases: a document with fewer than five words has its whole sequence as
one shingle; without words or text it is linked with nothing and is its own
component; so is a row without a doc_id (component null, kept).  Rows that
repeat a doc_id are one node whose texts may each make its links, so the
classes of its texts are linked with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.components import components
from tillroll.llm.shingles import mix64, shingle_hashes, slices
from tillroll.llm.text import table
from tillroll.storage import written

M = 131  # prime, so that any start and step walk through all registers
BANDS, ROWS = 32, 4
BASE, RATE = 1.001, 20.0
THRESHOLD = (75, 100)
#: Natural logarithm of the likelihood ratio beyond which a pair is ruled out.
RULED_OUT = 16.0
_U = np.uint64


def sketch(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16, rows x M) of rows given as shingle hashes and row begins; no shingle: zeros."""
    rows = len(begins) - 1
    lowest = np.full(rows * M, np.inf)
    row = np.repeat(np.arange(rows), np.diff(begins))
    start = (mix64(values ^ _U(0x5851F42D4C957F2D)) % _U(M)).astype(np.int64)
    step = (mix64(values ^ _U(0x14057B7EF767814F)) % _U(M - 1)).astype(np.int64) + 1
    with np.errstate(over="ignore"):
        for j in range(M):
            if not len(row):
                break
            draws = mix64(values + _U((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
            at = (draws >> _U(11)).astype(np.float64) * 2.0**-53
            np.minimum.at(lowest, row * M + (start + j * step) % M, (j + at) / M)
            # Done are the rows whose registers all lie below the next slice.
            open_rows = lowest.reshape(rows, M).max(axis=1, initial=0.0) > (j + 1) / M
            go = open_rows[row]
            if not go.all():
                row, values, start, step = row[go], values[go], start[go], step[go]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = -np.log1p(-lowest.clip(1e-300, 1 - 1e-16)) / RATE
        registers = np.floor(1 - np.log(x) / np.log(BASE))
    registers[np.isinf(lowest)] = 0
    return registers.clip(0, 65535).astype(np.uint16).reshape(rows, M)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band and row (rows x BANDS)."""
    used = registers[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    with np.errstate(over="ignore"):
        salt = mix64(np.arange(BANDS * ROWS, dtype=np.uint64).reshape(BANDS, ROWS) + _U(77))
        return mix64(mix64(used * _U(0x9FB21C651E98DF25) + salt).sum(axis=2, dtype=np.uint64))


def likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float):
    """Joint estimate from two sketches: (most likely Jaccard similarity, log ratio of that against ``least``)."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = M - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def score(j):
        part = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
        up, down = part(np.maximum(u - v * j, 1e-9)), part(np.maximum(v - u * j, 1e-9))
        with np.errstate(divide="ignore"):
            return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-9))

    grid = np.linspace(0.0, 1.0, 101)[None, :] * top
    scores = score(grid)
    best = scores.argmax(axis=1)
    at = np.arange(len(best))
    return grid[at, best], scores[at, best] - score(np.minimum(least, top))[:, 0]


SKETCHED = "doc_id long, n long, f1 long, f2 long, registers binary"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> set size, two fingerprints of the whole set, registers."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1):
                values, begins, _ = shingle_hashes(part.column(1))
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ _U(k)), dtype=np.uint64)]) for k in (1, 2)]
                with np.errstate(over="ignore"):
                    prints = [(s[begins[1:]] - s[begins[:-1]]).view(np.int64) for s in sums]
                registers = sketch(values, begins)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(begins)), pa.array(prints[0]), pa.array(prints[1]),
                     pa.array([r.tobytes() for r in registers], pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SKETCHED)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def _buckets(classes: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            keys = band_keys(_registers(batch.column(2))).view(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], names=["key", "rep", "n"]
            )

    return classes.select("rep", "n", "registers").mapInArrow(scan, "key long, rep long, n long")


def _length_fits(n_a, n_b):
    return F.least(n_a, n_b) * THRESHOLD[1] >= F.greatest(n_a, n_b) * THRESHOLD[0]


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose sketches don't rule the threshold out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    least = THRESHOLD[0] / THRESHOLD[1]

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
            best, ratio = likelihood(_registers(batch.column(4)), _registers(batch.column(5)), n_a, n_b, least)
            stays = pa.array((best >= least) | (ratio < RULED_OUT))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(stays), batch.column(1).filter(stays)], names=["a", "b"])

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return met.mapInArrow(scan, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets meet the threshold, made from both whole texts."""
    side = lambda x: docs.select(F.col("doc_id").cast("long").alias(x), F.col("text").alias(f"t_{x}"))

    def scan(batches):
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                two = pa.concat_arrays([batch.column(2).slice(i, 1), batch.column(3).slice(i, 1)])
                values, begins, _ = shingle_hashes(two)
                a, b = values[: begins[1]], values[begins[1] :]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if shared and THRESHOLD[1] * shared >= THRESHOLD[0] * (len(a) + len(b) - shared):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")
    return met.mapInArrow(scan, "a long, b long").distinct()


def _sets(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, hashes): the whole shingle sets of some classes."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1):
                values, begins, _ = shingle_hashes(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["rep", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(reps, "rep", "left_semi")
    return texts.mapInArrow(scan, "rep long, hashes array<long>")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """How many shingles of each class no other class of ``sets`` has: (__rep, own)."""
    alone = sets.select("rep", F.explode("hashes").alias("s")).groupBy("s").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count(F.lit(1)).alias("c"))
    own = alone.where("c = 1").groupBy(F.col("x").alias("__rep")).agg(F.count(F.lit(1)).alias("own"))
    # A doc_id with several sets could count the shingles of one against another: it counts none.
    several = sets.groupBy(F.col("rep").alias("__several")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return own.join(several, F.col("__rep") == F.col("__several"), "left_anti")


def _shares_enough(shared, n_a, n_b):
    """|A n B| is at least t / (1 + t) of |A| + |B| if the similarity is at least t."""
    return shared * (THRESHOLD[0] + THRESHOLD[1]) >= (n_a + n_b) * THRESHOLD[0]


#: Shingles of one side that a task compares at a time.
BLOCK = 1 << 20


def _compared(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of a bucket, from whole sets.

    ``apart``: (key, rep, n, label, top).  Those outside the bucket's largest component meet all
    others, block by block.  A block counts what a set shares with all sets of the other side in one
    pass over its shingles' postings; no pairs are made, and only one link per set and component leaves.
    """
    rows = apart.join(sets, F.col("rep") == F.col("__rep")).drop("__rep", "n")
    blocks = apart.groupBy(F.col("key").alias("__key")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, F.col("key") == F.col("__key")).drop("__key")
    at, others = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    minor = rows.where("label != top").select("key", "rep", "label", "hashes", at.alias("i"), F.explode(others).alias("j"))
    # New names throughout: both sides come from the same rows.
    whole = rows.select(
        F.col("key").alias("w_key"), F.col("rep").alias("w_rep"), F.col("label").alias("w_label"), F.col("hashes").alias("w_hashes"),
        at.alias("w_j"), F.explode(others).alias("w_i"),
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found, right = [], right.rename_columns([c.removeprefix("w_") for c in right.column_names])
        if left.num_rows and right.num_rows:
            (xs, x_at, x_label), (ys, y_at, y_label) = (
                (np.concatenate(lists) if lists else np.zeros(0, np.int64), np.cumsum([0, *map(len, lists)]), t.column("label").to_numpy())
                for t, lists in ((t, [np.asarray(h.values) for h in t.column("hashes").combine_chunks()]) for t in (left, right))
            )
            sizes = np.diff(y_at)
            order = np.argsort(ys, kind="stable")
            postings, owner = ys[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            x_rep, y_rep = left.column("rep").to_numpy(), right.column("rep").to_numpy()
            for k in range(len(x_rep)):
                own = xs[x_at[k] : x_at[k + 1]]
                low, high = np.searchsorted(postings, own, "left"), np.searchsorted(postings, own, "right")
                n = high - low
                places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                shared = np.bincount(owner[places], minlength=len(sizes))
                good = np.flatnonzero((THRESHOLD[1] * shared >= THRESHOLD[0] * (len(own) + sizes - shared)) & (y_label != x_label[k]))
                if len(good):
                    _, first = np.unique(y_label[good], return_index=True)
                    found += [(int(x_rep[k]), int(y_rep[g])) for g in good[first]]
        return pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    groups = whole.groupBy("w_key", "w_i", "w_j")
    return minor.groupBy("key", "i", "j").cogroup(groups).applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    sketched = written(sketches(docs), "sketches")
    same_set = ["n", "f1", "f2"]
    classes = written(
        sketched.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        .groupBy(*same_set)
        .agg(F.min(F.struct("doc_id", "registers")).alias("first"))
        .select(*same_set, F.col("first.doc_id").alias("rep"), F.col("first.registers").alias("registers")),
        "classes",
    )

    # A doc_id whose rows have different sets is a node that its classes are linked with.
    least, most = F.min(F.struct(*same_set)).alias("least"), F.max(F.struct(*same_set)).alias("most")
    several = sketched.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__d")).agg(least, most)
    several = written(several.where("least != most").select("__d"), "several")
    repeated = several.limit(1).count() > 0
    by_doc = sketched.select("doc_id", *[F.col(c).alias(f"__{c}") for c in same_set]).join(several, F.col("doc_id") == F.col("__d"), "left_semi")
    by_doc = classes.select("rep", *same_set).join(by_doc, [F.col(c) == F.col(f"__{c}") for c in same_set])
    by_doc = by_doc.where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

    # Every member of a bucket beside the bucket's smallest one; buckets of one are left out.
    buckets = _buckets(classes)
    leaders = (
        buckets.groupBy("key")
        .agg(F.min(F.struct("rep", "n")).alias("l"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .select(F.col("key").alias("__key"), "size", F.col("l.rep").alias("leader"), F.col("l.n").alias("leader_n"))
    )
    members = written(buckets.join(leaders, F.col("key") == F.col("__key")).drop("__key"), "buckets")

    stars = members.where((F.col("rep") != F.col("leader")) & _length_fits(F.col("n"), F.col("leader_n")))
    stars = stars.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(_verified(written(_likely(stars, classes), "likely"), docs), "links")
    if repeated:
        links = links.union(written(by_doc, "by_doc"))
    labels = components(links)

    def apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components: their label, and the bucket's largest one."""
        own = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
        rows = rows.join(own, F.col("rep") == F.col("__node"), "left").withColumn("label", F.coalesce("__label", "rep"))
        counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        largest = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
        mixed = largest.where("labels > 1").select(F.col("key").alias("__key"), F.col("top.label").alias("top"))
        return written(rows.join(mixed, F.col("key") == F.col("__key")).drop("__key", "__node", "__label"), "apart")

    still = apart(members.where("size > 2 AND rep != leader").select("key", "rep", "n"), labels)
    sets = written(_sets(still.select("rep").distinct(), docs), "sets")
    # A class whose own shingles alone rule out a partner of any size leaves.
    may = sets.join(_own_shingles(sets), F.col("rep") == F.col("__rep"), "left").where(
        _shares_enough(F.size("hashes") - F.coalesce("own", F.lit(0)), F.size("hashes"), F.size("hashes") * THRESHOLD[0] / THRESHOLD[1])
    )
    links = links.union(written(_compared(still, may.select(F.col("rep").alias("__rep"), "hashes")), "links"))
    labels = components(links, labels)

    own = labels.select(F.col("node").alias("__node"), "label")
    component = classes.drop("registers").join(own, F.col("rep") == F.col("__node"), "left").select(
        *[F.col(c).alias(f"__{c}") for c in same_set], F.coalesce("label", "rep").alias("component")
    )
    out = sketched.drop("registers").join(component, [F.col(c) == F.col(f"__{c}") for c in same_set], "left")
    if repeated:
        # A row without words has no class, but its doc_id may.
        nodes = labels.select(F.col("node").alias("__of"), F.col("label").alias("__component"))
        out = out.join(nodes, (F.col("n") == 0) & (F.col("doc_id") == F.col("__of")), "left")
        out = out.withColumn("component", F.coalesce("component", "__component"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"),
        F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"),
    )


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# All pairs with a common shingle, counted; components by passing on every smaller id.
ORACLE = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]))
                         WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM words
), shingles AS (
  SELECT r, unnest(s) AS g FROM sets WHERE doc_id IS NOT NULL
), shared AS (
  SELECT a.r AS ra, b.r AS rb, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shared JOIN sets x ON x.r = ra JOIN sets y ON y.r = rb
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), reach AS (
  SELECT doc_id AS node, doc_id AS label FROM sets WHERE doc_id IS NOT NULL
  UNION
  SELECT b, label FROM reach JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) e ON e.a = node WHERE label < b
), smallest AS (
  SELECT node, min(label) AS label FROM reach GROUP BY node
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, label AS component_id, coalesce(label = doc_id, true) AS kept
FROM sets LEFT JOIN smallest ON node = doc_id
"""
