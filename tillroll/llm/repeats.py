"""Removing repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier
(in a smaller doc_id, or before in the same document).

1. Runs.  Each window of WIDTH bytes has an anchor, the K bytes in it with the
   smallest hash.  Consecutive windows with the same anchor form a run of 100 to
   168 bytes.  Equal windows have equal anchors, so they lie in runs with the
   same anchor hash, wherever they are.
2. Equal runs.  Runs with equal anchor and equal content are settled by their
   first place: all later ones go entirely.  Each task first settles its own
   runs and sends on one of each kind, so a passage that a third of all
   documents share arrives once per task, not once per document.
3. Different runs with the same anchor may still share windows.  Only these are
   looked up in the texts.  Tasks get all runs of their anchors, leave out those
   whose bytes beside the anchor occur in no other, cut the rest into shards,
   build the Burrows-Wheeler transform of each, and merge the transforms by
   refining an interleave: starting from shard after shard, each round stably
   sorts the merged rows by their transform's character and steps to the suffix
   that begins with it, so after h rounds the rows are in order of their first h
   characters, and the rows that differ there for the first time give the common
   prefix lengths.  No suffix of two shards is compared directly.  Here only the
   rows behind the last byte of a window start, a fifth or less of all, and the
   common prefix is asked for WIDTH or not: after WIDTH rounds the intervals
   without a boundary hold the equal windows; all but the earliest of each go.
4. An anchor with more than ``CROWD`` different runs would make a task too large.
   Its windows are hashed (128 bits) and settled by their first place with an
   aggregate instead, which is exact and has no hot group.
5. The spans of each document are united and cut out.

Hashes: anchors and run contents are 64 bits each and count only together.

Defined cases: null and empty texts have no bytes and stay empty; texts shorter
than WIDTH lose nothing; documents that share a doc_id come in order of the
hash of their text, and rows that repeat both are one document (they lose the
same bytes); a null doc_id comes first; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.shingles import _P, _P_INV, _U, mix64, powers, slices, text_bytes
from tillroll.llm.text import table
from tillroll.storage import written

WIDTH, K = 100, 32
#: Different runs of one anchor beyond which its windows are settled by hash.
CROWD = 20_000
#: Bytes of runs a task sorts, and of a shard in it.
TASK_BYTES, SHARD_BYTES = 2 << 20, 1 << 19
#: Ways to share out the bytes beside an anchor that tell runs which share no window before they are sorted.
SPLITS = 8
#: Runs a task settles on its own at a time.
SETTLED_TOGETHER = 1 << 20
#: Bits of a gram's key that hold its place in a slice; the others are its hash, alike in any slice.
PLACE_BITS = 32
#: Stands for a missing doc_id: before all others.
NO_ID = -(2**63)
_BYTE = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, start in the row, windows, anchor hash, content hash, anchor's offset)."""
    n, span = len(raw), WIDTH - K + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    sizes = np.diff(offsets)
    n_windows = np.maximum(sizes - WIDTH + 1, 0)
    if not n_windows.sum():
        return none
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(_P, n), out=sums[1:])
        undo = powers(_P_INV, n)
        grams = mix64((sums[K:] - sums[:-K]) * undo[: n - K + 1])
    # Smallest gram of each window; the low bits hold the place, so the first of equals counts.
    low = _U((1 << PLACE_BITS) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keyed) // span) * span + span, ~_U(0))
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    count = n - WIDTH + 1
    anchor = (np.minimum(ahead[:count], behind[span - 1 : span - 1 + count]) & low).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), n_windows)
    begins = np.cumsum(n_windows) - n_windows
    at = np.arange(len(row)) - np.repeat(begins - offsets[:-1], n_windows)
    anchor = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    start = at[first]
    with np.errstate(over="ignore"):
        content = mix64((sums[start + length - 1 + WIDTH] - sums[start]) * undo[start] + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    row = row[first]
    return row, start - offsets[row], length, grams[anchor[first]].view(np.int64), content.view(np.int64), anchor[first] - start


def united(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each group with those that overlap or touch made one."""
    if not len(group):
        return group, start, end
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    # Groups are laid out one after the other, so that one running maximum serves all.
    shift = np.cumsum(np.append(False, group[1:] != group[:-1])) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(group)) - 1
    return group[first], start[first], reach[last] - shift[last]


def _settle(docs, hashes, doc_at, start, length, anchor, content):
    """The first of equal runs of a task, and the spans of the others."""
    order = np.lexsort((hashes, docs))
    place = np.empty(len(docs), np.int64)
    # Rows that repeat a document have the same place.
    step = np.append(False, (docs[order][1:] != docs[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])) if len(docs) else np.zeros(0, bool)
    place[order] = np.cumsum(step)
    when = (place[doc_at] << 36) + start
    with np.errstate(over="ignore"):
        kind = mix64(anchor.view(np.uint64) ^ mix64(content.view(np.uint64) + _U(0x632BE59BD9B4E019)))
    by = np.lexsort((when, kind))
    same = np.append(False, (anchor[by][1:] == anchor[by][:-1]) & (content[by][1:] == content[by][:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    firsts = by[~same]
    later = by[same & (when[by] > when[by][head])]
    return firsts, later


RUN = "m long, c long, doc long, h int, at long"


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc, h, text) -> rows (m, c, doc, h, at): a run by anchor, content and place, or a span that goes.

    ``at`` holds the start, the anchor's offset (8 bits) and the run's windows (7 bits); 0 windows mean a
    span that goes, whose end is c.
    """

    def scan(batches):
        held, size = [], 0

        def settled():
            docs = np.concatenate([p[0] for p in held])
            hashes = np.concatenate([p[1] for p in held])
            bases = np.cumsum([0, *[len(p[0]) for p in held[:-1]]])
            doc_at = np.concatenate([p[2] + b for p, b in zip(held, bases)])
            start, length, anchor, content, offset = (np.concatenate([p[k] for p in held]) for k in range(3, 8))
            firsts, later = _settle(docs, hashes, doc_at, start, length, anchor, content)
            d, s, e = united(doc_at[later], start[later], start[later] + length[later] - 1 + WIDTH)
            with np.errstate(over="ignore"):
                deal = mix64(docs[d].view(np.uint64) + mix64(s.astype(np.uint64))).view(np.int64)
            f = doc_at[firsts]
            columns = [
                (anchor[firsts], deal), (content[firsts], e), (docs[f], docs[d]), (hashes[f], hashes[d]),
                (start[firsts] << 15 | offset[firsts] << 7 | length[firsts], s << 15),
            ]
            arrays = [pa.array(np.concatenate(c)) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, names=["m", "c", "doc", "h", "at"])

        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                raw, offsets = text_bytes(part.column(2))
                found = runs(raw, offsets)
                if len(found[0]):
                    held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), *found))
                    size += len(found[0])
                if size >= SETTLED_TOGETHER:
                    yield settled()
                    held, size = [], 0
        if held:
            yield settled()

    return docs.mapInArrow(scan, RUN)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes of a text in order, by their first seven characters and then by doubling."""
    n, reach = len(text), 7
    key = np.zeros(n, np.int64)
    for i in range(reach):
        # Nine bits each; 0 stands behind the end.
        key <<= 9
        key[: max(0, n - i)] += text[i:].astype(np.int64) + 1
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (n + 1) + second
        reach *= 2


class Shard:
    """The Burrows-Wheeler transform of some strings: characters, where each row steps to, and row -> text position."""

    def __init__(self, strings: list[bytes]):
        # Characters are bytes plus one; 0 ends each string.  (No byte of UTF-8 text is 255.)
        joined = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)
        # In full order: steps by the transform alone then lead from each suffix to the very one before it.
        self.order = suffix_order(joined)
        self.transform = joined[self.order - 1]
        self.step = np.empty(len(joined), np.int32)
        self.step[np.argsort(self.transform, kind="stable")] = np.arange(len(joined), dtype=np.int32)
        # Row r's character, put before its suffix, gives the row with this number.
        sizes = np.array([len(s) + 1 for s in strings])
        self.string = np.repeat(np.arange(len(strings)), sizes)
        self.offset = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def merge(shards: list[Shard], depth: int, ends: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refine the interleave of shard transforms: (shard, row) of each merged row, and common prefix lengths.

    The length at a row counts the characters it shares with the row before; ``depth`` means that many or more.
    ``ends`` starts from these rows of each shard alone: each round steps them one character back, and their
    order among themselves is the same as with all others between them.  The suffixes of a round are then not
    those of the round before, so lengths below ``depth`` are told as 0.
    """
    bases = np.cumsum([0, *[len(s.transform) for s in shards]]).astype(np.int32)
    transform = np.concatenate([s.transform for s in shards])
    step = np.concatenate([s.step + b for s, b in zip(shards, bases)])
    rows = np.arange(len(transform), dtype=np.int32)
    if ends is not None:
        rows = np.concatenate([e.astype(np.int32) + b for e, b in zip(ends, bases)])
    block = np.zeros(len(rows), np.int32)
    edge = np.zeros(len(rows), bool)
    edge[:1] = True
    prefix = np.full(len(rows), depth, np.uint16)
    prefix[:1] = 0
    for h in range(depth):
        characters = transform[rows]
        order = np.argsort(characters, kind="stable")
        characters, block, rows = characters[order], block[order], step[rows[order]]
        edge[1:] = (characters[1:] != characters[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(edge, dtype=np.int32)
        if ends is None:
            prefix[edge & (prefix == depth)] = h
    if ends is not None:
        prefix[edge] = 0
    shard = np.searchsorted(bases, rows, side="right") - 1
    return shard, rows - bases[shard], prefix


def repeated_windows(strings: list[bytes], when: np.ndarray, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WIDTH bytes that occur earlier: (string, offset).  ``when``: the place of each string's first window."""
    shards, begin, held, firsts = [], 0, 0, []
    for i, s in enumerate(strings):
        held += len(s) + 1
        if held >= shard_bytes or i == len(strings) - 1:
            shards.append(Shard(strings[begin : i + 1]))
            firsts.append(begin)
            begin, held = i + 1, 0
    # A window is read backward from the row behind its last byte; no other row can reach one.
    shard, row, prefix = merge(shards, WIDTH, [np.flatnonzero(s.offset[s.order] >= WIDTH) for s in shards])
    string, offset = (np.empty(len(row), np.int64) for _ in range(2))
    for k, s in enumerate(shards):
        of = shard == k
        at = s.order[row[of]]
        string[of], offset[of] = s.string[at] + firsts[k], s.offset[at]
    interval = np.cumsum(prefix < WIDTH)
    if not len(string):
        return string, offset
    place = when[string] + offset
    heads = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    earliest = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(interval))))
    later = place > earliest
    return string[later], offset[later]


PIECE = "m long, doc long, h int, start int, content binary, anchor int"
SPAN = "doc long, h int, s int, e int"


def _pieces(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of runs, from the texts: each text meets the list of its own runs."""
    lists = reps.groupBy("doc", "h").agg(F.collect_list(F.struct("m", "at")).alias("runs"))
    lists = lists.select(F.col("doc").alias("__d"), F.col("h").alias("__h"), "runs")
    met = docs.join(lists, (F.col("doc") == F.col("__d")) & (F.col("h") == F.col("__h")))

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 2):
                flat = part.column(3).flatten()
                at = flat.field(1).to_numpy()
                start, n, anchor = at >> 15, at & 127, (at >> 7) & 255
                of = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column(3)).to_numpy())
                texts = [(t.as_py() or "").encode() for t in part.column(2)]
                content = [texts[i][b : b + k - 1 + WIDTH] for i, b, k in zip(of.tolist(), start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [flat.field(0), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)),
                     pa.array(start.astype(np.int32)), pa.array(content, pa.binary()), pa.array(anchor.astype(np.int32))],
                    names=["m", "doc", "h", "start", "content", "anchor"],
                )

    # A repeated row of a document brings its runs again, with the same places, which changes nothing.
    return met.select("doc", "h", "text", "runs").mapInArrow(scan, PIECE)


_PIECES = pa.schema([("m", pa.int64()), ("doc", pa.int64()), ("h", pa.int32()), ("start", pa.int32()), ("content", pa.binary()), ("anchor", pa.int32())])


def _may_share(m: list[int], content: list[bytes], anchor: list[int]) -> list[int]:
    """Runs that may share a window with another of their anchor.

    A window holds WIDTH - K bytes beside the anchor, some before it and the others behind.  Whatever
    the share, for one of the ``SPLITS`` pairs below it holds so many bytes before and so many behind:
    a run that shares no pair's bytes with another shares no window.
    """
    beside = WIDTH - K
    cuts = [beside * i // SPLITS for i in range(SPLITS + 1)]
    pairs = [(before, beside - after) for before, after in zip(cuts, cuts[1:])]
    sides, seen = [], Counter()
    for k, c, a in zip(m, content, anchor):
        own = [(k, j, c[a - x : a + K + y]) for j, (x, y) in enumerate(pairs) if x <= a and a + K + y <= len(c)]
        sides.append(own)
        seen.update(own)
    return [i for i, own in enumerate(sides) if any(seen[x] > 1 for x in own)]


def _sorted_spans(pieces: DataFrame, parts: int) -> DataFrame:
    """Spans that go, from merged transforms: all runs of an anchor are in one of ``parts`` tasks."""

    def scan(batches):
        held = pa.Table.from_batches(list(batches), schema=_PIECES)
        held = held.take(pa.array(_may_share(*(held.column(k).to_pylist() for k in ("m", "content", "anchor"))), pa.int64()))
        if not held.num_rows:
            return
        doc, h, start = (held.column(k).to_numpy() for k in ("doc", "h", "start"))
        order = np.lexsort((h, doc))
        place = np.empty(len(doc), np.int64)
        place[order] = np.cumsum(np.append(False, (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])))
        string, offset = repeated_windows(held.column("content").to_pylist(), (place << 36) + start)
        s = start[string].astype(np.int64) + offset
        first = np.empty(int(place.max()) + 1, np.int64)
        first[place] = np.arange(len(place))
        d, s, e = united(place[string], s, s + WIDTH)
        at = first[d]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(h[at]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc", "h", "s", "e"]
        )

    return pieces.repartition(parts, "m").mapInArrow(scan, SPAN)


def _hashed_spans(pieces: DataFrame) -> DataFrame:
    """Spans that go, for crowded anchors: the earliest place of each window by an aggregate."""

    def scan(batches):
        for batch in batches:
            rows = [(i, k, hashlib.blake2b(c[k : k + WIDTH], digest_size=16).digest())
                    for i, c in enumerate(batch.column(4).to_pylist()) for k in range(len(c) - WIDTH + 1)]
            at = pa.array([r[0] for r in rows], pa.int64())
            starts = pa.compute.add(batch.column(3).take(at), pa.array([r[1] for r in rows], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(at), batch.column(2).take(at), starts, pa.array([r[2] for r in rows], pa.binary())], names=["doc", "h", "s", "w"]
            )

    windows = written(pieces.mapInArrow(scan, "doc long, h int, s int, w binary"), "windows")
    earliest = windows.groupBy("w").agg(F.min(F.struct("doc", "h", "s")).alias("first"), F.count(F.lit(1)).alias("n"))
    earliest = earliest.where("n > 1").select(F.col("w").alias("__w"), "first")
    later = windows.join(earliest, F.col("w") == F.col("__w")).where(F.struct("doc", "h", "s") > F.col("first"))
    return later.select("doc", "h", "s", (F.col("s") + WIDTH).alias("e"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc, h, text) -> spans (doc, h, s, e) of bytes that go; they may overlap."""
    found = find_runs(docs)
    place = F.struct("doc", "h", "at")
    same, anchor = Window.partitionBy("m", "run", "c"), Window.partitionBy("m", "run")
    judged = (
        found.withColumn("run", F.col("at").bitwiseAND(F.lit(127)) > 0)
        .repartition("m")
        .withColumn("later", place > F.min(place).over(same))
        .withColumn("mixed", F.min("c").over(anchor) != F.max("c").over(anchor))
    )
    judged = written(judged.where("NOT run OR later OR mixed"), "runs")
    start = F.shiftright("at", 15)
    end = F.when(F.col("run"), start + F.col("at").bitwiseAND(F.lit(127)) - 1 + WIDTH).otherwise(F.col("c"))
    out = judged.where("NOT run OR later").select("doc", "h", start.cast("int").alias("s"), end.cast("int").alias("e"))

    # A place stands in a run once, though a repeated row may have brought it twice.
    reps = judged.where("run AND NOT later").select("m", "doc", "h", "at").distinct()
    total = reps.agg(F.sum(F.col("at").bitwiseAND(F.lit(127)) - 1 + WIDTH)).first()[0]
    if not total:
        return out
    crowded = reps.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select(F.col("m").alias("__m"))
    pieces = written(_pieces(reps, docs), "pieces").join(crowded, F.col("m") == F.col("__m"), "left")
    parts = max(1, math.ceil(total / TASK_BYTES))
    out = out.unionByName(_sorted_spans(pieces.where("__m IS NULL").drop("__m"), parts))
    if crowded.limit(1).count():
        out = out.unionByName(_hashed_spans(pieces.where("__m IS NOT NULL").drop("__m")))
    return out


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(docs: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, text) -> figures and a digest of what is left of each text.

    With ``texts`` also what is left, as ``kept``; characters that were cut through are replaced there.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash("text").alias("h"), "text")
    lists = written(spans(keyed), "spans").groupBy("doc", "h").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    lists = lists.select(F.col("doc").alias("__d"), F.col("h").alias("__h"), "gone")
    met = keyed.join(lists, (F.col("doc") == F.col("__d")) & (F.col("h") == F.col("__h")), "left").select("doc", "text", "gone")

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for i in range(part.num_rows):
                    raw = (part.column(1)[i].as_py() or "").encode()
                    gone = part.column(2).slice(i, 1).flatten()
                    s, e = gone.field(0).to_numpy().astype(np.int64), gone.field(1).to_numpy().astype(np.int64)
                    _, s, e = united(np.zeros(len(s), np.int64), s, e)
                    kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)])) if len(s) else raw
                    left = (kept.decode("utf-8", "replace"),) if texts else ()
                    rows.append((len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), *left))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])]
                ids = pa.array([None if d == NO_ID else d for d in part.column(0).to_pylist()], pa.int64())
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=names[: 1 + len(columns)])

    return met.mapInArrow(scan, DONE + ", kept string" * texts)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents"))
