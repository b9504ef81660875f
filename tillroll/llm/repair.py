"""Conversation structure repair at least cost, by tables of symbol blocks.

A conversation is read as a string with one symbol a row: the initial of its
role and its first fault.  Edits turn it into role initials ``(s?(ua)+)?``, a
machine of four states, so the cost of finishing from each state is a vector
of four numbers, worked out from the end.

Four-Russians tables: vectors less their least entry are few, so for every one
of them and every block of ``BLOCK`` symbols the vector before the block is
worked out once, and a conversation is read block by block by lookup.  Tracing
goes through the blocks forward; a block is expanded backward, from the vector
behind it, and each edit is the ASCII-least one that can still be finished at
least cost, so the audit is the least of all cheapest ones.  Expanded blocks
are kept as (state, vector behind, block) -> (edits, state).

How it runs: rows are ordered by range partitioning and written once, each with
its range and place.  Symbols are gathered into segments of at most ``CHUNK``
rows, one or two characters a row; a conversation's segments pass one task as a
stream, last to first for the vectors and first to last for the edits, and the
task holds one segment.  Texts meet their edits in a second stream, which holds
one row.

Defined cases: rows of a conversation come by turn (nulls first), rows of a
turn by role and text (their first 64 characters, then the whole); repeated
rows are rows of their own, so all but the first are duplicates; a null conv_id
is a conversation; null roles and texts become one space before anything else,
as do a null conv_id and turn where they are hashed; a role with another
initial, or none, is rerolled or deleted; ``gaps`` is null beyond 64 bits; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import SPACES, table
from tillroll.storage import written

#: Costs of the edits, and the added cost of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols of a block, and rows of a segment.
BLOCK, CHUNK = 3, 8192

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state a forced turn leads to, its role, and the states that may keep a row with an initial.
FORCED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: Cost of finishing behind the last row: inserts up to an assistant's turn.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbols of rows: initial (other: o) by fault (none, truncated, duplicate, blank); to the machine faulty rows to be deleted are alike.
INITIALS, FAULTS = "suao", "-tdb"
SYMBOL = {(i, f): chr(ord("A") + 4 * INITIALS.index(i) + FAULTS.index(f)) for i in INITIALS for f in FAULTS}
_CLASS = str.maketrans({c: "x" if f in "db" else i.upper() if f == "t" else i for (i, f), c in SYMBOL.items()})
_INITIAL = str.maketrans({c: i for (i, f), c in SYMBOL.items()})
CLASSES = "suaoSUAOx"


# --- the tables ----------------------------------------------------------------------------------

def edits(state: int, symbol: str) -> list[tuple[str, int, int, bool]]:
    """(initial, cost, next state, row used) of the edits at a row, in ASCII order."""
    out = [("D", DELETE, state, True), ("I", INSERT, FORCED[state], False)]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        kept = KEPT[symbol.lower()].get(state)
        if kept is not None:
            out.append(("K", KEEP + more, kept, True))
        out.append(("R", REROLE + more, FORCED[state], True))
    return out


def before(vector: tuple, symbol: str) -> tuple:
    """Costs of finishing ahead of a row, from the costs behind it."""
    costs = [min(cost + vector[to] for _, cost, to, used in edits(q, symbol) if used) for q in range(4)]
    for _ in range(2):  # START and SYSTEM reach ASSISTANT by two inserts; a longer chain is a circle.
        costs = [min(c, INSERT + costs[FORCED[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _normal(vector: tuple) -> tuple[tuple, int]:
    least = min(vector)
    return tuple(c - least for c in vector), least


@lru_cache(maxsize=1)
def tables() -> tuple[dict, dict]:
    """(vector, symbol) and (vector, block) -> (vector before, added cost), for all vectors that occur."""
    single, queue = {}, [_normal(END)[0]]
    known = set(queue)
    while queue:
        vector = queue.pop()
        for symbol in CLASSES:
            single[vector, symbol] = _normal(before(vector, symbol))
            if single[vector, symbol][0] not in known:
                known.add(single[vector, symbol][0])
                queue.append(single[vector, symbol][0])
    blocks = {}
    for vector in known:
        for symbols in product(CLASSES, repeat=BLOCK):
            at, cost = vector, 0
            for symbol in reversed(symbols):
                at, more = single[at, symbol]
                cost += more
            blocks[vector, "".join(symbols)] = at, cost
    return single, blocks


@lru_cache(maxsize=1 << 18)
def expand(state: int, behind: tuple, block: str) -> tuple[str, int]:
    """The edits of a block entered in a state, and the state behind it."""
    costs = [behind]
    for symbol in reversed(block):
        costs.append(before(costs[-1], symbol))
    costs.reverse()
    out, row = [], 0
    while row < len(block):
        for letter, cost, to, used in edits(state, block[row]):
            if cost + costs[row + used][to] == costs[row][state]:
                out.append(letter)
                state, row = to, row + used
                break
    return "".join(out), state


def read_back(symbols: str, behind: tuple) -> tuple[tuple, int]:
    """The vector before a string of symbol classes, and the added cost, by lookup from its end."""
    single, blocks = tables()
    cost, full = 0, len(symbols) - len(symbols) % BLOCK
    for symbol in reversed(symbols[full:]):
        behind, more = single[behind, symbol]
        cost += more
    for i in range(full - BLOCK, -1, -BLOCK):
        behind, more = blocks[behind, symbols[i : i + BLOCK]]
        cost += more
    return behind, cost


def trace(state: int, symbols: str, behind: tuple) -> tuple[str, int]:
    """The edits of a string of symbol classes, and the state behind it."""
    single, blocks = tables()
    full = len(symbols) - len(symbols) % BLOCK
    cuts = [symbols[i : i + BLOCK] for i in range(0, full, BLOCK)] + list(symbols[full:])
    vectors = [behind]
    for cut in reversed(cuts):
        vectors.append((blocks if len(cut) == BLOCK else single)[vectors[-1], cut][0])
    vectors.reverse()
    out = []
    for i, cut in enumerate(cuts):
        letters, state = expand(state, vectors[i + 1], cut)
        out.append(letters)
    return "".join(out), state


def closing(state: int) -> str:
    """Inserts behind the last row."""
    return "I" * (END[state] // INSERT)


# --- rows -----------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Damaged rows; ``copies`` is 2 where a row is repeated, and dropped rows are gone."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"),
    )
    return rows.where("kind != 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with their range, chunk and place, ordered within their ranges and written."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    heads = [F.substring("role", 1, 64), F.substring("text", 1, 64)]
    order = [F.col("conv_id"), F.col("turn"), *heads]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "role", "text")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn("range", F.spark_partition_id()).withColumn("place", place)
    return written(ranged.withColumn("chunk", F.call_function("div", F.col("place"), F.lit(CHUNK))), "turns")


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[f"__{c}"])
    return out


def _prefixed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in columns})


def segments(ordered: DataFrame) -> DataFrame:
    """(conv_id, range, chunk, symbols): the symbols of at most ``CHUNK`` rows of a conversation."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    rows = ordered.select(
        "conv_id", "range", "chunk", "place", "copies", "role",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.when(last == "", "b").when(last.isin(".", "!", "?"), "-").otherwise("t").alias("fault"),
    )
    # Only texts that a conversation says more than once meet the rows again.
    where = F.struct("range", "place")
    said = rows.where("fault != 'b'").groupBy("conv_id", "role", "digest").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("times"))
    said = _prefixed(said.where("times > 1").drop("times"), "conv_id", "role", "digest")
    met = rows.join(said, _same(rows, said, "conv_id", "role", "digest"), "left")
    later = F.col("first").isNotNull() & (F.struct("range", "place") > F.col("first"))
    fault = F.when((F.col("fault") != "b") & later, "d").otherwise(F.col("fault"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    named = F.create_map(*[F.lit(x) for key, c in SYMBOL.items() for x in ("".join(key), c)])
    again = F.when(F.col("__f") == "b", "b").otherwise("d")
    symbol = F.concat(named[F.concat("__i", "__f")], F.when(F.col("copies") == 2, named[F.concat(F.col("__i"), again)]).otherwise(""))
    coded = met.select("conv_id", "range", "chunk", "place", initial.alias("__i"), fault.alias("__f"), "copies").select(
        "conv_id", "range", "chunk", F.struct("place", symbol.alias("symbol")).alias("s"))
    gathered = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["symbol"])
    return coded.groupBy("conv_id", "range", "chunk").agg(F.array_join(gathered, "").alias("symbols"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SEGMENT = [("conv_id", pa.int64()), ("range", pa.int32()), ("chunk", pa.int64()), ("symbols", pa.string())]
_COSTED = pa.schema([*_SEGMENT, ("behind", pa.list_(pa.int64())), ("cost", pa.int64())])
_TRACED = pa.schema([*_SEGMENT, ("cost", pa.int64()), ("state", pa.int64()), ("edits", pa.string()), ("illegal", pa.int64())])
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                       ("text", pa.string()), ("edit", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _costed(batches):
    """Segments of a conversation from the last to the first: the vector behind each, and the cost from its start."""
    def rows():
        now = object()
        for conv, at, chunk, symbols in _rows(batches):
            if conv != now:
                now, (vector, cost) = conv, _normal(END)
            behind = vector
            vector, more = read_back(symbols.translate(_CLASS), vector)
            cost += more
            yield conv, at, chunk, symbols, list(behind), cost + vector[START]
    return _batches(rows(), _COSTED)


def _legal(initials: str) -> int:
    return sum(initials.count(pair) for pair in ("su", "ua", "au"))


def _traced(batches):
    """Segments from the first to the last: the state each is entered in, its edits and illegal neighbours.

    Inserts behind the last row are added when the conversation ends, so a segment waits for its successor.
    """
    def rows():
        waiting = None
        for conv, at, chunk, symbols, behind, cost in _rows(batches):
            initials = symbols.translate(_INITIAL)
            if waiting and waiting[0] == conv:
                yield waiting
                joint = last + initials[0]
            else:
                if waiting:
                    yield (*waiting[:6], waiting[6] + closing(state), waiting[7])
                state, joint = START, ""
            entered = state
            letters, state = trace(state, symbols.translate(_CLASS), tuple(behind))
            pairs = len(initials) - 1 + (len(joint) == 2)
            illegal = pairs - _legal(initials) - _legal(joint)
            last = initials[-1]
            waiting = (conv, at, chunk, symbols, cost, entered, letters, illegal)
        if waiting:
            yield (*waiting[:6], waiting[6] + closing(state), waiting[7])
    return _batches(rows(), _TRACED)


def traced(ordered: DataFrame) -> DataFrame:
    """Segments with the state they are entered in and their edits."""
    found = written(segments(ordered), "segments").select(*[c for c, _ in _SEGMENT]).repartition("conv_id")
    costed = found.sortWithinPartitions("conv_id", F.desc("range"), F.desc("chunk")).mapInArrow(_costed, _ddl(_COSTED))
    # The partitioning by conversation holds, but Spark can't know it after Python.
    costed = costed.repartition("conv_id").sortWithinPartitions("conv_id", "range", "chunk")
    return written(costed.mapInArrow(_traced, _ddl(_TRACED)), "edits")


def _edited(batches):
    """Rows and, ahead of each segment's rows, its edits -> repaired rows."""
    def rows():
        now, letters, at, state, seq = object(), "", 0, START, 0

        def inserted():
            nonlocal at, state, seq
            while at < len(letters) and letters[at] == "I":
                state, at, seq = FORCED[state], at + 1, seq + 1
                yield now, seq, None, ROLE[state], "", "I"

        for conv, turn, role, text, copies, marks, entered in _rows(batches):
            if marks is not None:
                yield from inserted()
                if conv != now:
                    now, seq = conv, 0
                letters, at, state = marks, 0, entered
                continue
            for _ in range(copies):
                yield from inserted()
                letter, at = letters[at], at + 1
                if letter == "K":
                    state = KEPT[role[0]][state]
                elif letter == "R":
                    state = FORCED[state]
                    role_now = ROLE[state]
                if letter != "D":
                    seq += 1
                    yield conv, seq, turn, role_now if letter == "R" else role, text, letter
        yield from inserted()
    return _batches(rows(), _REPAIRED)


def repaired(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """Repaired rows (conv_id, seq from 1, turn, role, text, edit); inserted rows have no turn.

    Partitioned by conversation, and in order within a partition.
    """
    ours = ordered.select("conv_id", "range", "chunk", "place", "turn", "role", "text", "copies",
                          F.lit(None).cast("string").alias("marks"), F.lit(None).cast("long").alias("state"))
    marks = found.select(
        "conv_id", "range", "chunk", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.col("edits").alias("marks"), "state")
    both = ours.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "range", "chunk", "place")
    return both.select("conv_id", "turn", "role", "text", "copies", "marks", "state").mapInArrow(_edited, _ddl(_REPAIRED))


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _digests(batches):
    def rows():
        now, digest = object(), None
        for conv, seq, _, role, text, _ in _rows(batches):
            if conv != now:
                if digest:
                    yield now, digest.hexdigest()
                now, digest = conv, hashlib.sha256()
            digest.update((f"{role}:{text}" if seq == 1 else f"\n{role}:{text}").encode())
        if digest:
            yield now, digest.hexdigest()
    return _batches(rows(), _DIGESTS)


def report(conversations: DataFrame, ordered: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``; ``ordered`` has its rows, damaged or as they are."""
    found = traced(ordered)
    count = lambda fault: F.sum(F.length(F.regexp_replace(
        "symbols", "[^" + "".join(SYMBOL[i, fault] for i in INITIALS) + "]", ""))).cast("long")
    told = F.transform(F.array_sort(F.collect_list(F.struct("range", "chunk", "edits"))), lambda x: x["edits"])
    sums = found.groupBy("conv_id").agg(
        count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
        F.sum("illegal").alias("illegal"), F.min_by("cost", F.struct("range", "chunk")).alias("cost"),
        F.array_join(told, "").alias("audit"),
    )
    wide = lambda c: c.cast("decimal(38,0)")
    turns = ordered.groupBy("conv_id").agg(
        F.coalesce(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.countDistinct("turn"), F.lit(0)).try_cast("long").alias("gaps"))
    digests = repaired(ordered, found).mapInArrow(_digests, _ddl(_DIGESTS))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (turns, sums, digests):
        part = _prefixed(part, "conv_id")
        out = out.join(part, _same(out, part, "conv_id"), "left").drop("__conv_id")
    gaps = F.when(F.col("cost").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps")
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", gaps, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op11_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return report(conversations, in_order(damage(conversations)))


# --- the statement that checks it -----------------------------------------------------------------

def _plus(best: str, cost: str, letter: str) -> str:
    """SQL: a state's best, eight digits of cost and then the audit, with an edit added (null stays null)."""
    return f"lpad((left({best}, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({best}, 9) || '{letter}'"


#: A forward search that keeps, for each state, the least (cost, audit) that leads there.
ORACLE = f"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) AS r(i)
), spaced AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), kinds AS (
    SELECT spaced.*, xor(list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM spaced, crc
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
           left(role, 1) AS i,
           right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
    FROM damaged
), faulty AS (
    SELECT *, ending = '' AS blank,
           ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup,
           lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au') AS illegal
    FROM numbered
), turns AS (
    SELECT *, blank OR dup AS gone, (NOT blank AND NOT dup AND ending NOT IN ('.', '!', '?'))::INT AS cut FROM faulty
), search(conv_id, n, b0, b1, b2, b3) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, '00000000', NULL::VARCHAR, '00000002I', '00000004II' FROM turns
    UNION ALL
    SELECT conv_id, n, b0, b1, least(b2, {_plus("b3", "2", "I")}), b3 FROM (
        SELECT conv_id, n, b0, b1, b2, least(b3, {_plus("b2", "2", "I")}) AS b3 FROM (
            SELECT conv_id, n, b0, b1, least(b2, {_plus("b0", "2", "I")}, {_plus("b1", "2", "I")}) AS b2, b3 FROM (
                SELECT s.conv_id, t.n, {_plus("b0", "3", "D")} AS b0,
                    least({_plus("b1", "3", "D")}, CASE WHEN NOT gone AND i = 's' THEN {_plus("b0", "cut", "K")} END) AS b1,
                    least({_plus("b2", "3", "D")},
                        CASE WHEN NOT gone AND i = 'u' THEN least({_plus("b0", "cut", "K")}, {_plus("b1", "cut", "K")}, {_plus("b3", "cut", "K")}) END,
                        CASE WHEN NOT gone THEN least({_plus("b0", "2 + cut", "R")}, {_plus("b1", "2 + cut", "R")}, {_plus("b3", "2 + cut", "R")}) END) AS b2,
                    least({_plus("b3", "3", "D")},
                        CASE WHEN NOT gone AND i = 'a' THEN {_plus("b2", "cut", "K")} END,
                        CASE WHEN NOT gone THEN {_plus("b2", "2 + cut", "R")} END) AS b3
                FROM search s JOIN turns t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = s.n + 1)))
), ends AS (
    SELECT conv_id, max_by(least(b0, b3), n) AS best FROM search GROUP BY conv_id
), told AS (
    SELECT conv_id, left(best, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM ends
), letters AS (
    SELECT conv_id, substr(audit, p, 1) AS e, p FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM told)
), placed AS (
    SELECT *, sum((e <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS n,
           sum((e <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS seq
    FROM letters
), joined AS (
    SELECT l.*, t.role, t.text, max((l.seq = 1 AND e = 'K' AND t.i = 's')::INT) OVER (PARTITION BY l.conv_id) AS opened
    FROM placed l LEFT JOIN turns t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.n = t.n
), digests AS (
    SELECT conv_id, sha256(string_agg(
        CASE WHEN e = 'K' THEN role WHEN (seq - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS digest
    FROM joined WHERE e <> 'D' GROUP BY conv_id
), sums AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
           sum(dup::INT) AS duplicate, sum(cut) AS truncated, sum(coalesce(illegal, false)::INT) AS illegal
    FROM turns GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id
LEFT JOIN told ON c.conv_id IS NOT DISTINCT FROM told.conv_id
LEFT JOIN digests ON c.conv_id IS NOT DISTINCT FROM digests.conv_id
"""
