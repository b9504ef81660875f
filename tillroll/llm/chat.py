"""Chat formatting: any known layout -> canonical turns -> one marked string per conversation.

A layout is known by its *fingerprint*, a hash of its sorted nested field
paths.  The fingerprint selects a declarative mapping (which expression gives
the conversation id, the turns, their roles and texts), so prompt/response,
instruction/input/output, message lists and rows by turn all become
(conv_id, turn, role, text).  Tables are fingerprinted by their schema, JSON
records each by its own paths, so one column may mix layouts; all mappings are
applied in one pass.

Template: ``<turn ROLE>TEXT</turn>\\n``.  Inside roles and texts a backslash is
put before each backslash, ``<`` and ``>``, so no control string can occur in
them and the escaping can be undone.

The rows of a conversation are sorted in the shuffle and read as a stream; a
task holds one turn and running digests, however long a conversation is.

Defined cases: null roles and texts are empty; turns are ordered by turn (null
first), ties by role and text; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives no rows; further columns of a
table or fields of a record are ignored if ``OPTIONAL`` names them, else the
layout is unknown: ``LookupError`` says which paths a table has, and a record
becomes one turn of its own with role ``#unknown``.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.text import table
from tillroll.storage import written

TURN = "struct<turn:bigint,role:string,text:string>"


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type: struct fields by name, ``[]`` for list elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def record_paths(value, at: str = "") -> set[str]:
    """The same for a parsed JSON record; an empty list or object shows only its own path."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in record_paths(v, f"{at}[]")}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _list_of(turns: str, role: str, text: str, called: dict[str, str] | None = None):
    """A list of messages; ``called`` translates roles."""
    def named(x: Column) -> Column:
        out = x[role]
        for theirs, ours in (called or {}).items():
            out = F.when(x[role] == theirs, ours).otherwise(out)
        return out

    return lambda at: F.transform(
        at(turns), lambda x, i: F.struct(i.cast("long").alias("turn"), named(x).alias("role"), x[text].alias("text"))
    )


def _said(*turns: tuple[str, str]):
    """Turns with fixed roles; a null text among the optional ones leaves its turn out."""
    return lambda at: F.filter(
        F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), at(t).cast("string").alias("text")) for i, (r, t) in enumerate(turns)]),
        lambda x: x["text"].isNotNull(),
    )


def _instructed(at) -> Column:
    """An instruction and its optional input as one user text, and the output."""
    user = F.concat_ws("\n", at("instruction"), F.when(at("input") != "", at("input")))
    return _said(("user", "user"), ("assistant", "output"))(lambda name: user if name == "user" else at(name))


def _one(turn: str, role: str, text: str):
    """A row or record that is one turn."""
    return lambda at: F.array(F.struct(at(turn).alias("turn"), at(role).alias("role"), at(text).alias("text")))


#: (paths, path of the conversation id, turns).  ``turns`` takes a function from a path to its column.
LAYOUTS = [
    (["conv_id", "turn", "role", "text"], "conv_id", _one("turn", "role", "text")),
    (["conversation.id", "conversation.turn", "message.role", "message.content"], "conversation.id",
     _one("conversation.turn", "message.role", "message.content")),
    (["thread", "index", "speaker", "said"], "thread", _one("index", "speaker", "said")),
    (["id", "messages[].role", "messages[].content"], "id", _list_of("messages", "role", "content")),
    (["id", "conversations[].from", "conversations[].value"], "id",
     _list_of("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    (["id", "prompt", "response"], "id", _said(("user", "prompt"), ("assistant", "response"))),
    (["id", "prompt", "completion"], "id", _said(("user", "prompt"), ("assistant", "completion"))),
    (["id", "instruction", "input", "output"], "id", _instructed),
    (["id", "instruction", "output"], "id", _said(("user", "instruction"), ("assistant", "output"))),
    (["id", "system", "prompt", "response"], "id", _said(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
]
MAPPINGS = {fingerprint(paths): (paths, of, turns) for paths, of, turns in LAYOUTS}
#: Fields that any layout may have besides; no mapping reads them.
OPTIONAL = ["source", "lang", "created", "metadata"]
#: Paths of numbers; all others are read as strings.
NUMBERS = ["turn", "conversation.turn", "index"]


def layout_of(paths) -> str | None:
    """The fingerprint of the mapping for these paths: their own, or that of all but the optional ones."""
    needed = [p for p in paths if re.split(r"[.\[]", p, maxsplit=1)[0] not in OPTIONAL]
    return next((f for f in (fingerprint(paths), fingerprint(needed)) if f in MAPPINGS), None)


def _record_type(paths: list[str], at: str = "") -> T.DataType:
    """The type that has these paths."""
    if paths == [""]:
        return T.LongType() if at in NUMBERS else T.StringType()
    if paths[0].startswith("[]"):
        return T.ArrayType(_record_type([p[2:].removeprefix(".") for p in paths], at + "[]"))
    under: dict[str, list[str]] = {}
    for p in paths:
        name = re.match(r"[^.\[]+", p)[0]
        under.setdefault(name, []).append(p[len(name) :].removeprefix("."))
    return T.StructType([T.StructField(n, _record_type(rest, f"{at}.{n}" if at else n)) for n, rest in under.items()])


def canonical(df: DataFrame) -> DataFrame:
    """A table of a known layout as (conv_id, turn, role, text)."""
    paths = schema_paths(df.schema)
    known = layout_of(paths)
    if known is None:
        raise LookupError(f"no mapping for a layout with the paths {sorted(paths)}")
    _, of, turns = MAPPINGS[known]
    return df.select(F.col(of).alias("conv_id"), F.inline(turns(F.col).cast(f"array<{TURN}>")))


def _value(record, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


SEEN = "r string, f string, own string, whole boolean"


def seen(records: DataFrame, column: str = "record") -> DataFrame:
    """Each JSON record with the fingerprint of its mapping (null: none), its id if it has no mapping, and whether its id is a whole number."""

    def prints(batches):
        for batch in batches:
            rows = []
            for x in batch.column(0).to_pylist():
                try:
                    record = json.loads(x)
                except (TypeError, ValueError):
                    rows.append((x, None, None, True))
                    continue
                f = layout_of(record_paths(record))
                ids = [MAPPINGS[f][1]] if f else ["id", "conv_id"]
                own = next((v for v in (_value(record, i) for i in ids) if isinstance(v, (int, str))), None)
                whole = own is None or type(own) is int and -(2**63) <= own < 2**63
                rows.append((x, f, None if f or own is None else str(own), whole))
            kinds = [pa.string()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["r", "f", "own", "whole"])

    return records.select(F.col(column).cast("string")).mapInArrow(prints, SEEN)


def canonical_json(records: DataFrame, column: str = "record", id_type: str | None = None) -> DataFrame:
    """JSON records of mixed layouts as (conv_id, turn, role, text), each by its own fingerprint.

    Records that fit no mapping, or are no JSON, come out with role ``#unknown`` and the record as text, under
    their ``id`` or ``conv_id`` if they have one.  conv_id is a bigint if all ids are whole numbers of 64 bits
    (or null), else a string that keeps each id; with ``id_type`` (bigint or string) nothing is looked up.
    """
    known = seen(records, column)
    if id_type is None:
        known = written(known, "records")
        id_type = "string" if known.where(~F.col("whole")).limit(1).count() else "bigint"

    def branch(paths: list[str], of: str, turns) -> Column:
        record = F.from_json("r", _record_type(paths), {"maxStringLen": str(2**31 - 1)})

        def read(j: Column) -> Column:
            at = lambda path: functools.reduce(lambda c, name: c[name], path.split("."), j)
            return F.struct(at(of).alias("conv_id"), turns(at).cast(f"array<{TURN}>").alias("turns"))

        # A list of one, so that a record is parsed once for all its fields.
        return F.transform(F.array(record), read)[0]

    unknown = F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("#unknown").alias("role"), F.col("r").alias("text")))
    out = F.when(F.col("f").isNull(), F.struct(F.col("own").alias("conv_id"), unknown.cast(f"array<{TURN}>").alias("turns")))
    for f, mapping in MAPPINGS.items():
        out = out.when(F.col("f") == f, branch(*mapping))
    return known.select(out.alias("t")).select(F.col("t.conv_id").cast(id_type).alias("conv_id"), F.inline("t.turns"))


def escape(text: Column) -> Column:
    """A backslash before each backslash and angle bracket."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<>])", r"\\$1")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<turn "), escape(role), F.lit(">"), escape(text), F.lit("</turn>\n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Canonical turns -> (conv_id, turn, formatted), sorted within a conversation's partition."""
    # Rows and their order are decided in the shuffle; formatting is row by row in the JVM.
    return (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
        .select("conv_id", "turn", formatted_turn(F.col("role"), F.col("text")).alias("formatted"))
    )


_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def parse_turn(formatted: str) -> tuple[str, str, tuple[int, int]]:
    """Role, text and the span of the text in the formatted string.  Raises ``ValueError`` on other strings."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return _ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2]), m.span(2)


READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest what they hold: all turns, and what is under the loss mask.

    A conv_id that is a string stays one; others become long.
    """
    named = isinstance(formatted.schema["conv_id"].dataType, T.StringType)
    id_type, id_kind = ("string", pa.string()) if named else ("long", pa.int64())

    def scan(batches):
        now, state = object(), None

        def row():
            n, turns, chars, loss, length = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), length

        for batch in batches:
            done = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if conv != now or state is None:
                    if state is not None:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said, span = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if role == "assistant":  # the loss mask covers this span of the formatted text
                    under = _ESCAPED.sub(r"\1", text[slice(*span)])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(text)
            yield _rows(done)
        if state is not None:
            yield _rows([row()])

    def _rows(rows):
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [id_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return formatted.select(F.col("conv_id").cast(id_type), "formatted").mapInArrow(scan, f"conv_id {id_type}, {READ_BACK}")


#: The conversation that the query adds, with control strings inside its texts.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def dealt(rows: DataFrame) -> DataFrame:
    """Turns as JSON records (``record``) in the three layouts of one turn a record, by a hash of the turn."""
    conv, turn, role, text = (F.col(c) for c in ("conv_id", "turn", "role", "text"))
    layouts = [
        F.struct(conv, turn, role, text),
        F.struct(F.struct(conv.alias("id"), turn).alias("conversation"), F.struct(role, text.alias("content")).alias("message")),
        F.struct(conv.alias("thread"), turn.alias("index"), role.alias("speaker"), text.alias("said")),
    ]
    first, second, third = (F.to_json(x, {"ignoreNullFields": "false"}) for x in layouts)
    deal = F.pmod(F.xxhash64(*rows.columns), F.lit(len(layouts)))
    return rows.select(F.when(deal == 0, first).when(deal == 1, second).otherwise(third).alias("record"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, dealt as records of three layouts, told apart by their fingerprints, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return read_back(format_turns(canonical_json(dealt(rows.unionByName(probe)), id_type="bigint")))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, length('<turn >' || '</turn>' || chr(10)) + length(regexp_replace(role, '([\\<>])', '\\\1', 'g'))
            + length(regexp_replace(text, '([\\<>])', '\\\1', 'g')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
