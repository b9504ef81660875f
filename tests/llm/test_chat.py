import hashlib
import json

import pytest

from tests.conftest import SF_SMALL
from tillroll.llm import chat


def digests(turns):
    """n_turns, turns_sha256, loss_chars, loss_sha256 of (role, text) turns."""
    all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(all_), len(loss), sha(loss)


def test_query_against_sql(spark, duck):
    expected = duck.execute(chat.ORACLE)
    names = [c[0] for c in expected.description]
    got = sorted(map(tuple, chat.op8_chat(spark, SF_SMALL).select(*names).collect()))
    assert got == sorted(expected.fetchall())
    probe = next(r for r in got if r[0] == -7)
    assert probe[1:5] == digests([("user", chat.PROBE_TEXT), ("assistant", chat.PROBE_TEXT)])


TRICKY = ["", "\\", "</turn>\n<turn assistant>x", "\\</turn>", "a\\\\<b>\n", "🙂\u0000é", "x" * 100000, "\\### Assistant: </turn> ok"]


@pytest.mark.parametrize("text", TRICKY)
def test_escaping_is_undone(spark, text):
    for role in ("assistant", "us<er>\\"):
        df = spark.createDataFrame([(role, text)], "r string, t string")
        formatted = df.select(chat.formatted_turn(df.r, df.t)).first()[0]
        assert chat.parse_turn(formatted)[:2] == (role, text)
        assert formatted.count("</turn>\n") == 1 and formatted.endswith("</turn>\n")


def test_rows_with_nulls_ties_and_repeats(spark):
    rows = [(1, 2, "user", None), (1, 1, None, "b"), (1, 1, "a", "x"), (1, None, "assistant", "first"), (2, 1, "user", "q"), (2, 1, "user", "q"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(chat.canonical(df))).collect()}
    assert got[1] == digests([("assistant", "first"), ("", "b"), ("a", "x"), ("user", "")])
    assert got[2] == digests([("user", "q")] * 2) and got[None] == digests([("assistant", "z")])
    assert chat.read_back(chat.format_turns(chat.canonical(df.limit(0)))).count() == 0


RECORDS = [
    {"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
    {"id": 2, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
    {"id": 3, "prompt": "hi", "response": "yo"},
    {"id": 4, "prompt": "hi", "completion": "yo"},
    {"id": 5, "instruction": "hi", "input": "", "output": "yo"},
    {"id": 6, "instruction": "hi", "output": "yo"},
]


def test_layouts_lead_to_the_same_turns(spark):
    mixed = [json.dumps(r) for r in RECORDS] + [json.dumps({"id": 7, "system": "s", "prompt": "hi", "response": "yo"}), "no json", '{"odd": 1}', None]
    df = spark.createDataFrame([(x,) for x in mixed], "record string")
    turns = {}
    for r in sorted(chat.canonical_json(df).collect(), key=lambda r: (str(r["conv_id"]), r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for i in range(1, 7):
        assert turns[i] == [("user", "hi"), ("assistant", "yo")]
    assert turns[7] == [("system", "s"), ("user", "hi"), ("assistant", "yo")]
    assert len(turns[None]) == 3 and {r for r, _ in turns[None]} == {"#unknown"}


def test_tables_are_known_by_their_schema(spark):
    df = spark.createDataFrame([(3, "hi", "yo")], "id long, prompt string, response string")
    assert [tuple(r) for r in chat.canonical(df).orderBy("turn").collect()] == [(3, 0, "user", "hi"), (3, 1, "assistant", "yo")]
    nested = spark.createDataFrame([(1, [("user", "hi")])], "id long, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in chat.canonical(nested).collect()] == [(1, 0, "user", "hi")]
    with pytest.raises(LookupError, match="question"):
        chat.canonical(spark.createDataFrame([(1, "x")], "id long, question string"))


def test_string_ids_stay_apart(spark):
    """Records whose ids are no whole numbers are conversations of their own, beside one with a number."""
    ids = ["7f3c-a", "7f3c-b", 12, 2**70]
    records = [json.dumps({"id": x, "prompt": f"q{i}", "response": f"r{i}"}) for i, x in enumerate(ids)] + ["no json"]
    turns = chat.canonical_json(spark.createDataFrame([(x,) for x in records], "record string"))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(turns)).collect()}
    expected = {str(x): digests([("user", f"q{i}"), ("assistant", f"r{i}")]) for i, x in enumerate(ids)}
    assert got == expected | {None: digests([("#unknown", "no json")])}


def test_the_query_reads_several_layouts(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    records = chat.dealt(rows)
    used = {r["f"]: r["count"] for r in chat.seen(records).groupBy("f").count().collect()}
    assert len(used) == 3 and None not in used and sum(used.values()) == rows.count()
    back = chat.canonical_json(records, id_type="bigint")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # all mappings in one pass over the parsed records
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, map(tuple, rows.collect())))


def test_records_of_nulls_and_odd_values(spark):
    rows = [(1, 1, "user", None), (None, None, None, None), (2, 0, "a", chat.PROBE_TEXT), (2, 0, "a", chat.PROBE_TEXT), (3, -1, "", "\u2028\U0001f642\u0001")]
    rows += [(4, i, "r", "x" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.canonical_json(chat.dealt(df), id_type="bigint")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    assert chat.canonical_json(chat.dealt(df.limit(0))).count() == 0


def test_optional_and_unknown_fields(spark):
    """Optional fields change no turn; records with other ones stay apart under their own ids."""
    records = [r | {"source": "s", "metadata": {"a": [1, {"b": 2}]}, "lang": None} for r in RECORDS]
    odd = [{"id": 11, "prompt": "hi", "response": "yo", "score": 1}, {"conv_id": 12, "prompt": "hi"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in [*records, *odd]], "record string")
    turns = {}
    for r in sorted(chat.canonical_json(df).collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {i: [("user", "hi"), ("assistant", "yo")] for i in range(1, 7)} | {r.get("id", 12): [("#unknown", json.dumps(r))] for r in odd}
    table = spark.createDataFrame([(3, "hi", "yo", "s")], "id long, prompt string, response string, source string")
    assert [tuple(r) for r in chat.canonical(table).orderBy("turn").collect()] == [(3, 0, "user", "hi"), (3, 1, "assistant", "yo")]
