import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tests.conftest import SF_SMALL
from tillroll.llm import repair


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault), by a forward search over whole states."""
    best = {"": (0, "", ())}
    ok = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        for _ in range(3):
            for q, (c, a, lines) in list(best.items()):
                role = "user" if "u" in ok[q] else "assistant"
                n = (c + 2, a + "I", (*lines, f"{role}:"))
                best[role[0]] = min(n, best.get(role[0], n))
        return best

    best = inserts(best)
    for role, text, fault in rows:
        new = {}
        for q, (c, a, lines) in best.items():
            more = [(q, c + 3, a + "D", lines)]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role[:1] and role[:1] in ok[q]:
                    more.append((role[:1], c + cut, a + "K", (*lines, f"{role}:{text}")))
                named = "user" if "u" in ok[q] else "assistant"
                more.append((named[0], c + 2 + cut, a + "R", (*lines, f"{named}:{text}")))
            for to, *n in more:
                new[to] = min(tuple(n), new.get(to, tuple(n)))
        best = inserts(new)
    return min(best[q] for q in ("", "a") if q in best)


def expected(table):
    """All columns in plain Python, from (conv_id, turn, role, text) rows."""
    sp = lambda v: " " if v is None else v
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in [r for r in table if r[0] == conv]:
            role, text = sp(role), sp(text)
            kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        cost, audit, lines = cheapest(marked)
        many = lambda f: sum(m[2] == f for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, many("blank"), many("duplicate"), many("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS `range`", "role AS edits", "turn AS place", "text AS symbols", "2 AS copies")


def run(spark, rows):
    df = frame(spark, rows)
    return sorted((tuple(r) for r in repair.report(df, repair.in_order(repair.damage(df))).collect()), key=str)


def test_sample_against_plain_python_and_sql(spark, duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = sorted((tuple(r) for r in repair.op11_repair(spark, SF_SMALL).collect()), key=str)
    assert got == expected(rows)
    assert got == sorted(duck.execute(repair.ORACLE).fetchall(), key=str)


WORDS = ["", " \t", "ok", "ok.", "Yes! ", "no", "why?", "a\nb.", "ünï.", None]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None]


def odd(rng, convs, most):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(0, most)):
            turn = None if rng.random() < 0.05 else t + 3 * (rng.random() < 0.1)
            rows.append((None if c == 0 else c, turn, rng.choice(ROLES), rng.choice(WORDS)))
    return rows


@pytest.mark.parametrize("chunk", [1, 4, 8192])
def test_odd_rows_in_segments_of_any_size(spark, monkeypatch, chunk):
    """Null, blank and repeated rows, unknown roles, ties; conversations cut into many segments."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = odd(rng, 60, 14) + [(900, i, rng.choice(ROLES[:4]), rng.choice(WORDS)) for i in range(150)]
    rows += rows[:20]
    want = expected(rows)
    assert run(spark, rows) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(repair.ORACLE).fetchall(), key=str) == want


def test_empty_table_long_texts_and_far_turns(spark):
    assert run(spark, []) == []
    rows = [(1, 0, "user", "word " * 60000 + "."), (1, 1, "assistant", "x" * 300000), (2, -(2**62), "user", "a."), (2, 2**62 - 1, "user", "b.")]
    got, want = run(spark, rows), expected(rows)
    assert got == want
    far = run(spark, [(2, -(2**63), "user", "a."), (2, 2**63 - 1, "user", "b.")])
    assert len(far) == 1


def test_dropped_conversations_stay(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def symbols(rng, n):
    return "".join(rng.choices(repair.CLASSES, k=n))


def test_tables_and_traces_against_a_forward_search():
    rng = random.Random(2)
    single, blocks = repair.tables()
    assert len(blocks) == len(single) // 9 * 9**repair.BLOCK
    faults = {"x": "blank"}
    for _ in range(3000):
        text = symbols(rng, rng.randint(0, 20))
        rows = [(x.lower() + "", "t", faults.get(x, "truncated" if x.isupper() else "")) for x in text]
        end, less = repair._normal(repair.END)
        vector, cost = repair.read_back(text, end)
        cut = rng.randint(0, len(text))
        middle, _ = repair.read_back(text[cut:], end)
        first, state = repair.trace(repair.START, text[:cut], middle)
        second, state = repair.trace(state, text[cut:], end)
        assert (less + cost + vector[0], first + second + repair.closing(state)) == cheapest(rows)[:2]


def test_repaired_rows_have_the_right_form(spark):
    rng = random.Random(9)
    df = frame(spark, odd(rng, 40, 12))
    ordered = repair.in_order(repair.damage(df))
    rows = repair.repaired(ordered, repair.traced(ordered)).collect()
    by_conv = {}
    for r in sorted(rows, key=lambda r: r.seq):
        by_conv.setdefault(r.conv_id, []).append(r)
    for turns in by_conv.values():
        assert [r.seq for r in turns] == list(range(1, len(turns) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns))
        assert all((r.edit == "I") == (r.turn is None and r.text == "") for r in turns if r.edit == "I")
