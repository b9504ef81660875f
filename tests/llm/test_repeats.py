import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillroll.llm import repeats

W = repeats.WIDTH


def brute_force(rows, order=None):
    """Figures of each row; ``order``: sort key of a row, by default its doc_id."""
    seen, out = {}, []
    for d, t in sorted(rows, key=order or (lambda r: r[0])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - W + 1):
            if seen.setdefault(raw[s : s + W], (d, s)) != (d, s):
                gone[s : s + W] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(raw) else 0
        out.append((d, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, n=60):
    """Texts that share passages, copies, repeated lines, periodic stretches and edges of all kinds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randrange(15, 60)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randrange(0, 40))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts += [p[a : len(p) - rng.randrange(0, 20)], prose(rng.randrange(0, 30))]
        rows.append((rng.randrange(10**6), " ".join(parts)))
        if i % 7 == 0:
            rows.append((rng.randrange(10**6), rows[rng.randrange(len(rows))][1]))
    rows += [(10**6, "ab" * 400), (10**6 + 1, "x" * 950), (10**6 + 2, "y" + "x" * 300), (10**6 + 3, (prose(12) + "\n") * 9)]
    return list({d: (d, t) for d, t in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_made_texts(documents_of, seed):
    rows = made(seed)
    assert got(repeats.cut(documents_of(rows).repartition(5))) == brute_force(rows)


def test_crowded_anchors(documents_of, monkeypatch):
    rows = made(3, 40)
    monkeypatch.setattr(repeats, "CROWD", 2)
    assert got(repeats.cut(documents_of(rows).repartition(3))) == brute_force(rows)


def test_sample(spark, sample):
    assert got(repeats.op10_repeats(spark, SF_SMALL)) == brute_force(sample)


def test_odd_rows(documents_of):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [r for r in ODD if r[0] is not None] + [(50, long), (50, long), (51, long + "."), (52, "a" * W), (53, "a" * (W - 1)), (54, "a" * W)]
    once = list(dict.fromkeys(rows))
    expected = {r[0]: r for r in brute_force(once)}
    result = repeats.cut(documents_of(rows).selectExpr("*", "doc_id AS doc", "text AS h", "1 AS m"), texts=True).collect()
    assert sorted(r["doc_id"] for r in result) == sorted(d for d, _ in rows)
    for r in result:
        assert tuple(r)[:5] == expected[r["doc_id"]]
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
    nothing = repeats.cut(documents_of([(None, long), (1, long)])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in nothing} == {None: 0, 1: len(long)}
    assert repeats.cut(documents_of([])).count() == 0


def test_merged_rows_are_in_suffix_order():
    rng = random.Random(4)
    shards_of = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(6)] for _ in range(4)]
    depth = 12
    shards = [repeats.Shard(s) for s in shards_of]
    shard, row, prefix = repeats.merge(shards, depth)
    suffixes = []
    for k, r in zip(shard, row):
        s = shards[k]
        at = s.order[r]
        suffixes.append((shards_of[k] + [b""])[s.string[at]][s.offset[at] :])
    full = [(x[:depth], p) for x, p in zip(suffixes, prefix) if len(x) >= depth]
    assert [x for x, _ in full] == sorted(x for x, _ in full)
    assert len(row) == sum(len(s.transform) for s in shards) and len({*zip(shard.tolist(), row.tolist())}) == len(row)
    for (a, pa), (b, pb) in zip(zip(suffixes, prefix), list(zip(suffixes, prefix))[1:]):
        if len(a) >= depth and len(b) >= depth:
            shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), depth)
            assert pb == min(shared, depth)


def test_rows_that_start_alone_keep_their_order():
    """From some rows alone: the order and the intervals that all rows give them."""
    rng = random.Random(5)
    shards_of = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(6)] for _ in range(4)]
    depth = 5
    shards = [repeats.Shard(s) for s in shards_of]
    all_rows = {x: i for i, x in enumerate(zip(*(a.tolist() for a in repeats.merge(shards, depth)[:2])))}
    prefix = repeats.merge(shards, depth)[2]
    shard, row, met = repeats.merge(shards, depth, [np.flatnonzero(s.offset[s.order] >= depth) for s in shards])
    at = [all_rows[x] for x in zip(shard.tolist(), row.tolist())]
    assert len(at) == sum(max(0, len(s) - depth + 1) for group in shards_of for s in group)
    assert [(prefix[a + 1 : b + 1] >= depth).all() for a, b in zip(sorted(at), sorted(at)[1:])] == (met[1:] >= depth).tolist()
    step = np.cumsum(prefix < depth)
    assert step[at].tolist() == sorted(step[at].tolist())


def test_runs_left_out_share_no_window():
    """Every two runs of an anchor with a common window stay, wherever their texts part."""
    rng = random.Random(6)
    anchor, word = bytes(rng.randrange(97, 123) for _ in range(repeats.K)), lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    beside = W - repeats.K
    for before in range(beside + 1):
        core = word(before), word(beside - before)
        made = []
        for _ in range(2):
            x, y = rng.randrange(beside - before + 1), rng.randrange(before + 1)
            made.append((word(x) + core[0] + anchor + core[1] + word(y), x + before))
        lone = (word(beside) + anchor + word(beside), beside)
        content, offset = zip(*made, lone)
        assert repeats._may_share([1, 1, 1], list(content), list(offset)) == [0, 1]
        assert repeats._may_share([1, 2, 1], list(content), list(offset)) == []
