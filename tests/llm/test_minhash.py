import re

import pyarrow as pa
import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillroll.llm import minhash
from tillroll.llm.components import components
from tillroll.llm.shingles import shingle_hashes

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    """doc_id -> (set size, component, kept), over all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None:
                if 100 * len(x & y) >= 75 * len(x | y):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return sorted(((d, len(s), root(d), True if d is None else d == root(d)) for d, s in sets), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_shingles_are_the_word_windows():
    texts = ["a b c d e f", "A b  c", "", None, "x", "a b c d e f a b c d e", "Éa b", "a b c", "\n", " a\tb c d e f "]
    _, at, _ = shingle_hashes(pa.array(texts))
    assert [int(x) for x in at[1:] - at[:-1]] == [len(shingles(t)) for t in texts]


def test_sample_against_all_pairs(spark, sample):
    df = minhash.op3_minhash(spark, SF_SMALL)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(df) == brute_force(sample)


def test_query_against_sql(spark, duck):
    expected = duck.execute(minhash.ORACLE)
    names = [c[0] for c in expected.description]
    df = minhash.op3_minhash(spark, SF_SMALL)
    assert sorted(names) == sorted(df.columns)
    assert got(df.select(*names)) == sorted(expected.fetchall(), key=str)


def test_chains_and_crowds(documents_of):
    """A chain whose ends differ, a crowd of near copies, and crowds that share a passage only."""
    base = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for step in range(8):  # neighbours are linked, the ends are not
        rows.append((n, " ".join(base[step * 3 :] + [f"z{i}" for i in range(step * 3)])))
        n += 1
    for k in range(60):
        words = [f"c{i}" for i in range(100)]
        words[k % 100] = f"own{k}"
        rows.append((n, " ".join(words)))
        n += 1
    for k in range(40):
        rows.append((n, " ".join([f"p{i}" for i in range(40)] + [f"q{k}x{i}" for i in range(40)])))
        n += 1
    assert got(minhash.near_duplicates(documents_of(rows))) == brute_force(rows)


def test_odd_rows(documents_of):
    rows = [r for r in ODD]
    result = got(minhash.near_duplicates(documents_of(rows).selectExpr("*", "doc_id AS n", "text AS registers")))
    assert result == brute_force(rows)
    assert minhash.near_duplicates(documents_of([])).count() == 0


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)]
    labels = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(labels[i] == 1 for i in range(1, 41)) and all(labels[100 + i] == 100 for i in range(50))


@pytest.mark.parametrize("similar", [0.3, 0.6, 0.75, 0.9])
def test_registers_agree_as_the_sets_do(similar):
    import numpy as np

    rng = np.random.default_rng(5)
    shared = int(2000 * 2 * similar / (1 + similar))
    near = []
    for _ in range(30):
        pool = rng.integers(1, 2**63, 4000, dtype=np.uint64)
        a, b = pool[:2000], np.concatenate([pool[:shared], pool[2000 : 4000 - shared]])
        r = minhash.sketch(np.concatenate([a, b]), np.array([0, 2000, 4000]))
        best, _ = minhash.likelihood(r[:1], r[1:], np.array([2000.0]), np.array([2000.0]), 0.75)
        near.append(best[0])
        merged = minhash.sketch(np.unique(np.concatenate([a, b])), np.array([0, len(np.unique(np.concatenate([a, b])))]))
        assert (np.maximum(r[0], r[1]) == merged[0]).all()  # mergeable
    assert abs(np.mean(near) - similar) < 0.03


def test_crowd_of_uneven_copies(documents_of):
    """Copies changed so much that only those near the original are linked, through it or each other."""
    import random

    rng = random.Random(9)
    rows = []
    for d in range(150):
        words = [f"c{i}" for i in range(150)]
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(150)] = f"m{d}x{rng.randrange(1000)}"
        rows.append((d, " ".join(words)))
    expected = brute_force(rows)
    assert 1 < len({c for _, _, c, _ in expected}) < 150
    assert got(minhash.near_duplicates(documents_of(rows))) == expected


def test_repeated_ids_with_different_texts(documents_of):
    """A document in several classes joins them, also if its own are no class's first, and if a text is empty."""
    texts = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"}
    near = texts["e"] + " more"
    rows = [(3, texts["a"]), (5, texts["b"]), (7, texts["a"]), (7, texts["b"]), (8, texts["b"]), (8, ""), (9, texts["c"]), (9, texts["d"])]
    rows += [(10, texts["d"]), (11, texts["e"]), (12, near), (12, texts["f"]), (2, texts["f"]), (12, None), (13, None), (None, texts["a"])]
    expected = brute_force(rows)
    assert {d: c for d, _, c, _ in expected} == {None: None, 2: 2, 3: 3, 5: 3, 7: 3, 8: 3, 9: 9, 10: 9, 11: 2, 12: 2, 13: 13}
    assert got(minhash.near_duplicates(documents_of(rows))) == expected
