"""The pipeline against a plain version of each stage, on the rows the stage before it returned."""

import hashlib
import math

import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import test_minhash, test_quality
from tests.llm.conftest import ODD
from tillroll.llm import mixing, pieces, pii, quality


@pytest.fixture(scope="module")
def stages(spark):
    from tillroll.storage import written

    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    columns = docs.columns
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = written(f(spark, docs, SF_SMALL), name)
        assert i == 4 or docs.columns == columns
        out.append([r.asDict() for r in docs.collect()])
    return out


def votes(text):
    """The rules' votes in plain Python."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = test_quality.measured(text)
    t = text or ""
    w, solid = t.split(), "".join(t.split())
    lines = [x for x in t.split("\n") if x.strip()]
    import regex

    letters, upper = len(regex.findall(r"[\p{L}\p{M}]", solid)), len(regex.findall(r"\p{Lu}", solid))
    stutters = sum(a == b for a, b in zip(w, w[1:]))
    marks = sum(not x.strip("#*$%&|<>") for x in w)
    share = lambda a, b: a / max(b, 1)
    vote = lambda good, bad: 0 if bad else 1 if good else None
    length = share(word_chars, n_words)
    return (
        vote(n_words >= 20, False), vote(2.5 <= length <= 8.5, length < 2.0 or length > 12),
        vote(share(n_symbols, n_words) < 0.02, share(n_symbols, n_words) > 0.1), vote(share(marks, n_words) < 0.02, share(marks, n_words) > 0.1),
        vote(share(letters, word_chars) > 0.8, share(letters, word_chars) < 0.72), vote(share(upper, letters) < 0.15, share(upper, letters) > 0.4),
        vote(share(n_dup, len(lines)) < 0.35, share(n_dup, len(lines)) > 0.5), vote(share(n_repeat, n_words) < 0.12, share(n_repeat, n_words) > 0.15),
        vote(share(stutters, n_words) < 0.05, share(stutters, n_words) > 0.2),
    )


def plain_em(rows):
    """Posterior of each row of votes, by expectation-maximisation over all rows."""
    kind = lambda v: 2 if v is None else v
    n, k = len(rows), len(rows[0])
    prior, good, bad = quality.PRIOR_GOOD, [quality.VOTES_ON_GOOD] * k, [quality.VOTES_ON_BAD] * k

    def posterior(row):
        odds = math.log(prior / (1 - prior)) + sum(math.log(good[i][kind(v)] / bad[i][kind(v)]) for i, v in enumerate(row))
        return 1 / (1 + math.exp(-odds))

    for _ in range(quality.ITERATIONS):
        p = [posterior(r) for r in rows]
        g, least = sum(p), quality.SMOOTHING * n
        of = lambda i, c, w, whole: (sum(x for x, r in zip(w, rows) if kind(r[i]) == c) + least) / (whole + 3 * least)
        q = [1 - x for x in p]
        good, bad = [tuple(of(i, c, p, g) for c in range(3)) for i in range(k)], [tuple(of(i, c, q, n - g) for c in range(3)) for i in range(k)]
        prior = min(max(g / n, 0.001), 0.999)
    return [posterior(r) for r in rows]


def test_quality_stage(stages, sample):
    p = plain_em([votes(t) for _, t in sample])
    expected = {d for (d, t), x in zip(sample, p) if x >= 0.5 and not test_quality.measured(t)[-1]}
    assert {r["doc_id"] for r in stages[0]} == expected


def test_dedup_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[0]]
    expected = {d for d, _, _, kept in test_minhash.brute_force(rows) if kept}
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(expected)


def test_surrogate_stage(stages):
    before = {r["doc_id"]: r for r in stages[1]}
    assert sorted(before) == sorted(r["doc_id"] for r in stages[2])
    for r in stages[2]:
        old = before[r["doc_id"]]
        found = pii.find(old["text"] or "")
        assert r["text"] == pii.replace(old["text"], {})[0] and r["n_chars"] == len(r["text"])
        assert all((old["text"])[b:e] not in r["text"] for b, e, k, _ in found if k in ("email", "phone", "card", "ip", "access"))
        if not found:
            assert r["text"] == old["text"]


def test_mixing_stage(stages):
    sizes = {}
    for r in stages[2]:
        sizes.setdefault(r["source"], []).append((r["doc_id"], len((r["text"] or "").split())))
    whole = {s: sum(n for _, n in x) for s, x in sizes.items()}
    text = {r["doc_id"]: r["text"] or "" for r in stages[2]}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(whole))}
    target, full = {}, set()
    while True:  # share out, fix what is full, share the rest again
        left = sum(whole.values()) - sum(3 * whole[s] for s in full)
        over = sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * whole[s] if s in full else left * weight[s] / over for s in whole}
        more = {s for s in whole if target[s] > 3 * whole[s]}
        if not more:
            break
        full |= more
    expected = []
    for s, rows in sizes.items():
        rate = target[s] / whole[s]
        for d, _ in rows:
            u = int(hashlib.md5(f"{mixing.SEED}:{d}:{s}:{hashlib.md5(text[d].encode()).hexdigest()}".encode()).hexdigest()[:12], 16) / 2**48
            expected += [d] * (int(rate) + (u < rate - int(rate)))
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(expected)


def test_piece_stage(stages):
    v = pieces.Vocabulary.load()
    text = {r["doc_id"]: r["text"] for r in stages[3]}
    assert sorted(r["doc_id"] for r in stages[4]) == sorted(r["doc_id"] for r in stages[3])
    for r in stages[4]:
        assert pieces.decode_ids(v, r["ids"]) == text[r["doc_id"]] and r["n_ids"] == len(r["ids"])


def test_run_and_odd_rows(spark, stages, documents_of, tmp_path):
    got = corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "ids").collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted((r["doc_id"], tuple(r["ids"])) for r in stages[4])
    clean = " ".join(f"sensible word{chr(97 + i)}" for i in range(20))
    rows = [*ODD, (40, clean), (40, clean), (41, clean), (None, clean)]
    clash = "ids n_ids pii_types __attempts __copy __rate __source __h __node __again others attempts text_hash drawn".split()
    documents_of(rows).selectExpr("*", "1 AS n", "'x' AS doc", *[f"'{c}' AS {c}" for c in clash]).write.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in left} <= {40, None, 6, 8} and {40, None} & {r["doc_id"] for r in left}
    assert all(r[c] == c for r in left for c in clash if c not in ("ids", "n_ids"))
    documents_of([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0


def test_texts_of_a_repeated_id_are_judged_apart(spark, documents_of):
    """Of rows that share a doc_id only the copies go, whichever text is the smaller one."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(3, b), (7, b), (7, a), (7, a), (7, c), (9, a + " more"), (8, c), (None, a), (7, None), (6, d), (6, d + " more"), (5, "")]
    docs = documents_of(rows)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sum(i == 6 for i, _ in got) == 1
    assert sorted(((i, t) for i, t in got if i != 6), key=str) == sorted([(3, b), (7, a), (7, c), (None, a), (7, None), (5, "")], key=str)
