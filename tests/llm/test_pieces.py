import random

import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillroll.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def full_viterbi(v, text):
    """Ids of the best path over the whole text at once."""
    if not text:
        return []
    return whole(v, pieces.SPACE + text.replace(pieces.SPACE, pieces.LITERAL).replace(" ", pieces.SPACE))


def whole(v, t):
    best = [(0, 0)]
    for end in range(1, len(t) + 1):
        options = []
        for at in range(max(0, end - v.longest), end):
            if t[at:end] in v.scores:
                options.append((best[at][0] + v.scores[t[at:end]], -at))
            elif at == end - 1:
                n = len((pieces.SPACE if t[at] == pieces.LITERAL else t[at]).encode())
                options.append((best[at][0] - pieces.BYTE_COST * n, -at))
        score, at = max(options)
        best.append((score, -at))
    cuts = [len(t)]
    while cuts[-1]:
        cuts.append(best[cuts[-1]][1])
    return pieces._ids(v, t, cuts[::-1])


def ids_of(v, text):
    import numpy as np

    return np.frombuffer(pieces.Encoder(v).encode(text), "int32").tolist()


TEXTS = ["Hello  world\nfoo ▁ x", " lead and trail ", "a", " ", "\n\n", "naïve 日本語 \u0000 🙂", "x" * 700, "ab" * 300 + " " * 40, "▁▁", "A." * 200]


@pytest.mark.parametrize("text", TEXTS)
def test_streaming_equals_the_whole(vocabulary, text):
    got = ids_of(vocabulary, text)
    assert got == full_viterbi(vocabulary, text)
    assert pieces.decode_ids(vocabulary, got) == text


def test_commits_come_early_and_in_order(vocabulary):
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(4000))
    runs = list(pieces.stream(vocabulary, text))
    assert len(runs) > 20  # committed all along, not at the end
    assert [i for r in runs for i in r] == whole(vocabulary, text)


def test_random_texts(vocabulary):
    rng = random.Random(7)
    for _ in range(150):
        text = "".join(rng.choice("abct he\n▁é日.,") for _ in range(rng.randrange(120)))
        got = ids_of(vocabulary, text)
        assert got == full_viterbi(vocabulary, text)
        assert pieces.decode_ids(vocabulary, got) == text


def test_vocabularies_without_certain_boundaries():
    v = pieces.Vocabulary([("a▁b", 1), ("a", 5), ("b", 6), ("▁", 3), ("x\ny", 2), *[("", -1)] * 256], {b: 5 + b for b in range(256)})
    assert v.joints is None
    for text in ["a b a b", "x\ny a b", "b\nb"]:
        assert ids_of(v, text) == full_viterbi(v, text)
        assert pieces.decode_ids(v, ids_of(v, text)) == text


def test_marks_behind_letters(vocabulary):
    """Only marks that follow a letter in no piece are boundaries."""
    v = pieces.Vocabulary([("a.", 1), ("a", 5), (".", 6), (",", 7), ("▁", 3), (",a", 2), *[("", -1)] * 256], {b: 6 + b for b in range(256)})
    assert v.joints.findall("a.") == [] and len(v.joints.findall("a,a")) == 1
    for text in ["a.a,a", "a,.a", ",a a."]:
        assert ids_of(v, text) == full_viterbi(v, text)
    rng = random.Random(3)
    for _ in range(100):
        text = "".join(rng.choice("abé.,!'|²1 ") for _ in range(rng.randrange(60)))
        assert ids_of(vocabulary, text) == full_viterbi(vocabulary, text)


def test_documents(spark, documents_of, sample):
    import hashlib

    got = {r["doc_id"]: r for r in pieces.op7_pieces(spark, SF_SMALL).collect()}
    v = pieces.Vocabulary.load()
    for d, t in sample:
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert len(got[d]["ids"]) == got[d]["n_ids"]
    for d, t in sample:
        assert got[d]["ids"] == full_viterbi(v, t)
    odd = pieces.decode(pieces.encode(documents_of(ODD).selectExpr("*", "lang AS stretch", "lang AS ids"))).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in odd) == sorted((str(d), t or "") for d, t in ODD)
    assert pieces.encode(documents_of([])).count() == 0
