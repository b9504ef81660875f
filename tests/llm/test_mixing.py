import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillroll.llm import mixing


def test_query_against_sql(spark, duck):
    expected = duck.execute(mixing.ORACLE)
    names = [c[0] for c in expected.description]
    df = mixing.op5_mixing(spark, SF_SMALL)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(expected.fetchall())


def test_targets_and_caps(documents_of):
    """A hot source, a tiny one that fills up, one without words, one without a name."""
    rows = [(i, "w " * 50, "hot") for i in range(300)] + [(1000 + i, "w " * 10, "big") for i in range(200)]
    rows += [(2000, "w w", "a-tiny"), (2001, "", "empty"), (2002, None, "empty"), (2003, "w " * 400, None)]
    out = mixing.mix(documents_of(rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    assert sum(t for _, t, _ in by.values()) == pytest.approx(sum(n for _, _, n in by.values()))
    assert by["a-tiny"][1] == 6 and by["a-tiny"][0] == 6 and by["empty"][:2] == [0, 0.0]
    for name in ("hot", "big"):
        assert by[name][0] == pytest.approx(by[name][1], rel=0.15)


@pytest.mark.parametrize("ids", ["none", "one"])
def test_rows_that_share_an_id_draw_apart(documents_of, ids):
    """A source at a rate of 0.4 whose documents have no id, or all the same."""
    name = None if ids == "none" else 7
    rows = [(name, f"w{i} " + "w " * 49, "z-thin") for i in range(600)] + [(i, "v " * 100, "a-full") for i in range(40)]
    docs = documents_of(rows)
    taken = target = 0
    for r in mixing.mix(docs, weights=(3, 2)).where("source = 'z-thin'").collect():
        taken, target = taken + r["size"] * r["copies"], r["target"]
    assert target < 0.9 * 600 * 50
    assert taken == pytest.approx(target, rel=0.1)
    assert mixing.emit(docs, weights=(3, 2)).where("source = 'z-thin'").count() * 50 == taken


def test_emitted_rows_are_the_copies_and_reruns_agree(documents_of):
    rows = [*[(d, t, f"s{i % 3}") for i, (d, t) in enumerate(ODD)], (77, "a b", None), (77, "a b", None)]
    docs = documents_of(rows).selectExpr("*", "n_chars AS size", "1 AS rate", "2 AS __copy", "3 AS __rate", "4 AS __source", "5 AS doc", "6 AS drawn")
    copies = mixing.mix(docs).groupBy("doc_id").sum("copies").collect()
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in emitted.groupBy("doc_id").count().collect()}
    assert counts == {r[0]: r[1] for r in copies if r[1]}
    again = {r["doc_id"]: r["count"] for r in mixing.emit(docs.repartition(7)).groupBy("doc_id").count().collect()}
    assert counts == again
    assert mixing.emit(documents_of([])).count() == 0 == mixing.mix(documents_of([])).count()
