import duckdb
import pytest

from tests.conftest import SF_SMALL

TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.fixture
def documents_of(spark):
    """Documents from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def sample(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


#: Nulls, empty and long texts, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, "a b c d e f g h i j k l m n o p q r s t"),
    (7, "a b c d e f g h i j k l m n o p q r s t"), (8, "wörd " * 30000), (9, "x" * 200000), (10, "α β γ δ ε ζ η θ"), (None, "one two"),
]
