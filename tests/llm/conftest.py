import duckdb
import pytest

from playmetry.llm.common import prepared

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def documents(llm):
    def make(*texts, ids=None, **more):
        """Documents with these texts, ids 0, 1, ... and columns whose names clash with inner ones."""
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "a", 7, "x") for i, t in zip(ids, texts)]
        return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, score string")

    return make
