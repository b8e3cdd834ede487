import duckdb
import pytest

import __spark_entry__ as e
from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query_against_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    if name in catalogue.oracle_sql():
        want = db.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({catalogue.oracle_sql()[name]})").fetchall()
        assert _norm(got) == _norm(want)


def test_registry(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "line", "snippet", "n_lines"]
