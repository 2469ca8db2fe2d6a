"""Every core query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from raywalk.plans import queries

SF = "/root/testdata/sf0.001"
#: Results of more rows are compared by DuckDB.
LARGE = 200_000


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    return sorted(repr(tuple(None if x != x else x for x in r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tables, name, tmp_path):
    queries.queries()[name](spark, SF).write.parquet(f"file://{tmp_path}/got")
    got = f"read_parquet('{tmp_path}/got/*.parquet')"
    if tables.execute(f"SELECT count(*) FROM {got}").fetchone()[0] <= LARGE:
        assert rows(tables.execute(f"FROM {got}").df()) == rows(tables.execute(queries.oracle_sql()[name]).df())
        return
    tables.execute(f"CREATE OR REPLACE TEMP TABLE want AS {queries.oracle_sql()[name]}")
    columns = ", ".join(sorted(r[0] for r in tables.execute("DESCRIBE want").fetchall()))
    assert sorted(r[0] for r in tables.execute(f"DESCRIBE FROM {got}").fetchall()) == columns.split(", ")
    for a, b in ((got, "want"), ("want", got)):
        assert tables.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchone()[0] == 0


def test_every_other_query_runs(spark):
    for name in sorted(set(queries.queries()) - set(queries.oracle_sql())):
        assert queries.queries()[name](spark, SF).count() > 0


def test_core_stands_without_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).resolve().parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "raywalk.llm" not in path.read_text(), path


@pytest.mark.parametrize("name", ["message_exchange", "pool_use"])
def test_a_log_is_parsed_once(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "Relation" in plan
