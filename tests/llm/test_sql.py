"""The registered queries against their SQL in DuckDB, and what they register."""

import duckdb
import pytest

from logweave.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


def plain(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    table = "pages" if name.startswith("op9") else "embeddings" if name.startswith("op7") else "documents"
    assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cursor = con.execute(queries.oracle_sql()[name])
        at = [x[0] for x in cursor.description]
        assert sorted(at) == columns
        assert plain(rows) == plain(tuple(r[at.index(c)] for c in columns) for r in cursor.fetchall())
