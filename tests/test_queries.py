"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from logweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("events", "customer", "part", "conversations")


def plain(rows):
    return sorted(tuple(f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cursor = con.execute(ORACLES[name])
        at = [x[0] for x in cursor.description]
        assert sorted(at) == columns
        assert plain(rows) == plain(tuple(r[at.index(c)] for c in columns) for r in cursor.fetchall())


def test_parameters_of_all_lines(spark):
    rows = QUERIES["extract_parameters_all"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count() and all(r["values"] for r in rows)
    assert {r["values"].count("|") for r in rows if r.log_index % 4 < 2} == {2} and not any("|" in r["values"] for r in rows if r.log_index % 4 > 1)
