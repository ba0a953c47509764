"""Queries with SQL equal DuckDB on the sf0.001 tables; all run and register."""

import duckdb
import pytest

from delaymart.llm.oracle import ORACLE
from delaymart.llm.queries import QUERIES
from tests.llm.conftest import SF, table_path

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(t)}')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})")
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == \
        dict(zip(cols, map(str, rel.types), strict=True))
    got = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)
    want = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rel.fetchall()), key=str)
    assert got == want and got


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert all(f.__doc__ for f in QUERIES.values())


def test_native_queries_run_no_python(spark):
    for name in ("op1_sharding", "op5_line_dedup", "op9_mix_sources"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("InArrow", "ArrowEval", "BatchEval", "InPandas")), name
