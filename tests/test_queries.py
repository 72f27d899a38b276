"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os
from collections import Counter

import pandas as pd
import pytest

from plumbline.queries import TABLES, _catalogue

DIR = "/root/testdata/sf0.001"
CATALOGUE = _catalogue()


def cell(x):
    if isinstance(x, (list, dict)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return str(x)
    if pd.isna(x):
        return ""
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables aren't here")
@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOGUE.items() if sql])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    run, sql = CATALOGUE[name]
    got, want = run(spark, DIR).toPandas(), con.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: Counter(tuple(cell(x) for x in r) for r in f[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("rows", [60_000, 600, 1, 0])
def test_cardinality_rounds_and_counts_as_sql_does(spark, tmp_path, rows):
    """Shares on a half (3 of 60000 is 0.005, 2499 of them 4.165), columns without values and a table without rows."""
    duckdb = pytest.importorskip("duckdb")
    run, sql = CATALOGUE["column_cardinality"]
    kinds = {"l_orderkey": "id", "l_partkey": "id % 3", "l_suppkey": "id % 2499", "l_linenumber": "cast(id % 9 as int)", "l_quantity": "cast(id % 38601 as double)", "l_extendedprice": "cast(id % 43035 as double)", "l_discount": "cast(null as double)", "l_tax": "0.5D", "l_returnflag": "cast(id % 15 as string)", "l_linestatus": "'O'", "l_shipdate": "timestamp_seconds(id % 46635)"}
    path = str(tmp_path / "lineitem.parquet")
    spark.range(rows).selectExpr(*[f"{x} AS {c}" for c, x in kinds.items()]).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    shown = lambda found: sorted(tuple(map(repr, r)) for r in found)
    assert shown(run(spark, str(tmp_path)).collect()) == shown(con.execute(sql).fetchall())
