"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from samplekit.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "events documents labels embeddings"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES.split():
        path = f"{DATA}/{t}.parquet"
        connection.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return connection


def values(frame):
    shown = [[None if pd.isna(v) else f"{float(v) + 0:.5g}" if isinstance(v, float) or "float" in type(v).__name__ else str(v) for v in row] for row in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(shown, key=str)


#: Without SQL: what each returns at least.
COLUMNS = {"g11_anova": {"f", "p"}, "g12_pairwise_ttest": {"t", "p"}, "h03_plateau_replay": {"run_id", "epoch", "lr"}}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) and COLUMNS.get(name, set()) <= set(got.columns)
        return
    expected = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert values(got) == values(expected)
