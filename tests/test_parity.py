"""DuckDB parity for every query that has an oracle (sf0.001; models excluded for speed)."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SLOW = {"kmeans3", "train_all", "metrics_table", "model_ranking", "cross_validate", "auto_pipeline", "latest_accuracy",
        "top_features", "calibrate_sigmoid", "permutation_importance", "train_forest", "train_forest_regressor",
        "score_average"}


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        v = round(v, 6) + 0.0
        return str(int(v)) if v.is_integer() else repr(v)
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted("|".join(_canon(r[c]) for c in cols) for r in pdf.to_dict("records"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    from cohort.sources.fixtures import TABLES
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _keys():
    import __spark_entry__ as e
    return sorted(k for k in e.oracle_sql() if k not in SLOW)


@pytest.mark.parametrize("key", _keys())
def test_parity(spark, con, key):
    import __spark_entry__ as e
    sdf = e.queries()[key](spark, SF).toPandas()
    ddf = con.sql(e.oracle_sql()[key]).df()
    assert _rows(sdf) == _rows(ddf)


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "total_entities" in df.columns
