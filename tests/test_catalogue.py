"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from siltstone.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(df, columns):
    return sorted((tuple(map(shown, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = db.execute(catalogue.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        for c in columns:  # integers with nulls come as floats from one side
            if pd.api.types.is_numeric_dtype(got[c]) and pd.api.types.is_numeric_dtype(want[c]):
                got[c], want[c] = got[c].astype("Float64").astype(object), want[c].astype("Float64").astype(object)
        assert rows(got, columns) == rows(want, columns)
