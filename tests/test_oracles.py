"""Every registered query against its DuckDB oracle on the smallest tables."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from nextbuy.constants import P_COLS
from nextbuy.sources.tables import TABLES, table_path

from .conftest import SF_SMALL

ORACLE_KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


def _norm(v):
    """Nulls -> None, every number -> float rounded to 6 places (nullable ints differ in dtype only)."""
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return float(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 6)
    return v


def _digest(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    rows = [repr(tuple(_norm(v) for v in r)) for r in pdf.itertuples(index=False)]
    return hashlib.md5("\n".join(sorted(rows)).encode()).hexdigest()


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_query_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[key]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _digest(got) == _digest(want)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["n", "map"] and df.count() == 1


def test_queries_without_oracle_hold_their_properties(spark):
    """The fitted queries: probabilities for every target customer, a MAP over them, uncorrelated projections."""
    q = E.queries()
    targets = {r.id for r in q["seq_testset"](spark, SF_SMALL).select("id").collect()}
    scores = q["score_products"](spark, SF_SMALL).toPandas()
    assert set(scores["id"]) == targets and len(scores) == len(targets)
    p = scores[P_COLS].to_numpy()
    assert ((p > 0) & (p < 1)).all() and (p.std(axis=0) > 0).any()
    held_out = q["eval_holdout"](spark, SF_SMALL).first()
    assert held_out["n"] == len(targets) and 0 <= held_out["map"] <= 1
    pc = q["an_pca_2d"](spark, SF_SMALL).toPandas()[["pc1", "pc2"]].to_numpy()
    cov = np.cov(pc.T)
    assert cov[0, 0] >= cov[1, 1] > 0 and abs(cov[0, 1]) < 1e-4 * cov[0, 0]
