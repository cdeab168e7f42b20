"""Every query with an SQL twin, compared with DuckDB on the same tables."""

import math

import duckdb
import pytest

from ironlift.operators.training import classifiers, n_selected

from ironlift.plans.registry import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{D}/events.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, want.fetchall())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == b


def test_training_queries(spark):
    scores = {r.model: r.accuracy for r in QUERIES["cv_accuracy"](spark, D).collect()}
    assert set(scores) == set(classifiers()) and all(0 <= x <= 1 for x in scores.values())
    ranked = QUERIES["feature_importance"](spark, D).collect()
    weights = [r.importance for r in ranked]
    lifts = QUERIES["master_ordered"](spark, D).where("label is not null").count()
    assert len(ranked) == n_selected(lifts) and weights == sorted(weights, reverse=True) and abs(sum(weights) - 1) < 1e-9
