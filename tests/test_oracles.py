"""Every registered query with an SQL twin, compared row by row with DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

# The training-data operators have tests of their own.
NAMES = list(entry_point.registry.queries())
TWINS = entry_point.oracles.oracle_sql()
# Full hyper-parameters take minutes; the gate runs these at the next scale up.
SLOW = {
    "logistic_regression", "linear_svm", "boosted_trees", "model_comparison",
    "model_comparison_all_seeds", "forest_tuning", "experiment",
}
# With 48 sessions for 285 features not every fit is right here; at the next scale up it is.
NEARLY = {"final_predictions": "user_id"}
ORACLES = {name: sql for name, sql in TWINS.items() if name not in SLOW | NEARLY.keys()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql_twin(spark, sf_dir, duck, name):
    df = entry_point.queries()[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got == canonical(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", NEARLY)
def test_fits_are_nearly_right_on_few_sessions(spark, sf_dir, duck, name):
    predicted = entry_point.queries()[name](spark, sf_dir)
    cursor = duck.execute(TWINS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(predicted.columns) == sorted(columns)
    truth = {row[columns.index("session_id")]: row[columns.index(NEARLY[name])] for row in cursor.fetchall()}
    found = {r["session_id"]: r[NEARLY[name]] for r in predicted.collect()}
    assert found.keys() == truth.keys()
    assert sum(found[s] == truth[s] for s in truth) >= 0.75 * len(truth)


def test_every_query_has_a_twin():
    assert set(NAMES) == set(TWINS)
    assert set(NAMES) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert len(df.columns) == 2 + 5 * 57
    assert df.count() == 60
