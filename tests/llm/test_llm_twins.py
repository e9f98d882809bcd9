"""Every training-data query that SQL can express, compared row by row with DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sensorloom.llm import registry

SF_DIR = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql_twin(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got == canonical(cursor.fetchall(), columns)


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert set(registry.queries()) - set(ORACLES) == {
        "pipeline",
        "op1_jaccard_components",
        "op4_pii_surrogates",
        "op7_bpe_round_trip",
        "op8_best_fit_packing",
        "op9_token_counts",
        "op11_bit_planes",
        "op12_periodic_runs",
        "op13_turn_repair",
    }
