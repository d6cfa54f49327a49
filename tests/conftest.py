from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


def views(con, sf_dir):
    """``con`` with a view on each table of ``sf_dir``."""
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.fixture(scope="session")
def duck(sf_dir):
    return views(duckdb.connect(), sf_dir)


def cell(value):
    """A value that compares alike from Spark and from DuckDB."""
    if isinstance(value, float):
        return f"{round(value, 5) + 0.0:.5f}" if value == value else "nan"
    if isinstance(value, dict):
        return tuple((k, cell(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value) if value is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def same_rows(frame, relation) -> None:
    """Same column names and the same multiset of rows."""
    names, ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    expected_names, theirs = rows_of(relation.columns, relation.fetchall())
    assert names == expected_names
    assert len(ours) == len(theirs)
    assert ours == theirs
