"""One Spark session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> Iterator[SparkSession]:
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def _cell(x: object) -> str:
    if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and x != x):
        return "null"
    if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool):
        return f"{x:.9g}"
    return repr(x)


def canonical(frame: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    """Columns by name, then rows as sorted text."""
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_cell, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same(duck: duckdb.DuckDBPyConnection) -> Callable[[DataFrame, str], None]:
    """Checks that a DataFrame has the rows that DuckDB finds."""

    def check(df: DataFrame, sql: str) -> None:
        assert canonical(df.toPandas()) == canonical(duck.execute(sql).df())

    return check
