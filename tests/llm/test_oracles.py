"""Every registered training-data query: SQL where there is some, and rows of the whole table in any case."""

from __future__ import annotations

import pytest

import __spark_entry__
from quillspark.llm import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()
TABLE = {"op1_warc": "pages", "op9_topk_search": "embeddings"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), SQL[name])


def test_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SQL and q != "op4_packing"])
def test_whole_table(name, spark, sf_dir):
    got = sorted(r["doc_id"] for r in QUERIES[name](spark, sf_dir).select("doc_id").collect())
    assert got == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
