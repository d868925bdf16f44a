"""Every registered search query against its SQL counterpart over the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from quillspark.plans import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), SQL[name])


def test_every_counterpart_has_a_query():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["qid", "rank", "doc_id", "chunk_no", "score", "source", "heading", "snippet", "expanded"]
    assert found.count() == 40


def test_rare_terms_have_rows(spark, sf_dir):
    """Every term has its frequency, the rarest too."""
    found = {r["df"] for r in QUERIES["b_df"](spark, sf_dir).select("df").distinct().collect()}
    assert {1, 2, 3, 4} < found and max(found) > 50


def test_judgments_look_at_no_results(spark, sf_dir):
    """Judged documents that a search misses lower its recall."""
    found = QUERIES["eval_ranking"](spark, sf_dir).collect()
    assert len(found) == 4 and all(0 < r["recall"] <= 1 and 0 < r["ndcg"] <= 1 for r in found)
    assert min(r["recall"] for r in found) < 0.5
