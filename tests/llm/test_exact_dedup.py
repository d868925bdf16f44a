"""Exact dedup against a dictionary, over several rounds of the merge; DataFrame operations alone."""

from __future__ import annotations

import hashlib
import random

import pytest

from quillspark.llm import exact_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, pick=max):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm := (t or "").translate(FOLD)]
        known = [x for x in ids if x is not None]
        keep = pick(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts,fan_in", [(1, 2), (9, 2), (9, 16)])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_rounds(spark, parts, fan_in, keep):
    rng = random.Random(parts)
    rows = [(rng.randrange(1 << 40), rng.choice(["Hot TEXT", "hot text", "hot Text", f"own {i}", f"pair {i // 2}", "", None])) for i in range(400)] + [(None, "own 3"), (None, "only null"), (None, "hot text"), (5, "ÄÖÜ"), (6, "äöü"), (7, "x" * 500_000), (8, "X" * 500_000)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, digest string, run int, check int").repartition(parts)
    got = exact_dedup.exact_dedup(docs, keep=keep, fan_in=fan_in)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, max if keep == "largest" else min)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(odd).collect()), key=str) == plain(rows)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_no_python_in_the_plan(odd):
    plan = exact_dedup.exact_dedup(odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rounds_merge_sorted_runs(spark):
    """Doubling runs: four rounds for nine, each a sorted aggregation after an exchange of its own."""
    docs = spark.createDataFrame([(i, f"text {i % 7}", "x") for i in range(90)], "doc_id long, text string, run string").repartition(9)
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().sparkPlan().toString()
    merges = [x for x in plan.split("\n") if "SortAggregate" in x and "max(" in x]
    assert len(merges) >= 4 and sum("RepartitionByExpression" in x or "REPARTITION_BY_COL" in x for x in plan.split("\n")) == 4
