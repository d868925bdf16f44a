"""Exact deduplication by a tree merge of sorted digest runs, with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: What equal texts agree in: SHA-256, and as a check of it at every level a hash of another kind and the length.
KEY = ["digest", "check", "n_bytes"]


def _merged(runs: DataFrame, run: Column, best: Column) -> DataFrame:
    """Runs that ``run`` gives one number are exchanged and merged: rows of a digest, which the order brings side by side, become one.

    ``best`` is of a struct, which Spark aggregates over sorted rows only: a merge as they pass, without a hash table.
    """
    met = runs.withColumn("run", run).repartition(*KEY, "run").sortWithinPartitions(*KEY, "run")
    return met.groupBy(*KEY, "run").agg(best.getField("id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 2) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Every scan partition is one run: its rows carry the digest of the normalised text (A-Z
    lower-cased) and the run's number, sorted by digest, in a table of the shared folder; a
    digest is one row of a run before anything moves. Runs are then merged in binomial
    rounds, ``fan_in`` neighbours at a time: each round exchanges them by digest and new run,
    brings equal digests side by side by sorting, and keeps one row of each, with the id that
    stays and the count. So a digest that fills a third of the table is a row per run in the
    first round, half as many in the next, and never in one task as a whole. Every merge
    holds rows equal only if SHA-256, a second hash (xxHash64) and the byte length all agree;
    texts themselves are not compared, as that would move them. The winners go back down the
    tree: to the runs (at most one row per digest and run) and from there to the rows of
    that run.

    Null text counts as empty; empty texts are equal to each other. A null id never wins
    over another; a group with null ids only keeps null as keep_id. Rows that repeat both id
    and text are all kept if their id is the one that stays. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    pick = {"largest": F.max, "smallest": F.min}[keep]
    best = pick(F.when(F.col("keep_id").isNotNull(), F.struct(F.col("keep_id").alias("id"))))  # null ids take no part
    runs = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("n_bytes"), F.spark_partition_id().alias("run")
    )
    runs = materialize(runs.sortWithinPartitions(*KEY), "digest-runs")
    last = runs.agg(F.max("run")).first()[0] or 0

    leaves = runs.groupBy(*KEY, "run").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    merged = leaves
    while last > 0:
        last //= fan_in
        merged = _merged(merged, F.floor(F.col("run") / fan_in).cast("int"), best)
    winners = merged.select(*KEY, "keep_id", "group_size")

    by_run = leaves.select(*KEY, "run").join(winners, KEY)
    return runs.join(by_run, [*KEY, "run"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
