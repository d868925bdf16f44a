"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Scaled components and scores are longs, below this in absolute value.
LIMIT = 1 << 63
#: Queries of a block whose dense score arrays are held at once.
AT_ONCE = 256


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and q (array of long): floor(scale * x) of each component as double.

    Vectors that are null, or hold null, NaN or infinite components, and rows with a null id
    take no part. A finite component that is no long once scaled is an error.
    """
    fits = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  NaN sorts above all
    floor = lambda x: F.when(F.abs(x.cast("double") * scale) < float(LIMIT), F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a scaled component exceeds 64 bits")).cast("long"))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), fits))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), floor).alias("q"))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.nonzero(scores > least)[0]
        found = np.concatenate([above, np.nonzero(scores == least)[0][: k - len(above)]])
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found]))]


def _dense(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _scores(postings: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Inner products of some queries (weights, a row each) with all rows: each term's posting list meets the queries that have the term."""
    scores = np.zeros((len(weights), postings.shape[1]), np.int64)
    for term in range(len(postings)):
        docs, asked = np.nonzero(postings[term])[0], np.nonzero(weights[:, term])[0]
        if len(docs) == postings.shape[1]:
            for a in asked:
                scores[a] += weights[a, term] * postings[term]
        elif len(docs):
            listed = postings[term, docs]
            for a in asked:
                scores[a, docs] += weights[a, term] * listed
    return scores


def _check_overflow(postings: np.ndarray, weights: np.ndarray, other: np.ndarray) -> None:
    """Raises if a score of a pair in ``other`` (a row for each query) exceeds a long. Sums wrap around, so a score that fits is right whatever its terms are."""
    sizes, asked = np.abs(postings.astype(float)), np.abs(weights.astype(float))
    if sizes.max(initial=0) * asked.max(initial=0) * len(sizes) < LIMIT / 2:
        return
    for a, doc in np.argwhere((asked @ sizes >= LIMIT / 2) & other):
        if not -LIMIT <= sum(int(x) * int(y) for x, y in zip(weights[a], postings[:, doc], strict=True)) < LIMIT:
            raise OverflowError("an inner product exceeds 64 bits")


def _search(k: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        rows = rows.sort_values("vec_id", kind="stable")
        ids, q_ids = rows["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        dims = max(map(len, [*rows["q"], *queries["q"]]))
        postings, weights = np.ascontiguousarray(_dense(list(rows["q"]), dims).T), _dense(list(queries["q"]), dims)
        found = []
        for begin in range(0, len(q_ids), AT_ONCE):
            scores = _scores(postings, weights[begin : begin + AT_ONCE])
            _check_overflow(postings, weights[begin : begin + AT_ONCE], ids != q_ids[begin : begin + AT_ONCE, None])
            for query, own in zip(q_ids[begin : begin + AT_ONCE], scores, strict=True):
                others = ids != query
                at = _top(own[others], ids[others], k)
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[others][at], "score": own[others][at]}))
        return pd.concat(found)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 8192, row_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Queries are the rows that meet ``is_query``; candidates are all rows but those with the
    query's own id; ties go to the smaller id. Rows and queries are dealt by hash into blocks
    of about the given sizes and every row block meets every query block once: within a pair
    of blocks each term's postings are scattered into dense score arrays, from which a
    partial selection keeps k per query; the selections are then merged. Both sides of a
    pair are bounded, whatever the table's size. Vectors of other lengths count as padded
    with zeros. A query without any candidate has no row. Repeated ids are candidates each,
    and a repeated query id gets one list. An empty table gives no rows; other columns are
    ignored.
    """
    prepare(vectors.sparkSession)
    rows = materialize(quantised(vectors, scale, id_col, vector_col), "vectors")
    asked = materialize(quantised(vectors.where(is_query), scale, id_col, vector_col).dropDuplicates(["vec_id"]), "queries")
    row_blocks = max(1, math.ceil(rows.count() / row_block))
    query_blocks = max(1, math.ceil(asked.count() / query_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("query_block", block(query_blocks)).withColumn("row_block", each(row_blocks))
    right = rows.withColumn("row_block", block(row_blocks)).withColumn("query_block", each(query_blocks))
    keys = ["row_block", "query_block"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
