"""Scoring and fusion over index tables. Every query carries a qid, so one job answers any number."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, FINANCE_TERMS, FUSION_K, NUMERIC_BOOST, TRIGRAM_WEIGHT, WORD_WEIGHT
from ..functions import text
from .index import KEY, LISTED, AskedIndex, ChunkIndex, Vocabulary, bm25_idf, lookup_terms, sparse_vectors


#: Up to so many postings are scored by one task, without an exchange.
ONE_TASK = 200_000


def few(queries: DataFrame) -> bool:
    """Whether the planner knows that the queries are LISTED at most, as it does of query_frame()."""
    most = queries._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() <= LISTED


def query_frame(spark: SparkSession, queries: Sequence[tuple[int, str]]) -> DataFrame:
    """qid and query; blank ones go, as they find nothing. A local relation, whose size the planner knows."""
    rows = [(i, q) for i, q in queries if q.strip(" ")]
    columns = {"qid": pa.array([i for i, _ in rows], pa.int32()), "query": pa.array([q for _, q in rows], pa.string())}
    return spark.createDataFrame(pa.table(columns))


def _query_fields(queries: DataFrame) -> DataFrame:
    """qid and the terms of each field (w, t), repeated as in the query."""
    words = queries.select("qid", text.tokens(text.collapse(F.col("query"))).alias("_words"))
    base = text.without_stopwords(F.col("_words"))
    return words.select("qid", F.concat(base, text.bigrams(base)).alias("w"), text.trigrams(F.col("_words")).alias("t"))


def terms_of(queries: DataFrame, fields: Sequence[str] = ("w", "t")) -> dict[str, list[str]]:
    """The terms of some queries by field, for an index of these alone."""
    rows = _query_fields(queries).collect()
    return {field: sorted({t for r in rows for t in r[field]}) for field in fields}


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, field, term, qf (occurrences in the query) and nq (distinct terms of it in the field, unknown ones too)."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in ("w", "t")])
    count = lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("qf"))  # noqa: E731  queries are short
    found = _query_fields(queries).select("qid", F.inline(fields))
    return found.select("qid", "field", F.size(F.array_distinct("terms")).alias("nq"), F.inline(F.transform(F.array_distinct("terms"), count)))


_WEIGHED = pa.schema([("qid", pa.int32()), ("field", pa.string()), ("nq", pa.int32()), ("term", pa.string()), ("qf", pa.int32()), ("idf", pa.float64())])


@dataclass
class Asked:
    """The terms of some queries (query_terms() with a positive idf), a condition on terms for scans, and how many postings meet both (None: unknown)."""

    terms: DataFrame
    listed: Column
    postings: int | None


def asked_terms(index: ChunkIndex | AskedIndex, queries: DataFrame, fields: Sequence[str] = ("w", "t")) -> Asked:
    """The terms of a few queries are looked up by a pushed list, and the planner is given the rows that come of it; those of many are joined."""
    n = index.field_stats()[0]
    if few(queries):
        rows = []
        for r in _query_fields(queries).collect():
            for field in fields:
                counted = Counter(r[field])
                rows += [{"qid": r["qid"], "field": field, "nq": len(counted), "term": t, "qf": qf} for t, qf in counted.items()]
        terms = {r["term"] for r in rows}
        if len(terms) <= LISTED:
            df, found, postings = index.frequencies(terms), [], 0
            for r in rows:
                k = df.get((r["field"], r["term"]), 0)
                if k and (idf := math.log((n - k + 0.5) / (k + 0.5) + 1)) > 0:
                    found.append(r | {"idf": idf})
                    postings += k
            return Asked(queries.sparkSession.createDataFrame(pa.Table.from_pylist(found, schema=_WEIGHED)), F.col("term").isin(sorted(terms)), postings)
    joined = query_terms(queries).where(F.col("field").isin(*fields)).join(index.document_frequency(), ["field", "term"])
    return Asked(joined.withColumn("idf", bm25_idf(F.col("df"), F.lit(float(n)))).where(F.col("idf") > 0), F.lit(True), None)


def bm25(index: ChunkIndex | AskedIndex, queries: DataFrame, fields: Sequence[str] = ("w", "t")) -> DataFrame:
    """qid, field, doc_id, chunk_no, raw (sum of contributions), matched (distinct query terms) and nq."""
    return scored(index, asked_terms(index, queries, fields), fields)


def scored(index: ChunkIndex | AskedIndex, asked: Asked, fields: Sequence[str] = ("w", "t")) -> DataFrame:
    """bm25() of terms that have been looked up; few postings are scored by one task."""
    _, w_avg, t_avg = index.field_stats()
    few_postings = asked.postings is not None and asked.postings <= ONE_TASK
    hits = index.hits(asked.terms.select("qid", "field", "term", "qf", "nq", "idf"), asked.listed & F.col("field").isin(*fields), few_postings)
    norm = 1 - BM25_B + BM25_B * F.col("len") / F.when(F.col("field") == "w", w_avg).otherwise(t_avg)
    gain = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * norm) * (1 + 0.1 * (F.col("qf") - 1))
    found = hits.groupBy("qid", "field", "block", "row", *KEY).agg(F.sum(gain).alias("raw"), F.count("*").alias("matched"), F.first("nq").alias("nq"))  # dealt by block and row already
    return found.drop("block", "row")


def covered(scored: DataFrame) -> DataFrame:
    """Adds score: raw times 0.4 + 0.6 * coverage, and 0.5 more at full coverage."""
    full = F.when(F.col("matched") == F.col("nq"), 0.5).otherwise(0.0)
    return scored.withColumn("score", F.col("raw") * (0.4 + 0.6 * F.col("matched") / F.col("nq") + full))


def best(scored: DataFrame, k: int, *order: Column, by: Sequence[str] = ("qid",)) -> DataFrame:
    """The first k of each query with their rank from 1; ties go to the earlier chunk."""
    window = Window.partitionBy(*by).orderBy(*order, *KEY)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def by_score(scored: DataFrame, k: int, by: Sequence[str] = ("qid",)) -> DataFrame:
    return best(scored, k, F.desc(F.round("score", 9)), by=by)


def fused(ranked: DataFrame, together: bool = False) -> DataFrame:
    """qid, doc_id, chunk_no and score: the weighted reciprocal ranks in the lists of both fields. together: whether one task has them all."""
    weight = F.when(F.col("field") == "w", WORD_WEIGHT).otherwise(TRIGRAM_WEIGHT)
    ranked = ranked if together else ranked.repartition("qid")  # the sums and the ranks that follow need no further exchange
    return ranked.groupBy("qid", *KEY).agg(F.sum(weight / (FUSION_K + F.col("rank"))).alias("score"))


def query_numbers(queries: DataFrame) -> DataFrame:
    """qid and its grouped numerals, for queries that have any."""
    numbers = F.filter(text.tokens(text.collapse(F.col("query"))), text.is_thousands)
    return queries.select("qid", numbers.alias("_numbers")).where(F.size("_numbers") > 0)


def numeric_boost(scored: DataFrame, contents: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame) -> DataFrame:
    """Adds boosted: score, and NUMERIC_BOOST once if the content holds a grouped numeral of the query. Contents are read for queries with numerals only; they are a table, or made for rows by a function."""
    numbers = query_numbers(queries)
    if numbers.isEmpty():
        return scored.withColumn("boosted", F.col("score"))
    asked = scored.join(numbers, "qid")
    asked = asked.join((contents(asked) if callable(contents) else contents).select(*KEY, "content"), KEY)
    hit = asked.where(F.exists("_numbers", lambda x: F.contains("content", x))).select("qid", *KEY, F.lit(NUMERIC_BOOST).alias("_boost"))
    return scored.join(hit, ["qid", *KEY], "left").withColumn("boosted", F.col("score") + F.coalesce("_boost", F.lit(0.0))).drop("_boost")


_VECTORS = pa.schema([("qid", pa.int32()), ("term", pa.string()), ("weight", pa.float64())])


def query_vectors(queries: DataFrame, index: Vocabulary) -> tuple[DataFrame, Column]:
    """qid, term and weight, and a condition on terms for scans. Terms of a few queries are looked up by a pushed list."""
    if few(queries):
        asked = [(r["qid"], Counter(r["terms"])) for r in queries.select("qid", lookup_terms(F.col("query")).alias("terms")).collect()]
        terms = set().union(*(c for _, c in asked))
        if len(terms) <= LISTED:
            idf, rows = index.weights(terms), []
            for qid, counted in asked:
                raw = {t: n * idf[t] for t, n in counted.items() if t in idf}
                norm = math.sqrt(math.fsum(x * x for x in raw.values()))
                rows += [{"qid": qid, "term": t, "weight": x / norm if norm > 0 else x} for t, x in raw.items()]
            return queries.sparkSession.createDataFrame(pa.Table.from_pylist(rows, schema=_VECTORS)), F.col("term").isin(sorted(terms))
    return sparse_vectors(queries, ["qid"], "query", index.vocab), F.lit(True)


def sparse_scores(vectors: DataFrame, query_vectors: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """qid, keys and sparse: the inner product of unit vectors, for those that share a term."""
    asked = query_vectors.select("qid", "term", F.col("weight").alias("_q"))
    return vectors.join(asked, "term").groupBy("qid", *keys).agg(F.sum(F.col("weight") * F.col("_q")).alias("sparse"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays over their common length, in double; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    square = lambda x: total(F.transform(x, lambda v: v.cast("double") * v.cast("double")))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def finance_boost(content: Column, boost: float, terms: Sequence[str] = FINANCE_TERMS) -> Column:
    """boost if the text has one of the terms and over 20 digits, else 0."""
    return F.when(text.has_term(content, terms) & (text.digit_count(content) > 20), boost).otherwise(0.0)


def query_trigrams(query: Column) -> Column:
    """Distinct padded trigrams of the query's words of four characters or more."""
    words = F.filter(text.white_terms(query), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.flatten(F.transform(words, text.padded_trigrams)))


def trigram_overlap(content: Column, asked: Column) -> Column:
    """2 * hits / (asked + seen) over the first 120 words, up to the word with which over 400 trigrams are seen."""
    words = F.filter(F.slice(text.white_terms(content), 1, 120), lambda w: F.length(w) >= 4)
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("tot"))

    def merge(a: Column, w: Column) -> Column:
        hits = F.size(F.filter(text.padded_trigrams(w), lambda g: F.array_contains(asked, g)))
        more = F.struct((a["hit"] + hits).alias("hit"), (a["tot"] + F.length(w)).alias("tot"))
        return F.when(a["tot"] > 400, a).otherwise(more)

    share = lambda a: F.when((a["tot"] > 0) & (F.size(asked) > 0), 2.0 * a["hit"] / (F.size(asked) + a["tot"])).otherwise(0.0)
    return F.aggregate(words, start, merge, share)
