"""Composed engines: BM25 with rank fusion, cosine with reranking, context and result rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import ClassVar


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FIELD_CANDIDATES, FINANCE_TERMS, Settings
from ..functions import segment, text
from ..scratch import materialize, scratch_path
from . import embed, score
from .index import KEY, AskedIndex, ChunkIndex, Vocabulary, kept_in_memory, lookup_terms, sparse_vectors, vocabulary


#: Keys of a block that a query meets.
KEY_BLOCK = 4096


def with_next(chunks: DataFrame) -> DataFrame:
    """Adds next: the content of the following chunk of the same document, or null."""
    return chunks.withColumn("next", F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk_no")))


def expanded(content: Column, following: Column, most: int) -> Column:
    """A chunk with up to 600 characters of the next, cut at ``most``."""
    return F.left(F.when(following.isNull(), content).otherwise(F.concat(content, F.lit(" "), F.left(following, F.lit(600)))), F.lit(most))


def _results(ranked: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], snippet: int, most: int, flat: bool, few: bool) -> DataFrame:
    """qid, rank, doc_id, chunk_no, score, page, source, heading, snippet and expanded.

    The ranked few are found first; those of few queries go to the driver, and their
    documents are looked up by a pushed list, those of many are written and joined. chunks
    are a table, or made for the ranked few by a function.
    """
    spark, ranked = ranked.sparkSession, ranked.select("qid", "rank", *KEY, "score")
    if few:
        table = ranked.toArrow()
        found, listed = spark.createDataFrame(table), table["doc_id"].unique().to_pylist()
    else:
        found, listed = materialize(ranked, "ranked"), None
    if not isinstance(chunks, DataFrame):
        known = chunks(found)
    elif listed is not None and len(listed) <= score.LISTED:
        known = chunks.where(F.col("doc_id").isin(listed))
        known = known.coalesce(1) if len(listed) <= 20 else known
    else:
        known = chunks.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    cut = text.snippet(F.col("content"), snippet) if flat else F.left("content", F.lit(snippet))
    wide = expanded(F.col("content"), F.col("next"), most)
    wide = F.regexp_replace(wide, text.WHITE, " ") if flat else wide
    page = F.col("page") if "page" in known.columns else F.lit(0)
    return found.join(with_next(known), KEY).select("qid", "rank", *KEY, "score", page.alias("page"), F.col("doc_id").cast("string").alias("source"), "heading", cut.alias("snippet"), wide.alias("expanded"))


def bm25_search(index: ChunkIndex | AskedIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """Words and trigrams by BM25, 200 each, fused by reciprocal rank, boosted for grouped numerals; the best k (1 at least)."""
    asked = score.asked_terms(index, queries)
    lists = score.by_score(score.covered(score.scored(index, asked)), FIELD_CANDIDATES, by=("qid", "field"))
    fused = score.fused(lists, asked.postings is not None and asked.postings <= score.ONE_TASK)
    if isinstance(index, AskedIndex):  # a few hundred are left of each query, which are scored once
        fused, chunks = queries.sparkSession.createDataFrame(fused.toArrow()) if score.few(queries) else materialize(fused, "fused"), index.texts
    else:
        chunks = index.chunks
    boosted = score.numeric_boost(fused, chunks, queries).withColumn("score", F.col("boosted"))
    ranked = score.by_score(boosted.select("qid", *KEY, "score"), max(k, 1))
    return _results(ranked, chunks, 300, 900, flat=True, few=score.few(queries))


@dataclass
class CosineIndex(Vocabulary):
    """TF-IDF vectors of chunks by a vocabulary of whole texts."""

    chunks: DataFrame
    vectors: DataFrame
    TABLES: ClassVar[tuple[str, ...]] = ("vocab", "chunks", "vectors")

    def warmed(self) -> CosineIndex:
        """This index kept in memory for searches, if its tables are small; its vocabulary is then held by the driver. Else as it is."""
        if kept_in_memory([self.chunks, self.vocab, self.vectors]):
            self.hold()
        return self

    @classmethod
    def build(cls, docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", idf_unit: str = "file", path: str | None = None) -> CosineIndex:
        """idf_unit: whether idf counts files (as on a fresh index) or chunks (as after reading one back)."""
        settings, spark = settings or Settings(), docs.sparkSession
        root = path or scratch_path(spark, "cosine-index")
        segment.chunks(docs, settings.chunking, id_col, text_col).write.option("compression", "zstd").parquet(f"{root}/chunks")
        chunks = spark.read.parquet(f"{root}/chunks")
        vocab = vocabulary(docs, text_col) if idf_unit == "file" else vocabulary(chunks, "content")
        vocab.sortWithinPartitions("term").write.parquet(f"{root}/vocab")
        vocab = spark.read.parquet(f"{root}/vocab")
        sparse_vectors(chunks, KEY, "content", vocab).write.option("compression", "zstd").parquet(f"{root}/vectors")  # a block's terms come in order, so a search reads few pages
        return cls(vocab, chunks, spark.read.parquet(f"{root}/vectors"))

    @classmethod
    def asked(cls, docs: DataFrame, queries: DataFrame, settings: Settings | None = None) -> CosineIndex:
        """Like build(), to be searched for some queries only: of all vectors, the weights of their terms are written."""
        settings = settings or Settings()
        chunks, vocab = materialize(segment.chunks(docs, settings.chunking), "chunks"), materialize(vocabulary(docs), "vocab")
        terms = {r[0] for r in queries.select(F.explode(lookup_terms(F.col("query")))).distinct().collect()}
        return cls(vocab, chunks, materialize(sparse_vectors(chunks, KEY, "content", vocab, terms), "vectors"))

    def save(self, path: str) -> None:
        for t in self.TABLES:
            getattr(self, t).write.parquet(f"{path}/{t}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CosineIndex:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in cls.TABLES])

    def stats(self) -> DataFrame:
        """chunks and word_terms."""
        both = self.chunks.agg(F.count("*").alias("chunks")).unionByName(self.vocab.agg(F.count("*").alias("word_terms")), allowMissingColumns=True)
        return both.agg(F.max("chunks").alias("chunks"), F.max("word_terms").alias("word_terms"))


def candidates(index: CosineIndex, queries: DataFrame, settings: Settings) -> DataFrame:
    """qid, doc_id, chunk_no, sparse and rank of the best chunks; those that share no term follow the positive ones with 0.

    Queries with enough positive chunks need no others. For the rest, chunks that they don't
    hit are taken in key order.
    """
    spark, most, order = queries.sparkSession, settings.top_k_candidates, F.desc(F.round("sparse", 9))
    asked, listed = score.query_vectors(queries, index)
    posted = index.vectors.where(listed)
    hits = score.sparse_scores(posted.coalesce(1) if index.held else posted, asked).select("qid", *KEY, "sparse")
    top = score.best(hits.where(F.round("sparse", 9) > 0), most, order)  # at most so many a query
    few = score.few(queries)
    found = spark.createDataFrame(top.toArrow()) if few else materialize(top, "candidates")
    counts = found.groupBy("qid").agg(F.count("*").alias("_n"))
    short = queries.select("qid").join(counts, "qid", "left").where(F.coalesce("_n", F.lit(0)) < most).select("qid")
    short = spark.createDataFrame(short.toArrow()) if few else materialize(short, "short")
    if short.isEmpty():
        return found
    hit = materialize(hits.join(short, "qid", "left_semi"), "hits")
    filler = _unhit(index.chunks.select(*KEY), hit.select("qid", *KEY), short, most)
    both = hit.unionByName(filler.withColumn("sparse", F.lit(0.0)))
    return found.join(short, "qid", "left_anti").unionByName(score.best(both, most, order))


def _unhit(keys: DataFrame, hit: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """qid and the first ``most`` keys of each query that it doesn't hit.

    A prefix of the keys is looked at, four times as long each round, for those queries only
    that found too few in the last, so the work of a query grows with its own hits.
    """
    total, size, done, left = keys.count(), 2 * most, None, queries
    while True:
        blocks = -(-min(size, total) // KEY_BLOCK)
        first = keys.orderBy(*KEY).limit(min(size, total)).withColumn("_block", F.pmod(F.xxhash64(*KEY), F.lit(blocks)))
        each = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))  # a query that is left meets the prefix block by block
        free = first.join(each, "_block").select("qid", *KEY).join(hit, ["qid", *KEY], "left_anti")
        free = materialize(score.best(free, most), "free").select("qid", *KEY)
        done = free if done is None else done.join(left, "qid", "left_anti").unionByName(free)
        if size >= total:
            return done
        enough = free.groupBy("qid").agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select("qid")
        left = materialize(left.join(enough, "qid", "left_anti"), "left")
        if left.isEmpty():
            return done
        size *= 4


def reranked(found: DataFrame, chunks: DataFrame, queries: DataFrame, settings: Settings, terms: Sequence[str] = FINANCE_TERMS, dense: DataFrame | None = None) -> DataFrame:
    """Adds dense, combined, finance, overlap and score. dense: qid, doc_id, chunk_no and dense; 0 where absent."""
    found = found.join(dense, ["qid", *KEY], "left") if dense is not None else found.withColumn("dense", F.lit(0.0))
    found = found.withColumn("dense", F.coalesce("dense", F.lit(0.0)))
    asked = queries.select("qid", score.query_trigrams(F.col("query")).alias("_asked"))
    w = settings.rerank_weight
    out = found.join(chunks.select(*KEY, "content"), KEY).join(asked, "qid")
    out = out.withColumn("combined", w * F.col("dense") + (1 - w) * F.col("sparse"))
    out = out.withColumn("finance", score.finance_boost(F.col("content"), settings.financial_boost, terms)).withColumn("overlap", score.trigram_overlap(F.col("content"), F.col("_asked")))
    return out.withColumn("score", F.col("combined") + F.col("finance") + F.col("overlap")).drop("_asked", "content")


def cosine_search(index: CosineIndex, queries: DataFrame, k: int = 10, settings: Settings | None = None, terms: Sequence[str] = FINANCE_TERMS, dense: DataFrame | None = None, load: Callable[[], embed.Encoder] | None = None, hashed: bool = False) -> DataFrame:
    """Candidates by sparse cosine, reranked with dense similarity and boosts; the best k.

    Dense similarity is 0 unless it is given (qid, doc_id, chunk_no, dense), or computed for
    the candidates by an encoder (load) or from hashed n-grams.
    """
    settings = settings or Settings()
    found = candidates(index, queries, settings)
    if dense is None and (load is not None or hashed):
        found = materialize(found, "candidates")
        dense = embed.dense(found, index.chunks, queries, settings.embedding_dim, load)
    scored = reranked(found, index.chunks, queries, settings, terms, dense)
    ranked = score.best(scored.drop("rank"), k, F.desc(F.round("score", 9)), F.desc(F.round("sparse", 9))).select("qid", "rank", *KEY, "score")
    return _results(ranked, index.chunks, 600, 2000, flat=False, few=score.few(queries))


def as_json(results: DataFrame) -> DataFrame:
    """qid and a JSON array of the results in rank order, scores with four decimals."""
    row = F.struct("rank", "doc_id", "chunk_no", F.round("score", 4).alias("score"), "page", "source", "heading", "snippet", "expanded")
    return results.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("results"))
