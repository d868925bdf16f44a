"""Ground truth and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import QUESTIONS


def parse(lines: DataFrame, col: str = "value") -> DataFrame:
    """qid, query and keywords from lines `N. query -> kw, kw`; lines without an arrow and empty keywords go."""
    trimmed = F.trim(F.col(col))
    arrow = F.instr(trimmed, "->")
    question = F.trim(F.regexp_replace(F.left(trimmed, arrow - 1), r"^[0-9.]+", ""))
    words = F.transform(F.split(F.substring(trimmed, arrow + 2, F.length(trimmed)), ","), lambda x: F.lower(F.trim(x)))
    number = F.regexp_extract(trimmed, r"^([0-9]+)", 1).try_cast("int")
    return lines.where(arrow > 0).select(number.alias("qid"), question.alias("query"), F.filter(words, lambda x: x != "").alias("keywords"))


def load(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def questions(spark: SparkSession) -> DataFrame:
    """qid, query and keywords of the built-in questions."""
    rows = [(i + 1, q, [w.lower() for w in words]) for i, (q, words) in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, "qid int, query string, keywords array<string>")


def hits(truth: DataFrame, results: DataFrame) -> DataFrame:
    """qid and hit: whether any keyword stands in the lower-case snippets and expansions of the query's results."""
    blob = results.groupBy("qid").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet", "expanded"))), lambda x: F.concat_ws(" ", x["snippet"], x["expanded"])), " ")).alias("blob"))
    found = truth.join(blob, "qid", "left")
    return found.select("qid", F.exists("keywords", lambda k: F.contains(F.coalesce("blob", F.lit("")), k)).alias("hit"))


def recall(found: DataFrame) -> DataFrame:
    """hits, queries and recall of hits()."""
    return found.agg(F.count_if("hit").alias("hits"), F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("recall"))


def ranking(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """qid, recall, mrr and ndcg at k, for results (qid, rank, doc_id) and relevant (qid, doc_id, gain)."""
    best = results.where(F.col("rank") <= k).groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    ideal = Window.partitionBy("qid").orderBy(F.desc("gain"), "doc_id")
    wanted = relevant.where(F.col("gain") > 0).withColumn("i", F.row_number().over(ideal))
    both = wanted.join(best, ["qid", "doc_id"], "left")
    discount = lambda c: F.log2(F.col(c) + 1)
    out = both.groupBy("qid").agg(
        F.avg(F.col("rank").isNotNull().cast("int")).alias("recall"),
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"),
        (F.coalesce(F.sum(F.col("gain") / discount("rank")), F.lit(0.0)) / F.sum(F.when(F.col("i") <= k, F.col("gain") / discount("i")))).alias("ndcg"),
    )
    return out.select("qid", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])
