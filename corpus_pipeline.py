"""Corpus pipeline: toxicity, language, line dedup, near-dedup, packing, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, line_dedup, near_dedup, packing, toxicity
from quillspark.llm.common import prepare, read_table, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its likeliest language is less likely than so many times the mean of all (and than LEAST_CERTAIN).
TIMES_THE_MEAN, LEAST_CERTAIN = 1.5, 0.5


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled ones among them, doesn't call toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("predicted") == 0).select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network has learned: those without a letter go, and those of which no language is half as likely again as the mean of all.

    Where nothing could be learned, there is nothing to reject by, and all documents stay.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.select(*COLUMNS)
    found = langid.predict(docs, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= min(LEAST_CERTAIN, TIMES_THE_MEAN / len(model.langs)))).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three sites or more share, but for one occurrence of each.

    n_chars follows the text. A document of which nothing but white space is left goes:
    each of its lines stands elsewhere.
    """
    found = line_dedup.line_dedup(docs)
    changed = F.col("n_removed") > 0
    return found.where(~changed | F.col("text").rlike(r"\S")).withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word shingles, similarity 0.8)."""
    found = near_dedup.near_dedup(docs, shingle=5, percent=80)
    ids = found.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", keep_civil), ("language", keep_known_language), ("line dedup", drop_boilerplate), ("near-dedup", keep_one_of_near_copies), ("packing", pack)]

#: The trained stages can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet to the shared folder and read again."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(path := scratch_path(spark, f"stage-{i}"))
        docs = spark.read.parquet(path)
    return docs
