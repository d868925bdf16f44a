"""Line deduplication: boilerplate is what many distinct sites share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Registers of a sketch: 2**12, a relative standard error of 1.6 %.
LG_K = 12
#: Estimates within this factor of the threshold are near it: over 15 standard errors wide.
NEAR = 1.25


def _line_hash(line: Column) -> Column:
    """128 bits of the line without outer white space."""
    return F.unhex(F.md5(line.cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def repeated_lines(docs: DataFrame, min_sites: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """doc_id, text_hash, pos and home (the first occurrence) of every line that stands on ``min_sites`` distinct sites or more."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(site_col).cast("string").alias("site"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = F.transform(F.transform(_lines(F.col("text")), _trimmed), lambda x: F.when(x != "", _line_hash(x)))
    whole = source.select("doc_id", "site", F.xxhash64("text").alias("text_hash"), hashed.alias("hashed"))  # below the generator, so once for each text
    lines = whole.select("doc_id", "site", "text_hash", F.posexplode("hashed").alias("pos", "line")).where(F.col("line").isNotNull())
    lines = materialize(lines, "lines")
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("home"))
    spread = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch").where(F.col("sites") >= min_sites / NEAR)
    found = materialize(lines.join(materialize(spread, "spread"), "line"), "shared-lines")
    near = found.where(F.col("sites") <= min_sites * NEAR)
    exact = near.groupBy("line", "site").agg(F.lit(1).alias("one"))  # first, so that a line of many rows shrinks before it moves
    exact = exact.groupBy("line").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    near = near.join(materialize(exact.select("line"), "exact-lines"), "line", "left_semi")
    both = found.where(F.col("sites") > min_sites * NEAR).unionByName(near)
    return both.select("doc_id", "text_hash", "pos", "home")


def line_dedup(docs: DataFrame, min_sites: int = 3, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with the lines removed that occur on ``min_sites`` distinct sites or more, but for one occurrence of each.

    Adds n_lines and n_removed to the columns of docs (in place of columns of these names). Lines are compared without spaces,
    tabs and carriage returns at their ends; blank lines are never removed. What stays is the
    first occurrence by (id, text hash, position), so no line is lost from the corpus. The
    spread of a line over sites is a HyperLogLog sketch, built per partition and merged;
    lines whose estimate lies near the threshold get an exact distinct count, so decisions
    are those of exact counting. A null site counts as none. Null text counts as empty, has
    one (blank) line, and stays null. Rows that repeat both id and text are one document
    here: all keep or lose the same lines. An empty table gives no rows.
    """
    at = F.struct("doc_id", "text_hash", "pos")
    removed = (
        repeated_lines(docs, min_sites, id_col, text_col, site_col)
        .where(~at.eqNullSafe(F.col("home")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("_line_dedup_gone"))
        .select(F.col("doc_id").alias("_line_dedup_id"), F.col("text_hash").alias("_line_dedup_hash"), "_line_dedup_gone")
    )
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text, lines, gone = F.coalesce(F.col(text_col), F.lit("")), F.col("_line_dedup_lines"), F.col("_line_dedup_gone")
    # Cut into lines before the join: an array of its output is read by position, where one built above it would be built anew for each.
    cut = docs.select(*[c for c in rest if c != text_col], F.split(F.col(text_col), "\n", -1).alias("_line_dedup_lines"), F.xxhash64(text).alias("_line_dedup_text"))
    joined = cut.join(removed, F.col(id_col).cast("long").eqNullSafe(F.col("_line_dedup_id")) & (F.col("_line_dedup_text") == F.col("_line_dedup_hash")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)  # by hash, so in proportion to the lines
    kept = F.array_join(F.when(gone.isNull(), lines).otherwise(F.transform(stay, lambda i: F.get(lines, i))), "\n")
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in rest],
        F.coalesce(F.size(lines), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
