"""Helpers shared by the training-data operators: scratch tables, hashing and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, materialize, scratch_path, spread
from ..shipping import ship

__all__ = ["drop", "materialize", "scratch_path", "spread"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A batch that goes to Python holds at most this many rows and roughly this many bytes.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers and keeps the Arrow batches small enough for very long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod. A null id counts as remainder 0 of an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def whole_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its texts exceed max_bytes, so that intermediate values stay bounded."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(text).cast(pa.binary()).to_pylist()] if batch.nbytes > max_bytes else None
    if sizes is None:
        if batch.num_rows:
            yield batch
        return
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > max_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def words(text: str) -> list[bytes]:
    """Words of a whole text after lower-casing A-Z: runs of anything but bytes 0x20 and 0x09 to 0x0D, where bytes are split."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def to_batch(columns: dict[str, tuple[Iterable, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], names=list(columns))


def stratified(df: DataFrame, stratum: Column, order: Column, most: int | Column, strata: int = 256) -> DataFrame:
    """A repeatable sample of about ``most`` rows at most of each of the ``strata`` commonest values of stratum, by the hash of ``order``."""
    keyed = df.withColumn("_stratum", stratum.cast("string")).where(F.col("_stratum").isNotNull())
    common = keyed.groupBy("_stratum").agg(F.count("*").alias("_rows")).orderBy(F.desc("_rows"), "_stratum").limit(strata)
    share = F.least(F.lit(1.0), most / F.col("_rows"))
    return keyed.join(F.broadcast(common), "_stratum").where(F.pmod(F.xxhash64(order), F.lit(1 << 20)) < share * (1 << 20)).drop("_stratum", "_rows")
