"""Documents from a folder of files."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Files of this size and more are read even if some bytes are no UTF-8.
LARGE = 100 << 20
#: Plain files beyond this are read by splits, in parts of so many characters.
HUGE, PART = 1 << 30, 32 << 20
_SKIPPED = r"(?i)^\.|enwik8|\.bin$|^(quillspark|config)\.json$|\.ds_store$"

Extractor = Callable[[bytes], str]


def indexable(name: Column) -> Column:
    """Neither hidden nor one of the engine's own files."""
    return ~name.rlike(_SKIPPED)


def pdf_text(raw: bytes) -> str:
    """Text of a PDF by the program pdftotext, where a worker has it."""
    return subprocess.run(["pdftotext", "-", "-"], input=raw, capture_output=True, check=True).stdout.decode("utf-8", "replace")


EXTRACTORS: dict[str, Extractor] = {"pdf": pdf_text}


def read_folder(spark: SparkSession, path: str, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """source (file name) and text of the files right in a folder.

    Any file is read as UTF-8 text; small ones with invalid bytes go, large ones have these
    replaced. ``extractors`` maps an extension without its dot to a function from bytes to
    text, in place of EXTRACTORS, which has one for pdf; a file for which it raises goes.
    Files without text go. A plain file beyond HUGE bytes, which no row can hold for long, is
    read by its splits: as documents name#place of up to PART characters, cut between lines.
    """
    extractors = EXTRACTORS if extractors is None else extractors
    every = spark.read.format("binaryFile").load(path)
    huge = [r["path"] for r in every.where(F.col("length") > HUGE).select("path").collect()]  # the length is pushed down: no content is read
    files = every.where(F.col("length") <= HUGE).select(F.element_at(F.split("path", "/"), -1).alias("source"), "length", "content")
    files = files.where(indexable(F.col("source")))
    kind = F.lower(F.regexp_extract("source", r"\.([^.]*)$", 1))
    special = list(extractors)
    plain = files.where(~kind.isin(*special)) if special else files
    plain = plain.where(F.is_valid_utf8(F.col("content").cast("string")) | (F.col("length") > LARGE))
    out = plain.select("source", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if special:
        ship(spark)

        def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = []
                for k, content in zip(pdf["kind"], pdf["content"], strict=True):
                    try:
                        texts.append(extractors[k](bytes(content)))
                    except Exception:  # an unreadable file is passed over, whatever its reader says
                        texts.append("")
                yield pd.DataFrame({"source": pdf["source"], "text": texts})

        out = out.unionByName(files.where(kind.isin(*special)).select("source", kind.alias("kind"), "content").mapInPandas(extract, "source string, text string"))
    if huge:
        out = out.unionByName(_split_files(spark, huge).where(indexable(F.col("source")) & ~F.lower(F.regexp_extract("source", r"\.([^.#]*)#[0-9.]*$", 1)).isin(*special)))
    return out.where(F.col("text") != "")


def _split_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source (file name, #, first byte of the split and number of the part) and text of files too large for a row."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(paths).select("_metadata.file_name", "_metadata.file_block_start", F.make_valid_utf8("value").alias("value"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"source": [f"{at[0]}#{at[1]}.{number}"], "text": ["\n".join(held)]})

        for batch in batches:
            for name, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((name, start) != at or size + len(line) > PART):
                    yield flush()
                    number, held, size = number + 1, [], 0
                at, number = (name, start), number if (name, start) == at else 0
                held.append(line)
                size += len(line) + 1
        if held:
            yield flush()

    return lines.mapInArrow(parts, "source string, text string")


def read_parquet(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source and text of a table; only the two columns are read."""
    return spark.read.parquet(path).select(F.col(id_col).cast("string").alias("source"), F.coalesce(text_col, F.lit("")).alias("text")).where(F.col("text") != "")
