"""Packing of token sequences: bounded-space online best fit, leftovers merged in rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import materialize, prepare, slices, spread, whole_texts

_COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Rows of the first pass also hold the run they came from and, where a window stayed open, their ids.
_SCHEMA = f"{_PIECE}, run long, ids binary"
_KINDS = _COLUMNS | {"run": pa.int64(), "ids": pa.binary()}


class Packer:
    """At most ``open_windows`` windows are open; rows of windows that are closed gather in ``rows``."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.limit, self.next_id = window, open_windows, first_id
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def _put(self, slot: list, piece: tuple) -> None:
        slot[0] += len(piece[2]) // 4
        slot[1].append(piece)
        if slot[0] == self.window:
            self._emit(slot[1])
            self.open = [x for x in self.open if x is not slot]

    def add(self, doc_id: int | None, start: int, ids: bytes, total: int) -> None:
        """Whole windows of a document stand alone; the rest goes to the open window it fills best.

        If it fits in none and all are in use, its head fills up the fullest, which is then
        emitted without padding, and its tail opens a new one.
        """
        view = memoryview(ids)
        while len(view) >= 4 * self.window:
            self._emit([(doc_id, start, bytes(view[: 4 * self.window]), total)])
            view, start = view[4 * self.window :], start + self.window
        while n := len(view) // 4:
            fits = [x for x in self.open if self.window - x[0] >= n]
            if fits:
                self._put(max(fits, key=lambda x: x[0]), (doc_id, start, bytes(view), total))
                return
            if len(self.open) < self.limit:
                self.open.append([0, []])
                continue
            fullest = max(self.open, key=lambda x: x[0])
            room = self.window - fullest[0]
            self._put(fullest, (doc_id, start, bytes(view[: 4 * room]), total))
            view, start = view[4 * room :], start + room

    def close(self) -> None:
        """Empties all windows: what they hold is laid end to end, so that one sequence at most is short."""
        pieces = [p for slot in sorted(self.open, key=lambda x: -x[0]) for p in slot[1]]
        self.open, self.limit = [], 1
        for piece in pieces:
            self.add(*piece)
        for slot in self.open:
            self._emit(slot[1])
        self.open = []

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def leftovers(self) -> list[tuple]:
        return [(d, s, len(ids) // 4, zlib.crc32(ids), total, ids) for _, pieces in self.open for d, s, ids, total in pieces]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)], names=list(_KINDS))


def _rows(done: list[tuple], rest: list[tuple], run: int) -> pa.RecordBatch:
    return _table([(*r, run, None) for r in done] + [(*r[:5], None, None, run, r[5]) for r in rest])


def _merger(window: int, open_windows: int, base: int, final: bool):
    """Packs what a group of runs left; the last group of all closes its windows."""

    def merge(table: pa.Table) -> pa.Table:
        group = table["group"][0].as_py()
        packer = Packer(window, open_windows, base + (group << 32))
        pieces = zip(*(table[c].to_pylist() for c in ("run", "doc_id", "start", "ids_crc32", "ids", "doc_tokens")), strict=True)
        for _, doc_id, start, _, ids, total in sorted(pieces, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3])):
            packer.add(doc_id, start, ids, total)
        if final:
            packer.close()
        return pa.Table.from_batches([_rows(packer.take(), packer.leftovers(), group)])

    return merge


def pack(docs: DataFrame, path: str, pattern: str, window: int = 1024, open_windows: int = 8, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 64, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and one ``end_id``; null text counts as empty and
    so is a single id. Ids are those of the tokenizers library for the file at ``path``
    without special tokens of its own; as there, the string of a special token in a text is
    that token, unless ``special_as_text``. (They are taken from its ranks, which give the
    same ids faster: ByteBpe.encode_ranked().) Every partition packs its own documents with ``open_windows`` windows;
    what then stays in open windows (a bounded number of ids per partition) is merged,
    ``fan_in`` partitions at a time, until one group is left, whose last sequence alone is
    short. The first pass is written to the shared folder: a task that runs again cannot
    change pieces that others have read. Rows with equal or null ids are separate documents.
    An empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, run = tokenizer(path, pattern), TaskContext.get().partitionId()
        encode = bpe.encode_ranked if special_as_text else bpe.encode_library
        packer = Packer(window, open_windows, run << 32)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(whole_texts(part.column("text"))), strict=True):
                    packer.add(doc_id, 0, ids + end, len(ids) // 4 + 1)
                yield _rows(packer.take(), [], run)
        yield _rows(packer.take(), packer.leftovers(), run)

    source = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    passed = materialize(source.mapInArrow(first, _SCHEMA), "packed")
    done = passed.where(F.col("ids").isNull())
    rest = passed.where(F.col("ids").isNotNull())
    last, level = rest.agg(F.max("run")).first()[0], 0
    out = done.drop("run", "ids")
    while last is not None:
        level, last = level + 1, last // fan_in
        merge = _merger(window, open_windows, level << 56, last == 0)
        grouped = rest.withColumn("group", F.floor(F.col("run") / fan_in)).groupBy("group")
        merged = materialize(grouped.applyInArrow(merge, _SCHEMA), "merged")
        out = out.unionByName(merged.where(F.col("ids").isNull()).drop("run", "ids"))
        rest = merged.where(F.col("ids").isNotNull())
        if last == 0:
            break
    return out
