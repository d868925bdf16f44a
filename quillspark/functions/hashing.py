"""Character n-gram feature hashing (FNV-1a, 64 bit)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import spread
from ..shipping import ship

SEED, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(chars: str) -> int:
    """Over code points rather than bytes."""
    h = SEED
    for c in chars:
        h = ((h ^ ord(c)) * PRIME) & MASK
    return h


@lru_cache(maxsize=200_000)
def word_dims(word: str, dim: int) -> tuple[int, ...]:
    """Dimensions of the 3- to 5-grams of a lower-case word between two #; none below three characters."""
    if len(word) < 3:
        return ()
    padded = f"#{word}#"
    return tuple(fnv1a(padded[i : i + n]) % dim for n in (3, 4, 5) for i in range(len(padded) - n + 1))


#: Words whose n-grams are hashed at once, and cells of texts and dimensions that are counted at once.
WORDS, CELLS = 50_000, 1 << 21


def _hashed(words: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """word_dims() of many words: all dimensions, and how many each word has."""
    padded = [f"#{w}#" if len(w) > 2 else "" for w in words]
    size = np.array([len(p) for p in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the word's end
    owners, dims = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), SEED, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(PRIME)
        owners.append(owner[at])
        dims.append((h % np.uint64(dim)).astype(np.int64))
    owner, found = np.concatenate(owners), np.concatenate(dims)
    return found[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _counts(texts: list[str | None], dim: int) -> np.ndarray:
    """How often each dimension is hit, by text."""
    words = [(t or "").lower().split() for t in texts]
    coded = pa.array([w for x in words for w in x], pa.string()).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in words])
    code, out = coded.indices.to_numpy().astype(np.int64), np.zeros(len(texts) * dim, np.int64)
    order = np.argsort(code, kind="stable")
    code, owner, known = code[order], owner[order], coded.dictionary.to_pylist()
    for first in range(0, len(known), WORDS):
        dims, many = _hashed(known[first : first + WORDS], dim)
        lo, hi = np.searchsorted(code, [first, first + WORDS])
        each, times = np.unique((code[lo:hi] - first) * len(texts) + owner[lo:hi], return_counts=True)
        word, text = each // len(texts), each % len(texts)
        start, n = np.cumsum(many) - many, many[word]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        cells = np.repeat(text, n) * dim + dims[np.repeat(start[word], n) + within]
        out += np.bincount(cells, np.repeat(times, n), minlength=len(out)).astype(np.int64)
    return out.reshape(len(texts), dim)


def histograms(df: DataFrame, keys: list[str], text_col: str, dim: int) -> DataFrame:
    """The keys, dim and n (arrays): how often each dimension is hit by the text's words. Rows without hits are absent."""
    ship(df.sparkSession)
    df = spread(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(CELLS // dim, 1)
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                found = _counts(batch.column(len(keys)).to_pylist(), dim)
                rows, dims = np.nonzero(found)
                hit, many = np.unique(rows, return_counts=True)
                ends = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (dims.astype(np.int32), found[rows, dims])]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(hit)) for i in range(len(keys))], *lists], names=[*keys, "dim", "n"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text_col).alias("_text")).mapInArrow(run, f"{kinds}, dim array<int>, n array<long>")


def histogram(df: DataFrame, keys: list[str], text_col: str, dim: int) -> DataFrame:
    """histograms() with a row for each dimension."""
    return histograms(df, keys, text_col, dim).select(*keys, F.inline(F.arrays_zip("dim", "n")))
