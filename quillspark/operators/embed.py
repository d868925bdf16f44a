"""Dense vectors of texts by a pluggable encoder; hashed n-grams where there is none or it fails."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import word_dims
from ..scratch import spread
from ..shipping import ship
from . import score
from .index import KEY

#: Texts that go to an encoder at once.
BATCH = 512
Encoder = Callable[[list[str]], np.ndarray]


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the last hidden states (texts, tokens, units) over the tokens that the mask marks."""
    weights = mask[..., None].astype(np.float64)
    return (hidden * weights).sum(1) / np.maximum(weights.sum(1), 1)


def fitted(vectors: np.ndarray, dim: int) -> np.ndarray:
    """Vectors padded or cut to dim and scaled to length 1; those without length stay as they are."""
    out = np.zeros((len(vectors), dim))
    out[:, : min(dim, vectors.shape[1])] = vectors[:, :dim]
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def hashed(texts: list[str], dim: int) -> np.ndarray:
    """How often each dimension is hit by the n-grams of a text's words."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for word, n in Counter(text.lower().split()).items():
            for d in word_dims(word, dim):
                out[i, d] += n
    return out


def embedded(rows: DataFrame, keys: list[str], text_col: str, dim: int, load: Callable[[], Encoder] | None = None) -> DataFrame:
    """The keys and embedding (array of double, of length 1 or all zeros).

    load gives the encoder, once per task. If it raises, or the encoder does for a batch,
    hashed n-grams stand in.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: Encoder | None = None
        if load is not None:
            try:
                encoder = load()
            except Exception:  # a missing or broken model is the documented case for the stand-in
                encoder = None
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts, vectors = [t or "" for t in batch.column(len(keys)).to_pylist()], None
                if encoder is not None:
                    try:
                        vectors = np.asarray(encoder(texts), float).reshape(len(texts), -1)
                    except Exception:
                        vectors = None
                found = fitted(hashed(texts, dim) if vectors is None else vectors, dim)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], lists], names=[*keys, "embedding"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return spread(rows).select(*keys, F.col(text_col).alias("_text")).mapInArrow(run, f"{kinds}, embedding array<double>")


def dense(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, dim: int, load: Callable[[], Encoder] | None = None) -> DataFrame:
    """qid, doc_id, chunk_no and dense: the cosine of query and chunk. Candidates alone are embedded, each once."""
    wanted = chunks.join(candidates.select(*KEY).distinct(), KEY, "left_semi")
    vectors = embedded(wanted, KEY, "content", dim, load)
    asked = embedded(queries, ["qid"], "query", dim, load).withColumnRenamed("embedding", "_asked")
    both = candidates.select("qid", *KEY).join(vectors, KEY).join(asked, "qid")
    return both.select("qid", *KEY, score.cosine(F.col("embedding"), F.col("_asked")).alias("dense"))
