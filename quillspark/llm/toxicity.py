"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, prepare, slices, spread, stratified, to_batch, whole_texts

_TERM = re.compile(r"\w+")
#: Hashed terms: a word, and its first four and five letters.
BITS = 18
PREFIXES = (4, 5)
CACHE_WORDS = 100_000


class Terms(dict):
    """Hashed terms of each word as bytes of int32, kept while the worker lives."""

    def __missing__(self, word: str) -> bytes:
        raw = [word.encode(), *(b"\x00%d\x00" % n + word[:n].encode() for n in PREFIXES if len(word) >= n)]
        found = np.array([zlib.crc32(x) & ((1 << BITS) - 1) for x in raw], "<i4").tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


_terms = Terms()


def term_ids(text: str) -> np.ndarray:
    """Distinct hashed terms of a whole text."""
    found = b"".join(map(_terms.__getitem__, set(_TERM.findall(text.lower()))))
    return np.unique(np.frombuffer(found, "<i4"))


@dataclass
class Model:
    """score = sigmoid(bias + sum of w + half of the sum over factors of (sum of v)^2 - sum of v^2)."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        v = self.v[ids]
        x = self.bias + float(self.w[ids].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _descend(docs: list[np.ndarray], labels: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray, epochs: int, sparse: float, group: float, rng, batch: int = 128, rate: float = 0.1) -> float:
    """Proximal AdaGrad on w and v in place, with an L1 penalty on w and a group penalty on the rows of v; gives the bias."""
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    heavy = min(3.0, float(np.sqrt((1 - labels.mean()) / labels.mean())))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = [i for i in order[at : at + batch] if len(docs[i])]
            if not some:
                continue
            ids = np.concatenate([docs[i] for i in some])
            sizes = np.array([len(docs[i]) for i in some])
            starts, owner, y = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(some)), sizes), labels[some]
            vi = v[ids]
            s = np.add.reduceat(vi, starts)
            x = bias + np.add.reduceat(w[ids], starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vi * vi).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y) * np.where(y == 1, heavy, 1.0) / len(some)
            gi = g[owner]
            dw = np.bincount(ids, gi, len(w))
            dv = np.stack([np.bincount(ids, gi * (s[owner, f] - vi[:, f]), len(w)) for f in range(v.shape[1])], 1)
            gw += dw * dw
            gv += dv * dv
            gb += g.sum() ** 2
            step = rate / np.sqrt(gw)
            w -= step * dw
            w[:] = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
            step = rate / np.sqrt(gv)
            v -= step * dv
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            v *= np.maximum(1 - step.mean(1, keepdims=True) * group / np.maximum(norm, 1e-9), 0)
            bias -= rate / np.sqrt(gb) * g.sum()
    return bias


def train(docs: list[np.ndarray], labels: np.ndarray, factors: int = 4, sparse: float = 1e-2, group: float = 3e-2, epochs: int = 3, again: int = 12, seed: int = 7, least_documents: int = 3) -> Model:
    """Strong penalties first select the terms that tell alone or in pairs; weights and factors of these are then fitted with weak ones."""
    m = 1 << BITS
    model = Model(0.0, np.zeros(m, np.float32), np.zeros((m, factors), np.float32))
    if not len(docs) or labels.min() == labels.max():
        model.bias = 0.0 if not len(docs) else float(8 * labels[0] - 4)
        return model
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate(docs), minlength=m)
    used = np.nonzero(seen >= least_documents)[0]
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    for times, least, pair in ((max(epochs, 30_000 // len(docs)), sparse, group), (again, sparse / 20, group / 20)):
        where = np.full(m, -1)
        where[used] = np.arange(len(used))
        known = [(x := where[d])[x >= 0] for d in docs]
        w, v = np.zeros(len(used)), rng.normal(0, 0.02, (len(used), factors))
        bias = _descend(known, labels, bias, w, v, min(times, 30), least, pair, rng)
        kept = (np.abs(w) > 0.05) | (np.abs(v).sum(1) > 0.05)
        if least == sparse:
            used = used[kept]
    model.bias, model.w[used], model.v[used] = bias, w, v
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 4000, negatives: int = 10_000, least_documents: int = 3) -> Model:
    """Learns from labelled documents outside the held-out fifth, about ``positives`` and ``negatives`` of them at most; of terms in ``least_documents`` of these or more."""
    prepare(docs.sparkSession)
    key = F.col(id_col).cast("long")
    known = labels.select(key.alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (crc_mod(F.col("_id"), 5) != 0))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = stratified(known, F.col("_y"), F.col("_id"), F.when(F.col("_y") == 1, positives).otherwise(negatives))
    sample = docs.select(key.alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [term_ids(t) for t in whole_texts(part.column("text"))]
                yield to_batch({"id": (part.column("_id"), None), "y": (part.column("_y"), None), "ids": (ids, pa.list_(pa.int32()))})

    found = sample.mapInArrow(run, "id long, y int, ids array<int>").toArrow()
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    flat = [found.column("ids")[int(i)].values.to_numpy() for i in order]
    return train(flat, found.column("y").to_numpy()[order].astype(float), least_documents=least_documents)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of each whole text, and the columns in ``keep``.

    Null text counts as empty; an empty text has the score of the bias alone. A null id is
    scored like any other. Other columns never enter a score. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = sent.value
        for batch in batches:
            for part in slices(batch, "_text"):
                scores = [fm.score(term_ids(t)) for t in whole_texts(part.column("_text"))]
                out = {"doc_id": (part.column("_id"), None), "held_out": (part.column("_held"), None), "score": (scores, pa.float64()), "predicted": ([int(x >= 0.5) for x in scores], pa.int32())}
                yield to_batch(out | {f"_k{i}": (part.column(f"_k{i}"), None) for i in range(len(kept))})

    key = F.col(id_col).cast("long")
    source = spread(docs).select(key.alias("_id"), (crc_mod(key, 5) == 0).alias("_held"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = "doc_id long, held_out boolean, score double, predicted int" + "".join(f", _k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept))
    scored = source.mapInArrow(run, schema)
    return scored.select(*([] if keep else ["doc_id"]), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "held_out", "score", "predicted")
