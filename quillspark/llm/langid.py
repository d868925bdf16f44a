"""Language identification: a byte convolutional network over fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, prepare, slices, spread, stratified, to_batch, whole_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character of the text is of Unicode's letters; digits, numerals and fractions are none."""
    return any(map(str.isalpha, text))


def windows(raw: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes: the last one is moved back to end with the text, a short one is filled with zeros."""
    if len(raw) <= WINDOW:
        return np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8)[None]
    x, full = np.frombuffer(raw, np.uint8), len(raw) // WINDOW
    out = x[: full * WINDOW].reshape(full, WINDOW)
    return out if full * WINDOW == len(raw) else np.concatenate([out, x[None, -WINDOW:]])


@dataclass
class Model:
    """Byte embeddings, filters of each width over them, rectified and max-pooled over the window, then softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    _tables: tuple | None = field(default=None, repr=False)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Embedding and filters folded: what two neighbouring bytes, or one, add to each filter."""
        if self._tables is None:
            e, n = self.embed.shape[1], self.filters[0].shape[1]
            at = lambda k, j: (self.embed @ self.filters[k][j * e : (j + 1) * e]).astype(np.float32)
            pair = lambda k, j: (at(k, j)[:, None] + at(k, j + 1)[None]).reshape(1 << 16, n)
            self._tables = np.concatenate([pair(0, 0), pair(1, 0), pair(2, 0), pair(2, 2)], 1), at(1, 2)
        return self._tables

    def pooled(self, x: np.ndarray) -> np.ndarray:
        pairs, single = self.tables()
        n = single.shape[1]
        two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        g = pairs[two]
        wide = [g[..., :n].max(1), (g[:, :-1, n : 2 * n] + single[x[:, 2:]]).max(1), (g[:, :-2, 2 * n : 3 * n] + g[:, 2:, 3 * n :]).max(1)]
        return np.maximum(np.concatenate(wide, 1) + np.concatenate(self.biases), 0)

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Of each window; blocks bound the memory."""
        h = np.concatenate([self.pooled(x[i : i + block]) for i in range(0, len(x), block)])
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each whole text: the mean of its windows."""
        rows = [windows(t.encode("utf-8", "surrogatepass")) if self.langs and has_letter(t) else None for t in texts]
        known = [r for r in rows if r is not None]
        if not known:
            return [(UNKNOWN, 0.0)] * len(texts)
        sizes = np.array([len(r) for r in known])
        mean = np.add.reduceat(self.probabilities(np.concatenate(known)), np.cumsum(sizes) - sizes) / sizes[:, None]
        found = iter(zip(mean.argmax(1).tolist(), mean.max(1).tolist(), strict=True))
        return [(UNKNOWN, 0.0) if r is None else (lambda x: (self.langs[x[0]], min(1.0, float(x[1]))))(next(found)) for r in rows]


def train(x: np.ndarray, y: np.ndarray, langs: list[str], size: int = 8, count: int = 16, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Model:
    """Adam on the cross-entropy; with max pooling, gradients reach only the best place of each filter."""
    rng = np.random.default_rng(seed)
    normal = lambda *s, by: rng.normal(0, by, s).astype(np.float32)
    p = [normal(256, size, by=0.5), *[normal(k * size, count, by=1 / np.sqrt(k * size)) for k in WIDTHS], *[np.zeros(count, np.float32) for _ in WIDTHS], normal(count * len(WIDTHS), max(1, len(langs)), by=0.1), np.zeros(max(1, len(langs)), np.float32)]
    m, v, t, k = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, len(WIDTHS)
    for _ in range(epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
            n = len(xb)
            emb = p[0][xb]
            best, hidden = [], []
            for i, width in enumerate(WIDTHS):
                patches = np.concatenate([emb[:, j : WINDOW - width + 1 + j] for j in range(width)], 2)
                z = patches @ p[1 + i]
                a = z.argmax(1)
                best.append((patches, a))
                hidden.append(np.take_along_axis(z, a[:, None], 1)[:, 0] + p[1 + k + i])
            z = np.concatenate(hidden, 1)
            h = np.maximum(z, 0)
            o = h @ p[-2] + p[-1]
            o = np.exp(o - o.max(1, keepdims=True))
            o /= o.sum(1, keepdims=True)
            o[np.arange(n), yb] -= 1
            o /= n
            g = [np.zeros_like(a) for a in p]
            g[-2], g[-1] = h.T @ o, o.sum(0)
            dz = (o @ p[-2].T) * (z > 0)
            for i, width in enumerate(WIDTHS):
                d = dz[:, i * count : (i + 1) * count]
                patches, a = best[i]
                chosen = patches[np.arange(n)[:, None], a]  # n x count x (width * size)
                g[1 + i], g[1 + k + i] = np.einsum("nc,ncs->sc", d, chosen), d.sum(0)
                back = (d[..., None] * p[1 + i].T[None]).reshape(n, count, width, size)
                for j in range(width):
                    flat = xb[np.arange(n)[:, None], a + j].ravel()
                    for s in range(size):
                        g[0][:, s] += np.bincount(flat, back[:, :, j, s].ravel(), 256)
            t += 1
            for a, ga, ma, va in zip(p, g, m, v, strict=True):
                ma += 0.1 * (ga - ma)
                va += 0.001 * (ga * ga - va)
                a -= rate * (ma / (1 - 0.9**t)) / (np.sqrt(va / (1 - 0.999**t)) + 1e-8)
    return Model(langs, p[0], p[1 : 1 + k], p[1 + k : 1 + 2 * k], p[-2], p[-1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1200, per_text: int = 2, languages: int = 256) -> Model:
    """Learns from ``per_text`` windows of about ``per_language`` documents at most of each of the ``languages`` commonest languages, none of the held-out quarter."""
    prepare(docs.sparkSession)
    key = F.col(id_col).cast("long")
    known = docs.select(key.alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("text")).where(F.col("_lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("_id"), 4) != 2))
    sample = stratified(known, F.col("_lang"), F.col("_id"), per_language, languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, lang, text in zip(batch.column("_id").to_pylist(), batch.column("_lang").to_pylist(), whole_texts(batch.column("text")), strict=True):
                if has_letter(text):
                    rows = windows(text.encode("utf-8", "surrogatepass"))
                    for i in sorted({(k * len(rows)) // per_text for k in range(per_text)}):
                        out.append((doc_id, i, lang, rows[i].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield to_batch({"id": (columns[0], pa.int64()), "i": (columns[1], pa.int32()), "lang": (columns[2], pa.string()), "bytes": (columns[3], pa.binary())})

    found = sample.mapInArrow(run, "id long, i int, lang string, bytes binary").toPandas().sort_values(["id", "i", "lang", "bytes"])
    langs = sorted(found["lang"].unique())
    x = np.frombuffer(b"".join(found["bytes"]), np.uint8).reshape(-1, WINDOW)
    return train(x, found["lang"].map({c: i for i, c in enumerate(langs)}).to_numpy(int), langs)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of each whole text, and the columns in ``keep``.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.
    Ids, sources and given languages never enter a prediction; a null id is predicted like
    any other. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = sent.value
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                found = cnn.predict(whole_texts(part.column("_text")))
                out = {"doc_id": (part.column("_id"), None), "held_out": (part.column("_held"), None), "lang_pred": ([x for x, _ in found], pa.string()), "score": ([s for _, s in found], pa.float64())}
                yield to_batch(out | {f"_k{i}": (part.column(f"_k{i}"), None) for i in range(len(kept))})

    key = F.col(id_col).cast("long")
    source = spread(docs).select(key.alias("_id"), (crc_mod(key, 4) == 2).alias("_held"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", _k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept))
    found = source.mapInArrow(run, schema)
    return found.select(*([] if keep else ["doc_id"]), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "held_out", "lang_pred", "score")
