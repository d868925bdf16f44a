"""Near-duplicate classes: circulant MinHash, banding, exact Jaccard confirmation, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, prepare, scratch_path, slices, spread, to_batch, whole_texts, words

#: 32 bands of 4 coordinates: two sets of similarity 0.8 share no band with probability 5e-8.
BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
#: Pairs whose sketches agree in less are over five standard errors below a similarity of 0.8.
LEAST_ESTIMATE = 0.62
#: Members of a bucket whose sketches are compared in one block; members, and shingles of theirs, on each side of a group that is confirmed.
BLOCK = 512
GROUP, GROUP_SHINGLES = 512, 1 << 20
CACHE_WORDS = 250_000
#: Edges of a graph that one task takes.
ONE_TASK_EDGES = 200_000

_SHIFTS = np.arange(COORDS, dtype=np.uint32)


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


_hashes = _Words()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of the whole sequence if it is shorter; none without words."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(out))


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signature(found: np.ndarray, block: int = 256) -> np.ndarray:
    """Minima of one permutation shifted circularly by 0, 1, 2, ..., over places that another one has dealt."""
    places = _permute((found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), block):
        np.minimum(out, _permute(places[i : i + block, None] - _SHIFTS, 0x21F0AAAD, 0xD35A2D97).min(0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A key per band; its upper bits are the band's number, so the smallest of some keys is of the first band."""
    x = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + x[:, i]
    return ((_mix(key) >> np.uint64(7)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(57))).astype(np.int64)


def _signed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest (null without shingles), bands and sketch (a byte per coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, size) for t in whole_texts(part.column("text"))]
                sigs = [signature(s) if len(s) else None for s in sets]
                yield to_batch(
                    {
                        "doc_id": (part.column("doc_id"), None),
                        "n_shingles": ([len(s) for s in sets], pa.int64()),
                        "digest": ([digest(s) if len(s) else None for s in sets], pa.binary()),
                        "bands": ([None if s is None else bands(s) for s in sigs], pa.list_(pa.int64())),
                        "sketch": ([None if s is None else s.astype(np.uint8).tobytes() for s in sigs], pa.binary()),
                    }
                )

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """digest and shingles of the wanted sets (digest, rep): only their documents move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for t in whole_texts(part.column("text")) if len(s := shingles(t, size))]
                yield to_batch({"digest": ([digest(s) for s in sets], pa.binary()), "shingles": ([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    source = _source(docs, id_col, text_col)
    texts = source.join(wanted.select("rep").distinct(), source["doc_id"].eqNullSafe(F.col("rep")), "left_semi")
    found = texts.mapInArrow(run, "digest binary, shingles array<long>")
    return found.join(wanted.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles"))


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys (long), over the bounds of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
        cuts = [0, *(np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and tuple(k[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(k[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of one sketch to many; coordinates of a byte agree by chance once in 256."""
    return ((a == b).mean(1) - 1 / 256) * (256 / 255)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Forest:
    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def link(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of a bucket: its likely pairs if they are few, else those of a best spanning forest.

    A row without a pair says that other likely pairs of the bucket are still to be looked at.
    """
    out: list[tuple] = []
    kinds = {"bucket": pa.int64(), "a": pa.binary(), "b": pa.binary()}

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        out.clear()
        return to_batch({c: (v, k) for (c, k), v in zip(kinds.items(), columns, strict=True)})

    for group in by_group(batches, ["bucket", "block"]):
        bucket, ids = group["bucket"][0].as_py(), group["digest"].to_pylist()
        sketch = _matrix(group["sketch"], np.uint8)
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids, sketch = [ids[i] for i in order], sketch[order]
        est, first, second = [], [], []
        for i in range(len(ids) - 1):
            e = estimates(sketch[i], sketch[i + 1 :])
            at = np.nonzero(e >= LEAST_ESTIMATE)[0]
            est.append(e[at])
            first.append(np.full(len(at), i))
            second.append(at + i + 1)
        more = group["blocks"][0].as_py() > 1
        if est and len(e := np.concatenate(est)):
            a, b = np.concatenate(first), np.concatenate(second)
            forest, pairs = _Forest(), 0
            for k in np.lexsort((b, a, -e)).tolist():
                if len(e) <= 3 or forest.link(int(a[k]), int(b[k])):
                    out.append((bucket, ids[a[k]], ids[b[k]]))
                    pairs += 1
            more = more or pairs < len(e)
        if more:
            out.append((bucket, None, None))
        if len(out) >= 4096:
            yield flush()
    yield flush()


def _confirming(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between labels within a bucket: whole sets are compared, the likeliest pairs first, until nothing likely is left unlinked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["bucket", "left", "right"]):
            band = group["bucket"][0].as_py() >> 57
            ids, labels, sets = group["digest"].to_pylist(), group["label"].to_pylist(), group["shingles"].combine_chunks()
            sketch, keys = _matrix(group["sketch"], np.uint8), _matrix(group["keys"], np.int64)
            asked = group["asked"].to_numpy()
            t, number = np.nonzero(~asked)[0], {x: i for i, x in enumerate(dict.fromkeys(labels))}
            label = np.array([number[x] for x in labels])
            found, left, right = [], [], []
            for i in np.nonzero(asked)[0]:
                e = estimates(sketch[i], sketch[t])
                at = np.nonzero((e >= LEAST_ESTIMATE) & (label[t] != label[i]))[0]
                same = keys[i] == keys[t[at]]
                at = at[same[:, : band + 1].any(1) & ~same[:, :band].any(1)]  # else it is up to an earlier bucket
                found.append(e[at])
                left.append(np.full(len(at), i))
                right.append(t[at])
            links, forest = [], _Forest()
            if found:
                e, a, b = np.concatenate(found), np.concatenate(left), np.concatenate(right)
                for k in np.lexsort((b, a, -e)).tolist():
                    x, y = int(label[a[k]]), int(label[b[k]])
                    if forest.root(x) == forest.root(y):
                        continue
                    one, two = sets[int(a[k])].values.to_numpy(), sets[int(b[k])].values.to_numpy()
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        forest.link(x, y)
                        links.append((min(labels[a[k]], labels[b[k]]), max(labels[a[k]], labels[b[k]])))
            yield to_batch({"a": ([x for x, _ in links], pa.binary()), "b": ([x for _, x in links], pa.binary())})

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the edges (u, v) and the least one that it reaches."""
    forest, kind = _Forest(), None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            forest.up.setdefault(u, u)
            forest.up.setdefault(v, v)
            forest.link(u, v)
    nodes, least = sorted(forest.up), {}
    roots = [least.setdefault(forest.root(x), x) for x in nodes]  # the first of a tree is its least
    if nodes:
        yield to_batch({"node": (nodes, kind), "root": (roots, kind)})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the least node it can reach) of every node that an edge (a, b) names.

    Large-star and small-star steps in turn, each written to the shared folder, until the
    edges stop changing; they then join each node to its root. One task finds the same in
    graphs of ONE_TASK_EDGES at most, without rounds.
    """
    spark = edges.sparkSession
    edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(path := scratch_path(spark, name))
    star, known = spark.read.parquet(path), None
    if star.count() <= ONE_TASK_EDGES:
        node = star.schema["u"].dataType.simpleString()
        return materialize(star.coalesce(1).mapInArrow(_roots, f"node {node}, root {node}"), name)
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before = path
        small.where(F.col("u") != F.col("v")).distinct().write.parquet(path := scratch_path(spark, name))
        star = spark.read.schema(star.schema).parquet(path)
        drop(spark, before)
        now = tuple(star.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == known:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = now


def near_dedup(docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if 100 * intersection >= percent * union of their sets of
    distinct word shingles; component_id is the smallest id that links reach, kept is true
    where it is the row's own. Equal sets are one node of the graph from the start, so copies
    cost nothing more. Nodes that share a bucket of a band are candidates. Large buckets are
    dealt into blocks; likely pairs of each block are confirmed on whole sets, first those of
    a spanning forest. Buckets that then still hold several components have all their other
    likely pairs confirmed too, in blocks of those outside the commonest component against
    all, so no link is lost to a bound; what is emitted never exceeds a forest per block.

    Texts that are null, empty or without words have no shingles, link with nothing and are
    kept. A null id never is a component_id unless all ids of the component are null; rows
    with equal id and set are kept together. An empty table gives no rows; other columns are
    ignored.
    """
    prepare(docs.sparkSession)
    signed = materialize(_signed(spread(docs), shingle, id_col, text_col), "signed")
    first = F.first(F.struct("n_shingles", "bands", "sketch")).alias("x")
    nodes = materialize(signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), first).select("digest", "rep", "x.*"), "nodes")

    keyed = nodes.select("digest", F.explode("bands").alias("bucket"))
    of = [F.count("*").alias("size"), F.expr("bit_xor(xxhash64(digest))").alias("x"), F.expr("bit_xor(xxhash64(digest, 1))").alias("y")]
    buckets = keyed.groupBy("bucket").agg(*of).where(F.col("size") > 1)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    buckets = buckets.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", blocks.alias("blocks"))
    members = keyed.join(buckets, "bucket").join(nodes.select("digest", "rep", "n_shingles", "sketch"), "digest")
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("digest", "bucket"), F.col("blocks")).cast("long")), "members")
    likely = members.select("bucket", "block", "blocks", "digest", "sketch").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    likely = materialize(likely.mapInArrow(_likely, "bucket long, a binary, b binary"), "likely")
    open_buckets = likely.where(F.col("a").isNull()).select("bucket").distinct()
    pairs = likely.where(F.col("a").isNotNull()).select("a", "b").distinct()

    touched = pairs.select(F.explode(F.array("a", "b")).alias("digest")).unionByName(members.where(F.col("blocks") > 1).select("digest")).distinct()
    sets = materialize(_sets(docs, nodes.select("digest", "rep").join(touched, "digest", "left_semi"), shingle, id_col, text_col), "sets")
    both = F.size(F.array_intersect("sa", "sb"))
    linked = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b")
    links = linked.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    star = components(links)

    held = members.join(open_buckets, "bucket", "left_semi").select("bucket", "digest", "n_shingles", "sketch")
    held = held.join(star.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("label", F.coalesce("root", "digest")).drop("root")
    held = materialize(held, "held")
    share = held.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    split = share.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "label")).alias("most")).where(F.col("n") > F.col("most.n"))
    chunks = lambda n, s: F.greatest(F.ceil(n / GROUP), F.ceil(s / GROUP_SHINGLES)).cast("long")
    split = split.select("bucket", F.col("most.label").alias("most"), chunks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("lefts"), chunks(F.col("n"), F.col("s")).alias("rights"))
    cut = held.join(materialize(split, "split"), "bucket")  # beside a written table, a large bucket of held may be split
    at = lambda n: F.pmod(F.xxhash64("digest", "bucket"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = cut.where(F.col("label") != F.col("most")).withColumn("left", at("lefts")).withColumn("right", each("rights")).withColumn("asked", F.lit(True))
    told = cut.withColumn("right", at("rights")).withColumn("left", each("lefts")).withColumn("asked", F.lit(False))
    rows = asked.unionByName(told).select("bucket", "left", "right", "asked", "digest", "label", "sketch")
    keys = nodes.select("digest", F.unhex(F.concat_ws("", F.transform("bands", lambda x: F.lpad(F.hex(x), 16, "0")))).alias("keys"))
    rows = rows.join(sets, "digest").join(keys, "digest").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    more = materialize(rows.mapInArrow(_confirming(percent), "a binary, b binary").distinct(), "links")
    if more.limit(1).count():
        star = components(star.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    named = nodes.select("digest", "rep").join(star.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("digest", "component_id")
    found = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    found = found.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
