"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, decoding through the byte table."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, spread, to_batch, whole_texts

#: A space that something other than white space follows always starts a match of the pattern.
_CUT = re.compile(r" (?=\S)")
#: Units of a text longer than this are encoded match by match, in groups of about this size.
LONG_UNIT = 1 << 16
#: The cache of units is emptied beyond this many entries; longer units never enter it.
CACHE_UNITS = 400_000
CACHED_CHARS = 40
#: So many units that the cache misses are encoded as one string.
JOINED = 1000


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(moved)}


def _from_ranks(path: str, pattern: str):
    """A tokenizers model that merges as a table of ranks says.

    Any two neighbours whose bytes together are a token may merge, lowest rank first, so
    every split of every token becomes a merge. A match that is a token itself is not merged.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    chars = byte_table()
    name = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    found = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    found.decoder = decoders.ByteLevel()
    return found


class ByteBpe:
    """Encodes whole texts to ids (little-endian unsigned 32-bit) and back to bytes."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.pattern = regex.compile(pattern)
        self.tokenizer = _from_ranks(path, pattern) if path.endswith(".tiktoken") else Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}
        self._ranked = self.special = None
        back = {c: b for b, c in byte_table().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: The byte table reversed: the bytes of each id.
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.token_lengths = np.array([len(x) for x in self.token_bytes], np.int64)

    def _groups(self, unit: str) -> Iterator[str]:
        if len(unit) <= LONG_UNIT:
            yield unit
            return
        begin = end = 0
        for m in self.pattern.finditer(unit):
            if m.end() - begin > LONG_UNIT and end > begin:
                yield unit[begin:end]
                begin = end
            end = m.end()
        yield unit[begin:]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of units that are each cut where a match starts."""
        flat, owner = [], []
        for i, unit in enumerate(units):
            for group in self._groups(unit):
                flat.append(group)
                owner.append(i)
        out: list[list[bytes]] = [[] for _ in units]
        begin = 0
        while begin < len(flat):  # bounded: an encoding takes far more memory than its text
            end, held = begin, 0
            while end < len(flat) and (end == begin or held + len(flat[end]) <= 1 << 19):
                held += len(flat[end])
                end += 1
            for i, e in zip(owner[begin:end], self.tokenizer.encode_batch_fast(flat[begin:end], add_special_tokens=False), strict=True):
                out[i].append(np.array(e.ids, "<u4").tobytes())
            begin = end
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _encode_joined(self, units: list[str]) -> list[bytes]:
        """Ids of short units that start with a space: encoded many to a string, parted by byte counts."""
        out: list[bytes] = []
        for at in range(0, len(units), JOINED):
            some = units[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.token_lengths[ids])
            stops = np.searchsorted(ends, np.cumsum([len(u.encode()) for u in some])) + 1
            raw, begin = ids.tobytes(), 0
            for stop in stops.tolist():
                out.append(raw[4 * begin : 4 * stop])
                begin = stop
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each match of the pattern by itself. Units seen before come from the cache."""
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        parts = [_CUT.split(t) for t in texts]
        cache = self.cache
        missing = [u for u in set().union(*(p[1:] for p in parts)) if u not in cache]
        short = [u for u in missing if len(u) <= CACHED_CHARS]
        cache.update(zip(short, self._encode_joined([" " + u for u in short]), strict=True))
        rest = [u for u in missing if len(u) > CACHED_CHARS]
        cache.update(zip(rest, self._encode_units([" " + u for u in rest]), strict=True))
        first = self._encode_units([p[0] for p in parts])
        out = [head + b"".join(map(cache.__getitem__, p[1:])) for head, p in zip(first, parts, strict=True)]
        for u in rest:
            del cache[u]
        return out

    def _by_rank(self):
        """The same vocabulary in tiktoken: in byte-level vocabularies ids are the ranks of the merges."""
        if self._ranked is None:
            import tiktoken

            special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            ranks = {self.token_bytes[i]: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
            self._ranked = tiktoken.Encoding("ranked", pat_str=self.pattern.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._ranked

    def encode_library(self, texts: list[str]) -> list[bytes]:
        """The ids that the library gives for the vocabulary file as it is: the strings of its special tokens in a text are these tokens."""
        if self.special is None:
            found = self.tokenizer.get_added_tokens_decoder()
            self.special = {t.content: i.to_bytes(4, "little") for i, t in found.items()}
            self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        parts, owner = [], []
        for i, text in enumerate(texts):
            begin = 0
            for m in self.special_pattern.finditer(text):
                parts += [text[begin : m.start()], m[0]]
                owner += [i, i]
                begin = m.end()
            parts.append(text[begin:])
            owner.append(i)
        if len(parts) == len(texts):
            return self.encode_ranked(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        for i, part, ids in zip(owner, parts, self.encode_ranked([p if p not in self.special else "" for p in parts]), strict=True):
            out[i].append(self.special.get(part, ids))
        return [b"".join(x) for x in out]

    def encode_ranked(self, texts: list[str]) -> list[bytes]:
        """The ids of encode(), from a table of ranks, about three times as fast for texts whose words seldom repeat.

        In a byte-level vocabulary an id is the rank of its merge, so that merging by lowest
        rank, as tiktoken does, and by the list of merges, as tokenizers does, take the same steps.
        """
        ranked, out = self._by_rank(), []
        for text in texts:
            parts, begin = [], 0
            while begin < len(text):
                cut = _CUT.search(text, begin + LONG_UNIT) if len(text) - begin > LONG_UNIT else None
                end = cut.start() if cut else len(text)
                if end - begin > 2 * LONG_UNIT:
                    parts += self._encode_units([text[begin:end]])
                else:
                    parts.append(ranked.encode_to_numpy(text[begin:end], disallowed_special=()).tobytes())
                begin = end
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_pieces(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """Text of consecutive pieces of ids; a character cut between two of them comes with the later one."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield decoder.decode(self.decode(ids))
        if rest := decoder.decode(b"", True):
            yield rest

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character of each token; tokens inside a character share it."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))
        ends = np.cumsum(self.token_lengths[np.frombuffer(ids, "<u4")])
        begins = ends - self.token_lengths[np.frombuffer(ids, "<u4")]
        return char[begins], np.where(ends > 0, char[np.maximum(ends - 1, 0)] + 1, 0)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One per Python worker and vocabulary."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and, on request, the tokens' character offsets (starts, ends).

    Null text counts as empty and gives no ids. Other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = whole_texts(part.column("text"))
                ids = bpe.encode(texts)
                out = {"doc_id": (part.column("doc_id"), None), "ids": ([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))}
                if offsets:
                    spans = [bpe.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                    out |= {"starts": ([s for s, _ in spans], pa.list_(pa.int64())), "ends": ([e for _, e in spans], pa.list_(pa.int64()))}
                yield to_batch(out)

    schema = "doc_id long, ids array<int>" + ", starts array<long>, ends array<long>" * offsets
    return spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text (string) of arrays of ids; bytes that are no UTF-8 become U+FFFD, null ids count as none."""
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield to_batch({"doc_id": (batch.column("doc_id"), None), "text": (texts, pa.string())})

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text: encoded, then decoded from the ids.

    Null text counts as empty (no tokens). Repeated rows give repeated results; other columns
    are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = bpe.encode(whole_texts(part.column("text")))
                yield to_batch(
                    {
                        "doc_id": (part.column("doc_id"), None),
                        "n_tokens": ([len(x) // 4 for x in ids], pa.int64()),
                        "ids_sha256": ([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        "decoded_sha256": ([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                    }
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
