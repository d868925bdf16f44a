"""Packing: every id in exactly one piece, no gaps, little padding, and the online rule on a small case."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


def run(docs, window=1024, **more):
    return packing.pack(docs, JSON, public_tokenizers.PATTERN, window=window, **more)


def check(rows, texts, window):
    """rows: Row of pieces; texts: (doc_id, text). Holds documents against their ids; gives the number of sequences."""
    tokenizer = Tokenizer.from_file(JSON)
    whole = defaultdict(list)
    for i, t in texts:
        whole[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(whole)
    for i, found in pieces.items():
        want = sorted((s, n, crc) for s, n, crc, _ in found)
        assert sum(n for _, n, _ in want) == sum(map(len, whole[i]))
        if len(whole[i]) > 1:
            continue
        ids, at = np.array(whole[i][0], "<u4"), 0
        for s, n, crc in want:
            assert s == at and n > 0 and crc == zlib.crc32(ids[s : s + n].tobytes())
            at += n
        assert at == len(ids) and {t for *_, t in found} == {len(ids)}
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert 0 < at <= window
    return sequences


@pytest.mark.parametrize("window,open_windows,fan_in", [(1024, 8, 64), (64, 1, 2), (16, 3, 2)])
def test_documents(documents, window, open_windows, fan_in):
    docs = documents.repartition(5)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sequences = check(run(docs, window, open_windows=open_windows, fan_in=fan_in).collect(), texts, window)
    fill = [sum(n for _, n in x) for x in sequences.values()]
    assert sum(f < window for f in fill) == 1, "one sequence alone is short"


def test_odd_rows(odd, none):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(run(odd, 32).collect(), texts, 32)
    assert run(none).count() == 0


def test_best_fit():
    p = packing.Packer(10, 2, 0)
    ids = lambda n: bytes(4 * n)
    p.add(1, 0, ids(6), 6)
    p.add(2, 0, ids(7), 7)  # fits nowhere: a second window
    p.add(3, 0, ids(2), 2)  # best fit is the fuller one
    assert [x[0] for x in p.open] == [6, 9]
    p.add(4, 0, ids(5), 5)  # fits in none and all are in use: its head fills the fullest, which is emitted
    assert [(r[0], r[1], r[2], r[6]) for r in p.take()] == [(2, 0, 7, 0), (3, 0, 2, 7), (4, 0, 1, 9), (1, 0, 6, 0), (4, 1, 4, 6)]  # the tail then fills the other
    assert p.open == []
    p.add(5, 0, ids(25), 25)  # whole windows stand alone
    assert [(r[1], r[2]) for r in p.rows if r[0] == 5][:2] == [(0, 10), (10, 10)]
    p.close()
    assert sum(r[2] for r in p.rows) == 25 and p.open == []


def test_a_long_document_spans_sequences(spark):
    docs = spark.createDataFrame([(1, "word " * 5000), (2, "tail")], "doc_id long, text string")
    rows = run(docs, 128).collect()
    check(rows, [(1, "word " * 5000), (2, "tail")], 128)
    assert len({r["sequence_id"] for r in rows if r["doc_id"] == 1}) >= 5000 // 128


def test_ids_are_those_of_the_plain_library(spark):
    """Strings of the special token in a text: the token, as the library has it, or text on request."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "no special", "<|endoftext|>é \U0001f642"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check(run(docs).collect(), list(enumerate(texts)), 1024)
    tokenizer = Tokenizer.from_file(JSON)
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    tokenizer.encode_special_tokens = True
    want = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in run(docs, special_as_text=True).collect()} == want
