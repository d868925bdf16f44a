"""Byte-level BPE against the tokenizers' own libraries, and exact round trips."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_ranks(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_json():
    found = Tokenizer.from_file(JSON)
    found.encode_special_tokens = True
    return found


TEXTS = [
    "",
    " ",
    "Hello world, don't stop  now\n\n  end ",
    "Über naïve 你好世界 \U0001f642\U0001f1e9\U0001f1ea é",
    "<|endoftext|> a <|endoftext|>",
    "a" * 3000 + " " + "b c " * 50_000,
    " " * 5000 + "x",
    "\n" * 3000 + "\t x\r\n y",
    "12345 678² ٣٤ ½",
    "你" * 70_000,
    "x\x00y\x1cz\x85w v u　t",
    "'s 'S 'll '' can't’s",
    "no spaces, but punctuation!?..." * 6000,
]


@pytest.fixture(scope="module")
def ranked():
    return bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), by_ranks(RANKS)


@pytest.fixture(scope="module")
def listed():
    return bpe.ByteBpe(JSON, public_tokenizers.PATTERN), by_json()


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_as_tiktoken(ranked):
    own, theirs = ranked
    assert [ids(x) for x in own.encode(TEXTS)] == [theirs.encode_ordinary(t) for t in TEXTS]
    assert [ids(x) for x in own.encode(TEXTS)] == [theirs.encode_ordinary(t) for t in TEXTS], "from the cache"


def test_as_tokenizers(listed):
    own, theirs = listed
    want = [theirs.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [ids(x) for x in own.encode(TEXTS)] == want
    assert [ids(x) for x in own.encode_ranked(TEXTS)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=60))
def test_any_text(ranked, listed, text):
    (own, theirs), (other, json) = ranked, listed
    raw = own.encode([text])[0]
    assert ids(raw) == theirs.encode_ordinary(text)
    assert own.decode(raw).decode() == text
    assert other.encode([text]) == other.encode_ranked([text])
    assert ids(other.encode([text])[0]) == json.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\r\x1c ab'1é你", max_size=40))
def test_white_space(ranked, listed, text):
    assert ids(ranked[0].encode([text])[0]) == ranked[1].encode_ordinary(text)
    assert ids(listed[0].encode_ranked([text])[0]) == listed[1].encode(text, add_special_tokens=False).ids


def test_other_vocabulary():
    own, theirs = bpe.ByteBpe(MULTI, public_tokenizers.PATTERN), by_ranks(MULTI)
    assert [ids(x) for x in own.encode(TEXTS)] == [theirs.encode_ordinary(t) for t in TEXTS]


def test_documents(ranked, documents):
    own, theirs = ranked
    texts = [r["text"] for r in documents.select("text").collect()]
    assert [ids(x) for x in own.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_byte_table():
    table = bpe.byte_table()
    assert sorted(table) == list(range(256)) and len(set(table.values())) == 256
    assert table[ord("a")] == "a" and table[0x20] == "Ġ" and table[0x0A] == "Ċ"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aé你\U0001f642 ", min_size=1, max_size=30), st.data())
def test_pieces_split_characters(ranked, text, data):
    own, _ = ranked
    raw = own.encode([text])[0]
    n = len(raw) // 4
    cuts = sorted(data.draw(st.lists(st.integers(0, n), max_size=4)))
    pieces = [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    got = list(own.decode_pieces(pieces))
    assert "".join(got) == text


def test_torn_character_at_the_end(ranked):
    own, theirs = ranked
    raw = np.array(theirs.encode_ordinary("\U0001f9ff")[:1], "<u4").tobytes()
    assert "�" in "".join(own.decode_pieces([raw]))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é你\U0001f642\n", max_size=40))
def test_offsets(ranked, text):
    own, _ = ranked
    raw = own.encode([text])[0]
    starts, ends = own.offsets(text, raw)
    at = 0
    for i, s, e in zip(ids(raw), starts, ends, strict=True):
        piece = own.token_bytes[i]
        whole = text.encode()
        assert whole[at : at + len(piece)] == piece
        assert s == len(whole[:at].decode("utf-8", "ignore")) and e == len((whole[: at + len(piece)] + b"").decode("utf-8", "ignore")) + (not valid(whole[: at + len(piece)]))
        at += len(piece)
    assert at == len(text.encode())


def valid(raw):
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_frames(spark, odd, none):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=str)
    theirs = by_ranks(RANKS)
    found = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, offsets=True)
    got = sorted(((r["doc_id"], r["ids"], len(r["starts"]), len(r["ends"])) for r in found.collect()), key=lambda r: str((r[0], theirs.decode(r[1]))))
    assert [(i, x) for i, x, _, _ in got] == [(i, theirs.encode_ordinary(t)) for i, t in rows]
    assert all(len(x) == a == b for _, x, a, b in got)
    back = bpe.decode(found, RANKS, public_tokenizers.PATTERN)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == rows
    trip = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)
    want = [(i, len(x := theirs.encode_ordinary(t)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert sorted((tuple(r) for r in trip.collect()), key=str) == sorted(want, key=str)
    for f in (bpe.encode, bpe.round_trip):
        assert f(none, RANKS, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in bpe.decode(nulls, RANKS, public_tokenizers.PATTERN).collect()) == [(1, ""), (2, "")]
