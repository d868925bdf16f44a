"""Tokens, n-grams and predicates against plain restatements and the cases that the tables lack."""

from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import hashing, segment, text

CASES = [
    "1.234.5678 a1.234 62.714 12.345,67x 12.345,67 1234.567 0.123,",
    "x 1.234,abc 9.999.999,1",
    "né néon 黄金 黄金价格 a漢b",
    "Ünïcode ROCKS, don't stop_me 3,5 ½ ² x",
    "",
    "   ",
    "ﬁne ＡＢＣ１２！？",
    "12.345.678.901 1.2345 .123 1.234. 1.234,",
]


def alnum(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "N"


def scan(s: str) -> list[str]:
    """The tokeniser as a scanner: a grouped numeral that nothing alphanumeric follows, else an alphanumeric run."""
    s, i, out = s.lower(), 0, []
    digit = lambda k: k < len(s) and s[k] in "0123456789"
    while i < len(s):
        if digit(i):
            j = i
            while digit(j) and j - i < 3:
                j += 1
            k, groups = j, 0
            while k + 3 < len(s) + 0 and s[k] == "." and all(digit(k + d) for d in (1, 2, 3)):
                k, groups = k + 4, groups + 1
            if groups:
                if k < len(s) and s[k] == "," and digit(k + 1):
                    k += 1
                    while digit(k):
                        k += 1
                if k >= len(s) or not alnum(s[k]):
                    out.append(s[i:k])
                    i = k
                    continue
        if alnum(s[i]):
            j = i
            while j < len(s) and alnum(s[j]):
                j += 1
            out.append(s[i:j])
            i = j
        else:
            i += 1
    return out


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", make(F.col("t"))).collect())]


def test_tokens(spark):
    assert column(spark, CASES, text.tokens) == [scan(c) for c in CASES]
    assert column(spark, CASES[:1], text.tokens)[0] == ["1", "234", "5678", "a1", "234", "62.714", "12", "345", "67x", "12.345,67", "1234", "567", "0.123"]


def test_tokens_of_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.tokens(F.col("text")).alias("w")).limit(60).collect()
    for r in rows:
        assert r["w"] == scan(r["text"])


def test_one_pass_says_what_the_columns_say(spark, sf_dir):
    rows = [(t,) for t in CASES] + [(r["text"],) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    words = text.tokens(F.col("t"))
    base = text.without_stopwords(words)
    df = spark.createDataFrame(rows, "t string").select("t", F.concat(base, text.bigrams(base)).alias("lex"), text.trigrams(words).alias("tri"))
    for r in df.collect():
        assert segment.analyse(r["t"]) == (r["lex"], r["tri"])


def test_bigrams_and_trigrams(spark):
    words = ["the", "cat", "at", "home", "again"]
    df = spark.createDataFrame([(words,), ([],), (["solo"],)], "w array<string>")
    assert [r[0] for r in df.select(text.bigrams(F.col("w"))).collect()] == [["the_cat", "home_again"], [], []]
    got = [r[0] for r in df.select(text.trigrams(F.col("w"))).collect()]
    assert got == [["#ho", "hom", "ome", "me#", "#ag", "aga", "gai", "ain", "in#"], [], ["#so", "sol", "olo", "lo#"]]
    numeral = spark.createDataFrame([(["62.714", "6271"],)], "w array<string>").select(text.trigrams(F.col("w"))).first()[0]
    assert numeral == ["#62", "627", "271", "71#"]


def test_stopwords_keep_repeats(spark):
    df = spark.createDataFrame([(["what", "gold", "gold", "the"],)], "w array<string>")
    assert df.select(text.without_stopwords(F.col("w"))).first()[0] == ["gold", "gold"]


def test_cjk_pairs(spark):
    values = ["黄金价", "né", "a漢b", "ab", "漢"]
    assert column(spark, values, lambda c: text.wide_bigrams(c, False)) == [["黄金", "金价"], [], ["漢b"], [], []]
    assert column(spark, values, lambda c: text.wide_bigrams(c, True)) == [["黄金", "金价"], ["né"], ["a漢", "漢b"], ["ab"], []]


@pytest.mark.parametrize("value,yes", [("1.234", True), ("12.345.678", True), ("1.234,5", True), ("1234", False), ("1.23", False), ("1.234,", False), ("a1.234", False), ("", False)])
def test_is_thousands(spark, value, yes):
    assert column(spark, [value], text.is_thousands) == [yes]


def test_query_params(spark):
    df = spark.createDataFrame([("http://x/a?q=a%20b&k=1=2&flag#f?z=1",), ("http://x/",), (None,)], "u string")
    got = [[tuple(p) for p in (r[0] or [])] for r in df.select(text.query_params(F.col("u"))).collect()]
    assert got == [[("q", "a b"), ("k", "1=2")], [], []]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é漢#", min_size=0, max_size=12))
def test_hash_is_mod_2_64(word):
    h = 14695981039346656037
    for c in word:
        h = ((h ^ ord(c)) * 1099511628211) % 2**64
    assert hashing.fnv1a(word) == h
    dims = hashing.word_dims(word, 384)
    assert len(dims) == (sum(max(0, len(word) + 3 - n) for n in (3, 4, 5)) if len(word) >= 3 else 0)


def test_normalize():
    assert segment.normalize("ﬁne  ＡＢＣ\n\t１２！") == "fine ABC 12!"
    assert segment.normalize("كِتَابٌ") == "كتاب"
    assert segment.normalize(None) == ""
