"""Index, scoring, trees and evaluation against plain restatements on small fixtures."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.config import SMALL_CHUNKS, Settings
from quillspark.functions import segment
from quillspark.operators import evaluate, score, search, tree
from quillspark.operators.index import ChunkIndex
from quillspark.plans import fixtures, queries
from tests.test_text import scan

WORDS = "gold nickel harbour vessel morning market revenue profit total company report figure amount annual night fish".split()
STOP = {"the", "a", "what", "is"}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, ". ".join(" ".join(rng.choice([*WORDS, "the", "a"]) for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(3, 25))) + ".") for i in range(40)]
    return rows, ChunkIndex.build(spark.createDataFrame(rows, "doc_id long, text string"))


def lists(content):
    words = scan(content)
    base = [w for w in words if w not in STOP]
    lex = base + [f"{a}_{b}" for a, b in zip(base, base[1:], strict=False) if len(a) > 2 and len(b) > 2]
    tri = [f"#{w}#"[i : i + 3] for w in words if len(w) >= 4 for i in range(len(w))]
    return lex, tri


def bm25(chunks, query, field):
    docs = {k: Counter(lists(c)[field]) for k, c in chunks.items()}
    asked, n = Counter(lists(query)[field]), len(docs)
    mean = max(sum(sum(d.values()) for d in docs.values()) / n, 1)
    out = {}
    for term, qf in asked.items():
        df = sum(term in d for d in docs.values())
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        for k, d in docs.items():
            if tf := d[term]:
                gain = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) * (1 + 0.1 * (qf - 1))
                raw, m = out.get(k, (0.0, 0))
                out[k] = raw + gain, m + 1
    scored = {k: raw * (0.4 + 0.6 * m / len(asked) + 0.5 * (m == len(asked))) for k, (raw, m) in out.items()}
    return sorted(scored, key=lambda k: (-round(scored[k], 9), k))[:200]


def test_fused_search(spark, corpus):
    rows, index = corpus
    chunks = {(i, j): c for i, t in rows for j, (_, c) in enumerate(segment.chunk(segment.normalize(t), SMALL_CHUNKS))}
    for query in ("gold revenue in the harbour", "vessel vessel market", "unknownword night"):
        ranks: Counter = Counter()
        for field, weight in ((0, 0.72), (1, 0.28)):
            for r, k in enumerate(bm25(chunks, query, field)):
                ranks[k] += weight / (60 + r + 1)
        want = sorted(ranks, key=lambda k: (-round(ranks[k], 9), k))[:10]
        got = search.bm25_search(index, score.query_frame(spark, [(1, query)]), 10).orderBy("rank").collect()
        assert [(r["doc_id"], r["chunk_no"]) for r in got] == want
        assert [r["score"] for r in got] == pytest.approx([ranks[k] for k in want])


def test_many_blocks_and_many_terms(spark, corpus, monkeypatch):
    """The same results from lists that come in many blocks, by joins in place of pushed lists, and after an addition."""
    rows, index = corpus
    asked = score.query_frame(spark, [(1, "gold revenue in the harbour"), (2, "vessel vessel market")])
    want = sorted(map(tuple, search.bm25_search(index, asked, 10).collect()))
    monkeypatch.setattr(segment, "HELD_TERMS", 50)
    blocks = ChunkIndex.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    assert blocks.posted.select("block").distinct().count() > 1
    halves = ChunkIndex.build(spark.createDataFrame(rows[:11], "doc_id long, text string")).add(spark.createDataFrame(rows[11:], "doc_id long, text string"))
    for limit in (score.LISTED, 1):
        monkeypatch.setattr(score, "LISTED", limit)
        for found in (index, blocks, halves):
            got = sorted(map(tuple, search.bm25_search(found, asked, 10).collect()))
            assert [(*r[:4], round(r[4], 9), *r[5:]) for r in got] == [(*r[:4], round(r[4], 9), *r[5:]) for r in want]


def test_a_search_reads_the_lists_of_its_terms(spark, corpus):
    found = score.bm25(corpus[1], score.query_frame(spark, [(1, "gold nickel")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_small_tables_are_spread(spark, sf_dir):
    from quillspark.scratch import spread

    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "RoundRobin" in spread(small)._jdf.queryExecution().toString()
    large = spark.range(10_000_000)
    assert spread(large) is large


def test_least_one_result(spark, corpus):
    assert search.bm25_search(corpus[1], score.query_frame(spark, [(1, "gold")]), 0).count() == 1


def test_numeric_boost_counts_once(spark):
    rows = spark.createDataFrame([(1, 0, "of 62.714 and 1.000 tons", 1.0), (2, 0, "of 62714 tons", 1.0)], "doc_id long, chunk_no int, content string, score double").withColumn("qid", F.lit(1))
    got = score.numeric_boost(rows.drop("content"), rows.select("doc_id", "chunk_no", "content"), score.query_frame(spark, [(1, "62.714 or 1.000?")]))
    assert {r["doc_id"]: r["boosted"] for r in got.collect()} == {1: pytest.approx(1.6), 2: 1.0}


def test_context_is_of_the_same_document(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b" * 700), (2, 0, "c")], "doc_id long, chunk_no int, content string")
    got = {(r["doc_id"], r["chunk_no"]): r["x"] for r in search.with_next(rows).select("doc_id", "chunk_no", search.expanded(F.col("content"), F.col("next"), 500).alias("x")).collect()}
    assert got == {(1, 0): "a " + "b" * 498, (1, 1): "b" * 500, (2, 0): "c"}


@pytest.mark.parametrize("digits,boost", [(20, 0.0), (21, 0.3)])
def test_finance_boost_needs_over_twenty_digits(spark, digits, boost):
    rows = spark.createDataFrame([("Revenue " + "7" * digits,)], "t string")
    assert rows.select(score.finance_boost(F.col("t"), 0.3)).first()[0] == boost


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0, 9.0]), ([0.0], [1.0]), ([], [1.0]), ([1.0, 0.0], [0.0, 3.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(score.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 0.0, 0.0, 0.0])


def overlap(content, query):
    grams = lambda w: [f"#{w}#"[i : i + 3] for i in range(len(w))]
    asked = {g for w in query.lower().split() if len(w) >= 4 for g in grams(w)}
    hit = tot = 0
    for w in [w for w in content.lower().split()[:120] if len(w) >= 4]:
        if tot > 400:
            break
        hit, tot = hit + sum(g in asked for g in grams(w)), tot + len(w)
    return 2 * hit / (len(asked) + tot) if asked and tot else 0.0


def test_trigram_overlap(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(50)
    for query in ("this from with the thing", "a b c", ""):
        got = rows.select("text", score.trigram_overlap(F.col("text"), score.query_trigrams(F.lit(query))).alias("x")).collect()
        assert [r["x"] for r in got] == pytest.approx([overlap(r["text"], query) for r in got])


@pytest.mark.parametrize("limit,block", [(score.LISTED, 4096), (0, 3)])
def test_candidates_are_filled_with_unmatched_chunks(spark, corpus, monkeypatch, limit, block):
    monkeypatch.setattr(score, "LISTED", limit)
    monkeypatch.setattr(search, "KEY_BLOCK", block)
    rows, _ = corpus
    index = search.CosineIndex.build(spark.createDataFrame(rows, "doc_id long, text string"), Settings(top_k_candidates=12))
    asked = score.query_frame(spark, [(1, "gold"), (2, "nothingatall")])
    got = search.candidates(index, asked, Settings(top_k_candidates=12)).collect()
    by = {q: sorted((r["rank"], r["doc_id"], r["sparse"]) for r in got if r["qid"] == q) for q in (1, 2)}
    assert [len(x) for x in by.values()] == [12, 12]
    assert [d for _, d, _ in by[2]] == list(range(12)) and {s for _, _, s in by[2]} == {0.0}


def stacked(text):
    """Nodes by a stack: [id, level, heading, content, parent]."""
    out, stack, held = [], [], []

    def flush():
        if len(body := " ".join(held)) and len(body.encode()) >= 100:
            head = stack[-1] if stack else None
            out.append([len(out), 0, out[head][2] if head is not None else "", body, head])
        held.clear()

    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            continue
        start, level = line[:20], 0
        if line.lower().startswith(("bab ", "chapter ", "bagian ")):
            level = 1
        elif line[0] in "0123456789" and "." in start:
            after = start.split(".", 1)[1].lstrip()
            level = 2 if len(after.encode()) >= 5 and after[0] not in "0123456789" else 0
        if not level:
            held.append(line)
            continue
        flush()
        while stack and out[stack[-1]][1] >= level:
            stack.pop()
        out.append([len(out), level, line[:200], "", stack[-1] if stack else None])
        stack.append(len(out) - 1)
    flush()
    return out


def test_tree_against_a_stack(spark):
    rng, bits = random.Random(9), ["Chapter one", "BAB 2", "1. Background text", "2.3 Detail", "3. More text here", "short", "A paragraph that runs long enough to be kept on its own, since it has well over one hundred bytes in all.", "", "  9. ab"]
    rows = [(i, "\n".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(80)] + [(100 - i, t) for i, t in fixtures.OUTLINES]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = tree.nodes(tree.lines(docs))
    got: dict = {}
    for r in nodes.orderBy("doc_id", "node_id").collect():
        got.setdefault(r["doc_id"], []).append([r["node_id"], r["level"], r["heading"], r["content"], r["parent_id"]])
    want = {i: s for i, t in rows if (s := stacked(t))}
    assert got == want
    rolled = {(r["doc_id"], r["node_id"]): r["content"] for r in tree.rolled_up(nodes).collect()}
    for i, found in want.items():
        for n in reversed(found):
            children = [rolled[i, c[0]] for c in found if c[4] == n[0]]
            assert rolled[i, n[0]] == " ".join(x for x in [n[3], *children] if x)


def test_dense_tree_search(spark, sf_dir, tmp_path):
    """Against the plain inner product of hashed vectors."""
    from quillspark.functions.hashing import word_dims
    from quillspark.operators.index import vocabulary

    nodes = tree.rolled_up(queries.outline_nodes(spark, sf_dir)).cache()
    vocab, asked, query = vocabulary(queries.docs(spark, sf_dir)), queries.asked(spark), dict(fixtures.QUERIES)
    bare = {(r["qid"], r["doc_id"], r["node_id"]): r["score"] for r in tree.search(tree.TreeIndex.build(nodes, vocab), asked, 50).collect()}
    index = tree.TreeIndex.build(nodes, vocab, 384)
    got = tree.search(index, asked, 50).collect()
    index.save(path := str(tmp_path / "tree"))
    for again in (tree.TreeIndex.load(spark, path), tree.TreeIndex.load(spark, path).warmed()):
        near = {(r["qid"], r["doc_id"], r["node_id"]): r["score"] for r in tree.search(again, asked, 50).collect()}
        assert near == pytest.approx({(r["qid"], r["doc_id"], r["node_id"]): r["score"] for r in got})
    content = {(r["doc_id"], r["node_id"]): r["content"] for r in nodes.collect()}
    hist = lambda t: Counter(d for w in t.lower().split() for d in word_dims(w, 384))
    unit = lambda x: {k: v / n for k, v in x.items()} if (n := math.sqrt(sum(v * v for v in x.values()))) else x
    hists = {k: hist(c) for k, c in content.items()}
    df = Counter(d for h in hists.values() for d in h)
    for r in got:
        q = unit({d: n * math.log((len(content) - df[d] + 0.5) / (df[d] + 0.5) + 1) for d, n in hist(query[r["qid"]]).items() if df[d]})
        v = unit(hists[r["doc_id"], r["node_id"]])
        assert r["score"] == pytest.approx(bare[r["qid"], r["doc_id"], r["node_id"]] + 0.4 * sum(w * v.get(d, 0) for d, w in q.items()))


def test_evaluation(spark):
    truth = evaluate.parse(spark.createDataFrame([(x,) for x in fixtures.TRUTH], "value string"))
    assert [(r["qid"], r["query"], r["keywords"]) for r in truth.collect()] == [(1, "What this from is?", ["this", "from"]), (2, "Und der nicht auf", ["nicht", "zzzz"]), (3, "revenue and 62.714", ["62.714"]), (4, "avec dans", ["qqqq", "avec"])]
    results = spark.createDataFrame([(1, 1, "FROM here", ""), (2, 1, "none", "none")], "qid int, rank int, snippet string, expanded string")
    found = evaluate.hits(truth, results)
    assert {r["qid"]: r["hit"] for r in found.collect()} == {1: True, 2: False, 3: False, 4: False}
    assert evaluate.recall(found).first()["recall"] == 0.25


def test_ranking(spark):
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "qid int, rank int, doc_id long")
    relevant = spark.createDataFrame([(1, 11, 1), (1, 12, 1), (1, 99, 1), (2, 5, 1)], "qid int, doc_id long, gain int")
    got = {r["qid"]: (r["recall"], r["mrr"], r["ndcg"]) for r in evaluate.ranking(results, relevant, 10).collect()}
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert got[1] == pytest.approx((2 / 3, 0.5, (1 / math.log2(3) + 1 / math.log2(4)) / ideal), abs=1e-6)
    assert got[2] == (0, 0, 0)


def test_encoders(spark):
    """A pluggable encoder, cut and padded; one that fails leaves the work to hashed n-grams."""
    from quillspark.operators import embed

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["gold gold silver", "", None, "silver"])], "k int, t string")

    def load():
        return lambda texts: np.array([[t.count("gold"), t.count("silver")] for t in texts])

    def broken():
        raise OSError("no model")

    def failing():
        def encode(texts):
            raise ValueError("out of memory")

        return encode

    def vectors(how, dim):
        return {r["k"]: r["embedding"] for r in embed.embedded(rows, ["k"], "t", dim, how).collect()}

    got = vectors(load, 4)
    assert got[0] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5), 0, 0]) and got[1] == got[2] == [0] * 4 and got[3] == [0, 1, 0, 0]
    assert vectors(load, 1)[0] == [1.0]
    plain = vectors(None, 64)
    assert vectors(broken, 64) == vectors(failing, 64) == plain
    assert sum(x * x for x in plain[0]) == pytest.approx(1) and plain[1] == [0] * 64
    hidden, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert embed.pooled(hidden, mask).tolist() == [[2, 3, 4, 5]]
    asked = score.query_frame(spark, [(1, "silver")])
    chunks = spark.createDataFrame([(7, 0, "gold silver"), (8, 0, "gold")], "doc_id long, chunk_no int, content string")
    found = chunks.withColumn("qid", F.lit(1))
    got = {r["doc_id"]: r["dense"] for r in embed.dense(found, chunks, asked, 2, load).collect()}
    assert got == {7: pytest.approx(1 / math.sqrt(2)), 8: 0.0}
