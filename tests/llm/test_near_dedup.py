"""Near-duplicate classes against all pairs in plain Python; small blocks make every way of confirming run."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillspark.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain(rows, size=4, percent=80):
    sets = [shingle_set(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        known = [x for x in (least.get(root(i)), k) if x is not None]
        least[root(i)] = min(known) if known else None
    out = []
    for i, (k, _) in enumerate(rows):
        c = least[root(i)] if sets[i] else k
        out.append((k, len(sets[i]), c, k == c))
    return sorted(out, key=str)


def run(spark, rows, size=4, percent=80):
    docs = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "doc_id long, text string, digest string, bands string, n_shingles int").repartition(3)
    return sorted((tuple(r) for r in near_dedup.near_dedup(docs, size, percent).collect()), key=str)


def family(rng, words, n, first):
    """A text and n - 1 descendants, each made from one before by changing a word or two."""
    base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
    out = [base]
    for _ in range(n - 1):
        x = list(rng.choice(out))
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice(words)
        out.append(x)
    return [(first + i, " ".join(w.upper() if rng.random() < 0.1 else w for w in x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("block,edges_of_one_task", [(512, 0), (4, 0), (4, 200_000)])
def test_families(spark, monkeypatch, block, edges_of_one_task):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GROUP", block // 2)
    monkeypatch.setattr(near_dedup, "ONE_TASK_EDGES", edges_of_one_task)
    rng, rows = random.Random(block), []
    words = [f"word{i}" for i in range(400)]
    for n in (1, 1, 1, 2, 2, 3, 5, 8, 13, 40):
        rows += family(rng, words, n, 1000 - len(rows) * 7 if n % 2 else 5000 + len(rows))
    rng.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_chain_links_beyond_the_threshold(spark):
    """Neighbours are linked, ends aren't: the class is the whole chain."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: 50 - 0], *[]][i : i + 40])) for i in range(11)]
    got = run(spark, rows)
    assert got == plain(rows) and {c for _, _, c, _ in got} == {0}


def test_exact_bound(spark):
    """4 of 5 shingles shared is in, one less is out; fewer than four words are one shingle."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "p q r s t u v"), (4, "p q r s t u"), (5, "x y"), (6, "X  y"), (7, "x y z"), (8, "y x")]
    got = run(spark, rows)
    assert got == plain(rows)
    assert {k: c for k, _, c, _ in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in near_dedup.near_dedup(odd).collect()), key=str) == plain(rows)
    assert near_dedup.near_dedup(none).count() == 0


def test_white_space_is_ascii_only(spark):
    rows = [(1, "a\x0bb\x1cc d e f"), (2, "a b\x1cc d e f"), (3, "a b c d e f"), (4, "a b c d e f")]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [4, 5])
def test_documents(spark, documents, size):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert run(spark, rows, size) == plain(rows, size)


def test_signature_is_a_minimum_over_the_set():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    whole = near_dedup.signature(a)
    assert (whole == np.minimum(near_dedup.signature(a[:200]), near_dedup.signature(a[200:]))).all()
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 100).astype(np.uint64)])
    assert abs((near_dedup.signature(b) == whole).mean() - 400 / 600) < 0.15
    assert len({*near_dedup.bands(whole).tolist()}) == near_dedup.BANDS


@pytest.mark.parametrize("edges_of_one_task", [0, 1000])
def test_components_of_a_long_chain(spark, monkeypatch, edges_of_one_task):
    monkeypatch.setattr(near_dedup, "ONE_TASK_EDGES", edges_of_one_task)
    n = 60
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in zip(order, order[1:], strict=False)] + [(b"\xf0", b"\xf0"), (b"\xf1", b"\xf2")], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in near_dedup.components(edges).collect()}
    assert {got.get(bytes([i]), bytes([i])) for i in range(n)} == {b"\x00"} and got[b"\xf2"] == b"\xf1"


def test_recall_at_the_threshold():
    """Of 2,000 pairs of sets of similarity 0.8 exactly, those that share no band, or whose sketches look too unlike."""
    rng = np.random.default_rng(11)
    lost = 0
    for n in np.repeat([9, 45, 180, 900], 500):
        x = rng.integers(0, 1 << 63, n + n // 9 * 2, dtype=np.uint64)  # n in both, n / 9 more in each: n / (n + 2 n / 8) is 0.8 for n of 8 to 9 parts
        both, each = x[: n // 9 * 8], n // 9
        one, two = np.concatenate([both, x[n : n + each]]), np.concatenate([both, x[n + each :]])
        a, b = near_dedup.signature(one), near_dedup.signature(two)
        likely = near_dedup.estimates(a.astype(np.uint8), b.astype(np.uint8)[None])[0] >= near_dedup.LEAST_ESTIMATE
        lost += not (likely and (near_dedup.bands(a) == near_dedup.bands(b)).any())
    assert lost == 0
