"""The trained operators: what they learn, what they never look at, and their bounds."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, lm, toxicity

WORDS = [f"plain{c}{d}" for c in "abcdefgh" for d in "klmnop"]


def remainder(i, mod):
    return zlib.crc32(b"" if i is None else str(i).encode()) % mod


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


# --- toxicity


def test_pairs_beyond_linear_weights(spark):
    """Toxic only where an insult and a group stand together: either word alone says nothing."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(WORDS) for _ in range(12)] + ["scumbag"] * insult + ["foreigners"] * group
        rng.shuffle(words)
        docs.append((i, " ".join(words), None))
        labels.append((i, int(insult and group)))
    docs, labels = frame(spark, docs), frame(spark, labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.97


def test_held_out_accuracy(spark, documents, labels):
    big = documents.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(big, toxicity.fit(big, marks)).join(marks, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["toxic"]).mean() > 0.9
    pos, neg = got[got["toxic"] == 1]["score"].to_numpy(), got[got["toxic"] == 0]["score"].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.9


def test_toxicity_ignores_held_out_labels_and_other_columns(spark, documents, labels):
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    by = lambda d, m: {r["doc_id"]: r["score"] for r in toxicity.score(d, m).collect()}
    first = by(documents, toxicity.fit(documents, labels))
    assert by(other, toxicity.fit(other.repartition(3), flipped.repartition(2))) == first
    moved = documents.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    assert {i - 1_000_000: s for i, s in by(moved, toxicity.fit(documents, labels)).items()} == first


def test_toxicity_of_odd_rows(spark, odd, none, labels):
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(got) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in got)
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(none, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, nothing).collect()} == {0.5}
    odd_labels = frame(spark, [(1, None), (None, 1), (3, 7), (4, 1), (4, 0)], "doc_id long, toxic int")
    toxicity.score(odd, toxicity.fit(odd, odd_labels)).collect()
    kept = toxicity.score(odd, model, keep=("doc_id", "text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted"]


def test_scores_are_plain_pairwise_sums():
    """Of a factorization machine, term by term and pair by pair; and gradients against differences of the loss."""
    rng = np.random.default_rng(8)
    w, v = rng.normal(0, 1, 30), rng.normal(0, 1, (30, 4))
    model = toxicity.Model(0.3, w, v)
    for n in (0, 1, 2, 9):
        ids = rng.permutation(30)[:n]
        x = 0.3 + sum(w[i] for i in ids) + sum(float(v[i] @ v[j]) for a, i in enumerate(ids) for j in ids[a + 1 :])
        assert model.score(ids) == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-9)
    docs, labels = [rng.permutation(30)[:5] for _ in range(6)], np.array([0, 1, 0, 1, 1, 0.0])
    w, v = w * 0.1, v * 0.1
    start = toxicity.Model(0.1, w.copy(), v.copy())

    def loss():
        return -np.mean([np.log(p if y else 1 - p) for p, y in ((start.score(d), y) for d, y in zip(docs, labels, strict=True))])

    toxicity._descend(docs, labels, 0.1, w, v, 1, 0.0, 0.0, np.random.default_rng(0), rate=1e-6)
    for old, new in ((start.w, w), (start.v, v)):
        change = new - old
        for at in zip(*np.nonzero(change), strict=True):
            by = slope(old, at, loss)
            if abs(by) > 1e-4:
                assert np.sign(change[at]) == -np.sign(by)


# --- language


def test_language_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_ignores_held_out_rows_and_other_columns(documents):
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = documents.withColumn("lang", F.when(hidden, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("y")).repartition(3)
    by = lambda d, m: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(d, m).collect()}
    first, second = langid.fit(documents), langid.fit(other)
    assert "zz" not in second.langs
    assert by(other, second) == by(documents, first)


def test_language_of_odd_rows(spark, odd, none):
    model = langid.fit(odd)
    got = langid.predict(odd, model).collect()
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert len(got) == len(texts)
    for i, t in texts:
        for r in (r for r in got if str(r["doc_id"]) == i and i != "None"):
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t)) and r["held_out"] == (remainder(int(i), 4) == 2)
    assert langid.predict(none, model).count() == 0
    nothing = langid.fit(none)
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(odd, nothing).collect()} == {("und", 0.0)}
    one = langid.fit(frame(spark, [(1, "only one language here", "en")]))
    assert {r["lang_pred"] for r in langid.predict(odd, one).collect()} <= {"en", "und"}


def test_what_counts_as_a_letter(spark):
    """Numerals and fractions are none, whatever the class of words they match."""
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(["½", "²³", "①", "Ⅷ", "٣", "a½", "ª", "漢", "é", "_"])])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [got[i] == "und" for i in range(10)] == [True, True, True, True, True, False, False, False, False, True]


def test_gradients_of_the_convolutions(monkeypatch):
    """One step of Adam without momentum moves each weight against the sign of its slope, as differences of the loss give it."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(1, 9, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    start = langid.train(x, y, ["a", "b", "c"], epochs=0)
    moved = langid.train(x, y, ["a", "b", "c"], epochs=1, rate=1e-6)

    def loss(model):
        model._tables = None
        p = model.probabilities(x).astype(float)
        return -np.log(p[np.arange(6), y]).mean()

    weights = lambda m: [m.embed, *m.filters, *m.biases, m.out, m.out_bias]
    checked = 0
    for old, new in zip(weights(start), weights(moved), strict=True):
        flat, change = old.reshape(-1), (new - old).reshape(-1)
        for i in np.argsort(-np.abs(flat))[:6]:
            kept = flat[i]
            flat[i] = kept + 2e-3
            up = loss(start)
            flat[i] = kept - 2e-3
            by = (up - loss(start)) / 4e-3
            flat[i] = kept
            if abs(by) > 2e-3:
                checked += 1
                assert np.sign(change[i]) == -np.sign(by)
    assert checked >= 10


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 512, 1000):
        raw = bytes(i % 251 + 1 for i in range(n))
        got = langid.windows(raw)
        assert got.shape[1] == langid.WINDOW and b"".join(w.tobytes() for w in got[:-1]) == raw[: (len(got) - 1) * langid.WINDOW]
        assert n <= langid.WINDOW or got[-1].tobytes() == raw[-langid.WINDOW :]


def test_folded_network_is_the_network():
    """The tables of byte pairs give what embedding, filters and max pooling give."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    model = langid.train(x, np.arange(40) % 3, ["a", "b", "c"], epochs=1)
    emb = model.embed[x]
    wide = []
    for k, width in enumerate(langid.WIDTHS):
        patches = np.concatenate([emb[:, j : langid.WINDOW - width + 1 + j] for j in range(width)], 2)
        wide.append((patches @ model.filters[k]).max(1) + model.biases[k])
    assert np.allclose(model.pooled(x), np.maximum(np.concatenate(wide, 1), 0), atol=1e-3)
    assert np.allclose(model.probabilities(x).sum(1), 1, atol=1e-5)


# --- language model

VOCABULARY = lm.SIDE * lm.SIDE
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(FOLD)), None]


def base_scores(rows):
    counts = Counter(t for i, x in rows if remainder(i, 7) != 2 for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, x in rows:
        found = tokens(x)
        logs = [math.log10((counts[t] + 1) / (total + 1 * (distinct + 1))) for t in found]
        out.append((i, remainder(i, 7) == 2, len(found), sum(counts[t] > 0 for t in found), total, math.fsum(logs)))
    return out


def compare(got, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    found, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(base_scores(rows), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("common", [1 << 17, 1500])
def test_counts_of_documents(documents, monkeypatch, common):
    """Words beyond the commonest are counted by a join."""
    monkeypatch.setattr(lm, "COMMON", common)
    got = lm.score(documents.repartition(3)).collect()
    compare(got, [(r["doc_id"], r["text"]) for r in documents.collect()])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_odd_rows(spark, odd, none):
    compare(lm.score(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert lm.score(none).count() == 0
    held = next(i for i in range(100) if remainder(i, 7) == 2)
    got = lm.score(frame(spark, [(held, "no training text at all", None)])).first()
    assert (got["train_tokens"], got["n_known"]) == (0, 0) and math.isfinite(got["score"])


def test_probabilities_add_up_to_one():
    """Over all classes and words, and the class of all other words, at any state."""
    net = lm.fresh(np.arange(VOCABULARY, 0, -1).astype(float), 500)
    rng = np.random.default_rng(3)
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.3, net.p[k].shape).astype(np.float32)
    h = rng.normal(0, 1, (lm.HIDDEN, 1)).astype(np.float32)
    logs, _ = lm.log_probabilities(net, np.repeat(h, VOCABULARY + 1, 1), np.arange(VOCABULARY + 1))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("size,few", [(1, 0), (80, 0), (1, 9), (80, 9)])
def test_gradients_of_the_softmax(size, few, monkeypatch):
    """Against differences of the loss, with small and with very large logits, class by class and all at once."""
    monkeypatch.setattr(lm, "FEW", few)
    rng = np.random.default_rng(1)
    net = lm.fresh(np.arange(VOCABULARY, 0, -1).astype(float), 50)
    h, target = rng.normal(0, 1, (lm.HIDDEN, 5)), np.array([0, 40, 40, VOCABULARY, 999])
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    net.p["cb"] *= size
    grad = {k: np.zeros_like(v) for k, v in net.p.items()}
    _, dh = lm.log_probabilities(net, h, target, grad)
    loss = lambda: -lm.log_probabilities(net, h, target)[0].sum()
    for k, at in (("c", (3, 1)), ("cb", (0,)), ("o", (1, 4, 8)), ("ob", (1, 8))):
        assert grad[k][at] == pytest.approx(slope(net.p[k], at, loss), abs=1e-5)
    assert dh[3, 2] == pytest.approx(slope(h, (3, 2), loss), abs=1e-5)


def slope(x, at, loss, e=1e-5):
    old = x[at]
    x[at] = old + e
    up = loss()
    x[at] = old - e
    down = loss()
    x[at] = old
    return (up - down) / (2 * e)


def test_gradients_of_the_recurrence():
    """Of a window of three lanes that end at different steps and hold several texts, against differences of the loss."""
    rng = np.random.default_rng(6)
    net = lm.fresh(np.arange(VOCABULARY, 0, -1).astype(float), 50)
    net.p = {k: v + rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    texts = [rng.integers(0, 40, n) for n in (6, 1, 3, 2, 4)]
    source, target, new, own, live = next(lm.Lanes(texts, 3).windows(0, 9))
    assert live[0] == 3 and live[-1] < 3 and new[1:].any() and sum(live) == sum(map(len, texts))
    h = rng.normal(0, 0.5, (lm.HIDDEN, 3))
    begun = h * ~new[0]  # a lane that begins a text forgets

    def loss():
        total = 0.0
        for s in range(3):
            state = begun[:, [s]]
            for t in range(sum(m > s for m in live)):
                state = np.zeros_like(state) if new[t, s] else state
                state = net.step(net.p["w"][[source[t, s]]].T, state)[0]
                total -= lm.log_probabilities(net, state, target[t, [s]])[0][0]
        return total

    grad = {k: np.zeros_like(v) for k, v in net.p.items() if k != "w"}
    _, (used, dw) = lm._window(net, source, target, new, live, h, grad)
    assert set(used) == {source[t, s] for t, m in enumerate(live) for s in range(m)}
    for i in range(0, 3 * lm.HIDDEN, 5):
        assert grad["u"][3, i] == pytest.approx(slope(net.p["u"], (3, i), loss), abs=1e-5)
        for j in (0, len(used) - 1):
            assert dw[j, i] == pytest.approx(slope(net.p["w"], (used[j], i), loss), abs=1e-5)
    assert grad["o"][0, 2, 5] == pytest.approx(slope(net.p["o"], (0, 2, 5), loss), abs=1e-5)


def test_training_learns_order():
    """A fixed cycle of words has no surprise for a network that carries its state."""
    net = lm.fresh(np.full(8, 100.0), 0)
    texts = [np.array([(i + j) % 8 for j in range(64)]) for i in range(8)] * 40
    before = lm.log_scores(net, texts[:8]).sum()
    for _ in range(30):
        lm.train_lanes(net, texts, lanes=64)
    assert lm.log_scores(net, texts[:8]).sum() > before / 4


def test_texts_side_by_side_score_as_alone():
    rng = np.random.default_rng(4)
    net = lm.fresh(np.arange(VOCABULARY, 0, -1).astype(float), 50)
    texts = [rng.integers(0, VOCABULARY + 1, n).astype(np.uint16) for n in (1, 700, 3, 45, 2, 2000, 9)]
    together = lm.log_scores(net, texts, 3)
    assert together == pytest.approx([lm.log_scores(net, [t])[0] for t in texts], rel=1e-5)
    plain, p = [], net.p
    for t in texts[:4]:
        h, total, last = np.zeros((lm.HIDDEN, 1)), 0.0, 0
        for x in t:
            h = net.step(p["w"][[last]].T, h)[0]
            total += lm.log_probabilities(net, h, np.array([x]))[0][0]
            last = x
        plain.append(total / math.log(10))
    assert together[:4] == pytest.approx(plain, rel=1e-4)
    assert len(lm.log_scores(net, [])) == 0


def test_memory_of_a_very_long_text():
    """A text of a million tokens beside many short ones: memory is of all tokens, not of the longest for each."""
    import tracemalloc

    rng = np.random.default_rng(5)
    net = lm.fresh(np.arange(VOCABULARY, 0, -1).astype(float), 50)
    texts = [rng.integers(0, VOCABULARY + 1, n).astype(np.uint16) for n in [1_000_000] + [20] * 600]
    tracemalloc.start()
    found = lm.log_scores(net, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(found).all() and peak < 100e6


def test_vocabulary_grows_with_the_corpus(documents, monkeypatch):
    """By the fourth root of the distinct words, without a step; probabilities still add up, and counts are what they were."""
    sides = [lm.side_of(n) for n in (0, 1000, 1 << 23, 1 << 25, 1 << 27, 1 << 31, 1 << 60)]
    assert sides == [32, 32, 32, 45, 64, 128, 255]
    net = lm.fresh(np.arange(45 * 45, 0, -1).astype(float), 500, 45)
    logs, _ = lm.log_probabilities(net, np.zeros((lm.HIDDEN, 45 * 45 + 1), np.float32), np.arange(45 * 45 + 1))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    monkeypatch.setattr(lm, "SIDE_WORDS", 1000)
    assert lm.side_of(5000) > lm.SIDE
    got = lm.score(documents.repartition(3)).collect()
    compare(got, [(r["doc_id"], r["text"]) for r in documents.collect()])
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_averages_weigh_tokens():
    import pickle

    nets = [(pickle.dumps({"a": np.array([v], np.float32)}), n) for v, n in ((1.0, 1), (4.0, 2))]
    raw, n = lm._average(nets)
    assert n == 3 and pickle.loads(raw)["a"][0] == pytest.approx(3.0)




def test_network_learns_from_every_training_text(spark):
    """One short text that the hash of an earlier sample left out, in every row: it must be learned all the same."""
    text = next(t for k in range(99) if zlib.crc32((t := " ".join(f"w{k}x{j % 20}" for j in range(60))).encode() + b" \n") % 16)
    got = lm.score(frame(spark, [(i, text, None) for i in range(2000)])).where("held_out").first()
    assert got["score"] > 0.9 * got["base_score"]


def test_training_counts_every_token():
    """Texts of one token and of many windows, held in several parts."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, VOCABULARY + 1, n).astype(np.uint16) for n in (1, 700, 3, 64, 65, 2000, 9, 1)]
    for held in (50, 4000):
        assert lm.train_texts(lm.fresh(np.full(VOCABULARY, 5.0), 9), iter(texts), 0.05, held) == sum(map(len, texts))


def test_training_takes_its_memory_once():
    """Windows of training use the same arrays again; with new ones each took about 2,400 page faults, a third of the time."""
    import resource

    net = lm.fresh(np.arange(VOCABULARY, 0, -1).astype(float), 50)
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, VOCABULARY + 1, 20 * lm.WINDOW).astype(np.uint16) for _ in range(lm.TOGETHER)]
    lm.train_lanes(net, texts)
    begun = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    lm.train_lanes(net, texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - begun < 20 * 600


def test_workspace_lies_in_one_block():
    """Arrays of a training window lie side by side in memory that may have large pages, and don't overlap."""
    work = lm.Workspace()
    net = lm.fresh(np.arange(VOCABULARY, 0, -1).astype(float), 50)
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, VOCABULARY + 1, lm.WINDOW).astype(np.uint16) for _ in range(lm.TOGETHER)]
    source, target, new, _, live = next(lm.Lanes(texts, lm.TOGETHER).windows(0, lm.WINDOW))
    grad = {k: np.zeros_like(v) for k, v in net.p.items() if k != "w"}
    lm._window(net, source, target, new, live, np.zeros((lm.HIDDEN, lm.TOGETHER), np.float32), grad, work)
    places = sorted((x.ctypes.data, x.ctypes.data + x.nbytes) for x in work.held.values())
    assert len(places) > 8 and places[-1][1] - places[0][0] <= lm.BLOCK
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
    assert len(work.flat("large", lm.BLOCK, np.float32)) == lm.BLOCK and not len(work.flat("none", 0, np.float32))


def test_words_in_bulk():
    """They are those of each text alone, for all bytes, without a Python object for each."""
    import pyarrow as pa

    from quillspark.llm.common import words

    rng = np.random.default_rng(9)
    letters = [*map(chr, range(256)), "é", "你", "\U0001f642", *" \t\n\r A" * 6]
    texts = [None, "", " ", "\n a", "a ", "  A  B \t\n", *("".join(rng.choice(letters, n)) for n in range(300))]
    for part in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(3, 200), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        found, ends = lm._words(part)
        found, cuts = found.to_pylist(), [0, *ends.tolist()]
        assert [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] == [words(t or "") for t in part.to_pylist()]
        (counts, end) = lm._gather(iter([pa.RecordBatch.from_arrays([part], ["text"])]))
        assert dict(zip(counts["word"].to_pylist(), counts["n"].to_pylist(), strict=True)) == Counter(found)
        assert end["n"].to_pylist() == [len(part)][: len(part)]


def test_count_of_the_end_beside_many_words_of_its_level(spark, monkeypatch):
    """One long training text: its words and its end have one occurrence each, too many for the common ones."""
    monkeypatch.setattr(lm, "COMMON", 20)
    train = next(i for i in range(100) if remainder(i, 7) != 2)
    held = next(i for i in range(100) if remainder(i, 7) == 2)
    rows = [(train, " ".join(f"w{j}" for j in range(100))), (held, "w1 w2 elsewhere")]
    compare(lm.score(frame(spark, [(*r, None) for r in rows])).collect(), rows)


@pytest.mark.parametrize("joined", [1 << 20, 50])
def test_rare_words_are_looked_up(documents, monkeypatch, joined):
    """Their join sorts no words, in tasks whose number grows with that of distinct words."""
    monkeypatch.setattr(lm, "COMMON", 1500)
    monkeypatch.setattr(lm, "JOINED", joined, raising=False)
    got = lm.score(documents.repartition(3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ShuffledHashJoin \[word#", plan) and not re.search(r"SortMergeJoin \[word#", plan)
    assert ("REPARTITION_BY_NUM" in plan) == (joined == 50)
    compare(got.collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])
