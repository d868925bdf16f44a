"""Sources, stored indexes, the engine object, its command line and HTTP, streams and configuration."""

from __future__ import annotations

import json
import math
import threading
import urllib.error
import urllib.request

import pytest

from quillspark import cli
from quillspark.config import Settings
from quillspark.engine import SearchEngine
from quillspark.operators import evaluate
from quillspark.operators.index import ChunkIndex
from quillspark.operators.search import CosineIndex
from quillspark.sources.folder import read_folder, read_parquet
from quillspark.streaming.ingest import index_stream, load_stream

GOLD = "GOLD REPORT 2026. The company sold gold and nickel in great amounts this year, and its revenue rose by a tenth over the year before. "
SHIPS = "Of harbours and ships. Vessels leave the harbour in the morning and return at night with fish, which the market sells before the sun is up. "


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    (top / "gold.md").write_text("# Gold\n\n" + GOLD * 3)
    (top / "ships.txt").write_text(SHIPS * 3)
    (top / "tiny.csv").write_text("a,b\n1,2\n")
    (top / ".hidden.txt").write_text(GOLD)
    (top / "config.json").write_text("{}")
    (top / "data.BIN").write_bytes(b"x" * 200)
    (top / "broken.txt").write_bytes(b"\xff\xfe" + GOLD.encode())
    (top / "paper.pdf").write_bytes(b"%PDF" + SHIPS.encode())
    (top / "bad.pdf").write_bytes(b"none")
    (top / "empty.txt").write_text("")
    (top / "sub").mkdir()
    (top / "sub/deep.txt").write_text(GOLD)
    return str(top)


def pdf(raw: bytes) -> str:
    if not raw.startswith(b"%PDF"):
        raise ValueError("no PDF")
    return raw[4:].decode()


def test_folder(spark, folder):
    assert {r["source"] for r in read_folder(spark, folder, {}).collect()} == {"gold.md", "ships.txt", "tiny.csv", "paper.pdf", "bad.pdf"}
    found = {r["source"]: r["text"] for r in read_folder(spark, folder, {"pdf": pdf}).collect()}
    assert set(found) == {"gold.md", "ships.txt", "tiny.csv", "paper.pdf"} and found["paper.pdf"] == SHIPS


def test_huge_files_are_read_by_splits(spark, tmp_path, monkeypatch):
    """Parts together are the file, line by line; each is bounded, and small files stay whole."""
    from quillspark.sources import folder

    monkeypatch.setattr(folder, "HUGE", 4000)
    monkeypatch.setattr(folder, "PART", 1000)
    lines = [f"line {i} of a file that is too large é" for i in range(500)]
    (tmp_path / "huge.txt").write_bytes("\n".join(lines).encode() + b"\n\xff end")
    (tmp_path / "small.txt").write_text("small")
    (tmp_path / "huge.pdf").write_text("x" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = {r["source"]: r["text"] for r in read_folder(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found.pop("small.txt") == "small" and all(k.startswith("huge.txt#") and len(t) <= 1000 for k, t in found.items()) and len(found) >= 15
    place = lambda k: tuple(map(int, k.partition("#")[2].split(".")))
    assert "\n".join(found[k] for k in sorted(found, key=place)) == "\n".join([*lines, "\ufffd end"])


def test_pdf_by_a_program(spark, tmp_path, monkeypatch):
    """pdftotext, where there is one; here a stand-in that tells what it was given. Without it, such files go."""
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/paper.pdf").write_bytes(b"%PDF\xff" + SHIPS.encode())
    (tmp_path / "docs/quillspark.json").write_text("{}")
    (tmp_path / "bin").mkdir()
    program = tmp_path / "bin/pdftotext"
    program.write_text('#!/bin/sh\necho "text of $1 to $2"\n')
    program.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path / 'bin'}:/usr/bin:/bin")
    from quillspark.sources import folder

    assert folder.pdf_text(b"%PDF") == "text of - to -\n"
    path = str(program)
    by = lambda raw: __import__("subprocess").run([path, "-", "-"], input=raw, capture_output=True, check=True).stdout.decode()  # noqa: E731  workers have the PATH that they began with
    assert [tuple(r) for r in read_folder(spark, str(tmp_path / "docs"), {"pdf": by}).collect()] == [("paper.pdf", "text of - to -\n")]
    program.unlink()
    assert read_folder(spark, str(tmp_path / "docs")).count() == 0


def test_parquet_source(spark, sf_dir):
    found = read_parquet(spark, f"{sf_dir}/documents.parquet")
    assert found.columns == ["source", "text"] and found.count() == 200
    assert "n_chars" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["bm25", "cosine"])
def test_engine(spark, folder, tmp_path, kind):
    engine = SearchEngine(spark, Settings(), kind)
    with pytest.raises(RuntimeError):
        engine.health()
    cache = str(tmp_path / "kept")
    n = engine.index_folder(folder, cache)
    assert n == engine.health() == engine.stats()["chunks"] == sum(r["count"] for r in engine.chunks_per_source().collect())
    again = SearchEngine(spark, Settings(), kind)
    assert again.index_folder("/nowhere", cache) == n
    best = json.loads(again.search_json("gold revenue", 2))
    assert best[0]["source"] == "gold.md" and best[0]["rank"] == 1
    both = {(r["qid"], r["source"]) for r in engine.search(["harbour ships", "nickel"], 1).collect()}
    assert both & {(0, "ships.txt"), (0, "paper.pdf")} and (1, "gold.md") in both
    assert engine.search("   ").count() == 0
    engine.save(str(tmp_path / "saved"))
    chunks = again.index.chunks
    assert chunks.storageLevel.useMemory
    again.forget()
    assert again.index is None and not chunks.storageLevel.useMemory
    again.load(str(tmp_path / "saved"))
    assert again.stats() == engine.stats()
    truth = evaluate.parse(spark.createDataFrame([("1. gold revenue? -> tenth",), ("2. ships -> nothing of it,",)], "value string"))
    found = engine.evaluate(truth)
    assert (found["hits"], found["queries"], found["recall"]) == (1, 2, 0.5)


def test_progress(spark, folder):
    told = []
    SearchEngine(spark, Settings()).index_folder(folder, tell=lambda done, total: told.append((done, total)))
    assert told and all(0 <= done <= total for done, total in told) and told[-1][0] == told[-1][1] > 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_built_in_questions(spark, folder, capsys):
    truth = evaluate.questions(spark)
    assert truth.count() == 20 and all(w == w.lower() for r in truth.collect() for w in r["keywords"])
    cli.main(["benchmark", folder])
    assert capsys.readouterr().out.count("/20 =") == 2


def test_compacted_index(spark):
    engine = SearchEngine(spark, Settings())
    for i in range(3):
        engine.add(GOLD if i % 2 else SHIPS, f"doc{i}")
    before, found = engine.stats(), [tuple(r) for r in engine.search("gold ships", 5).collect()]
    index = engine.index.compacted()
    assert (index.totals.count(), index.terms.groupBy("field", "term").count().where("count > 1").count()) == (1, 0)
    for engine.index in (index, index.warmed()):
        assert engine.stats() == before and sorted(map(tuple, engine.search("gold ships", 5).collect())) == sorted(found)


def test_many_queries_stay_on_executors(spark, folder, monkeypatch):
    """More queries than the driver looks at: the same answers by joins."""
    for kind in ("bm25", "cosine"):
        engine = SearchEngine(spark, Settings(top_k_candidates=3), kind)
        engine.index_folder(folder)
        asked = ["gold revenue", "harbour ships", "nothingatall", "nickel"]
        key = lambda df: sorted((r["qid"], r["rank"], r["source"], round(r["score"], 9)) for r in df.collect())
        want = key(engine.search(asked, 3))
        with monkeypatch.context() as m:
            m.setattr("quillspark.operators.score.LISTED", 1)
            assert key(engine.search(asked, 3)) == want


def test_scratch_tables_go(spark):
    from pathlib import Path

    from quillspark.scratch import drop, materialize, scratch_path

    found = materialize(spark.range(3), "some")
    path = Path(found.inputFiles()[0].removeprefix("file:")).parent
    assert path.is_dir() and path.parent == Path(scratch_path(spark, "x")).parent
    drop(spark, str(path))
    assert not path.exists()


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        SearchEngine(spark, kind="other")


def test_add_texts(spark):
    engine = SearchEngine(spark, Settings())
    assert engine.add(GOLD, "one", page=3) == 1
    assert engine.add("too short", "two") == 0
    assert engine.add(SHIPS, "three") == 1
    found = engine.search("gold", 5).collect()
    assert [(r["source"], r["page"]) for r in found] == [("one", 3)]
    with pytest.raises(RuntimeError):
        SearchEngine(spark, Settings(), "cosine").add(GOLD, "one")


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "source string, text string")
    for kind in ("bm25", "cosine"):
        engine = SearchEngine(spark, Settings(), kind)
        assert engine.index_documents(none) == 0
        assert engine.search("gold").count() == 0


def test_idf_by_chunk(spark):
    docs = spark.createDataFrame([(1, GOLD * 60), (2, SHIPS)], "doc_id long, text string")
    by_file, by_chunk = (CosineIndex.build(docs, Settings(), idf_unit=u) for u in ("file", "chunk"))
    n = by_file.chunks.count()
    assert n > 2
    idf = [{r["term"]: r["idf"] for r in x.vocab.collect()}["the"] for x in (by_file, by_chunk)]
    assert idf == pytest.approx([math.log(2 / 3), math.log(n / (n + 1))])  # in every text: negative, and kept so


def test_stream_counts_a_batch_once(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40).cache()
    docs.where("doc_id % 2 = 0").write.parquet(str(source / "a"))
    path, checkpoint = str(tmp_path / "index"), str(tmp_path / "checkpoint")
    read = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(source / "*"))
    index_stream(read(), path, checkpoint).awaitTermination()
    docs.where("doc_id % 2 = 1").write.parquet(str(source / "b"))
    index_stream(read(), path, checkpoint).awaitTermination()
    index_stream(read(), path, checkpoint).awaitTermination()
    found, whole = load_stream(spark, path), ChunkIndex.build(docs)
    assert found.stats().first() == whole.stats().first()


def test_settings(tmp_path):
    whole, part = tmp_path / "whole.json", tmp_path / "part.json"
    whole.write_text(Settings(chunk_chars=1000, rerank_weight=0.5).to_json())
    part.write_text('{"chunk_chars": 1}')
    assert Settings.load(str(part), str(whole)).chunk_chars == 1000
    assert Settings.load(str(part), str(tmp_path / "none.json")) == Settings()
    assert Settings.load(str(whole)).rerank_weight == 0.5


def test_command_line(spark, folder, tmp_path, capsys):
    questions = tmp_path / "q.txt"
    questions.write_text("1. gold revenue -> tenth\n")
    cli.main(["search", folder, "gold", "revenue"])
    cli.main(["--kind", "cosine", "test", folder, str(questions)])
    said = capsys.readouterr().out
    assert "gold.md" in said and "recall 1/1 = 100.0%" in said


def test_http(spark, folder):
    server = cli.serve(cli.Service(SearchEngine(spark, Settings())), "127.0.0.1", 0)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", body, timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/")[0] == 200 and ask("/nothing")[0] == 404 and ask("/nothing", b"")[0] == 404
        assert ask("/health") == (200, {"status": "empty", "chunks": 0})
        assert ask("/search?q=gold")[0] == 503
        assert ask("/search")[0] == 400 and ask("/search?q=gold&top_k=x")[0] == 400
        assert ask("/index", b"[]")[0] == 400 and ask("/index", b"{}")[0] == 400
        status, said = ask("/index", json.dumps({"folder": folder}).encode())
        assert status == 200 and said["chunks"] > 0
        status, said = ask("/search?q=gold%20revenue&top_k=1")
        assert status == 200 and said["query"] == "gold revenue" and [r["source"] for r in said["results"]] == ["gold.md"]
        assert ask("/health")[1]["chunks"] > 0
        assert ask("/stop", b"") == (200, {"status": "stopped"})
        thread.join(20)
        assert not thread.is_alive()
    finally:
        server.shutdown()


def test_idle_server_ends(spark):
    server = cli.serve(cli.Service(SearchEngine(spark, Settings())), "127.0.0.1", 0, idle=0.5)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health", timeout=20) as r:
        assert r.status == 200
    thread.join(20)
    assert not thread.is_alive()
