"""python -m quillspark: search, evaluate and serve a folder of documents from one session."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .engine import KINDS, SearchEngine
from .operators import evaluate


class Service:
    """The engine behind HTTP: reads run side by side, an index is swapped in whole when it is built."""

    def __init__(self, engine: SearchEngine, folder: str | None = None, cache: str | None = None):
        self.engine, self.folder, self.cache = engine, folder, cache
        self.building = threading.Lock()
        self.asked, self.busy = time.monotonic(), 0
        self.stop: Callable[[], None] = lambda: None

    @contextmanager
    def answering(self) -> Iterator[None]:
        """A request, for the time of the last one and the number that are being answered."""
        self.busy += 1
        try:
            yield
        finally:
            self.busy -= 1
            self.asked = time.monotonic()

    def health(self) -> tuple[int, dict]:
        ready = self.engine.index is not None
        return 200, {"status": "ok" if ready else "empty", "chunks": self.engine.health() if ready else 0}

    def search(self, query: dict[str, list[str]]) -> tuple[int, dict]:
        asked, most = query.get("q", [""])[0], query.get("top_k", ["10"])[0]
        if not asked.strip():
            return 400, {"error": "q is missing"}
        if not most.isdigit():
            return 400, {"error": "top_k is a number"}
        if self.engine.index is None:
            return 503, {"error": "nothing is indexed yet"}
        began = time.time()
        results = json.loads(self.engine.search_json(asked, int(most)))
        return 200, {"query": asked, "latency_ms": round(1000 * (time.time() - began), 1), "results": results}

    def index(self, body: bytes) -> tuple[int, dict]:
        try:
            given = json.loads(body or b"{}")
            folder, no_cache = given.get("folder", self.folder), bool(given.get("no_cache", False))
        except (ValueError, AttributeError):
            return 400, {"error": "the body is a JSON object"}
        if not folder:
            return 400, {"error": "folder is missing"}
        with self.building:
            began = time.time()
            fresh = SearchEngine(self.engine.spark, self.engine.settings, self.engine.kind)
            cache = self.cache if folder == self.folder and not no_cache else None
            chunks = fresh.index_folder(folder, cache)
            before, self.engine, self.folder = self.engine, fresh, folder
            before.forget()
        return 200, {"folder": folder, "chunks": chunks, "seconds": round(time.time() - began, 3)}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            with service.answering():
                self.get()

        def do_POST(self) -> None:
            with service.answering():
                self.post()

        def get(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/":
                self.answer(200, {"name": "quillspark", "paths": ["/health", "/search?q=&top_k=", "POST /index", "POST /stop"]})
            elif url.path == "/health":
                self.answer(*service.health())
            elif url.path == "/search":
                self.answer(*service.search(parse_qs(url.query)))
            else:
                self.answer(404, {"error": "no such path"})

        def post(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if urlsplit(self.path).path == "/index":
                self.answer(*service.index(body))
            elif urlsplit(self.path).path == "/stop":
                self.answer(200, {"status": "stopped"})
                threading.Thread(target=service.stop, daemon=True).start()  # which waits for the end of this request
            else:
                self.answer(404, {"error": "no such path"})

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(service: Service, host: str, port: int, idle: float | None = None) -> ThreadingHTTPServer:
    """A server that is bound and still to be started. It ends by POST /stop, or once nobody has asked for ``idle`` seconds."""
    server = ThreadingHTTPServer((host, port), handler(service))
    service.stop = server.shutdown
    if idle is not None:

        def watch() -> None:
            while (rest := service.asked + idle - time.monotonic()) > 0 or service.busy:
                time.sleep(max(rest, 0.05))
            server.shutdown()

        threading.Thread(target=watch, daemon=True).start()
    return server


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    parser.add_argument("--kind", choices=sorted(KINDS), default="bm25")
    parser.add_argument("--cache", help="folder that keeps the index")
    parser.add_argument("--no-cache", action="store_true", help="build the index anew")
    parser.add_argument("--top-k", type=int, default=10)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("search", help="print the results of one query")
    one.add_argument("folder")
    one.add_argument("query", nargs="+")
    for name, text in (("test", "recall over a file of questions and keywords"), ("benchmark", "recall and latency over the same, run twice")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("folder")
        sub.add_argument("questions", nargs="?" if name == "benchmark" else None, help="file of lines N. question -> keyword, keyword" + " (default: the built-in questions)" * (name == "benchmark"))
    for name in ("serve", "daemon"):
        sub = commands.add_parser(name, help="answer over HTTP")
        sub.add_argument("folder", nargs="?")
        sub.add_argument("--host", default="127.0.0.1")
        sub.add_argument("--port", type=int, default=9090)
        sub.add_argument("--idle", type=float, help="end after so many seconds without a request")
    end = commands.add_parser("stop", help="end the server of a port")
    end.add_argument("--host", default="127.0.0.1")
    end.add_argument("--port", type=int, default=9090)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    given = _arguments(sys.argv[1:] if argv is None else argv)
    if given.command == "stop":
        with urllib.request.urlopen(f"http://{given.host}:{given.port}/stop", b"", timeout=10) as r:
            print(r.read().decode())
        return 0
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    engine = SearchEngine(spark, kind=given.kind)
    began = time.time()
    if given.folder:
        tell = (lambda done, total: print(f"\r{done}/{total} tasks", end="", file=sys.stderr)) if sys.stderr.isatty() else None
        print(f"{engine.index_folder(given.folder, given.cache, given.no_cache, tell)} chunks in {time.time() - began:.1f} s")
    if given.command == "search":
        began = time.time()
        for r in json.loads(engine.search_json(" ".join(given.query), given.top_k)):
            print(f"{r['rank']}. [{r['score']:.4f}] {r['source']} | {r['heading']}\n{r['expanded'][:500]}\n")
        print(f"{1000 * (time.time() - began):.0f} ms")
    elif given.command in ("test", "benchmark"):
        truth = evaluate.load(spark, given.questions) if given.questions else evaluate.questions(spark)
        for _ in range(1 + (given.command == "benchmark")):
            found = engine.evaluate(truth, given.top_k)
            print(f"recall {found['hits']}/{found['queries']} = {found['recall']:.1%}, {found['average_ms']:.1f} ms a query")
    else:
        server = serve(Service(engine, given.folder, given.cache), given.host, given.port, given.idle)
        print(f"http://{given.host}:{server.server_port}")
        server.serve_forever()
    return 0
