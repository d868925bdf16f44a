"""The engine object: index a folder or table, search it, save and load it, evaluate it."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import evaluate, search
from .operators.index import ChunkIndex
from .operators.score import query_frame
from .operators.search import CosineIndex
from .progress import Tell, progress
from .sources.folder import read_folder

KINDS = {"bm25": ChunkIndex, "cosine": CosineIndex}


class SearchEngine:
    """Holds immutable index tables; opening another index swaps the reference.

    kind is bm25 (words and trigrams, fused by rank) or cosine (TF-IDF, reranked).
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, kind: str = "bm25"):
        if kind not in KINDS:
            raise ValueError("kind is bm25 or cosine")
        self.spark, self.settings, self.kind = spark, settings or Settings.load(), kind
        self.index: ChunkIndex | CosineIndex | None = None

    def index_documents(self, docs: DataFrame, id_col: str = "source", text_col: str = "text", path: str | None = None, tell: Tell | None = None) -> int:
        """Builds the index of a table of documents; gives the number of chunks. tell is called with tasks done and known meanwhile."""
        with progress(self.spark, tell):
            if self.kind == "cosine":
                self.index = CosineIndex.build(docs, self.settings, id_col=id_col, text_col=text_col, path=path).warmed()
            else:
                self.index = ChunkIndex.build(docs, id_col=id_col, text_col=text_col, path=path).warmed()
            return self.health()

    def index_folder(self, folder: str, cache: str | None = None, no_cache: bool = False, tell: Tell | None = None) -> int:
        """Opens the index kept under ``cache`` if there is one, else reads the folder and keeps it there."""
        if cache and not no_cache:
            try:
                self.load(cache)
                return self.health()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return self.index_documents(read_folder(self.spark, folder), path=cache, tell=tell)

    def add(self, text: str, source: str, page: int = 0) -> int:
        """Adds one text to a bm25 index; gives the number of its chunks. A cosine index is built as a whole."""
        if self.kind != "bm25":
            raise RuntimeError("a cosine index is built as a whole")
        docs = self.spark.createDataFrame([(source, text)], "source string, text string")
        more = ChunkIndex.build(docs, page=page, id_col="source")
        self.index = more if self.index is None else self.index.union(more)
        return more.chunks.count()

    def save(self, path: str) -> None:
        self._opened().save(path)

    def load(self, path: str) -> None:
        self.index = KINDS[self.kind].load(self.spark, path).warmed()

    def forget(self) -> None:
        """Lets go of an index; what is kept of it in memory is freed. Searches that still run read its tables."""
        if self.index is not None:
            for t in self.index.TABLES:
                getattr(self.index, t).unpersist()
        self.index = None

    def _opened(self) -> ChunkIndex | CosineIndex:
        if self.index is None:
            raise RuntimeError("nothing is indexed yet")
        return self.index

    def health(self) -> int:
        return self._opened().chunks.count()

    def stats(self) -> dict[str, int]:
        return self._opened().stats().first().asDict()

    def _answers(self, rows: list[tuple[int, str]], top_k: int) -> DataFrame:
        index, asked = self._opened(), query_frame(self.spark, rows)
        if self.kind == "cosine":
            return search.cosine_search(index, asked, top_k, self.settings)
        return search.bm25_search(index, asked, top_k)

    def search(self, queries: str | Sequence[str], top_k: int = 10) -> DataFrame:
        """Result rows of one query or many, in one job."""
        asked = [queries] if isinstance(queries, str) else list(queries)
        return self._answers(list(enumerate(asked)), top_k)

    def search_json(self, query: str, top_k: int = 10) -> str:
        found = search.as_json(self.search(query, top_k)).first()
        return found["results"] if found else "[]"

    def evaluate(self, truth: DataFrame, top_k: int = 10) -> dict[str, float]:
        """Hits, queries, recall and the average milliseconds per query."""
        rows = truth.select("qid", "query").collect()
        began = time.time()
        results = self._answers([(r["qid"], r["query"]) for r in rows], top_k)
        found = evaluate.recall(evaluate.hits(truth, results)).first().asDict()
        return found | {"average_ms": 1000 * (time.time() - began) / max(1, len(rows))}

    def chunks_per_source(self) -> DataFrame:
        return self._opened().chunks.groupBy(F.col("doc_id").cast("string").alias("source")).count()
