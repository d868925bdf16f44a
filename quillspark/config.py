"""Tunables of the search engines."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

# Fixed values, on which results depend: words left out of the lexical field, and terms of the finance boosts.
STOPWORDS = (
    "berapa", "siapa", "apa", "bagaimana", "kapan", "mengapa", "mana", "tolong", "jelaskan", "sebutkan", "tunjukkan", "berikan",
    "what", "how", "who", "whom", "whose", "which", "when", "where", "why", "is", "are", "do", "does", "did", "the", "a", "an",
    "ne", "kadar", "kim", "hangi", "nedir", "nasil", "kac", "quoi", "quel", "quelle", "est", "sont", "qing", "shenme",
)
FINANCE_TERMS = (
    "revenue", "income", "pendapatan", "profit", "laba", "assets", "aset", "liabilitas", "utang", "equity", "ekuitas", "modal", "dividen", "dividend",
    "arus", "kas", "cash", "penjualan", "sales", "beban", "cost", "expense", "tax", "pajak", "emas", "gold", "nikel", "nickel", "bauksit", "bauxite",
)
TREE_FINANCE_TERMS = ("revenue", "pendapatan")


@dataclass(frozen=True)
class Chunking:
    """Sizes in UTF-8 bytes."""

    target: int
    overlap: int
    least: int
    hard: int


@dataclass(frozen=True)
class Settings:
    """Chunk sizes and weights of the cosine engine (fixed values unless a file gives others); the field names are those of its JSON file."""

    chunk_chars: int = 4800
    chunk_overlap: int = 400
    min_chunk: int = 100
    hard_split: int = 7200
    embedding_dim: int = 384
    top_k_candidates: int = 200
    top_k_results: int = 10
    rerank_weight: float = 0.6
    financial_boost: float = 0.3

    @property
    def chunking(self) -> Chunking:
        return Chunking(self.chunk_chars, self.chunk_overlap, self.min_chunk, self.hard_split)

    @classmethod
    def load(cls, *paths: str) -> Settings:
        """The first file that holds a complete object, else the defaults; a file with a field missing is passed over."""
        for path in paths or ("quillspark.json", "config.json"):
            try:
                with open(path, encoding="utf-8") as f:
                    found = json.load(f)
                return cls(**{x.name: type(x.default)(found[x.name]) for x in fields(cls)})
            except (OSError, ValueError, KeyError, TypeError):
                continue
        return cls()

    def to_json(self) -> str:
        return json.dumps(asdict(self))


# Fixed values, on which results depend: chunk sizes of the BM25 engine, and its constants.
SMALL_CHUNKS = Chunking(600, 140, 100, 900)
BM25_K1, BM25_B = 1.2, 0.75
WORD_WEIGHT, TRIGRAM_WEIGHT, FUSION_K = 0.72, 0.28, 60.0
NUMERIC_BOOST = 0.6
FIELD_CANDIDATES = 200
# The questions of the benchmark command, each with the words of which one has to be found.
QUESTIONS = (
    ("Berapa total uang yang dihasilkan perusahaan dari pelanggan?", ("62.714", "revenue", "pendapatan")),
    ("Pendapatan bersih PT ANTAM semester 1 2026 berapa?", ("62.714", "pendapatan")),
    ("How much money did the company earn from customer contracts?", ("62.714", "revenue", "income")),
    ("Selisih antara pendapatan dan beban pokok penjualan?", ("10.851", "laba", "gross")),
    ("Berapa keuntungan sebelum dikurangi beban operasi dan pajak?", ("10.851", "laba", "bruto")),
    ("Profit after tax berapa juta rupiah?", ("8.443", "laba", "bersih", "profit")),
    ("Seluruh nilai kekayaan yang dimiliki perusahaan berapa?", ("aset", "assets", "total")),
    ("Total kewajiban yang harus dibayar perusahaan?", ("utang", "liabilities", "kewajiban")),
    ("Bagian pemegang saham dari total aset berapa?", ("ekuitas", "equity", "modal")),
    ("Berapa bagian keuntungan yang dibagikan ke pemegang saham?", ("dividen", "dividend")),
    ("Berapa uang tunai yang dihasilkan dari kegiatan operasi?", ("arus kas", "cash flow", "operating")),
    ("Berapa jumlah emas yang diproduksi perusahaan?", ("emas", "gold", "produksi")),
    ("Produksi logam nikel berapa ton?", ("nikel", "nickel", "ton")),
    ("Siapa yang memimpin perusahaan sebagai presiden direktur?", ("direktur", "presiden", "CEO")),
    ("Apa saja produk pertambangan utama perusahaan?", ("tambang", "mining", "produksi")),
    ("Berapa beban pajak penghasilan yang harus dibayar?", ("pajak", "tax")),
    ("Berapa hak tagih dari pelanggan yang belum dibayar?", ("piutang", "receivable", "pelanggan")),
    ("Berapa stok emas yang belum dijual?", ("persediaan", "inventory", "emas")),
    ("Berapa selisih antara pendapatan dan beban pokok penjualan?", ("laba kotor", "gross profit", "selisih")),
    ("Arus kas dari kegiatan operasi berapa?", ("arus", "kas", "operasi", "cash")),
)
