"""Queries and small inline tables for cases that the driver's tables lack."""

from __future__ import annotations

from ..config import FINANCE_TERMS

QUERIES = [(1, "this from with that the thing"), (2, "Und der nicht auf sich wird"), (3, "avec dans pour les des"), (4, "tion thest 62.714 revenue this")]
#: The language of the documents that are judged for a query.
JUDGED = [(1, "en"), (2, "de"), (3, "fr"), (4, "en")]
#: Finance terms, and strings that the corpus has.
TERMS = (*FINANCE_TERMS, "ention", "ungen")
CJK_WORDS = ["黄金", "黄金价格", "né", "néon", "ab", "a漢b", "漢", "plain"]
TRUTH = ["1. What this from is? -> this, from", "2. Und der nicht auf -> nicht, zzzz", "3. revenue and 62.714 -> 62.714,", "no arrow here", "4. avec dans -> qqqq, AVEC "]
_LONG = "Some plain words that stand below their heading and go on for long enough to be kept as a paragraph of their own, with a second clause. "
OUTLINES = [
    (-1, "Chapter 1 Intro\n1. Background text\n1.1 Detail\n" + _LONG + "\n" + _LONG + "\n2. Further matter\nshort\nChapter 2 More revenue\n" + _LONG),
    (-2, _LONG + "\nBAB I Pendahuluan\n\n  3. Latar belakang \r\n" + _LONG + "\n2024. 12 x\nBagian akhir\n" + _LONG + "this from with that"),
    (-3, "\n\n"),
]
