"""Line dedup against exact counting in plain Python, on small fixtures and around the threshold."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from quillspark.llm import line_dedup


def plain(rows, least):
    """rows: (doc_id, text, source); the text that each row keeps, and how many lines it loses."""
    sites, lines = defaultdict(set), []
    for i, t, s in {(i, t or "", s): None for i, t, s in rows}:
        for pos, line in enumerate(t.split("\n")):
            if key := line.strip(" \t\r"):
                lines.append((key, i, t, pos))
                if s is not None:
                    sites[key].add(s)
    kept_first: dict = {}
    for key, i, _, pos in sorted(lines, key=lambda x: (x[1] is not None, x[1] or 0, x[3])):
        kept_first.setdefault(key, (i, pos))
    out = []
    for i, t, _ in rows:
        found = (t or "").split("\n")
        stay = [line for pos, line in enumerate(found) if not (key := line.strip(" \t\r")) or len(sites[key]) < least or kept_first[key] == (i, pos)]
        out.append((i, t if len(stay) == len(found) else "\n".join(stay), len(found), len(found) - len(stay)))
    return sorted(out, key=str)


def run(spark, rows, least, parts=3):
    docs = spark.createDataFrame([(*r, 7, 9, "x") for r in rows], "doc_id long, text string, source string, n_lines int, home int, line string").repartition(parts)
    got = line_dedup.line_dedup(docs, least)
    assert got.columns == ["doc_id", "text", "source", "home", "line", "n_lines", "n_removed"]
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str)


def test_small_cases(spark):
    rows = [
        (1, "shared\nown one\n\nshared", "a"),
        (2, "  shared\t\r\nown two", "b"),
        (3, "shared", "c"),
        (4, "twice\ntwice", "a"),
        (5, "twice", "b"),
        (6, None, "c"),
        (7, "", None),
        (8, "\n\n", "d"),
        (9, "Shared", "e"),
        (None, "no id, shared by many", "a"),
        (10, "no id, shared by many", "b"),
        (11, "no id, shared by many", "c"),
        (12, "shared", None),
        (13, "x" * 300_000 + "\nshared", "q"),
    ]
    assert run(spark, rows, 3) == plain(rows, 3)
    assert run(spark, rows, 2) == plain(rows, 2)


@pytest.mark.parametrize("least", [3, 40])
def test_around_the_threshold(spark, least):
    """Lines on n sites, for every n around the threshold: sketches decide the far ones, exact counts the near ones."""
    rng, rows, number = random.Random(least), [], 0
    for n in range(1, 2 * least + 2):
        for site in rng.sample(range(200), n):
            number += 1
            rows.append((number, f"line on {n} sites\nown {number}", f"site{site}"))
            if rng.random() < 0.3:
                number += 1
                rows.append((number, f"line on {n} sites", f"site{site}"))
    assert run(spark, rows, least) == plain(rows, least)


def test_repeated_rows_share_their_fate(spark):
    rows = [(1, "shared\nrest", "a")] * 2 + [(2, "shared", "b"), (3, "shared", "c")]
    assert run(spark, rows, 3) == sorted([(1, "shared\nrest", 2, 0)] * 2 + [(2, "", 1, 1), (3, "", 1, 1)], key=str)


def test_empty_table(none):
    assert line_dedup.line_dedup(none).count() == 0


def test_odd_rows(odd):
    assert line_dedup.line_dedup(odd).count() == odd.count()


def test_removal_in_proportion_to_the_lines(spark):
    """Documents of 200,000 lines, every other one shared by three sites."""
    import time

    n = 200_000
    rows = [(k, "\n".join(f"shared {i}" if i % 2 else f"own {k} {i}" for i in range(n)), f"site{k}") for k in range(3)]
    began = time.monotonic()
    got = run(spark, rows, 3)
    assert time.monotonic() - began < 40
    assert [r[2:] for r in got] == [(n, 0), (n, n // 2), (n, n // 2)]
    assert got[1][1] == "\n".join(f"own 1 {i}" for i in range(0, n, 2)) and got[0][1] == rows[0][1]
