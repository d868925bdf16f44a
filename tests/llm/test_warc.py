"""Archives: exact round trips, pushed filters, plain and compressed files, and broken ones."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, key string, record_type string"


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def expected(rows):
    best: dict = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        best[raw] = max((x for x in (best.get(raw), i) if x is not None), default=None)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = best[raw]
        out.append((i, len(raw), digest(raw), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.example/x y", "<p>one</p>"),
    (2, "http://b.example/", "<p>one</p>"),
    (2, "http://b.example/", "<p>one</p>"),
    (3, None, None),
    (4, "http://c.example/\r\nX: y", ""),
    (5, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "u", "你好 \U0001f642 \x00 \r\n\r\n"),
    (None, "u", "no id"),
    (None, "u", "<p>one</p>"),
    (7, "u", "long " * 300_000),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    got = warc.round_trip(table(spark, ROWS).repartition(3), str(tmp_path / "w"))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected(ROWS)
    urls = {r["page_id"]: r["url"] for r in got.collect()}
    assert urls[1] == "http://a.example/x%20y" and urls[3] is None and urls[4] == "http://c.example/%20%20X:%20y"


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(table(spark, []), str(tmp_path / "w")).count() == 0


def test_small_payloads_are_never_revisits(spark):
    got = warc.deduplicated(table(spark, ROWS), min_bytes=11)
    assert {r["record_type"] for r in got.where("payload_bytes < 11").collect()} == {"response"}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "w")
    warc.write_archives(warc.deduplicated(table(spark, ROWS)), path)
    return path


def test_filters_reach_the_headers(spark, archive):
    found = warc.read_archives(spark, archive).where((F.col("warc_type") == "revisit") & F.col("target_uri").startswith("http://"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert sorted(warc_id for (warc_id,) in found.select(warc.page_id(F.col("record_id"))).collect()) == [1]
    reader = warc.WarcReader({"path": archive})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringEndsWith, StringStartsWith

    kept = [EqualTo(("payload_bytes",), 3), GreaterThan(("target_uri",), "a")]
    assert list(reader.pushFilters([EqualTo(("warc_type",), "response"), In(("target_uri",), ("u", "v")), *kept])) == kept
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(got) == 4 and {r[0] for r in got} == {"response"}
    for f, n in ((StringStartsWith(("target_uri",), "http://b"), 2), (StringEndsWith(("target_uri",), ".example/"), 2), (StringContains(("target_uri",), "c.ex"), 1)):
        reader = warc.WarcReader({"path": archive})
        assert list(reader.pushFilters([f])) == []
        assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == n


def test_payload_modes(spark, archive):
    whole = {r["record_id"]: r for r in warc.read_archives(spark, archive).where("warc_type = 'response'").collect()}
    brief = {r["record_id"]: r for r in warc.read_archives(spark, archive, "digest").where("warc_type = 'response'").collect()}
    bare = warc.read_archives(spark, archive, "none").where("warc_type = 'response'").collect()
    for k, r in whole.items():
        assert digest(bytes(r["payload"])) == r["payload_sha1"] == brief[k]["payload_sha1"] and len(r["payload"]) == r["payload_bytes"]
        assert brief[k]["payload"] is None
    assert {r["payload"] for r in bare} == {r["payload_sha1"] for r in bare} == {None}
    with pytest.raises(ValueError):
        warc.WarcReader({"path": archive, "payload": "some"})


RECORD = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nX-Folded: one\r\n two\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody"
    first = RECORD % (b"warcinfo", 1, 4, b"info")
    second = (RECORD % (b"response", 2, len(http), http)).replace(b"X-Folded", b"Content-Type: application/http; msgtype=response\r\nX-Folded")
    (tmp_path / "plain.warc").write_bytes(first + second)
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(second))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["warc_type"], bytes(r["payload"])) for r in got) == [("response", b"body")] * 2 + [("warcinfo", b"info")] * 2
    assert {r["headers"]["x-folded"] for r in got} == {"one two"}
    small = warc.WarcReader({"path": str(tmp_path), "maxpartitionbytes": "1"})
    assert sorted(p.value[0][0].rpartition("/")[2] for p in small.partitions() if p.value[0][1] == 0) == ["members.warc.gz", "plain.warc"]
    assert sorted(r[0] for p in small.partitions() for r in small.read(p)) == ["response", "response", "warcinfo", "warcinfo"]  # no member tells its length, so one task reads all


def test_broken_archives(tmp_path):
    (tmp_path / "cut.warc").write_bytes((RECORD % (b"response", 2, 400, b"short"))[:-4])
    (tmp_path / "other").mkdir()
    (tmp_path / "other/no.warc").write_bytes(b"hello\r\n\r\n")
    for path, said in ((tmp_path / "cut.warc", "Content-Length"), (tmp_path / "other", "no WARC record")):
        reader = warc.WarcReader({"path": str(path)})
        with pytest.raises(ValueError, match=said):
            list(reader.read(reader.partitions()[0]))


def test_members_tell_their_length(spark, archive):
    """Records that filters or the payload mode pass over are not inflated, and large archives are shared by member."""
    for x in archive_files(archive):
        raw = x.read_bytes()
        assert gzip.decompress(raw).startswith(b"WARC/1.1")
        at = 0
        with x.open("rb") as f:
            while at < len(raw):
                packed, plain = warc._lengths(f, at)
                assert len(gzip.decompress(raw[at : at + packed])) == plain
                at += packed
        assert at == len(raw)
    want = sorted(rows_of(warc.WarcReader({"path": archive})), key=str)
    assert len(want) == len(ROWS)
    for most in (1, 24, 300, 5000):
        reader = warc.WarcReader({"path": archive, "maxpartitionbytes": str(most)})
        assert sorted(rows_of(reader), key=str) == want
    assert max(len(warc.WarcReader({"path": archive, "maxpartitionbytes": "300"}).partitions()), 0) > len(archive_files(archive))


def archive_files(path):
    from pathlib import Path

    return sorted(Path(path).glob("*.warc.gz"))


def rows_of(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_skipped_payloads_are_not_inflated(tmp_path, monkeypatch):
    import os

    payload = os.urandom(3 << 20).hex().encode()
    records = [warc._record(i, "u", payload, len(payload), "x", "response", None, "d") for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.gzip_member, records)))
    inflated = []
    fill = warc._Gzip._fill

    def counting(self):
        found = fill(self)
        inflated.append(len(self.buffer) - self.place if found else 0)
        return found

    monkeypatch.setattr(warc._Gzip, "_fill", counting)
    assert len(rows_of(warc.WarcReader({"path": str(tmp_path), "payload": "none"}))) == 3
    assert sum(inflated) < 3 * len(payload) / 10
    whole = rows_of(warc.WarcReader({"path": str(tmp_path), "payload": "digest"}))
    assert {(r[-3], r[-2]) for r in whole} == {(len(payload), digest(payload))}


def test_an_archive_within_a_payload(tmp_path):
    """A member that holds an archive, stored as it is, doesn't mislead the cut."""
    inner = b"".join(warc.gzip_member(warc._record(i, "inner", b"x" * 50, 50, "x", "response", None, "d")) for i in range(20))
    outer = [warc._record(i, "outer", p, len(p), "x", "response", None, "d") for i, p in enumerate((b"a", inner, b"c"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.gzip_member(x, 0) for x in outer))
    for most in (100, 700):
        assert [r[2] for r in rows_of(warc.WarcReader({"path": str(tmp_path), "maxpartitionbytes": str(most)}))] == ["outer"] * 3


def test_archives_are_added_and_of_bounded_size(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(warc.deduplicated(table(spark, ROWS).coalesce(1)), path, archive_bytes=2000)
    first = archive_files(path)
    assert len(first) > 1 and not [x for x in (tmp_path / "w").iterdir() if x.is_dir()]
    warc.write_archives(warc.deduplicated(table(spark, ROWS[:1])), path)
    assert len(archive_files(path)) == len(first) + 1
    assert warc.read_archives(spark, path).count() == len(ROWS) + 1


def test_payloads_of_one_digest_never_meet(spark):
    """Only rows with the same id join a payload's digest, and no exchange of the digests holds payloads."""
    plan = warc.deduplicated(table(spark, ROWS))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "LeftSemi" in x]
    assert len(joins) == 1 and "page_id" in joins[0] and "first_id" in joins[0]
