"""WARC archives as a Python data source: a writer of one gzip member per record, and a reader that reads headers first."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import materialize, prepare

_PAGE = "urn:quillspark:page:"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BLANKS = dict.fromkeys([*range(0x21), 0x7F], "%20")
#: Bytes of the head of a gzip member with one extra field of two lengths.
_HEAD = 24
#: Archives are read and inflated by pieces of so many bytes.
_PIECE, _INFLATED = 1 << 14, 1 << 18
_SHORT = "a record ends before its Content-Length"
#: Columns that come from headers alone, with the header of each.
HEADER_COLUMNS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_SCHEMA = ", ".join(f"{c} string" for c in HEADER_COLUMNS) + ", content_length long, headers map<string,string>, payload_bytes long, payload_sha1 string, payload binary"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: each five digits are four characters."""
    out = []
    for i in range(8):
        five = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type and refers_to of each page.

    Of pages with equal payloads (by SHA-256 and length) of at least ``min_bytes`` bytes the
    largest id is the response and the others revisit it; smaller payloads are all responses.

    Digests of the rows are written once, with the scan partition (run) of each. A digest that
    fills a third of the table is one row per run before it moves, and the response's id goes
    back to the runs, so no task holds more of one digest than a run has. Payloads move once,
    dealt by digest and id, to be held against the responses' ids: copies of one payload
    under many ids never meet.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    key, same = ["key", "payload_bytes"], [F.unhex(F.sha2("payload", 256)).alias("key"), F.octet_length("payload").cast("long").alias("payload_bytes")]
    digest = base32_of_hex(F.sha1("payload")).alias("payload_digest")
    runs = materialize(source.select("page_id", "url", *same, digest, F.spark_partition_id().alias("run")), "page-digests")
    leaves = runs.groupBy(*key, "run").agg(F.max("page_id").alias("first_id"))
    winners = leaves.groupBy(*key).agg(F.max("first_id").alias("first_id"))

    typed = runs.join(leaves.select(*key, "run").join(winners, key), [*key, "run"])
    revisits = typed.where((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    keyed = source.select("*", *same)
    first = winners.select(F.col("key").alias("k"), F.col("payload_bytes").alias("b"), "first_id")
    responses = keyed.join(first, (F.col("key") == F.col("k")) & (F.col("payload_bytes") == F.col("b")) & F.col("page_id").eqNullSafe(F.col("first_id")), "left_semi")
    if min_bytes > 0:
        responses = responses.where(F.col("payload_bytes") >= min_bytes).unionByName(keyed.where(F.col("payload_bytes") < min_bytes))
    return responses.select("page_id", "url", "payload", "payload_bytes", digest, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "url", F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to"))
    )


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """data as a gzip member that tells its own compressed and plain length in the extra field ``sl``, so that readers can pass over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    whole = _HEAD + len(body) + 8
    if max(whole, len(data)) >> 32:
        raise ValueError("a record exceeds 4 GB")
    lengths = whole.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return b"".join((b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0", lengths, body, zlib.crc32(data).to_bytes(4, "little"), len(data).to_bytes(4, "little")))


def _record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """A WARC 1.1 record. White space and control characters in a URL are written as %20; a null URL has no header."""
    urn = lambda x: f"<{_PAGE}{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.translate(_BLANKS))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "\r\n"]
    return b"".join(("\r\n".join(head).encode("utf-8", "surrogatepass"), http, payload, b"\r\n\r\n"))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Every task writes archives of its own under _temporary; those of the tasks that count are moved at the end, the rest vanish."""

    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.most, self.level = int(options.get("archivebytes", 1 << 30)), int(options.get("level", 6))
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _file_system(self.path)
        system.create_dir(f"{root}/{self.job}", recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                payloads = batch.column("payload").cast(pa.large_binary())
                heads = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")), strict=True)
                for i, (page_id, url, n, digest, kind, refers_to) in enumerate(heads):
                    member = gzip_member(_record(page_id, url, payloads[i].as_py() or b"", n, digest, kind, refers_to, self.date), self.level)
                    if out is not None and size + len(member) > self.most:
                        out.close()
                        out = None
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{root}/{self.job}/{names[-1]}", compression=None), 0
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _file_system(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 1 << 30, level: int = 6) -> None:
    """Adds the rows of deduplicated() to path as WARC 1.1 records, a gzip member each, in archives of ``archive_bytes`` at most (of one record at least).

    A task that is run again writes new files; only files of tasks that count are kept.
    """
    spark = records.sparkSession
    prepare(spark)
    spark.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").option("date", date).option("archiveBytes", str(archive_bytes)).option("level", str(level)).save(path)


class Files(InputPartition):
    """Archives by (path, begin, end, size): a reader takes the members that begin in that range; end is None for all."""

    def __init__(self, ranges: list[tuple[str, int, int | None, int]]):
        super().__init__(ranges)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Plain:
    """The bytes of a plain archive."""

    def __init__(self, raw):
        self.stream = io.BufferedReader(raw, 1 << 20)
        self.readline = self.stream.readline

    def read(self, n: int) -> bytes:
        return self.stream.read(n)

    def skip(self, n: int) -> None:
        self.stream.seek(n, 1)


def _lengths(raw, at: int) -> tuple[int, int] | None:
    """Compressed and plain length of the gzip member at this place, if its extra field ``sl`` tells them."""
    raw.seek(at)
    head = raw.read(_HEAD)
    if len(head) < _HEAD or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    n = int.from_bytes(head[10:12], "little")
    extra = head[12 : 12 + n] + (raw.read(n - _HEAD + 12) if n > _HEAD - 12 else b"")
    while len(extra) >= 4:
        size = int.from_bytes(extra[2:4], "little")
        if extra[:2] == b"sl" and size == 8 and len(extra) >= 12:
            found = int.from_bytes(extra[4:8], "little"), int.from_bytes(extra[8:12], "little")
            return found if found[0] >= _HEAD else None
        extra = extra[4 + size :]
    return None


def _between(raw, size: int, begin: int, end: int) -> tuple[int, int] | None:
    """The first member that begins in a range, and the first beyond it, by the members' own lengths; None unless these lead from the archive's start to its end."""
    at, first, stop = 0, size, size
    while at < size:
        if at >= begin:
            first = min(first, at)
        if at >= end:
            stop = min(stop, at)
        if (found := _lengths(raw, at)) is None:
            return None
        at += found[0]
    return (first, stop) if at == size else None


class _Gzip:
    """The plain bytes of gzip members from one place to another, inflated piece by piece; members that tell their length are passed over without that."""

    def __init__(self, raw, at: int, end: int):
        self.raw, self.at, self.end = raw, at, end  # at: where the next member begins, once one is over
        self.buffer, self.place = b"", 0
        self.unpacker, self.rest, self.left, self.next = None, b"", None, at

    def _fill(self) -> bool:
        """More plain bytes; False at the end."""
        while True:
            if self.unpacker is None:
                if self.at >= self.end:
                    return False
                lengths = _lengths(self.raw, self.at)
                self.left, self.next = (lengths[1], self.at + lengths[0]) if lengths else (None, None)
                self.raw.seek(self.at)
                self.unpacker, self.rest = zlib.decompressobj(31), b""
            packed = self.rest or self.raw.read(_PIECE)
            if not packed:
                raise ValueError("a gzip member ends before its end")
            more = self.unpacker.decompress(packed, _INFLATED)
            self.rest = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.at = self.raw.tell() - len(self.unpacker.unused_data)
                self.unpacker = None
            if self.left is not None:
                self.left -= len(more)
            if more:
                self.buffer, self.place = self.buffer[self.place :] + more, 0
                return True

    def read(self, n: int) -> bytes:
        """n bytes, fewer at the end."""
        out, wanted = [], n
        while wanted and (self.place < len(self.buffer) or self._fill()):
            out.append(self.buffer[self.place : self.place + wanted])
            self.place += len(out[-1])
            wanted -= len(out[-1])
        return b"".join(out)

    def readline(self) -> bytes:
        scanned = self.place
        while (at := self.buffer.find(b"\n", scanned)) < 0:
            unread = len(self.buffer) - self.place
            if not self._fill():
                at = len(self.buffer) - 1
                break
            scanned = unread
        line = self.buffer[self.place : at + 1]
        self.place = at + 1
        return line

    def skip(self, n: int) -> None:
        while n > 0:
            here = len(self.buffer) - self.place
            if here >= n:
                self.place += n
                return
            n -= here
            self.buffer, self.place = b"", 0
            if self.unpacker is not None and self.left is not None and self.left - n <= 4:  # what else it has is the end of the record
                n -= min(n, self.left)
                self.at, self.unpacker = self.next, None
            elif not self._fill():
                raise ValueError(_SHORT)


def _headers(stream) -> dict[str, str] | None:
    """Headers of the next record with names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    found: dict[str, str] = {}
    last = None
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a folded header
            found[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


class WarcReader(DataSourceReader):
    """Plans archives into partitions by size; passes over the block of each record whose headers don't meet the filters."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("maxpartitionbytes", 32 << 20))
        self.payload = options.get("payload", "bytes")
        if self.payload not in ("bytes", "digest", "none"):
            raise ValueError("payload is bytes, digest or none")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x for x in found if x.is_file and x.size and x.base_name[0] not in "._"), key=lambda x: (-x.size, x.path))
        out: list[list[tuple]] = []
        held = self.most + 1
        for x in files:
            if x.size > self.most and x.base_name.endswith(".gz"):
                out += [[(x.path, at, at + self.most, x.size)] for at in range(0, x.size, self.most)]
                continue
            if held + x.size > self.most:
                out.append([])
                held = 0
            out[-1].append((x.path, 0, None, x.size))
            held += x.size
        return [Files(x) for x in out] or [Files([])]

    def _wanted(self, row: dict[str, str | None]) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, In):
                good = value in f.value
            elif isinstance(f, EqualTo):
                good = value == f.value
            elif isinstance(f, IsNotNull):
                good = True
            elif isinstance(f, StringStartsWith):
                good = value.startswith(f.value)
            elif isinstance(f, StringEndsWith):
                good = value.endswith(f.value)
            else:
                good = f.value in value
            if not good:
                return False
        return True

    def _digest(self, stream, length: int, http: bool) -> tuple[int, str]:
        """Length and SHA-1 of a payload, which is never held as a whole."""
        found, size, head = hashlib.sha1(), 0, b""
        while length:
            piece = stream.read(min(length, _INFLATED))
            if not piece:
                raise ValueError(_SHORT)
            length -= len(piece)
            if http:
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                piece, head, http = head[at + 4 :], b"", False
            found.update(piece)
            size += len(piece)
        return size, base64.b32encode(found.digest()).decode()

    def _records(self, stream) -> Iterator[tuple]:
        while (headers := _headers(stream)) is not None:
            length = int(headers["content-length"])
            row = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()}
            if not self._wanted(row):
                stream.skip(length)
                continue
            payload = digest = size = None
            http = (row["content_type"] or "").startswith("application/http")
            if self.payload == "none" or row["warc_type"] == "revisit":
                stream.skip(length)
            elif self.payload == "digest":
                size, digest = self._digest(stream, length, http)
            else:
                payload = stream.read(length)
                if len(payload) != length:
                    raise ValueError(_SHORT)
                if http:
                    payload = payload.partition(b"\r\n\r\n")[2]
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            yield (*row.values(), length, headers, size, digest, payload)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, begin, end, size in partition.value:
            with _file_system(self.path)[0].open_input_file(path) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                if not packed:
                    if begin == 0:
                        yield from self._records(_Plain(raw))
                    continue
                own = None if end is None else _between(raw, size, begin, end)
                if own is None and begin == 0:  # one that can't be cut is read by the task of its beginning
                    own = 0, size
                if own is not None:
                    yield from self._records(_Gzip(raw, *own))


class WarcDataSource(DataSource):
    """spark.read.format("warc"): options path, payload (bytes, digest or none) and maxPartitionBytes.

    Filters on the columns of HEADER_COLUMNS are pushed down; records that fail them are
    passed over without decoding: by their Content-Length in plain archives, and by the
    compressed length that a gzip member tells of itself; without one, they are inflated.
    payload=digest hands on length and SHA-1 only, payload=none reads headers alone. Archives
    may be plain or gzipped, in one or many members. Gzipped ones beyond maxPartitionBytes
    are shared by several tasks if all their members tell their lengths.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added")
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return spark.read.format("warc").option("payload", payload).option("maxPartitionBytes", str(most)).load(path)


def page_id(urn: Column) -> Column:
    """The id in a record id that write_archives() made; null for one without."""
    return F.regexp_extract(urn, rf"^<{_PAGE}(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages to archives under path and reads them again: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Length and digest of responses are those of the payload read back, those of revisits
    stand in their headers. A null page id stays null and never wins over another; rows that
    repeat the largest id of their payload are all responses. Null html is an empty payload.
    An empty table gives no rows.
    """
    write_archives(deduplicated(pages), path)
    records = read_archives(pages.sparkSession, path, payload="digest")
    return records.select(
        page_id(F.col("record_id")).alias("page_id"),
        F.coalesce("payload_bytes", F.try_element_at("headers", F.lit("payload-length")).cast("long")).alias("payload_bytes"),
        F.coalesce("payload_sha1", F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page_id(F.col("refers_to")).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
