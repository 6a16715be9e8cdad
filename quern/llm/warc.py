"""WARC archives: a writer for page tables and a Python data source that reads them.

Writer: one record a page, each a gzip member of its own whose ``sl`` extra field (the
skip lengths of the WARC gzip annex) holds its compressed and uncompressed length. Of
pages with equal payloads of ``least`` bytes or more, that with the smallest id is the
response and the others are revisits that refer to it.

Reader: partitions are planned from the files; predicates on record type, target URI,
digest and record id are pushed down; headers are parsed first, and a record that is not
wanted is skipped by its length without inflating its payload.

Edge cases: a null html is an empty payload; a null url has no WARC-Target-URI; a null
page id has no page header and reads back as null (and is never the response of a group
that has an id; where all ids of a group are null, all are responses); repeated rows with
the least id are all responses; a payload of any length is one record; an empty table gives
no archive and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from .common import new_dir

#: Payloads under so many bytes are stored again rather than referred to.
LEAST = 100
#: Parts into which the pages of a repeated digest are dealt.
SALTS = 16

SCHEMA = (
    "record_type string, record_id string, date string, target_uri string, payload_digest string, refers_to string, "
    "headers map<string,string>, payload binary"
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "date", "target_uri", "payload_digest", "refers_to")]
    + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
_FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
_BLOCK = 1 << 20


# ---------------------------------------------------------------- files


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _open(path: str, mode: str):
    if (local := _local(path)) is not None:
        return open(local, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if "r" in mode else store.open_output_stream(inner)


def _publish(part: str, path: str) -> None:
    if (local := _local(path)) is not None:
        os.replace(_local(part), local)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.move(fs.FileSystem.from_uri(part)[1], inner)


def _files(path: str) -> list[tuple[str, int]]:
    if (local := _local(path)) is not None:
        if os.path.isfile(local):
            return [(local, os.path.getsize(local))]
        found = sorted(e.path for e in os.scandir(local) if e.name.endswith((".warc", ".warc.gz"))) if os.path.isdir(local) else []
        return [(p, os.path.getsize(p)) for p in found]
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [(prefix + i.path, i.size) for i in store.get_file_info(fs.FileSelector(inner)) if i.path.endswith((".warc", ".warc.gz"))]


# ---------------------------------------------------------------- records


def _line(value: str) -> str:
    return " ".join(value.splitlines()) if value else ""


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n{}\r\n\r\n".format("\r\n".join(lines)).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with an ``sl`` extra field: its own length and that of ``data``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff"
    total = len(head) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last] = value.strip()
    return out


class _Bytes:
    """A file read forward in blocks, in which what is not wanted is passed over."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.buf = file, size, 0, b""

    def need(self, n: int) -> bytes:
        while len(self.buf) < n and (more := self.file.read(max(_BLOCK, n - len(self.buf)))):
            self.buf += more
        return self.buf

    def skip(self, n: int) -> None:
        if n <= len(self.buf):
            self.buf = self.buf[n:]
        else:
            self.file.seek(self.at + n)
            self.buf = b""
        self.at += n


def records(file, size: int, wanted, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records for which ``wanted(headers)``, plain or gzipped by record."""
    data = _Bytes(file, size)
    while data.at < size:
        start = data.need(24)
        if not start:
            return
        if start[:2] == b"\x1f\x8b":
            yield from _gzipped(data, wanted, payload)
        elif start[:5] == b"WARC/":
            n = 4096
            while (end := data.need(n).find(b"\r\n\r\n")) < 0:
                if len(data.buf) < n:
                    raise ValueError(f"WARC header without end at byte {data.at}")
                n *= 4
            headers = parse_headers(data.buf[:end])
            length = int(headers.get("Content-Length", 0))
            if wanted(headers):
                block = data.need(end + 4 + length)[end + 4 : end + 4 + length] if payload else None
                yield headers, None if block is None else _payload(headers, block)
            data.skip(end + 4 + length + 4)
        elif start[:1] in b"\r\n":
            data.skip(1)
        else:
            raise ValueError(f"neither a WARC record nor a gzip member at byte {data.at}")


def _gzipped(data: _Bytes, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    start, total = data.buf, 0
    if start[3] & 4 and start[12:14] == b"sl":
        total = struct.unpack("<I", start[16:20])[0]
    inflate, out, used = zlib.decompressobj(31), b"", 0
    raw = data.need(total) if total and total <= _BLOCK else data.need(_BLOCK)
    feed = raw[: total or None]
    while (end := out.find(b"\r\n\r\n")) < 0 and not inflate.eof:
        out += inflate.decompress(feed, 4096)
        feed = inflate.unconsumed_tail
        if not feed and not inflate.eof:
            used = len(data.buf)
            feed = data.need(used + _BLOCK)[used:]
            if not feed:
                raise ValueError(f"gzip member without end at byte {data.at}")
    headers = parse_headers(out[:end])
    take = wanted(headers)
    if take or not total:  # without its length, a member's end is only found by inflating it
        parts = [out]
        while not inflate.eof:
            parts.append(inflate.decompress(feed))
            feed = b""
            if not inflate.eof:
                have = len(data.buf)
                feed = data.need(have + _BLOCK)[have:]
                if not feed:
                    raise ValueError(f"gzip member without end at byte {data.at}")
        if take:
            block = b"".join(parts)[end + 4 :][: int(headers.get("Content-Length", 0))]
            yield headers, _payload(headers, block) if payload else None
        if not total:
            total = len(data.buf) - len(inflate.unused_data) if inflate.unused_data or inflate.eof else len(data.buf)
    data.skip(total)


def _payload(headers: dict[str, str], block: bytes) -> bytes | None:
    if headers.get("WARC-Type") == "revisit":
        return None
    if headers.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


# ---------------------------------------------------------------- data source


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        super().__init__((path, size))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in _FIELDS and isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif name in _FIELDS and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name in _FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self):
        return [_File(*f) for f in _files(self.path)] or [_File("", 0)]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            got = _field(headers, name)
            if got is None or (got not in value if kind == "in" else not got.startswith(value)):
                return False
        return True

    def read(self, partition):
        path, size = partition.value
        rows: list[tuple] = []
        held = 0
        if not path:
            return
        with _open(path, "rb") as file:
            for headers, payload in records(file, size, self._wanted, self.payload):
                rows.append((*(_field(headers, n) for n in _FIELDS), list(headers.items()), payload))
                held += len(payload or b"")
                if len(rows) >= 2000 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _field(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(_FIELDS[name])
    return value.removeprefix("sha256:") if value and name == "payload_digest" else value


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload=false`` reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# ---------------------------------------------------------------- writing


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, kind and refers_to of every page.

    Which pages are revisits is found from ids and digests alone. Repeated digests are dealt
    to ``SALTS`` tasks each, so a page that a third of the rows repeat is no hot key; payloads
    are dealt by page, not by digest.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt")
    keys = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"), salt).where(F.col("bytes") >= least)
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    again = keys.join(groups, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first").distinct()
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    return rows.select("page_id", "url", "html", "digest", F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("kind"), F.col("first").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives under ``path``, one a task, and returns (file, records) of each.

    A task writes beside its archive and then moves it in place, so a repeated task
    leaves one whole archive.
    """
    if (local := _local(path)) is not None:
        os.makedirs(local, exist_ok=True)

    def write(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        name, file, n = f"{path}/part-{k:06d}.warc.gz", None, 0
        part = f"{path}/.part-{k:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                file = file or _open(part, "wb")
                file.write(member(record(kind, page_id, url, html.encode(), digest, refers_to, date)))
                n += 1
        if file:
            file.close()
            _publish(part, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return plan_records(pages, least).mapInArrow(write, "file string, records long")


def warc_round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes every page to archives, reads them back and describes each record."""
    path = path or new_dir(spark, "warc")
    done = write_warc(pages, path).agg(F.sum("records")).first()[0] or 0
    kind = pages.schema["page_id"].dataType
    page = F.col("headers")["X-Page-ID"].cast(kind).alias("page_id")
    # both predicates are pushed into the source: revisits by their headers, and payloads of responses only
    full = read_warc(spark, path).where("record_type = 'response'")
    full = full.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    refs = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    origin = F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1).cast(kind).alias("refers_to")
    refs = refs.select(page, F.col("headers")["X-Payload-Length"].cast("long").alias("payload_bytes"), "payload_digest", "record_type", origin)
    out = full.unionByName(refs)
    return out if done else out.limit(0)


def digest_of(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
