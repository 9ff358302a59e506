"""WARC archives as a Spark data source, and revisit records for equal payloads.

Files hold one gzip member per record (.warc.gz) or plain records (.warc). A member that this module writes carries its
length in its header (the `sl` field of the WARC convention for gzip), so that a reader goes on to the next record without
inflating payloads; members of other writers are inflated to their end, piece by piece. Reading plans byte ranges of
`partition_bytes`: small files share a partition, and a large .warc.gz has several, each of which reads the records that
begin in it, found by a member's first bytes. Plain records don't tell where they begin, so a .warc is one partition, read
record by record. In a partition, each record's headers are read and parsed first; pushed-down predicates on them (record
type, URI, digest and so on) decide before anything else is inflated, and payloads are only decoded where the `payload`
option asks for them. A task holds CHUNK bytes of a file and the payloads of one batch.

Paths may be plain, file:, or any URI that pyarrow's file systems open.
"""

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from corvane.llm.common import local_path, settle

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
FILE_BYTES = 256 << 20
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
#: So much of a member is inflated at a time while its headers are read.
HEAD = 2048
#: Bytes of a file that a task holds, and that it inflates at a time.
CHUNK, FEED = 1 << 20, 16 << 10
_MEMBER = b"\x1f\x8b\x08"

_FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest", "payload_bytes": "warc-payload-bytes",
}


def _file_system(uri: str):
    """A pyarrow file system and the path on it."""
    from pyarrow import fs

    plain = local_path(uri)
    return (fs.LocalFileSystem(), plain) if plain else fs.FileSystem.from_uri(uri)


def _clean(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def member(record: dict) -> bytes:
    """The gzip member of one record."""
    payload = record["payload"] if record["record_type"] != "revisit" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(record['payload'] or b'')}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {_clean(record['record_type'])}", f"WARC-Record-ID: <{_clean(record['record_id'])}>", f"WARC-Date: {_clean(record['warc_date'])}"]
    if record["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(record['target_uri'])}")
    if record["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{_clean(record['refers_to'])}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{record['payload_digest']}", f"WARC-Payload-Bytes: {record['payload_bytes']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + http + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 24 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _value(name: str, headers: dict[str, str]):
    found = headers.get(_FIELDS[name])
    if found is None:
        return None
    if name == "payload_bytes":
        return int(found)
    if name == "payload_digest":
        return found.removeprefix("sha256:")
    return found[1:-1] if name in ("record_id", "refers_to") and found[:1] == "<" else found


def _predicate(f: Filter) -> Callable[[dict[str, str]], bool] | None:
    """The filter over a record's headers; None if it isn't one of those known here."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, (EqualTo, In)) and (of := _predicate(inner)):
            name = inner.attribute[0]
            return lambda h: _value(name, h) is not None and not of(h)
        return None
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in _FIELDS:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda h: _value(name, h) is None
    if isinstance(f, IsNotNull):
        return lambda h: _value(name, h) is not None
    want = f.value
    if isinstance(f, EqualNullSafe):
        return lambda h: _value(name, h) == want
    tests = {
        EqualTo: lambda v: v == want, In: lambda v: v in want, StringStartsWith: lambda v: v.startswith(want), StringEndsWith: lambda v: v.endswith(want), StringContains: lambda v: want in v,
        GreaterThan: lambda v: v > want, GreaterThanOrEqual: lambda v: v >= want, LessThan: lambda v: v < want, LessThanOrEqual: lambda v: v <= want,
    }
    test = tests.get(type(f))
    return test and (lambda h: (v := _value(name, h)) is not None and test(v))


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Window:
    """Bytes of a file by their place; the last chunk read is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.first, self.held = file, size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on; fewer at the file's end."""
        n = max(0, min(n, self.size - at))
        if at < self.first or at + n > self.first + len(self.held):
            self.file.seek(at)
            self.first, self.held = at, self.file.read(max(n, min(CHUNK, self.size - at)))
        return self.held[at - self.first : at - self.first + n]


class _Inflated:
    """What a gzip member holds, taken piece by piece."""

    def __init__(self, window: _Window, at: int):
        self.window, self.at, self.inflate = window, at, zlib.decompressobj(31)

    def more(self, most: int) -> bytes:
        """Some bytes, at most `most`; empty at the member's end."""
        while not self.inflate.eof:
            fed = self.inflate.unconsumed_tail
            if not fed:
                fed = self.window.bytes(self.at, FEED)
                self.at += len(fed)
                if not fed:
                    raise ValueError("the file ends inside a gzip member")
            if out := self.inflate.decompress(fed, most):
                return out
        return b""

    def end(self) -> int:
        """Where the next member begins, when this one has been taken whole."""
        return self.at - len(self.inflate.unused_data)


def _body(block: bytes, headers: dict[str, str]) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :] if headers.get("content-type", "").startswith("application/http") else block


def _read_member(window: _Window, at: int, wanted: Callable[[dict[str, str]], bool], payloads: bool) -> tuple[dict[str, str] | None, bytes | None, int]:
    """Headers (None if not wanted), payload if asked for, and the next member's place."""
    head = window.bytes(at, 20)
    if head[:2] != _MEMBER[:2]:
        raise ValueError(f"no gzip member at byte {at}")
    size = struct.unpack_from("<I", head, 16)[0] if len(head) == 20 and head[3] & 4 and head[12:14] == b"sl" else 0
    member_, raw = _Inflated(window, at), bytearray()
    while (end := raw.find(b"\r\n\r\n")) < 0 and (more := member_.more(HEAD)):
        raw += more
    headers = _headers(bytes(raw[:end])) if end >= 0 else {}
    take = wanted(headers)
    body = None
    if take and payloads and headers.get("warc-type") != "revisit":
        while more := member_.more(CHUNK):
            raw += more
        body = _body(bytes(raw[end + 4 : end + 4 + int(headers.get("content-length", 0))]), headers)
    elif not size:
        while member_.more(CHUNK):
            pass
    return headers if take else None, body, at + size if size else member_.end()


def _read_plain(window: _Window, at: int, wanted: Callable[[dict[str, str]], bool], payloads: bool) -> tuple[dict[str, str] | None, bytes | None, int]:
    """The same for a record that isn't compressed."""
    raw = b""
    while (end := raw.find(b"\r\n\r\n")) < 0:
        more = window.bytes(at + len(raw), HEAD)
        if not more:
            raise ValueError("the file ends inside a record's headers")
        raw += more
    headers = _headers(raw[:end])
    first, n = at + end + 4, int(headers.get("content-length", 0))
    take = wanted(headers)
    body = _body(window.bytes(first, n), headers) if take and payloads and headers.get("warc-type") != "revisit" else None
    return headers if take else None, body, first + n + 4


def _first_member(window: _Window, start: int, end: int) -> int | None:
    """The first place in [start, end) where a record's member begins; None if there is none."""
    at = start
    while at < min(end, window.size):
        held = window.bytes(at, CHUNK)
        found = held.find(_MEMBER)
        if found < 0:
            at += max(1, len(held) - len(_MEMBER) + 1)
            continue
        at += found
        try:
            if zlib.decompressobj(31).decompress(window.bytes(at, FEED), 5) == b"WARC/":
                return at if at < end else None
        except zlib.error:
            pass
        at += 1
    return None


def read_records(file, size: int, wanted: Callable[[dict[str, str]], bool], payloads: bool, start: int = 0, end: int | None = None, plain: bool = False) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and, if asked for, payload of the wanted records that begin in [start, end) of a file."""
    window, end = _Window(file, size), size if end is None else min(end, size)
    at = start if plain or not start else _first_member(window, start, end)
    read = _read_plain if plain else _read_member
    while at is not None and at < end:
        headers, body, at = read(window, at, wanted, payloads)
        if headers is not None:
            yield headers, body


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.filters = options["path"], []
        self.payloads = options.get("payload", "false").lower() == "true"
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _predicate(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Ranges]:
        from pyarrow import fs

        system, path = _file_system(self.root)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith((".warc.gz", ".warc")))
        out, room = [], 0
        for name, size in found:
            step = self.most if name.endswith(".gz") else max(size, 1)
            for start in range(0, size, step):
                part = min(step, size - start)
                if not out or part > room:
                    out, room = [*out, []], self.most
                out[-1].append((name, start, start + part))
                room -= part
        return [_Ranges(x) for x in out]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        if not partition or not partition.ranges:
            return
        names = [*_FIELDS, "payload"]
        kinds = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        tests = [_predicate(f) for f in self.filters]
        system, _ = _file_system(self.root)
        rows, held = [], 0
        for path, start, end in partition.ranges:
            with system.open_input_file(path) as file:
                for headers, body in read_records(file, file.size(), lambda h: all(t(h) for t in tests), self.payloads, start, end, not path.endswith(".gz")):
                    rows.append([*(_value(n, headers) for n in _FIELDS), body])
                    held += len(body or b"") + 300
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcWriter(DataSourceArrowWriter):
    """Files get their final names when the whole job has succeeded; files of failed attempts go or keep a .tmp name."""

    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _file_system(self.root)
        system.create_dir(path, recursive=True)
        paths, file, size = [], None, 0
        for batch in iterator:
            for record in batch.to_pylist():
                if file is None or size > self.most:
                    if file:
                        file.close()
                    paths.append(f"{path}/part-{uuid.uuid4().hex}.warc.gz.tmp")
                    file, size = system.open_output_stream(paths[-1], compression=None), 0
                size += file.write(member(record)) or 0
        if file:
            file.close()
        return _Written(paths)

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = _file_system(self.root)
        for path in (p for m in messages if m for p in m.paths):
            system.move(path, path.removesuffix(".tmp"))

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _file_system(self.root)
        for path in (p for m in messages if m for p in m.paths):
            system.delete_file(path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The records of all .warc.gz and .warc files in a folder; `payload` is null unless asked for, and always in revisits.
    An empty folder gives an empty table."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partition_bytes", str(partition_bytes)).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Append records (columns of SCHEMA) to a folder. Payloads of revisits are left out."""
    records.sparkSession.dataSource.register(WarcSource)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    records.select(*columns).write.format("warc").mode("append").save(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """A WARC record per row: of rows with equal payloads of at least `least` bytes, those with the smallest id are
    responses and the others revisit it; all smaller payloads are responses.

    Null html is an empty payload, a null url has no target URI. Rows that repeat the smallest id with the same payload
    are all responses. Rows without an id are responses with an empty record id. Payloads may be of any length; one record is
    held at a time. Other columns are ignored. An empty table gives an empty archive.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    key = F.col(id_col).cast("string")
    rows = pages.select(F.col(id_col).alias("_id"), F.concat(F.lit("urn:x-page:"), F.coalesce(key, F.lit(""))).alias("record_id"), F.col(url_col).alias("target_uri"), body.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    marks = settle(rows.where((F.col("payload_bytes") >= least) & F.col("_id").isNotNull()).select("_id", "payload_digest"), "digests")
    first = marks.groupBy("payload_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first <> _last").drop("_last")
    first = settle(first, "firsts")  # a plain scan, so that the join can split a hot payload
    again = marks.join(first, "payload_digest").where("_id <> _first").select("_id", "payload_digest", "_first").distinct()
    joined = rows.join(settle(again, "revisits"), ["_id", "payload_digest"], "left")
    revisit = F.col("_first").isNotNull()
    return joined.select(
        "record_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("warc_date"),
        F.when(revisit, F.concat(F.lit("urn:x-page:"), F.col("_first").cast("string"))).alias("refers_to"), "payload_digest", "payload_bytes", "payload",
    )
