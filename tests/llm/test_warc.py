import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from corvane.llm.warc import HEAD, LEAST_REVISIT, page_records, read_records, read_warc, write_warc

BIG = "<html>" + "é" * 3000 + "</html>"


def read_members(data, wanted, payloads, **options):
    return read_records(io.BytesIO(data), len(data), wanted, payloads, **options)


PAGES = [(3, "http://a/1", BIG), (1, "http://a/2", BIG), (2, None, "x" * 50), (4, "http://b/\r\nInjected: yes", "x" * 50), (5, "u" * 5000, None), (6, "http://c", ""), (7, "http://c", BIG + "\r\n\r\n" + "WARC/1.1"), (None, "n", BIG), (1, "http://a/2", BIG)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit("clash"), "_first": F.lit(1)}).repartition(3)
    write_warc(page_records(pages), path)
    return path


def test_round_trip(spark, archive):
    got = read_warc(spark, archive, payload=True).collect()
    assert len(got) == len(PAGES)
    stored = sorted((r.record_id, bytes(r.payload).decode()) for r in got if r.record_type == "response")
    assert stored == sorted((f"urn:x-page:{'' if i is None else i}", h or "") for i, _, h in PAGES if i != 3)
    (again,) = [r for r in got if r.record_type == "revisit"]
    assert (again.record_id, again.refers_to, again.payload) == ("urn:x-page:3", "urn:x-page:1", None)
    assert again.payload_bytes == len(BIG.encode()) and again.payload_digest == hashlib.sha256(BIG.encode()).hexdigest()
    assert not [r for r in got if r.target_uri and "\n" in r.target_uri]


def test_pushed_filters_agree_with_spark(spark, archive):
    everything = read_warc(spark, archive).cache()
    for test in ("record_type = 'revisit'", "record_type <> 'revisit'", "target_uri like 'http://a%'", "refers_to is not null", "target_uri is null", "record_id in ('urn:x-page:1', 'urn:x-page:6')", "payload_bytes > 60 and record_type = 'response'", "refers_to <=> null", "target_uri like '%c' or payload_bytes = 0"):
        want = sorted(map(str, everything.where(test).collect()))
        assert sorted(map(str, read_warc(spark, archive).where(test).collect())) == want, test


def test_small_partitions_and_whole_files(spark, archive):
    assert read_warc(spark, archive, partition_bytes=100).count() == len(PAGES)
    import os

    for name in os.listdir(archive):
        if name.endswith(".warc.gz"):
            raw = gzip.decompress(open(f"{archive}/{name}", "rb").read())
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_members_without_the_length_field():
    raw = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <u:1>\r\nContent-Type: text/plain\r\nContent-Length: 9000\r\n\r\n" + b"z" * 9000 + b"\r\n\r\n"
    data = gzip.compress(raw) * 3
    assert [(h["warc-type"], len(b)) for h, b in read_members(data, lambda h: True, True)] == [("resource", 9000)] * 3
    assert [b for _, b in read_members(data, lambda h: True, False)] == [None] * 3 and HEAD < 9000


@pytest.mark.parametrize("step", [50, 700, 9000])
def test_ranges_read_each_record_once(archive, step):
    import os

    for name in sorted(os.listdir(archive)):
        if name.endswith(".warc.gz"):
            data = open(f"{archive}/{name}", "rb").read() + gzip.compress(b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\n\x1f\x8b\x08\r\n\r\n")
            every = list(read_members(data, lambda h: True, True))
            parts = [r for start in range(0, len(data), step) for r in read_members(data, lambda h: True, True, start=start, end=start + step)]
            assert parts == every and every[-1][1] == b"\x1f\x8b\x08"


def test_plain_records_and_files_cut_off(spark, tmp_path):
    record = lambda n: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <u:{n}>\r\nContent-Length: {n}\r\n\r\n".encode() + b"y" * n + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(map(record, (0, 5, 4000))))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(n)) for n in range(1000, 1200)))
    got = read_warc(spark, str(tmp_path), payload=True, partition_bytes=1000).collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == sorted((f"u:{n}", n) for n in (0, 5, 4000, *range(1000, 1200)))
    with pytest.raises(ValueError):
        list(read_members(gzip.compress(record(9))[:-12], lambda h: True, True))


def test_memory_stays_flat_on_a_large_file():
    import tracemalloc

    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 100000\r\n\r\n" + bytes(range(250)) * 400 + b"\r\n\r\n"
    data = io.BytesIO(gzip.compress(record, 0) * 300)
    tracemalloc.start()
    assert sum(1 for _ in read_records(data, len(data.getvalue()), lambda h: True, False)) == 300
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # of a file of 30 MB, its copy by getvalue included


def test_unwanted_payloads_are_not_inflated(monkeypatch, archive):
    import os
    import zlib

    import corvane.llm.warc as m

    (name,) = [n for n in os.listdir(archive) if n.endswith(".warc.gz")][:1]
    data, seen = open(f"{archive}/{name}", "rb").read(), []

    make = zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.inner = make(bits)

        def decompress(self, *a):
            out = self.inner.decompress(*a)
            seen.append(len(out))
            return out

        def __getattr__(self, k):
            return getattr(self.inner, k)

    monkeypatch.setattr(m.zlib, "decompressobj", Counting)
    list(read_members(data, lambda h: False, True))
    assert max(seen) <= HEAD


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_warc(page_records(pages), str(tmp_path))
    assert read_warc(spark, str(tmp_path)).count() == 0 and LEAST_REVISIT == 100
