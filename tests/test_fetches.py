"""Fetches by retry rules, and records of what was fetched."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.functions.contents import SOURCES
from corvane.sources.providers import BRIEF, PATIENT, fetch_missing, fetch_records, fetched

GOOD = b"<div id=leaf-statute-body>" + b"x" * 2000


def answers(by_url):
    """A fetcher that gives each url's answers in turn, the last one for good."""
    asked = {}

    def fetch(url):
        k = asked[url] = asked.get(url, 0) + 1
        answer = by_url[url][min(k, len(by_url[url])) - 1]
        if answer is None:
            raise OSError("no line")
        return answer

    return fetch


def urls(spark, names):
    return spark.createDataFrame([(n,) for n in names], "url string").coalesce(1)


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (PATIENT, {"ok": (200, None, 1), "gone": (404, None, 1), "refused": (403, "http 403", 6), "busy": (200, None, 3), "down": (None, "no line", 6), "back": (200, None, 2)}),
        (BRIEF, {"ok": (200, None, 1), "gone": (404, None, 1), "refused": (403, None, 1), "busy": (200, None, 3), "down": (None, "no line", 3), "back": (200, None, 2)}),
    ],
)
def test_retry_rules(spark, rule, want):
    table = {"ok": [(200, b"x")], "gone": [(404, b"")], "refused": [(403, b"")], "busy": [(503, b""), (429, b""), (200, b"y")], "down": [None], "back": [None, (200, b"z")]}
    got = fetched(urls(spark, table), answers(table), rule=rule, pause=lambda s: None).collect()
    assert {r.url: (r.http_status, r.error, r.tries) for r in got} == want


def test_pauses_grow():
    assert [BRIEF.delay(k) for k in (1, 2, 3)] == [1, 2, 4] and PATIENT.delay(1) == 0.6 and PATIENT.delay(20) == 30


def test_only_what_no_valid_record_covers_is_fetched(spark):
    wanted = urls(spark, "abc")
    manifest = spark.createDataFrame([("a", True), ("b", False)], "url string, valid boolean")
    got = fetch_missing(wanted, manifest, ["url"], lambda url: (200, url.encode()))
    assert {r.url: bytes(r.body) for r in got.collect()} == {"b": b"b", "c": b"c"}


def test_records_of_cached_and_fetched_pages(spark):
    wanted = spark.createDataFrame([(s, f"u{s}") for s in "123456"], "section string, url string")
    stored = spark.createDataFrame([("1", bytearray(GOOD)), ("2", bytearray(b"old and short")), ("3", bytearray(b""))], "section string, body binary")
    table = {"u3": [(200, GOOD)], "u4": [(404, b"not there")], "u5": [(503, b"busy")], "u6": [None], "u1": [(200, b"again")], "u2": [(200, GOOD)]}
    run = lambda **options: {r.section: r for r in fetch_records(wanted, stored, SOURCES["tx_public_law"], answers(table), tries=2, pause=lambda s: None, **options).collect()}
    got = run()
    assert {s: (r.valid, r.cached, r.http_status, r.error) for s, r in got.items()} == {
        "1": (True, True, 200, None), "2": (False, True, 200, None), "3": (True, False, 200, None), "4": (False, False, 404, None), "5": (False, False, 503, "http 503"), "6": (False, False, 0, "no line"),
    }
    assert bytes(got["3"].body) == GOOD and got["3"].content_sha256 == hashlib.sha256(GOOD).hexdigest() and got["3"].bytes == len(GOOD)
    assert got["2"].body is None and got["4"].body is None and got["6"].content_sha256 == "" and got["6"].bytes == 0
    forced = run(force=True)
    assert not any(r.cached for r in forced.values()) and forced["2"].valid and not forced["1"].valid


def test_nothing_wanted(spark):
    wanted = spark.createDataFrame([], "section string, url string")
    stored = spark.createDataFrame([], "section string, body binary")
    assert fetch_records(wanted, stored, SOURCES["tx_public_law"], lambda url: (200, GOOD)).where(F.col("valid")).count() == 0
