import shutil
from datetime import datetime, timedelta
from functools import partial

import pytest

from corvane.streaming.state import state_store, with_status

SCHEMA = "k string, digest string, quality double, at timestamp, n long"
START = datetime(2024, 1, 1)


def record(n, k, digest, hours, quality=1.0):
    return (k, digest, quality, START + timedelta(hours=hours), n)


@pytest.fixture
def run(spark, tmp_path):
    """Feed files of records to the stream, one micro-batch each; every call is a restart."""
    fed = [0]

    def feed(*files, keep=timedelta(days=3), delay="1 hour"):
        for rows in files:
            fed[0] += 1
            out = tmp_path / f"part-{fed[0]}"
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(out))
            (tmp_path / "in").mkdir(exist_ok=True)
            shutil.copy(next(out.glob("*.parquet")), tmp_path / "in" / f"{fed[0]:03}.parquet")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        known = with_status(stream, "k", "digest", "quality", "at", keep, delay, ("n",))
        with state_store(spark):
            q = known.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema(known.schema).parquet(str(tmp_path / "out")).collect()
        return {r.n: (r.status, r.best_quality) for r in rows}, q.recentProgress

    return feed


def plain(rows, keep=timedelta(days=3)):
    known, out = {}, {}
    for k, digest, quality, at, n in sorted(rows, key=lambda r: (r[3], r[4])):
        old = known.get(k)
        if old is None or at - old[2] > keep:
            status, best = "new", quality
        else:
            status = "cached" if old[0] == digest else "fresh"
            best = max(old[1], quality)
        known[k] = (digest, best, at)
        out[n] = (status, best)
    return out


def test_statuses_over_batches_and_restarts(run, spark):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    first = [record(1, "a", "x", 0, 2.0), record(2, "a", "x", 1), record(3, "a", "y", 2, 5.0), record(4, "b", "x", 1), record(5, "hot", "d0", 0)] + [record(100 + i, "hot", f"d{i // 3}", 0.5 + i / 100) for i in range(60)]
    second = [record(6, "a", "y", 10), record(7, "b", "z", 11), record(8, "c", "x", 12)]
    third = [record(9, "a", "y", 30), record(10, "c", "x", 30), record(11, "b", "z", 11 + 73)]
    run(first)
    run(second)
    got, _ = run(third)
    assert got == plain(first + second + third) and got[11][0] == "new" and got[9][0] == "cached"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_old_keys_are_dropped_and_come_back_as_new(run):
    got, progress = run([record(1, "old", "x", 0), record(2, "live", "x", 0)], [record(3, "live", "x", 200)], [record(4, "live", "x", 201)], [record(5, "live", "y", 202)])
    assert got == {1: ("new", 1.0), 2: ("new", 1.0), 3: ("new", 1.0), 4: ("cached", 1.0), 5: ("fresh", 1.0)}
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert held[-1] < max(held)  # the old key's state and timer are gone
    again, progress = run([record(6, "old", "x", 203)])
    assert again[6][0] == "new"


def test_null_keys_digests_and_qualities(run):
    got, _ = run([record(1, None, None, 0), record(2, None, None, 1), record(3, None, "x", 2), ("q", "x", None, START, 4), ("q", "x", 3.0, START + timedelta(hours=1), 5)])
    assert {n: s for n, (s, _) in got.items()} == {1: "new", 2: "cached", 3: "fresh", 4: "new", 5: "cached"} and got[5][1] == 3.0


def test_many_keys_share_rows_of_state(run, monkeypatch):
    monkeypatch.setitem(globals(), "with_status", partial(with_status, buckets=8))
    rows = [record(n, f"k{(n * n + n // 900) % 700}", f"d{n % 2}", n // 4 / 12.5, float(n * 13 % 11)) for n in range(5000)]
    got, progress = run(rows[:2500], rows[2500:], keep=timedelta(hours=5))
    assert got == plain(rows, timedelta(hours=5)) and {s for s, _ in got.values()} == {"new", "cached", "fresh"}
    assert 0 < max(o.numRowsTotal for p in progress for o in p.stateOperators) <= 8  # not a row, nor a call, for each key


def test_keys_last_as_long_in_any_time_zone(run, spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got, _ = run([record(1, "a", "x", 0)], [record(2, "b", "x", 71)], [record(3, "b", "x", 71.2)], [record(4, "a", "x", 71.5)])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got[4][0] == "cached"


def test_a_record_whose_key_is_over_at_once(run):
    got, _ = run([record(1, "a", "x", 0), record(2, "live", "x", 200)], [record(3, "late", "x", 100)], [record(4, "late", "x", 200)])
    assert got == {1: ("new", 1.0), 2: ("new", 1.0), 3: ("new", 1.0), 4: ("new", 1.0)}


def test_records_without_a_time_come_last(run):
    got, _ = run([("a", "x", 1.0, None, 1), record(2, "a", "x", 0), ("a", "x", 2.0, None, 3), ("b", "x", 1.0, None, 4)], [record(5, "a", "x", 1), record(6, "b", "x", 1)])
    assert {n: s for n, (s, _) in got.items()} == {2: "new", 1: "cached", 3: "new", 4: "new", 5: "new", 6: "new"}
