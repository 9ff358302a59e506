import pytest
from pyspark.sql import functions as F

from corvane.operators.metrics import Heartbeat, Watched, failure_totals, fetch_totals, rate_and_eta, record_totals, stream_totals

ROWS = [(1, True, 200, None, 10.0), (2, False, 404, None, None), (3, None, 500, "http 500", 0.0), (4, True, 200, None, 2.5)]
SCHEMA = "n long, valid boolean, status int, error string, size double"
WANT = {"completed": 4, "valid": 2, "not_found": 1, "errors": 1, "bytes": 12.5}


def totals():
    return fetch_totals(F.col("valid"), F.col("status"), F.col("error"), F.col("size"))


def test_totals_come_with_the_job(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    watched = Watched(rows, totals() | failure_totals(F.col("status") >= 400, F.col("n"), F.concat(F.lit("http "), "status")))
    watched.table.write.parquet(f"{tmp_path}/out")
    got = watched.totals
    assert {k: got[k] for k in WANT} == WANT and got["failures"] == 2 and tuple(got["first_failure"]) == (2, "http 404")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_totals_of_nothing(spark, tmp_path):
    watched = Watched(spark.createDataFrame([], SCHEMA), totals() | record_totals(F.col("error"), F.col("valid")) | failure_totals(F.col("valid"), F.col("n"), F.col("error")))
    watched.table.write.parquet(f"{tmp_path}/out")
    assert {k: v or 0 for k, v in watched.totals.items()} == {"completed": 0, "valid": 0, "not_found": 0, "errors": 0, "bytes": 0, "files": 0, "records": 0, "skipped": 0, "failures": 0, "first_failure": 0}


@pytest.mark.parametrize(("done", "before", "seconds", "want"), [(50, 30, 2, (10.0, 5.0)), (50, 50, 2, (0.0, None)), (100, 90, 0, (10_000.0, 0.0))])
def test_rate_and_eta(done, before, seconds, want):
    assert rate_and_eta(done, before, seconds, 100) == want


def test_a_stream_reports_its_batches(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    lines = []
    heartbeat = Heartbeat(total=12, name="fetches", query="beat", report=lambda line, so_far: lines.append((line, so_far)))
    spark.streams.addListener(heartbeat)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("fetches", *(c.alias(n) for n, c in totals().items()))
        query = stream.writeStream.queryName("beat").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert heartbeat.ended.wait(30)
    finally:
        spark.streams.removeListener(heartbeat)
    assert heartbeat.done == 12 and heartbeat.totals == {k: 3 * v for k, v in WANT.items()} == stream_totals(query, "fetches")
    assert [line.split()[0] for line, _ in lines] == ["4/12", "8/12", "12/12"] and lines[-1][0].endswith("eta=0.0min") and lines[0][1]["valid"] == 2
