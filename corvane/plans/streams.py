"""Streams over the events table, run to their end, and a round trip of records through files."""

from datetime import timedelta

from pyspark.sql import functions as F

from corvane.plans.catalog import query, table
from corvane.session import shared_path
from corvane.sources.records import SECTION, read_json_lines, unified, write_json_lines
from corvane.streaming.manifests import append_new, deduplicated, windowed_counts
from corvane.streaming.state import state_store, with_status


def _stream(spark, folder):
    schema = table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark, stream, label, mode="append"):
    out = shared_path(spark, label)
    done = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("stream_window_counts", """
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")  # fmt: skip
def stream_window_counts(spark, folder):
    """Days that the watermark has closed. An extension: the event time of the supplied table."""
    done = _finished(spark, windowed_counts(_stream(spark, folder), "ts"), "stream-windows")
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_dedupe", "SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark, folder):
    """The first record of each user within the watermark's delay, which covers all of the table."""
    return _finished(spark, deduplicated(_stream(spark, folder), "user_id", "ts", "60 days"), "stream-dedupe").select("user_id")


@query("stream_manifest", "SELECT event_id, event_type FROM events")
def stream_manifest(spark, folder):
    """Records appended once, though the stream is started twice without its state."""
    out = shared_path(spark, "stream-manifest")
    for run in (1, 2):
        append_new(_stream(spark, folder).select("event_id", "event_type"), f"{out}/rows", ["event_id"], f"{out}/state-{run}").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "event_type")


@query("consolidate_roundtrip", """
SELECT lower(lang || '/' || source || '/' || doc_id) AS id, CASE WHEN doc_id % 3 > 0 THEN 'chapter' ELSE '' END AS levels, length(text) AS n_chars FROM documents
""")  # fmt: skip
def consolidate_roundtrip(spark, folder):
    """Documents as parsed sections, consolidated, written as JSON lines by code and read again."""
    docs = table(spark, folder, "documents")
    values = {"jurisdiction": F.col("lang"), "law_code": F.col("source"), "section_num": F.col("doc_id").cast("string"), "text": F.col("text"), "chapter": F.when(F.col("doc_id") % 3 > 0, F.lit("1"))}
    empty = spark.createDataFrame([], SECTION)
    sections = docs.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])
    records = unified(sections)
    out = shared_path(spark, "consolidated")
    write_json_lines(records, out)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    back = read_json_lines(spark, out, schema)
    return back.select("id", F.concat_ws(",", F.map_keys("hierarchy")).alias("levels"), F.length("text").cast("long").alias("n_chars"))


@query("stream_known_keys", """
WITH l AS (
  SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (
  SELECT *, CASE WHEN before IS NULL OR ts - before > INTERVAL 12 HOUR THEN 'new' WHEN was = event_type THEN 'cached' ELSE 'fresh' END AS status FROM l
), g AS (SELECT *, count(*) FILTER (status = 'new') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM s)
SELECT event_id, user_id, status, round(max(value) OVER (PARTITION BY user_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS best_quality FROM g
""")  # fmt: skip
def stream_known_keys(spark, folder):
    """New, cached or fresh for each event of a user, from state by key that a timer drops twelve hours after the last event."""
    rows = _stream(spark, folder).select("event_id", "user_id", "event_type", "value", "ts")
    known = with_status(rows, "user_id", "event_type", "value", "ts", timedelta(hours=12), "60 days", order=("event_id",))
    with state_store(spark):
        done = _finished(spark, known, "stream-known")
    return done.select("event_id", "user_id", "status", F.round("best_quality", 6).alias("best_quality"))
