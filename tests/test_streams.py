"""Timers, expiry and the keyed sink of the streaming jobs."""

import os

from pyspark.sql import functions as F

from tests.test_pipeline import at
from tests.test_queries import SF_DIR
from trailmark.streaming import dwell
from trailmark.streaming.sinks import KeyedSink
from workload import compare, stream_queries

SCHEMA = "tab_id long, ts timestamp, seq long, kind string, url string, title string"


def run_dwell(spark, tmp_path, parts, **options):
    """The visits after each part, which is a micro-batch (and what its watermark sets off) of its own."""
    told = []
    for number, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = dwell.stream_dwell(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), **options)
        out = f"{tmp_path}/out"
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(out, format="parquet").awaitTermination()
        rows_ = spark.read.schema(stream.schema).parquet(out).collect()
        told.append(sorted((r.tab_id, r.url, r.dwell_seconds) for r in rows_))
    return told


def test_timer_tells_a_visit_before_it_ends(spark, tmp_path):
    a, b = "https://a.org/1", "https://b.org/2"
    told = run_dwell(spark, tmp_path, [
        [(1, at(0), 1, "updated", a, "A"), (2, at(0), 2, "updated", b, "B")],
        [(2, at(0.25), 3, "removed", None, None), (3, at(2), 4, "activated", None, None)],  # event time passes the threshold of tab 1
        [(1, at(3), 5, "removed", None, None), (3, at(60), 6, "removed", None, None)],
    ], timers=True)
    assert told == [[], [(1, a, 30.0)], [(1, a, 30.0)]]


def test_silent_tabs_expire(spark, tmp_path):
    a = "https://a.org/1"
    told = run_dwell(spark, tmp_path, [
        [(1, at(0), 1, "updated", a, "A"), (2, at(0), 2, "updated", a, "A")],
        [(2, at(5), 3, "alarm", None, None), (9, at(60), 4, "removed", None, None)],  # tab 1 expires after ten minutes, tab 2 told
        [(1, at(61), 5, "removed", None, None), (2, at(61), 6, "removed", None, None)],
    ], ttl_seconds=600.0)
    assert told == [[], [(2, a, 300.0)], [(2, a, 300.0)]]


def test_keyed_sink_keeps_the_newest_row(spark, tmp_path):
    sink = KeyedSink(spark, f"{tmp_path}/s", spark.createDataFrame([], "k string, n long, v long").schema, ["k", "n"])

    def write(number, *rows):
        sink.write(spark.createDataFrame(list(rows), "k string, n long, v long"), number)

    def held():
        return sorted(tuple(r) for r in sink.read().collect())

    assert held() == []
    sink.compact()
    write(0, ("a", 1, 1), ("b", 1, 1))
    write(1, ("a", 1, 2), ("a", 2, None))
    write(1, ("a", 1, 3), ("a", 2, None))  # replayed
    assert held() == [("a", 1, 3), ("a", 2, None), ("b", 1, 1)]
    sink.compact()
    sink.compact()
    assert held() == [("a", 1, 3), ("a", 2, None), ("b", 1, 1)] and list(sink._whole("batches")) == []
    write(2, ("b", 1, 9))
    write(1, ("a", 1, 0))  # a late replay of what the base holds
    assert held() == [("a", 1, 3), ("a", 2, None), ("b", 1, 9)]
    sink.compact()
    assert held() == [("a", 1, 3), ("a", 2, None), ("b", 1, 9)] and list(sink._whole("base")) == [2]
    assert sink.read().filter(F.col("k").isNull()).count() == 0


def test_pages_that_share_a_url_are_told_each(spark, tmp_path):
    """The URLs of these pages occur twice, as some do on larger tables; the store holds each once."""
    read = spark.read.parquet
    pages = read(f"{SF_DIR}/pages.parquet").filter("page_id < 40")
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 40))
    # One file per table: what the check SQL reads by name.
    twice.toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    for name in os.listdir(SF_DIR):
        if name != "pages.parquet":
            os.symlink(f"{SF_DIR}/{name}", f"{tmp_path}/{name}")
    query, sql = stream_queries.QUERIES["stream_ingest"]
    line = compare.check(spark, compare.connect(str(tmp_path)), "stream_ingest", query, sql, str(tmp_path))
    assert line.startswith("ok"), line
