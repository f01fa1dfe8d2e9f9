"""Incremental ingest and running counters on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.functions import text as T
from trailmark.operators import assembly
from trailmark.plans import ingest as plan
from trailmark.sources.tables import Snapshots


def ingest_stream(
    visits: DataFrame,
    store: Snapshots,
    checkpoint: str,
    settings: plan.Settings | None = None,
    on_outcomes: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Runs the ingest job on every micro-batch; each is one commit of the buckets it changes.

    The commit record holds the stream (`name`, the checkpoint folder by default) and the batch number, so a
    batch that is replayed after a failure is not applied twice, and other commits do not count. `on_outcomes` gets the outcomes of a batch before it is committed and must
    overwrite what it wrote for the same number.
    """
    stream = name or checkpoint

    def apply(batch: DataFrame, number: int) -> None:
        if store.applied(stream, number):
            return
        notify = None if on_outcomes is None else lambda outcomes: on_outcomes(outcomes, number)
        plan.ingest_into(store, batch, settings, stream, number, notify)

    writer = visits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drop_repeats(visits: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Drops exact repeats (same URL and content) that arrive within the watermark."""
    keyed = visits.withColumn("_hash", T.content_hash(F.col("content"))).withWatermark("ts", within)
    return keyed.dropDuplicatesWithinWatermark(["url", "_hash"]).drop("_hash")


def running_skips(skips: DataFrame) -> DataFrame:
    """`domain, reason, count, last_seen` over a stream, for update or complete mode."""
    kept = skips.filter((F.col("domain") != "") & (F.col("reason") != "empty"))
    return kept.groupBy("domain", "reason").agg(F.count("*").alias("count"), F.max("ts").alias("last_seen"))


def daily_maintenance(store: Snapshots, as_of: Column, days: int, keep: int = 2) -> DataFrame:
    """The scheduled run: drops expired pages, makes keyword index and edges one segment each, deletes the files
    of all but the newest `keep` commits, and returns the counts."""
    tables, counts = plan.evict(store.load(), as_of, days)
    counts = store.spark.createDataFrame(counts.collect(), counts.schema)  # one row, before its files go
    plan.commit_removal(store, tables)
    store.compact_index()
    store.compact_edges()
    store.expire(keep)
    return counts


def weekly_digest(store: Snapshots, as_of: Column) -> DataFrame:
    """The scheduled digest text of the last seven days."""
    return assembly.digest_input(store.load()["pages"], as_of)
