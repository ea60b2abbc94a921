"""Clustering of events that arrive over time."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cluster import cluster
from ..plans.params import jet_name

PARTICLE = ["event_id", "idx", "px", "py", "pz", "energy"]


def cluster_stream(particles: DataFrame, path: str, checkpoint: str, algorithm: str, params: Mapping[str, object] | None = None, name: str | None = None, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Clusters whole events as their files arrive and appends their nodes at ``path``; runs until caught up by default.

    A micro-batch that is tried again writes to its own folder again, so nothing is counted twice.
    """
    jet = jet_name(name or algorithm)

    def batch(df: DataFrame, number: int) -> None:
        cluster(df, algorithm, params).withColumn("jet_name", F.lit(jet)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return particles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def gather_events(particles: DataFrame, time: str = "ts", delay: str = "10 seconds", quiet_ms: int = 10_000, keep_ms: int = 600_000) -> DataFrame:
    """Events whose particles arrive as separate rows, one row each once nothing has come for ``quiet_ms`` of event time:
    event_id, revision and lists idx, px, py, pz, energy.

    Particles that come later, but not behind the watermark, give the whole event again once it is quiet, with the next
    revision; the greatest one counts. An event is kept for ``keep_ms`` after each of its rows, so that later
    particles find it; those that come later still begin it anew, at revision 0. State is the particles of events that are kept.
    """
    lists = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in PARTICLE[1:]]
    state = T.StructType([T.StructField("revision", T.LongType()), T.StructField("waits", T.BooleanType()), *lists])
    out = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("revision", T.LongType()), *lists])

    def step(key: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        revision, waits, *kept = held.get if held.exists else (0, True, *([] for _ in lists))
        if held.hasTimedOut:
            if waits:
                order = sorted(range(len(kept[0])), key=kept[0].__getitem__)
                yield pd.DataFrame({"event_id": [key[0]], "revision": [revision], **{c: [[x[i] for i in order]] for c, x in zip(PARTICLE[1:], kept, strict=True)}})
            if waits and keep_ms > 0:
                held.update((revision + 1, False, *kept))
                held.setTimeoutTimestamp(held.getCurrentWatermarkMs() + keep_ms)
            else:
                held.remove()
            return
        kept, latest = [list(x) for x in kept], 0
        for chunk in chunks:
            for c, x in zip(PARTICLE[1:], kept, strict=True):
                x += chunk[c].astype(float).tolist()
            latest = max(latest, int(chunk["_pf_ms"].max()))
        held.update((revision, True, *kept))
        held.setTimeoutTimestamp(max(latest, held.getCurrentWatermarkMs()) + quiet_ms)

    rows = particles.withWatermark(time, delay).select(time, F.unix_millis(time).alias("_pf_ms"), *PARTICLE)
    return rows.groupBy("event_id").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def windowed(events: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream by tumbling or sliding windows and type, late rows within ``delay`` included."""
    by = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(by.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, by: str = "user_id", delay: str = "10 minutes") -> DataFrame:
    """Sessions of an event stream: rows of one ``by`` that follow each other within ``gap``, with their number and sum."""
    found = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), by)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")
