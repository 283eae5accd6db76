"""Streams: scoring requests as they come, windowed rates with late data, and online duplicates. All keep bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.rules import THRESHOLD, crs_scores, signature_hit


def scored(requests: DataFrame, raw: str = "raw", level: int = 2, threshold: int = THRESHOLD) -> DataFrame:
    """Rule score, decision and fast match of each request; stateless, so any stream or table goes."""
    out = crs_scores(requests, raw, levels=(level,), threshold=threshold)
    return out.withColumnsRenamed({f"score_pl{level}": "score", f"pred_pl{level}": "blocked"}).withColumn("signature", signature_hit(raw))


def _timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, for which times without a zone become instants of the session's zone; a table as it is."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if rows.isStreaming else rows


def rates(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Rows and mean value of each tumbling window and type; rows later than the watermark are dropped with their windows."""
    rows = _timed(events, time, late)
    out = rows.groupBy(F.window(time, every).alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", user: str = "user_id") -> DataFrame:
    """Rows of each session: a user's events with no pause of the gap or longer."""
    rows = _timed(events, time, late)
    out = rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), user, "n")


def first_seen(requests: DataFrame, text: str = "raw", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each text once within the watermark."""
    rows = requests.withColumn("_digest", F.sha2(F.coalesce(text, F.lit("")), 256))
    if not requests.isStreaming:
        return rows.dropDuplicates(["_digest"]).drop("_digest")
    return _timed(rows, time, late).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now and gives the rows, from an in-memory table of that name."""
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
