"""Stream queries run over tables: what the streaming operators give once all rows have come."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators.rules import SIGNATURES
from tidewright.plans.registry import query
from tidewright.session import table
from tidewright.streaming import scoring


@query("event_rates", """
    SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2
    """)  # fmt: skip
def event_rates(spark, sf_dir):
    return scoring.rates(table(spark, sf_dir, "events")).withColumn("mean_value", F.round("mean_value", 6))


@query("user_sessions", """
    WITH d AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k
    """)  # fmt: skip
def user_sessions(spark, sf_dir):
    return scoring.sessions(table(spark, sf_dir, "events"))


@query(
    "inline_scores",
    "SELECT doc_id, CASE WHEN " + " OR ".join("contains(lower(text), '" + x.replace("'", "''") + "')" for x in SIGNATURES) + " THEN 1 ELSE 0 END AS signature FROM documents WHERE text IS NOT NULL",
)
def inline_scores(spark, sf_dir):
    """The literal signatures on documents as they come."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    return scoring.scored(rows, "text").select("doc_id", "signature")


@query("texts_first_seen", "SELECT count(DISTINCT text) AS n FROM documents")
def texts_first_seen(spark, sf_dir):
    return scoring.first_seen(table(spark, sf_dir, "documents"), "text").agg(F.count("*").alias("n"))
