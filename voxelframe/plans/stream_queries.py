"""Streams over the events table: triage, ledger, signals, throughput, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.plans.base import query
from voxelframe.sources import lenses as L
from voxelframe.streaming import live


def _events(spark, sf):
    """The events as a stream of files; their time stamps have no zone and are taken as UTC."""
    schema = L.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events*.parquet")
    return rows.withColumn("ts", F.expr("cast(ts as timestamp)"))


_AREA = "CASE WHEN event_id % 23 = 0 THEN 0 ELSE floor(value)::BIGINT + 5 END"


@query(f"SELECT event_type AS neuron, user_id AS chain_idx, event_id AS seq FROM events WHERE event_id % 100 < 30 AND event_id % 7 <> 0 AND {_AREA} > 20")
def triage_stream(spark, sf):
    """Frames of a low score with a mask of some size, as they come."""
    e = _events(spark, sf).filter("event_id % 100 < 30 and event_id % 7 <> 0 and if(event_id % 23 = 0, 0L, cast(floor(value) as bigint) + 5) > 20")
    return live.drained(e.selectExpr("event_type as neuron", "user_id as chain_idx", "event_id as seq"))


@query(f"WITH {L.REVIEWS} SELECT neuron, chain_idx, arg_max(review, (ts, seq)) AS review FROM reviews GROUP BY ALL")
def ledger_stream(spark, sf):
    rows = _events(spark, sf).selectExpr(
        "concat('N', user_id) as neuron", "event_id % 15 as chain_idx", "ts", "event_id as seq",
        "case event_type when 'view' then 'in_review' when 'click' then 'approved' when 'error' then 'rejected' when 'purchase' then 'corrected' else 'unreviewed' end as review")
    return live.merged_ledger(rows, "review")


@query(f"""WITH a AS (SELECT event_type AS neuron, user_id AS chain_idx, event_id AS seq, ts, {_AREA} AS area FROM events), l AS (SELECT *, lag(area) OVER (PARTITION BY neuron, chain_idx ORDER BY ts, seq) AS p FROM a)
SELECT neuron, chain_idx, seq, area, CASE WHEN area > 0 AND p > 0 THEN round(area / p, 9) END AS area_ratio FROM l""")
def qc_stream(spark, sf):
    rows = _events(spark, sf).selectExpr("event_type as neuron", "user_id as chain_idx", "ts", "event_id as seq", "if(event_id % 23 = 0, 0L, cast(floor(value) as bigint) + 5) as area")
    live.with_map_state(spark)
    last = live.revised(live.ratios(rows), ["neuron", "chain_idx", "seq"])
    return last.select("neuron", "chain_idx", "seq", "area", F.round("area_ratio", 9).alias("area_ratio"))


_DONE = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""WITH w AS (SELECT event_type AS phase, date_trunc('day', ts) AS d, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT phase, epoch(d)::BIGINT AS start, n, total FROM w WHERE d + INTERVAL 1 DAY <= {_DONE}""")
def events_window(spark, sf):
    """Throughput per day and phase; a day is given out when the watermark, an hour behind, has passed it."""
    e = _events(spark, sf).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), F.col("event_type").alias("phase"))
    return live.drained(e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("phase", F.unix_timestamp("window.start").alias("start"), "n", "total"))


@query(f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o), g AS (SELECT user_id AS reviewer, k, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY ALL)
SELECT reviewer, floor(epoch(a))::BIGINT AS start, n FROM g WHERE b + INTERVAL 4 HOUR <= {_DONE}""")
def review_sessions(spark, sf):
    """Sessions of a reviewer, closed by four hours without an event."""
    e = _events(spark, sf).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "4 hours"), F.col("user_id").alias("reviewer"))
    return live.drained(e.agg(F.count("*").alias("n")).select("reviewer", F.unix_timestamp("session_window.start").alias("start"), "n"))
