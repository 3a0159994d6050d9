"""Streaming queries: each runs a stream over the events
file to completion and returns its sink; the oracle is the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators.rules import RuleSet
from tabvet.plans.registry import query
from tabvet.streaming import validate as ST

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
EVENT_RULES = [("value_cap", "value <= 300"), ("known_type", "event_type IN ('view', 'click', 'purchase', 'signup')")]


def _stream(spark, sf):
    return ST.event_stream(spark, f"{sf.rstrip('/')}/events.parquet", EVENTS_SCHEMA)


@query("n01_stream_rules", """
SELECT event_id, coalesce(value <= 300, false) AS VALID_value_cap,
  coalesce(event_type IN ('view', 'click', 'purchase', 'signup'), false) AS VALID_known_type FROM events""")
def n01_stream_rules(spark, sf):
    s = ST.stream_rules(_stream(spark, sf), RuleSet(EVENT_RULES)).select("event_id", "VALID_value_cap", "VALID_known_type")
    return ST.run_available(s, "n01")


@query("n02_windowed_violations", """
WITH l AS (SELECT ts, 'value_cap' AS rule FROM events WHERE NOT coalesce(value <= 300, false)
           UNION ALL SELECT ts, 'known_type' FROM events WHERE NOT coalesce(event_type IN ('view','click','purchase','signup'), false))
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, rule, CAST(count(*) AS BIGINT) AS violations FROM l GROUP BY 1, 2""")
def n02_windowed_violations(spark, sf):
    s = ST.windowed_violations(_stream(spark, sf), RuleSet(EVENT_RULES), "ts", "1 day", "100 days")
    # update mode: each window's running count is upserted, the last one wins
    out = ST.run_update(s, "n02", keys=["window_start", "rule"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rule", "violations")


@query("n03_dedup_within_watermark", """
SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def n03_dedup_within_watermark(spark, sf):
    # a watermark longer than the data span: duplicates are dropped across the whole stream
    s = ST.dedup_stream(_stream(spark, sf), ["user_id", "event_type"], "ts", "100 days")
    return ST.run_available(s, "n03").agg(F.count(F.lit(1)).alias("n"))


@query("n04_stateful_sequence", """
WITH ft AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS first_a,
  min(CASE WHEN event_type = 'purchase' THEN ts END) AS first_b FROM events GROUP BY user_id)
SELECT user_id, first_a, first_b, CASE WHEN first_a IS NULL OR first_b IS NULL THEN true ELSE first_a < first_b END AS VALID_sequence FROM ft""")
def n04_stateful_sequence(spark, sf):
    s = ST.sequence_state(_stream(spark, sf), "view", "purchase")
    return ST.run_update(s, "n04")
