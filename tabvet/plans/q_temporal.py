"""Temporal-rule and metric-log queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators import metriclog as ML
from tabvet.operators import temporal as TP
from tabvet.plans.registry import query, r6
from tabvet.session import table


def _events(spark, sf):
    return table(spark, sf, "events")


def _log(spark, sf):
    return _events(spark, sf).select(F.col("event_type").alias("metric"), "value", "ts", "event_id")


_FT = """ft AS (SELECT user_id, min(CASE WHEN event_type = '{a}' THEN ts END) AS first_{a},
  min(CASE WHEN event_type = '{b}' THEN ts END) AS first_{b} FROM events GROUP BY user_id)"""


@query("f01_sequence_rule", f"""WITH {_FT.format(a='view', b='purchase')}
SELECT user_id, first_view, first_purchase,
  CASE WHEN first_view IS NULL OR first_purchase IS NULL THEN true ELSE first_view < first_purchase END AS VALID_sequence FROM ft""")
def f01_sequence_rule(spark, sf):
    return TP.sequence_rule(_events(spark, sf), "user_id", "event_type", "ts", "view", "purchase")


@query("f02_duration_rule", f"""WITH {_FT.format(a='signup', b='purchase')}
SELECT user_id, first_signup, first_purchase,
  round(epoch_us(first_purchase) / 1e6 - epoch_us(first_signup) / 1e6, 6) AS duration_seconds,
  CASE WHEN first_signup IS NULL OR first_purchase IS NULL THEN true
       ELSE (epoch_us(first_purchase) - epoch_us(first_signup)) / 1e6 BETWEEN 0 AND 604800 END AS VALID_duration FROM ft""")
def f02_duration_rule(spark, sf):
    d = TP.duration_rule(_events(spark, sf), "user_id", "event_type", "ts", "signup", "purchase", 0, 7 * 86400)
    return d.withColumn("duration_seconds", r6("duration_seconds"))


def _user_flags(spark, sf):
    e = _events(spark, sf)
    return e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}")
                                      for t in ("view", "click", "purchase", "signup")])


_FLAGS = """fl AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_view,
  count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase,
  count(*) FILTER (WHERE event_type = 'signup') AS n_signup FROM events GROUP BY user_id)"""


def _deps():
    return TP.DependencyRules().add("purchase", ["n_view", "n_click"]).add("purchase", ["n_signup"]) \
        .add("review", ["n_purchase", "n_email"])


@query("f03_dependency_rule", f"""WITH {_FLAGS}
SELECT user_id, n_view, n_click, n_purchase, n_signup, (n_view <> 0 AND n_click <> 0 AND n_signup <> 0) AS DEP_purchase,
  false AS DEP_review FROM fl""")
def f03_dependency_rule(spark, sf):
    return _deps().validate(_user_flags(spark, sf))


@query("f04_dependency_graph", f"""WITH {_FLAGS},
e AS (SELECT * FROM (VALUES ('purchase', 'n_view'), ('purchase', 'n_click'), ('purchase', 'n_signup'),
                           ('review', 'n_purchase'), ('review', 'n_email')) AS t(dependent, prerequisite)),
s AS (SELECT 'n_view' AS prerequisite, count(*) FILTER (WHERE n_view <> 0) AS entities_satisfying FROM fl
      UNION ALL SELECT 'n_click', count(*) FILTER (WHERE n_click <> 0) FROM fl
      UNION ALL SELECT 'n_signup', count(*) FILTER (WHERE n_signup <> 0) FROM fl
      UNION ALL SELECT 'n_purchase', count(*) FILTER (WHERE n_purchase <> 0) FROM fl)
SELECT dependent, prerequisite, CAST(coalesce(entities_satisfying, 0) AS BIGINT) AS entities_satisfying
FROM e LEFT JOIN s USING (prerequisite)""")
def f04_dependency_graph(spark, sf):
    fl = _user_flags(spark, sf)
    deps = _deps()
    edges = deps.edges(spark)
    present = [c for c in fl.columns if c.startswith("n_")]
    sat = fl.agg(*[F.count_if(F.col(c) != 0).alias(c) for c in present]) \
        .unpivot([], present, "prerequisite", "entities_satisfying")
    return edges.join(F.broadcast(sat), "prerequisite", "left").fillna(0, ["entities_satisfying"]) \
        .select("dependent", "prerequisite", F.col("entities_satisfying").cast("bigint"))


@query("f05_order_check", """
SELECT event_id, user_id, value,
  coalesce(NOT (value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id)), true) AS VALID_SEQUENCE FROM events""")
def f05_order_check(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "value")
    return TP.order_check(e, ["event_id"], "value", ["user_id"])


@query("f05_order_check_global", """
SELECT event_id, ts, coalesce(NOT (ts < lag(ts) OVER (ORDER BY event_id)), true) AS VALID_SEQUENCE FROM events""")
def f05_order_check_global(spark, sf):
    e = _events(spark, sf).select("event_id", "ts")
    return TP.order_check(e, ["event_id"], "ts")


@query("f06_calendar_features", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS YEAR, CAST(month(ts) AS INTEGER) AS MONTH, CAST(day(ts) AS INTEGER) AS DAY,
  CAST(hour(ts) AS INTEGER) AS HOUR, CAST(isodow(ts) - 1 AS INTEGER) AS DAY_OF_WEEK,
  CAST(isodow(ts) - 1 IN (5, 6) AS INTEGER) AS IS_WEEKEND, CAST(quarter(ts) AS INTEGER) AS QUARTER,
  CAST(weekofyear(ts) AS INTEGER) AS WEEK_OF_YEAR FROM events""")
def f06_calendar_features(spark, sf):
    e = _events(spark, sf).select("event_id", "ts")
    return TP.calendar_features(e, "ts").drop("ts")


_GAP = """g AS (SELECT event_id, user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap
           FROM events)"""


@query("f07_interval_rule", f"""WITH {_GAP}
SELECT event_id, user_id, round(gap, 6) AS gap_seconds, CASE WHEN gap IS NULL THEN true ELSE gap BETWEEN 0 AND 172800 END AS VALID_interval FROM g""")
def f07_interval_rule(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts")
    out = TP.interval_rule(e, ["user_id"], ["ts", "event_id"], "ts", 0, 2 * 86400)
    return out.select("event_id", "user_id", r6("gap_seconds").alias("gap_seconds"), "VALID_interval")


@query("f07_periodic_rule", f"""WITH {_GAP}
SELECT event_id, CASE WHEN gap IS NULL THEN true ELSE (gap - 3600 * floor(gap / 3600)) <= 300
  OR 3600 - (gap - 3600 * floor(gap / 3600)) <= 300 END AS VALID_periodic FROM g""")
def f07_periodic_rule(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts")
    return TP.periodic_rule(e, ["user_id"], ["ts", "event_id"], "ts", 3600, 300).select("event_id", "VALID_periodic")


@query("f07_deadline_rule", """
SELECT event_id, coalesce(ts <= TIMESTAMP '2024-01-25 00:00:00', false) AS VALID_deadline FROM events""")
def f07_deadline_rule(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", TP.deadline_rule(e, "ts", "2024-01-25 00:00:00").alias("VALID_deadline"))


# --- metric log -----------------------------------------------------------------

_ORD = "ORDER BY ts, event_id"
_POS = f"""p AS (SELECT event_type AS metric, value, ts, event_id,
  row_number() OVER (PARTITION BY event_type {_ORD}) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)"""


@query("l01_metric_statistics", f"""
SELECT event_type AS metric, CAST(count(value) AS BIGINT) AS count, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(arg_max(value, (ts, event_id)), 6) AS last,
  round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type""")
def l01_metric_statistics(spark, sf):
    s = ML.statistics(_log(spark, sf))
    return s.select("metric", "count", r6("mean", 9).alias("mean"), r6("std").alias("std"), r6("min").alias("min"),
                    r6("max").alias("max"), r6("last").alias("last"), r6("median").alias("median"))


@query("l02_last_readings", f"WITH {_POS} SELECT metric, value, ts, event_id FROM p WHERE n - r + 1 <= 5")
def l02_last_readings(spark, sf):
    return ML.last_n(_log(spark, sf), 5).select("metric", "value", "ts", "event_id")


@query("l03_mean_last_n", f"WITH {_POS} SELECT metric, round(avg(value), 9) AS mean_last_n FROM p WHERE n - r + 1 <= 100 GROUP BY metric")
def l03_mean_last_n(spark, sf):
    return ML.mean_last_n(_log(spark, sf), 100).select("metric", r6("mean_last_n", 9).alias("mean_last_n"))


@query("l04_trend_slope", f"""WITH {_POS}
SELECT metric, round(CASE WHEN count(*) >= 50 THEN coalesce(regr_slope(value, r), 0) ELSE 0 END, 9) AS trend
FROM p WHERE n - r + 1 <= 50 GROUP BY metric""")
def l04_trend_slope(spark, sf):
    return ML.trend(_log(spark, sf), 50).select("metric", r6("trend", 9).alias("trend"))


@query("l05_divergence_flags", f"""WITH {_POS},
w AS (SELECT metric, event_id, avg(value) OVER (PARTITION BY metric ORDER BY r ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mn,
        avg(value) OVER (PARTITION BY metric ORDER BY r ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS mp,
        count(*) OVER (PARTITION BY metric ORDER BY r ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM p)
SELECT metric, event_id, round(mn, 9) AS mean_new, round(mp, 9) AS mean_prev, c >= 20 AND mn > 1.4 * mp AS diverging FROM w""")
def l05_divergence_flags(spark, sf):
    d = ML.divergence_flags(_log(spark, sf))
    return d.select("metric", "event_id", r6("mean_new", 9).alias("mean_new"), r6("mean_prev", 9).alias("mean_prev"),
                    F.coalesce(F.col("diverging"), F.lit(False)).alias("diverging"))


@query("l06_stagnation_flags", f"""WITH {_POS},
w AS (SELECT metric, event_id, var_pop(value) OVER (PARTITION BY metric ORDER BY r ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v,
        count(*) OVER (PARTITION BY metric ORDER BY r ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM p)
SELECT metric, event_id, round(v, 2) AS rolling_var, c >= 20 AND v < 1e-3 AS stagnating FROM w""")
def l06_stagnation_flags(spark, sf):
    d = ML.stagnation_flags(_log(spark, sf))
    return d.select("metric", "event_id", r6("rolling_var", 2).alias("rolling_var"), "stagnating")


def _stop_sql(mode):
    new = "p.value < s.best - 1e-4" if mode == "min" else "p.value > s.best + 1e-4"
    return f"""WITH RECURSIVE {_POS},
s AS (SELECT metric, r, value AS best, 0 AS waited FROM p WHERE r = 1
      UNION ALL SELECT p.metric, p.r, CASE WHEN {new} THEN p.value ELSE s.best END,
        CASE WHEN {new} THEN 0 ELSE s.waited + 1 END FROM s JOIN p ON p.metric = s.metric AND p.r = s.r + 1)
SELECT metric, min(r) AS stop_position FROM s WHERE waited >= 10 GROUP BY metric"""


@query("l07_early_stop_point", _stop_sql("min"))
def l07_early_stop_point(spark, sf):
    return ML.early_stop_point(_log(spark, sf), 10, 1e-4).select("metric", "stop_position")


@query("l07_early_stop_point_max", _stop_sql("max"))
def l07_early_stop_point_max(spark, sf):
    return ML.early_stop_point(_log(spark, sf), 10, 1e-4, mode="max").select("metric", "stop_position")


@query("l08_ratio_alarm", """
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, avg(value) FILTER (WHERE event_type = 'click') AS a,
             avg(value) FILTER (WHERE event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT bucket_start, round(a, 6) AS mean_a, round(b, 6) AS mean_b,
  CASE WHEN a > b * 3 THEN 'a_weak' WHEN b > a * 3 THEN 'b_weak' ELSE 'balanced' END AS stability,
  CASE WHEN a / (b + 1e-8) > 2.0 THEN 'raise_lr_a' WHEN a / (b + 1e-8) < 0.5 THEN 'raise_lr_b' ELSE 'none' END AS balance FROM w""")
def l08_ratio_alarm(spark, sf):
    r = ML.ratio_alarm(_log(spark, sf), "click", "view")
    return r.select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), r6("mean_a").alias("mean_a"),
                    r6("mean_b").alias("mean_b"), "stability", "balance")


@query("l09_metric_export", """
SELECT metric, value, timestamp FROM (
  SELECT 'value' AS metric, CAST(value AS DOUBLE) AS value, ts AS timestamp FROM events
  UNION ALL SELECT 'k', CAST(json_extract(props, '$.k') AS DOUBLE), ts FROM events)""")
def l09_metric_export(spark, sf):
    e = _events(spark, sf).select("ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return ML.export(e, "ts", ["value", "k"])


@query("l13_append_readings", """
SELECT event_type AS metric, CAST(count(*) AS BIGINT) AS readings FROM events GROUP BY event_type""")
def l13_append_readings(spark, sf):
    log = _log(spark, sf)
    first = log.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    second = log.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    appended = first.unionByName(second)  # log_batch: append a batch of readings
    return appended.groupBy("metric").agg(F.count(F.lit(1)).alias("readings"))


@query("l14_retention", f"""WITH {_POS},
k AS (SELECT *, CASE WHEN n <= 10000 THEN n ELSE 5000 + (n - 10001) % 5001 END AS held FROM p)
SELECT metric, CAST(count(*) AS BIGINT) AS kept, min(event_id) AS oldest_kept FROM k WHERE n - r < held GROUP BY metric""")
def l14_retention(spark, sf):
    kept = ML.retention(_log(spark, sf))
    return kept.groupBy("metric").agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("oldest_kept"))


@query("l15_best_so_far", f"""WITH {_POS},
m AS (SELECT *, min(value) OVER (PARTITION BY metric ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM p)
SELECT metric, event_id, pm IS NULL OR value < pm AS is_best FROM m""")
def l15_best_so_far(spark, sf):
    return ML.best_so_far(_log(spark, sf)).select("metric", "event_id", "is_best")


@query("l16_detection_stats", f"""WITH {_POS},
s AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, arg_max(value, (ts, event_id)) AS current FROM p GROUP BY metric),
t AS (SELECT metric, CASE WHEN count(*) >= 50 THEN coalesce(regr_slope(value, r), 0) ELSE 0 END AS trend FROM p
      WHERE n - r + 1 <= 50 GROUP BY metric)
SELECT metric, round(mean, 9) AS mean, round(std, 6) AS std, round(current, 6) AS current, round(trend, 9) AS trend
FROM s JOIN t USING (metric)""")
def l16_detection_stats(spark, sf):
    d = ML.detection_stats(_log(spark, sf))
    return d.select("metric", r6("mean", 9).alias("mean"), r6("std").alias("std"), r6("current").alias("current"),
                    r6("trend", 9).alias("trend"))
