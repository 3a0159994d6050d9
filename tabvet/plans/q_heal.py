"""Coupled groups, healing and scoring queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabvet.functions.hashing import hu_sql
from tabvet.operators import heal as HL
from tabvet.operators import integrity as I
from tabvet.operators import score as SC
from tabvet.plans.registry import query, r6
from tabvet.session import table

TWO_PI = 2 * math.pi


# --- fixtures ---------------------------------------------------------------------

def cyclic_fixture(spark, sf):
    """hour/month sin-cos pairs from events.ts, shrunk by 0.9 and zeroed on
    every 97th event, plus a generic pair with an inferred period."""
    e = table(spark, sf, "events")
    z = F.col("event_id") % 97 == 0
    h = TWO_PI * F.hour("ts") / 24.0
    m = TWO_PI * F.month("ts") / 12.0
    d = TWO_PI * (F.dayofweek("ts") - 1) / 7.0
    sc = lambda x: F.when(z, F.lit(0.0)).otherwise(0.9 * x)
    return e.select("event_id", sc(F.sin(h)).alias("hour_sin"), sc(F.cos(h)).alias("hour_cos"),
                    sc(F.sin(m)).alias("month_sin"), sc(F.cos(m)).alias("month_cos"),
                    F.sin(d).alias("wk_sin"), F.cos(d).alias("wk_cos"))


def _cyc_sql():
    def sc(x):
        return f"CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE 0.9 * {x} END"
    h, m, d = "2 * pi() * hour(ts) / 24.0", "2 * pi() * month(ts) / 12.0", "2 * pi() * dayofweek(ts) / 7.0"
    return f"""cy AS (SELECT event_id, {sc(f'sin({h})')} AS hour_sin, {sc(f'cos({h})')} AS hour_cos,
  {sc(f'sin({m})')} AS month_sin, {sc(f'cos({m})')} AS month_cos, sin({d}) AS wk_sin, cos({d}) AS wk_cos FROM events)"""


def onehot_fixture(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    zero, two = k % 13 == 0, k % 17 == 0
    return o.select("o_orderkey", *[F.when(zero, F.lit(0.0)).when(two & F.lit(s in ("F", "O")), F.lit(1.0))
                                    .otherwise((st == s).cast("double")).alias(f"status_{s}") for s in ("F", "O", "P")])


_OH_SQL = """oh AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderkey % 17 = 0 THEN 1.0 ELSE CAST(o_orderstatus = 'F' AS DOUBLE) END AS status_F,
  CASE WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderkey % 17 = 0 THEN 1.0 ELSE CAST(o_orderstatus = 'O' AS DOUBLE) END AS status_O,
  CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE CAST(o_orderstatus = 'P' AS DOUBLE) END AS status_P FROM orders)"""


def datetime_fixture(spark, sf):
    """d_year ... d_is_weekend raw components of o_orderdate (day pushed to
    31 for February orders with key % 5 = 0), z-scored with the table's
    own statistics."""
    o = table(spark, sf, "orders")
    t = F.col("o_orderdate")
    day = F.when((F.month(t) == 2) & (F.col("o_orderkey") % 5 == 0), F.lit(31)).otherwise(F.dayofmonth(t))
    raw = o.select("o_orderkey", F.year(t).cast("double").alias("d_year"), F.month(t).cast("double").alias("d_month"),
                   day.cast("double").alias("d_day"), F.hour(t).cast("double").alias("d_hour"),
                   F.weekday(t).cast("double").alias("d_dayofweek"), (F.weekday(t) >= 5).cast("double").alias("d_is_weekend"))
    return raw


# --- C18-C20 -------------------------------------------------------------------------

@query("c18_detect_groups", f"""WITH {_OH_SQL},
v AS (SELECT avg(CAST(status_F + status_O + status_P IN (0, 1) AS DOUBLE)) AS share FROM oh)
SELECT "column", group_id, kind, CAST(period AS DOUBLE) AS period, position FROM (VALUES ('hour_sin', 0, 'cyclic', 24.0, 0), ('hour_cos', 0, 'cyclic', 24.0, 1),
  ('month_sin', 1, 'cyclic', 12.0, 0), ('month_cos', 1, 'cyclic', 12.0, 1), ('wk_sin', 2, 'cyclic', 7.0, 0),
  ('wk_cos', 2, 'cyclic', 7.0, 1)) AS t("column", group_id, kind, period, position)
UNION ALL SELECT c, 3, 'onehot', CAST(NULL AS DOUBLE), p FROM (VALUES ('status_F', 0), ('status_O', 1), ('status_P', 2)) AS u(c, p), v
  WHERE share >= 0.85""")
def c18_detect_groups(spark, sf):
    cy = cyclic_fixture(spark, sf).drop("event_id")
    oh = onehot_fixture(spark, sf).drop("o_orderkey")
    groups = HL.detect_groups(cy) + HL.detect_groups(oh)
    return HL.groups_table(spark, groups).withColumn("period", F.col("period").cast("double"))


@query("c19_cyclic_period", f"""WITH {_cyc_sql()},
nm AS (SELECT avg(CAST(sqrt(wk_sin * wk_sin + wk_cos * wk_cos) >= 0.8 AS DOUBLE)) AS m FROM cy),
a AS (SELECT DISTINCT round(atan2(wk_sin, wk_cos), 2) AS a FROM cy),
g AS (SELECT min(nx - a) AS step FROM (SELECT a, lead(a) OVER (ORDER BY a) AS nx FROM a) WHERE nx IS NOT NULL),
e AS (SELECT 2 * pi() / step AS est FROM g)
SELECT CASE WHEN abs(est - 7) / 7 < 0.25 THEN 7.0 WHEN abs(est - 12) / 12 < 0.25 THEN 12.0 WHEN abs(est - 24) / 24 < 0.25 THEN 24.0
  WHEN abs(est - 31) / 31 < 0.25 THEN 31.0 WHEN abs(est - 52) / 52 < 0.25 THEN 52.0 WHEN abs(est - 60) / 60 < 0.25 THEN 60.0
  WHEN abs(est - 365) / 365 < 0.25 THEN 365.0 ELSE round(est, 1) END AS period FROM e, nm WHERE m >= 0.5""")
def c19_cyclic_period(spark, sf):
    cy = cyclic_fixture(spark, sf)
    return HL.cyclic_period(cy, "wk_sin", "wk_cos")


@query("c20_group_lookup", """
SELECT * FROM (VALUES ('hour_sin', 0, 'cyclic', true, true), ('hour_cos', 0, 'cyclic', true, true),
  ('month_sin', 1, 'cyclic', true, true), ('month_cos', 1, 'cyclic', true, true), ('wk_sin', 2, 'cyclic', true, true),
  ('wk_cos', 2, 'cyclic', true, true), ('event_id', NULL, NULL, false, false))
  AS t("column", group_id, kind, is_coupled, is_cyclic_channel)""")
def c20_group_lookup(spark, sf):
    cy = cyclic_fixture(spark, sf)
    groups = HL.detect_groups(cy.drop("event_id"))
    cols = spark.createDataFrame([(c,) for c in cy.columns], "column string")
    return HL.group_lookup(cols, HL.groups_table(spark, groups).select("column", "group_id", "kind"))


# --- G1-G7 ------------------------------------------------------------------------------

def _proj_sql(s, c, period):
    n = f"sqrt({s} * {s} + {c} * {c})"
    fb = 0.0 if period is None else TWO_PI / period
    sn = f"(CASE WHEN {n} < 1e-8 THEN {math.sin(fb)!r} ELSE {s} / {n} END)"
    cn = f"(CASE WHEN {n} < 1e-8 THEN {math.cos(fb)!r} ELSE {c} / {n} END)"
    if period is None:
        return sn, cn
    step = TWO_PI / period
    snapped = f"(round_even(atan2({sn}, {cn}) / {step!r}, 0) * {step!r})"
    return f"sin({snapped})", f"cos({snapped})"


@query("g01_unit_circle_projection", f"""WITH {_cyc_sql()}
SELECT event_id, round({_proj_sql('hour_sin', 'hour_cos', None)[0]}, 6) AS hour_sin,
  round({_proj_sql('hour_sin', 'hour_cos', None)[1]}, 6) AS hour_cos FROM cy""")
def g01_unit_circle_projection(spark, sf):
    cy = cyclic_fixture(spark, sf)
    s, c = HL.cyclic_projection(F.col("hour_sin"), F.col("hour_cos"), None)
    return cy.select("event_id", r6(s).alias("hour_sin"), r6(c).alias("hour_cos"))


@query("g02_snap_angle", f"""WITH {_cyc_sql()}
SELECT event_id, round({_proj_sql('month_sin', 'month_cos', 12.0)[0]}, 6) AS month_sin,
  round({_proj_sql('month_sin', 'month_cos', 12.0)[1]}, 6) AS month_cos FROM cy""")
def g02_snap_angle(spark, sf):
    cy = cyclic_fixture(spark, sf)
    s, c = HL.cyclic_projection(F.col("month_sin"), F.col("month_cos"), 12.0)
    return cy.select("event_id", r6(s).alias("month_sin"), r6(c).alias("month_cos"))


def _oh_proj_sql(mode):
    arr = "[status_F, status_O, status_P]"
    idx = f"CASE WHEN list_max({arr}) <= 0 THEN {mode + 1} ELSE list_position({arr}, list_max({arr})) END"
    return ", ".join(f"CAST(({idx}) = {i + 1} AS DOUBLE) AS status_{s}" for i, s in enumerate("FOP"))


_MODE_SQL = """mode AS (SELECT CASE WHEN sf >= so AND sf >= sp THEN 0 WHEN so >= sp THEN 1 ELSE 2 END AS m
  FROM (SELECT sum(CAST(o_orderstatus = 'F' AS DOUBLE)) AS sf, sum(CAST(o_orderstatus = 'O' AS DOUBLE)) AS so,
        sum(CAST(o_orderstatus = 'P' AS DOUBLE)) AS sp FROM orders))"""


def _reference_onehot(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(*[(F.col("o_orderstatus") == s).cast("double").alias(f"status_{s}") for s in "FOP"])


@query("g04_onehot_mode", f"WITH {_MODE_SQL} SELECT CAST(m AS INTEGER) AS mode_index FROM mode")
def g04_onehot_mode(spark, sf):
    ref = _reference_onehot(spark, sf)
    m = HL.onehot_mode_index(ref, ["status_F", "status_O", "status_P"])
    return ref.agg(F.count(F.lit(1)).alias("_n")).select(F.lit(m).cast("int").alias("mode_index"))


@query("g03_onehot_projection", f"""WITH {_OH_SQL}, {_MODE_SQL}
SELECT o_orderkey, {_oh_proj_sql(0).replace('THEN 1 ELSE', 'THEN m + 1 ELSE')} FROM oh, mode""")
def g03_onehot_projection(spark, sf):
    oh = onehot_fixture(spark, sf)
    mode = HL.onehot_mode_index(_reference_onehot(spark, sf), ["status_F", "status_O", "status_P"])
    proj = HL.onehot_projection([F.col(f"status_{s}") for s in "FOP"], mode)
    return oh.select("o_orderkey", *[p.alias(f"status_{s}") for p, s in zip(proj, "FOP")])


_DT_RAW = """dr AS (SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS d_year, CAST(month(o_orderdate) AS DOUBLE) AS d_month,
  CAST(CASE WHEN month(o_orderdate) = 2 AND o_orderkey % 5 = 0 THEN 31 ELSE day(o_orderdate) END AS DOUBLE) AS d_day,
  CAST(hour(o_orderdate) AS DOUBLE) AS d_hour, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS d_dayofweek,
  CAST(isodow(o_orderdate) - 1 >= 5 AS DOUBLE) AS d_is_weekend FROM orders)"""

_DT_COMPS = ["year", "month", "day", "hour", "dayofweek", "is_weekend"]


@query("g06_datetime_stats", f"""WITH {_DT_RAW}
SELECT {', '.join(f"round(avg(d_{c}), 6) AS mean_{c}, round(CASE WHEN stddev_samp(d_{c}) > 1e-8 THEN stddev_samp(d_{c}) ELSE 1.0 END, 6) AS std_{c}" for c in _DT_COMPS)},
  CAST(floor(quantile_cont(d_year, 0.5)) AS INTEGER) || '-01-01' AS median_ts FROM dr""")
def g06_datetime_stats(spark, sf):
    raw = datetime_fixture(spark, sf)
    g = HL.Group("datetime", tuple(f"d_{c}" for c in _DT_COMPS))
    stats, med = HL.datetime_stats(raw, g)
    cols = []
    for c in _DT_COMPS:
        m, s = stats[c]
        cols += [F.lit(round(m, 6)).alias(f"mean_{c}"), F.lit(round(s, 6)).alias(f"std_{c}")]
    return raw.agg(F.count(F.lit(1)).alias("_n")).select(*cols, F.lit(med).alias("median_ts"))


@query("g05_datetime_projection", f"""WITH {_DT_RAW},
st AS (SELECT {', '.join(f"avg(d_{c}) AS m_{c}, CASE WHEN stddev_samp(d_{c}) > 1e-8 THEN stddev_samp(d_{c}) ELSE 1.0 END AS s_{c}" for c in _DT_COMPS)},
         CAST(floor(quantile_cont(d_year, 0.5)) AS INTEGER) AS my FROM dr),
z AS (SELECT o_orderkey, {', '.join(f"(d_{c} - m_{c}) / s_{c} AS z_{c}" for c in _DT_COMPS)} FROM dr, st),
rw AS (SELECT o_orderkey, least(greatest(round_even(z_year * s_year + m_year, 0), 1970), 2100) AS y,
         least(greatest(round_even(z_month * s_month + m_month, 0), 1), 12) AS mo,
         least(greatest(round_even(z_day * s_day + m_day, 0), 1), 31) AS dd,
         least(greatest(round_even(z_hour * s_hour + m_hour, 0), 0), 23) AS hh FROM z, st),
cl AS (SELECT o_orderkey, y, mo, CASE WHEN mo = 2 THEN least(dd, 28) WHEN mo IN (4, 6, 9, 11) THEN least(dd, 30) ELSE dd END AS dd, hh FROM rw),
ts AS (SELECT o_orderkey, coalesce(try_cast(make_timestamp(CAST(y AS BIGINT), CAST(mo AS BIGINT), CAST(dd AS BIGINT), CAST(hh AS BIGINT), 0, 0) AS TIMESTAMP),
          make_timestamp((SELECT my FROM st), 1, 1, 0, 0, 0)) AS t FROM cl)
SELECT o_orderkey, round((year(t) - m_year) / s_year, 6) AS d_year, round((month(t) - m_month) / s_month, 6) AS d_month,
  round((day(t) - m_day) / s_day, 6) AS d_day, round((hour(t) - m_hour) / s_hour, 6) AS d_hour,
  round((isodow(t) - 1 - m_dayofweek) / s_dayofweek, 6) AS d_dayofweek,
  round((CAST(isodow(t) - 1 >= 5 AS DOUBLE) - m_is_weekend) / s_is_weekend, 6) AS d_is_weekend FROM ts, st""")
def g05_datetime_projection(spark, sf):
    raw = datetime_fixture(spark, sf)
    g = HL.Group("datetime", tuple(f"d_{c}" for c in _DT_COMPS))
    stats, med = HL.datetime_stats(raw, g)
    z = raw.select("o_orderkey", *[((F.col(f"d_{c}") - stats[c][0]) / stats[c][1]).alias(f"d_{c}") for c in _DT_COMPS])
    proj = HL.datetime_projection(list(g.columns), stats, med)
    return z.select("o_orderkey", *[r6(proj[f"d_{c}"]).alias(f"d_{c}") for c in _DT_COMPS])


@query("g07_repair_groups", f"""WITH {_cyc_sql()}
SELECT event_id, round({_proj_sql('hour_sin', 'hour_cos', 24.0)[0]}, 6) AS hour_sin,
  round({_proj_sql('hour_sin', 'hour_cos', 24.0)[1]}, 6) AS hour_cos,
  round({_proj_sql('month_sin', 'month_cos', 12.0)[0]}, 6) AS month_sin,
  round({_proj_sql('month_sin', 'month_cos', 12.0)[1]}, 6) AS month_cos,
  round({_proj_sql('wk_sin', 'wk_cos', 7.0)[0]}, 6) AS wk_sin, round({_proj_sql('wk_sin', 'wk_cos', 7.0)[1]}, 6) AS wk_cos FROM cy""")
def g07_repair_groups(spark, sf):
    cy = cyclic_fixture(spark, sf)
    groups = HL.detect_groups(cy.drop("event_id"))
    out = HL.repair_groups(cy, groups)
    return out.select("event_id", *[r6(c).alias(c) for c in out.columns if c != "event_id"])


@query("g08_heal_batch", f"""WITH {_OH_SQL}, ref AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM oh
  WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0),
mode AS (SELECT CASE WHEN f >= o AND f >= p THEN 0 WHEN o >= p THEN 1 ELSE 2 END AS m
  FROM (SELECT sum(status_F) AS f, sum(status_O) AS o, sum(status_P) AS p FROM ref)),
pick AS (SELECT oh.*, status_F + status_O + status_P <> 1 AS bad,
  CAST(floor({hu_sql('13:0', 'o_orderkey')} * (SELECT count(*) FROM ref)) AS BIGINT) + 1 AS r FROM oh),
h AS (SELECT pick.o_orderkey, {', '.join(f"CASE WHEN bad THEN ref.status_{s} ELSE pick.status_{s} END AS status_{s}" for s in 'FOP')}
  FROM pick LEFT JOIN ref USING (r))
SELECT o_orderkey, {_oh_proj_sql(0).replace('THEN 1 ELSE', 'THEN m + 1 ELSE')} FROM h, mode""")
def g08_heal_batch(spark, sf):
    oh = onehot_fixture(spark, sf)
    ref = onehot_fixture(spark, sf).filter((F.col("o_orderkey") % 13 != 0) & (F.col("o_orderkey") % 17 != 0))
    groups = [HL.Group("onehot", ("status_F", "status_O", "status_P"))]
    ssum = F.col("status_F") + F.col("status_O") + F.col("status_P")
    out = HL.heal_batch(oh, groups, ref, {0: ssum != 1.0}, key="o_orderkey")
    return out


# --- G9-G12 and H: banking fixture ------------------------------------------------

def bank_pair(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    v = c.select(
        F.when(seg == "BUILDING", "savings").when(seg == "AUTOMOBILE", "checking")
        .when(seg == "MACHINERY", "business").when(seg == "HOUSEHOLD", "cd").otherwise("loan").alias("account_type"),
        F.when(F.col("c_nationkey") < 12, "north").otherwise("south").alias("region"),
        (F.lit(10) + F.col("c_nationkey") * 4).alias("age"), F.col("c_acctbal").alias("balance"),
        F.col("c_custkey").alias("customer_id"))
    return v.filter(F.col("customer_id") % 2 == 0), v.filter(F.col("customer_id") % 2 == 1)


_BANK = """bank AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'savings' WHEN 'AUTOMOBILE' THEN 'checking'
    WHEN 'MACHINERY' THEN 'business' WHEN 'HOUSEHOLD' THEN 'cd' ELSE 'loan' END AS account_type,
  CASE WHEN c_nationkey < 12 THEN 'north' ELSE 'south' END AS region, 10 + c_nationkey * 4 AS age, c_acctbal AS balance,
  c_custkey AS customer_id FROM customer),
ref AS (SELECT * FROM bank WHERE customer_id % 2 = 0), syn AS (SELECT * FROM bank WHERE customer_id % 2 = 1)"""

_CTX = """s12 AS (SELECT account_type, region, quantile_cont(age, 0.5) AS med FROM ref GROUP BY account_type, region),
s1 AS (SELECT account_type, quantile_cont(age, 0.5) AS med FROM ref GROUP BY account_type),
s2 AS (SELECT region, quantile_cont(age, 0.5) AS med FROM ref GROUP BY region),
s0 AS (SELECT quantile_cont(age, 0.5) AS med, min(age) AS mn, max(age) AS mx FROM ref),
healed AS (SELECT syn.customer_id, syn.account_type, syn.region, syn.balance, syn.age AS age0,
  NOT coalesce(syn.age BETWEEN 18 AND 100, false) AS viol,
  CASE WHEN NOT coalesce(syn.age BETWEEN 18 AND 100, false)
       THEN CAST(round_even(least(greatest(coalesce(s12.med, s1.med, s2.med, s0.med), s0.mn), s0.mx), 0) AS INTEGER)
       ELSE syn.age END AS age
  FROM syn LEFT JOIN s12 USING (account_type, region) LEFT JOIN s1 USING (account_type) LEFT JOIN s2 USING (region), s0)"""


def _hard_soft():
    hs = I.HardSoftRules()
    hs.add_rule("adult_age", "age BETWEEN 18 AND 100", ["age"])
    hs.add_rule("balance_score", lambda d: F.least(F.greatest(F.col("balance") / 10000.0, F.lit(0.0)), F.lit(1.0)),
                ["balance"], rule_type="soft")
    return hs


@query("g09_contextual_heal", f"WITH {_BANK}, {_CTX} SELECT customer_id, age, viol AS healed FROM healed")
def g09_contextual_heal(spark, sf):
    ref, syn = bank_pair(spark, sf)
    viol = ~F.coalesce(F.col("age").between(18, 100), F.lit(False))
    h = HL.contextual_heal(syn, ref, "age", viol, ["age"], key="customer_id", jitter=0.0)
    return h.select("customer_id", F.col("age").cast("int").alias("age"), F.col("_healed_age").alias("healed"))


@query("g10_onehot_winner", f"""WITH {_OH_SQL}
SELECT o_orderkey, {', '.join(f"CASE WHEN o_orderkey % 17 = 0 THEN CAST(list_position([status_F, status_O, status_P], list_max([status_F, status_O, status_P])) = {i + 1} AS DOUBLE) ELSE status_{s} END AS status_{s}" for i, s in enumerate('FOP'))} FROM oh""")
def g10_onehot_winner(spark, sf):
    oh = onehot_fixture(spark, sf)
    return HL.onehot_winner(oh, "status", F.col("o_orderkey") % 17 == 0)


@query("g11_heal_confidence", f"""WITH {_BANK}, {_CTX},
c AS (SELECT customer_id, CASE WHEN viol THEN 1 ELSE 0 END AS nb, CASE WHEN NOT coalesce(age BETWEEN 18 AND 100, false) THEN 1 ELSE 0 END AS na,
        least(greatest(balance / 10000.0, 0), 1) AS soft FROM healed)
SELECT customer_id, round(CASE WHEN nb = 0 THEN 1.0 ELSE greatest(least(1.0, (nb - na) / greatest(nb, 1) * 0.7 + soft * 0.3), 0) END, 6)
  AS heal_confidence FROM c""")
def g11_heal_confidence(spark, sf):
    ref, syn = bank_pair(spark, sf)
    hs = _hard_soft()
    before = hs.check(syn).select("customer_id", F.col("violations").alias("v0"))
    viol = ~F.coalesce(F.col("age").between(18, 100), F.lit(False))
    healed = HL.contextual_heal(syn, ref, "age", viol, ["age"], key="customer_id").drop("_healed_age")
    after = hs.check(healed).select("customer_id", F.col("violations").alias("v1"), "soft_score")
    j = before.join(after, "customer_id")
    return j.select("customer_id", r6(HL.heal_confidence(F.col("v0"), F.col("v1"), F.col("soft_score"))).alias("heal_confidence"))


@query("g12_nonnegative_integer", """
SELECT o_orderkey, greatest(0, CAST(round_even(o_totalprice / 1000.0 - 100, 0) AS BIGINT)) AS price_k FROM orders""")
def g12_nonnegative_integer(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000.0 - 100).alias("price_k"))
    return HL.nonnegative_integer(o, ["price_k"])


# --- H1-H10 -----------------------------------------------------------------------------

@query("h01_prior", f"""WITH {_BANK}
SELECT account_type AS v, round(count(*) / (SELECT count(*) FROM ref), 9) AS p FROM ref GROUP BY account_type""")
def h01_prior(spark, sf):
    ref, _ = bank_pair(spark, sf)
    return SC.prior(ref, "account_type").select("v", r6("p", 9).alias("p"))


@query("h02_conditional", f"""WITH {_BANK}
SELECT account_type AS p0, CAST(age AS BIGINT) AS v, round(count(*) / sum(count(*)) OVER (PARTITION BY account_type), 9) AS p,
  round(count(*) / (SELECT count(*) FROM ref), 9) AS joint FROM ref GROUP BY account_type, age""")
def h02_conditional(spark, sf):
    ref, _ = bank_pair(spark, sf)
    c = SC.conditional(ref, "age", ["account_type"])
    j = SC.conditional(ref, "age", ["account_type"], joint=True).withColumnRenamed("p", "joint")
    return c.join(j, ["p0", "v"]).select("p0", F.col("v").cast("bigint"), r6("p", 9).alias("p"), r6("joint", 9).alias("joint"))


@query("h03_bdeu", f"""WITH {_BANK},
cells AS (SELECT account_type, age, count(*) AS n FROM ref GROUP BY account_type, age),
cfg AS (SELECT account_type, count(*) AS nj FROM ref GROUP BY account_type),
qr AS (SELECT count(DISTINCT account_type) AS q, count(DISTINCT age) AS r FROM ref)
SELECT s.customer_id, round((coalesce(n, 0) + 5.0 / (q * r)) / (coalesce(nj, 0) + 5.0 / q), 9) AS p_bdeu
FROM syn s LEFT JOIN cells USING (account_type, age) LEFT JOIN cfg USING (account_type), qr""")
def h03_bdeu(spark, sf):
    ref, syn = bank_pair(spark, sf)
    model = SC.bdeu(ref, "age", ["account_type"])
    d = SC.attach_bdeu(syn, "age", ["account_type"], model)
    return d.select("customer_id", r6(SC.bdeu_probability(d, "age", ["account_type"], model), 9).alias("p_bdeu"))


_LIK = """pr AS (SELECT account_type, count(*) / (SELECT count(*) FROM ref) AS p FROM ref GROUP BY account_type),
cd AS (SELECT account_type, age, count(*) / sum(count(*)) OVER (PARTITION BY account_type) AS p FROM ref GROUP BY account_type, age),
lik AS (SELECT s.customer_id, least(greatest(exp((ln(greatest(coalesce(pr.p, 1e-5), 1e-10)) + ln(greatest(coalesce(cd.p, 1e-5), 1e-10))) / 2), 0), 1) AS p
        FROM syn s LEFT JOIN pr USING (account_type) LEFT JOIN cd USING (account_type, age))"""


def _bayes(ref):
    return SC.BayesianScorer([("account_type", "age")]).fit(ref)


@query("h04_row_likelihood", f"WITH {_BANK}, {_LIK} SELECT customer_id, round(p, 9) AS row_probability FROM lik")
def h04_row_likelihood(spark, sf):
    ref, syn = bank_pair(spark, sf)
    return _bayes(ref).score(syn).select("customer_id", r6("row_probability", 9).alias("row_probability"))


_ENT = """cat AS (SELECT account_type, count(*) / (SELECT count(*) FROM ref) AS p FROM ref GROUP BY account_type),
reg AS (SELECT region, count(*) / (SELECT count(*) FROM ref) AS p FROM ref GROUP BY region),
ast AS (SELECT avg(age) AS am, stddev_samp(age) AS asd FROM ref),
bst AS (SELECT avg(balance) AS m, stddev_samp(balance) AS s FROM ref),
ent AS (SELECT syn.customer_id, (
   CASE WHEN coalesce(cat.p, 0) = 0 THEN 0.3 WHEN cat.p < 0.01 THEN 0.6 ELSE least(1.0, -ln(cat.p) / 5) END
 + CASE WHEN coalesce(reg.p, 0) = 0 THEN 0.3 WHEN reg.p < 0.01 THEN 0.6 ELSE least(1.0, -ln(reg.p) / 5) END
 + CASE WHEN abs((age - am) / (asd + 1e-10)) < 1 THEN 1.0 WHEN abs((age - am) / (asd + 1e-10)) < 2 THEN 0.8
        WHEN abs((age - am) / (asd + 1e-10)) < 3 THEN 0.6 ELSE 0.3 END
 + CASE WHEN abs((balance - m) / (s + 1e-10)) < 1 THEN 1.0 WHEN abs((balance - m) / (s + 1e-10)) < 2 THEN 0.8
        WHEN abs((balance - m) / (s + 1e-10)) < 3 THEN 0.6 ELSE 0.3 END) / 4.0 AS e
  FROM syn LEFT JOIN cat USING (account_type) LEFT JOIN reg USING (region), ast, bst)"""

_ENT_COLS = ["account_type", "region", "age", "balance"]


@query("h05_entropy_score", f"WITH {_BANK}, {_ENT} SELECT customer_id, round(e, 9) AS entropy_score FROM ent")
def h05_entropy_score(spark, sf):
    ref, syn = bank_pair(spark, sf)
    es = SC.EntropyScorer().fit(ref, _ENT_COLS)
    return es.score(syn.select("customer_id", *_ENT_COLS)).select("customer_id", r6("entropy_score", 9).alias("entropy_score"))


_CONF = """conf AS (SELECT customer_id, least(greatest(0.2 * least(lik.p * 10, 1.0)
  + 0.5 * least(greatest(balance / 10000.0, 0), 1) + 0.3 * e - 0.05 * least(1.0, 0 * 0.08), 0), 1) AS c
  FROM syn JOIN lik USING (customer_id) JOIN ent USING (customer_id))"""


@query("h06_confidence", f"WITH {_BANK}, {_LIK}, {_ENT}, {_CONF} SELECT customer_id, round(c, 9) AS confidence FROM conf")
def h06_confidence(spark, sf):
    ref, syn = bank_pair(spark, sf)
    s = _bayes(ref).score(syn.select("customer_id", *_ENT_COLS), "p")
    s = SC.EntropyScorer().fit(ref, _ENT_COLS).score(s, "e")
    soft = F.least(F.greatest(F.col("balance") / 10000.0, F.lit(0.0)), F.lit(1.0))
    return s.select("customer_id", r6(SC.confidence(F.col("p"), soft, F.col("e"), F.lit(0)), 9).alias("confidence"))


@query("h07_triage", f"""WITH {_BANK}, {_LIK}, {_ENT}, {_CONF}
SELECT customer_id, CASE WHEN c >= 0.5 THEN 'valid' ELSE 'discarded' END AS status FROM conf""")
def h07_triage(spark, sf):
    ref, syn = bank_pair(spark, sf)
    s = _bayes(ref).score(syn.select("customer_id", *_ENT_COLS), "p")
    s = SC.EntropyScorer().fit(ref, _ENT_COLS).score(s, "e")
    soft = F.least(F.greatest(F.col("balance") / 10000.0, F.lit(0.0)), F.lit(1.0))
    conf = SC.confidence(F.col("p"), soft, F.col("e"), F.lit(0))
    return s.select("customer_id", SC.triage(conf, F.lit(0), 0.5).alias("status"))


def _vah(spark, sf, strategy="conservative"):
    ref, syn = bank_pair(spark, sf)
    return SC.validate_and_heal(syn, ref, _hard_soft(), "customer_id", {"adult_age": ["age"]}, _bayes(ref),
                                SC.EntropyScorer().fit(ref, _ENT_COLS), count_like=["age"], threshold=0.5,
                                strategy=strategy)


@query("h08_validate_and_heal")
def h08_validate_and_heal(spark, sf):
    out = _vah(spark, sf, "aggressive")
    return out.select("customer_id", "account_type", "region", "age", r6("balance").alias("balance"), "status")


@query("h09_health_score")
def h09_health_score(spark, sf):
    return SC.health_report(_vah(spark, sf)).withColumn("health_score", r6("health_score"))


@query("h10_audit_trail")
def h10_audit_trail(spark, sf):
    t = _vah(spark, sf)
    return t.select("customer_id", "status", r6("confidence").alias("confidence"),
                    r6("entropy_score").alias("entropy_score"), "violations", "corrections")
