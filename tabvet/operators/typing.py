"""Semantic typing of columns.

Every decision tree is a ``CASE WHEN`` over a small per-column fact table
produced by the profiling jobs (one row per column), so typing k columns
costs the profiling scans only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.session import cut_lineage
from tabvet.operators import profile as P
from tabvet.operators.powerlaw import power_laws
from tabvet.operators.tails import tail_behavior

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _is_numeric(dt) -> bool:
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)


def dtype_facts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Driver-side schema facts as a tiny table (one row per column)."""
    rows = []
    for c in cols:
        dt = df.schema[c].dataType
        rows.append((c, _is_numeric(dt), isinstance(dt, T.IntegralType), isinstance(dt, _TEMPORAL),
                     isinstance(dt, T.BooleanType)))
    return df.sparkSession.createDataFrame(
        rows, "feature string, is_numeric boolean, is_integral boolean, is_temporal_type boolean, is_bool boolean")


def column_facts(df: DataFrame, cols: list[str]) -> DataFrame:
    """nunique, rows, non-null, uniqueness, normalised entropy, min/max
    (numeric) per column: one LONG count job + one numeric agg."""
    counts = P.category_counts(df, cols)
    stats = P.categorical_stats(counts).select("feature", "unique_count", "uniqueness", "norm_entropy",
                                               F.col("n").alias("non_null"))
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    facts = dtype_facts(df, cols)
    num = [c for c in cols if _is_numeric(df.schema[c].dataType)]
    out = F.broadcast(facts).join(stats, "feature", "left")
    if num:
        mm = P.to_long(df, num).groupBy("feature").agg(F.min("v").alias("min"), F.max("v").alias("max"))
        out = out.join(F.broadcast(mm), "feature", "left")
    else:
        out = out.withColumn("min", F.lit(None).cast("double")).withColumn("max", F.lit(None).cast("double"))
    return _attach_scalar(out, rows)


def _attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row via a broadcast key join."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one_row.withColumn("_k", F.lit(1))), "_k").drop("_k")


# C3 ------------------------------------------------------------------------

def semantic_types(df: DataFrame, cols: list[str], temporal: DataFrame | None = None,
                   id_threshold: float = 0.95, entropy_threshold: float = 0.8,
                   categorical_max: int = 50, high_cardinality: int = 100) -> DataFrame:
    """INVARIANT -> TEMPORAL -> BINARY -> IDENTIFIER -> CATEGORICAL/CONTINUOUS."""
    f = column_facts(df, cols)
    if temporal is not None:
        f = f.join(F.broadcast(temporal.select("feature", F.col("is_temporal").alias("_tmp"))), "feature", "left")
        tmp = F.coalesce(F.col("_tmp"), F.lit(False))
    else:
        tmp = F.col("is_temporal_type") | (F.col("is_numeric") & (F.col("min") > 1e9) & (F.col("max") < 2e9))
    k = F.coalesce(F.col("unique_count"), F.lit(0))
    u, h = F.col("uniqueness"), F.col("norm_entropy")
    num = F.col("is_numeric")
    st = (F.when(k <= 1, "INVARIANT")
          .when(tmp, "TEMPORAL")
          .when(k == 2, "BINARY")
          .when((u > id_threshold) & num & F.col("is_integral"),
                F.when(h > 0.95, "IDENTIFIER").otherwise("CONTINUOUS"))
          .when((u > id_threshold) & num, "CONTINUOUS")
          .when(u > id_threshold, "IDENTIFIER")
          .when(num, F.when((k < categorical_max) & (h < entropy_threshold), "CATEGORICAL").otherwise("CONTINUOUS"))
          .when(k < high_cardinality, "CATEGORICAL")
          .otherwise("IDENTIFIER"))
    return f.select("feature", st.alias("semantic_type"))


# C4 ------------------------------------------------------------------------

def feature_schema(df: DataFrame, cols: list[str]) -> DataFrame:
    """Schema inference: numeric and not low-cardinality -> continuous
    (robust scaling, min/max, dim 1); temporal type or 'date' in the name
    -> datetime (dim 6); else categorical, one-hot below 25 values (dim
    max(2, k)) or label (dim 1), default '__MISSING__'."""
    f = column_facts(df, cols)
    k, n = F.coalesce(F.col("unique_count"), F.lit(0)), F.col("n_rows")
    low = (k < 15) | ((k / n < 0.01) & (k < 50))
    cont = F.col("is_numeric") & ~low
    # a text column whose name says 'date' is datetime only if all its
    # values parse; the name test is applied to typed columns directly
    dated = F.col("is_temporal_type") | (F.lower(F.col("feature")).contains("date") & F.col("_parses"))
    parses = _name_date_parse(df, cols)
    f = f.join(F.broadcast(parses), "feature", "left").fillna(False, ["_parses"])
    ftype = F.when(cont, "continuous").when(dated, "datetime").otherwise("categorical")
    enc = F.when(ftype == "categorical", F.when(k < 25, "onehot").otherwise("label"))
    dim = (F.when(ftype == "continuous", 1).when(ftype == "datetime", 6)
           .when(k < 25, F.greatest(F.lit(2), k)).otherwise(1))
    return f.select("feature", ftype.alias("feature_type"),
                    F.when(ftype == "continuous", F.coalesce(F.col("min"), F.lit(0.0))).alias("min_value"),
                    F.when(ftype == "continuous", F.coalesce(F.col("max"), F.lit(1.0))).alias("max_value"),
                    F.when(ftype == "continuous", F.lit("robust")).alias("scaling"),
                    enc.alias("encoding"), dim.cast("int").alias("output_dim"),
                    F.when(ftype == "categorical", F.lit("__MISSING__")).alias("default_value"))


def _name_date_parse(df: DataFrame, cols: list[str]) -> DataFrame:
    spark = df.sparkSession
    parts = []
    for c in cols:
        dt = df.schema[c].dataType
        if "date" in c.lower() and isinstance(dt, T.StringType):
            s = F.col(f"`{c}`")
            parts.append((c, F.coalesce(F.bool_and(s.isNull() | F.try_to_timestamp(s).isNotNull()), F.lit(True))))
    if not parts:
        return spark.createDataFrame([], "feature string, _parses boolean")
    one = df.agg(*[p.alias(f"p{i}") for i, (_, p) in enumerate(parts)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"p{i}").alias("_parses"))
                                         for i, (c, _) in enumerate(parts)])))


# C5, C6 ---------------------------------------------------------------------

def relationship_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """binary (2 values) / numerical / categorical (< 50 % distinct) /
    categorical_high_cardinality."""
    f = column_facts(df, cols)
    k = F.coalesce(F.col("unique_count"), F.lit(0))
    t = (F.when(k == 2, "binary").when(F.col("is_numeric"), "numerical")
         .when(k < F.col("n_rows") * 0.5, "categorical").otherwise("categorical_high_cardinality"))
    return f.select("feature", t.alias("relationship_type"))


def cli_metadata(df: DataFrame, cols: list[str]) -> DataFrame:
    """numeric -> continuous with min/max; else categorical with cardinality."""
    f = column_facts(df, cols)
    t = F.when(F.col("is_numeric"), "continuous").otherwise("categorical")
    return f.select("feature", t.alias("type"),
                    F.when(F.col("is_numeric"), F.col("min")).alias("min"),
                    F.when(F.col("is_numeric"), F.col("max")).alias("max"),
                    F.when(~F.col("is_numeric"), F.col("unique_count")).alias("cardinality"))


# C1, C2 ---------------------------------------------------------------------

def deep_types(df: DataFrame, cols: list[str], strict: bool = False, alpha: float = 0.05) -> DataFrame:
    """Deep-type decision tree.  Numeric columns: integer -> DISCRETE_UNIFORM;
    multimodal; gaussian (Jarque-Bera re-aim or KS p > alpha); heavy tail;
    cyclic; default CONTINUOUS_MULTIMODAL.  Text: ORDINAL / LOW (<10) / HIGH
    cardinality.  Integers of 20 values or more, heavy tails and categories of
    high cardinality become their power-law types where B20 and B21 accept
    the frequencies of the values.  ``strict=False`` tests cyclicity before
    the integer branch (SURVEY Q2)."""
    num = [c for c in cols if _is_numeric(df.schema[c].dataType)]
    txt = [c for c in cols if c not in num]
    out = None
    if num:
        prof = P.numeric_profile(df, num)
        ks = P.ks_normal(df, num).select("feature", "ks_p_value")
        jb = P.jarque_bera(prof).select("feature", "is_gaussian")
        mm = P.multimodality(df, num).select("feature", "is_multimodal")
        tail = tail_behavior(df, num).select("feature", "tail_behavior")
        cyc = P.cyclicity(prof)
        j = prof.join(ks, "feature").join(jb, "feature").join(mm, "feature").join(tail, "feature").join(cyc, "feature")
        cyclic_first = F.lit(not strict) & F.col("is_cyclic")
        t = (F.when(cyclic_first, "CYCLIC")
             .when(F.col("is_integer"), "DISCRETE_UNIFORM")
             .when(F.col("is_multimodal"), "CONTINUOUS_MULTIMODAL")
             .when(F.col("is_gaussian") | (F.col("ks_p_value") > alpha), "CONTINUOUS_GAUSSIAN")
             .when(F.col("tail_behavior") == "HEAVY_TAILED", "CONTINUOUS_HEAVY_TAILED")
             .when(F.col("is_cyclic"), "CYCLIC")
             .otherwise("CONTINUOUS_MULTIMODAL"))
        out = j.select("feature", F.lit(True).alias("is_numeric"), t.alias("deep_type"), "unique_count")
    if txt:
        cp = P.categorical_profile(df, txt).select("feature", "unique_count")
        orde = P.ordinality(df, txt).select("feature", "is_ordinal")
        j = cp.join(orde, "feature")
        t = (F.when(F.col("is_ordinal"), "ORDINAL").when(F.col("unique_count") < 10, "CATEGORICAL_LOW_CARDINALITY")
             .otherwise("CATEGORICAL_HIGH_CARDINALITY"))
        part = j.select("feature", F.lit(False).alias("is_numeric"), t.alias("deep_type"), "unique_count")
        out = part if out is None else out.unionByName(part)
    out = cut_lineage(out)
    # one row per column comes back; only the columns that the test applies to are fitted, all at once
    asked = [r["feature"] for r in out.collect() if r["deep_type"] in POWER_LAW_TYPES and r["unique_count"] >= 20]
    if asked:
        laws = power_laws(df, asked).filter("is_power_law").select("feature", F.lit(True).alias("_law"))
        other = F.create_map(*[F.lit(x) for pair in POWER_LAW_TYPES.items() for x in pair])
        out = (out.join(F.broadcast(cut_lineage(laws)), "feature", "left")
               .withColumn("deep_type", F.when(F.col("_law"), other[F.col("deep_type")]).otherwise(F.col("deep_type")))
               .drop("_law"))
    return out.drop("unique_count")


#: Types that a power law of the value frequencies turns into another.
POWER_LAW_TYPES = {
    "DISCRETE_UNIFORM": "DISCRETE_POWER_LAW", "CATEGORICAL_HIGH_CARDINALITY": "CATEGORICAL_POWER_LAW",
    "CONTINUOUS_HEAVY_TAILED": "CONTINUOUS_POWER_LAW_HEAVY_TAIL",
}

# Transformation recommended per deep type (default: quantile_gaussian).
TRANSFORMS = [
    ("CONTINUOUS_GAUSSIAN", "identity", "{}"),
    ("CONTINUOUS_MULTIMODAL", "quantile_gaussian", '{"n_quantiles": 1000, "output_distribution": "normal"}'),
    ("CONTINUOUS_HEAVY_TAILED", "box_cox", '{"method": "box-cox"}'),
    ("DISCRETE_UNIFORM", "ordinal_encoding", "{}"),
    ("DISCRETE_POWER_LAW", "log_transformation", '{"offset": 1}'),
    ("CATEGORICAL_LOW_CARDINALITY", "one_hot", "{}"),
    ("CATEGORICAL_HIGH_CARDINALITY", "target_encoding", '{"smoothing": 10}'),
    ("ORDINAL", "ordinal_encoding", '{"mapping_strategy": "frequency"}'),
    ("CYCLIC", "sincos_encoding", '{"period": 24}'),
]


def recommended_transform(deep: DataFrame) -> DataFrame:
    """Broadcast lookup type -> transformation (default quantile_gaussian)."""
    spark = deep.sparkSession
    lut = spark.createDataFrame(TRANSFORMS, "deep_type string, transformation string, parameters string")
    j = deep.join(F.broadcast(lut), "deep_type", "left")
    return j.select("feature", "deep_type",
                    F.coalesce("transformation", F.lit("quantile_gaussian")).alias("transformation"),
                    F.coalesce("parameters", F.lit(TRANSFORMS[1][2])).alias("parameters"))


# C7 ------------------------------------------------------------------------

# deep/base type -> canonical type.
CANONICAL = {
    "CATEGORICAL_LOW_CARDINALITY": "categorical", "CATEGORICAL_HIGH_CARDINALITY": "categorical",
    "CATEGORICAL_POWER_LAW": "categorical", "CATEGORICAL": "categorical", "ORDINAL": "categorical",
    "NOMINAL": "categorical", "BOOLEAN": "categorical", "BINARY": "categorical", "DISCRETE": "categorical",
    "DISCRETE_UNIFORM": "continuous", "DISCRETE_POWER_LAW": "continuous", "CONTINUOUS": "continuous",
    "NUMERIC": "continuous", "FLOAT": "continuous", "INTEGER": "continuous", "REAL": "continuous",
    "CONTINUOUS_GAUSSIAN": "continuous", "CONTINUOUS_HEAVY_TAILED": "continuous",
    "CONTINUOUS_POWER_LAW_HEAVY_TAIL": "continuous", "CONTINUOUS_MULTIMODAL": "multimodal",
    "CYCLIC": "datetime", "DATETIME": "datetime", "DATE": "datetime", "TIME": "datetime",
    "TIMESTAMP": "datetime",
}


def canonical_projection(meta: DataFrame) -> DataFrame:
    """meta: (feature, deep_type, type, output_dim, n_classes, cardinality,
    n_modes) with any of the last five possibly NULL.  Canonical type from
    deep type, else base type, else continuous; multimodal output_dim =
    n_modes (>= 2); categorical output_dim from explicit > 1, classes > 1,
    cardinality > 1, else 2; datetime default 1."""
    spark = meta.sparkSession
    lut = spark.createDataFrame(list(CANONICAL.items()), "key string, canonical string")
    m = meta
    for c, t in (("deep_type", "string"), ("type", "string"), ("output_dim", "int"), ("n_classes", "int"),
                 ("cardinality", "int"), ("n_modes", "int")):
        if c not in m.columns:
            m = m.withColumn(c, F.lit(None).cast(t))
    m = m.withColumn("_dk", F.upper(F.trim("deep_type"))).withColumn("_bk", F.upper(F.trim("type")))
    m = m.join(F.broadcast(lut.select(F.col("key").alias("_dk"), F.col("canonical").alias("_dc"))), "_dk", "left")
    m = m.join(F.broadcast(lut.select(F.col("key").alias("_bk"), F.col("canonical").alias("_bc"))), "_bk", "left")
    canon = F.coalesce("_dc", "_bc", F.lit("continuous"))
    modes = F.when(F.col("n_modes") >= 2, F.col("n_modes")).otherwise(2)
    dim = (F.when(canon == "multimodal", modes)
           .when(canon == "categorical",
                 F.when(F.col("output_dim") > 1, F.col("output_dim"))
                 .when(F.col("n_classes") > 1, F.col("n_classes"))
                 .when(F.col("cardinality") > 1, F.col("cardinality")).otherwise(2))
           .when(canon == "datetime", F.coalesce("output_dim", F.lit(1)))
           .otherwise(F.col("output_dim")))
    return m.select("feature", canon.alias("canonical_type"), dim.cast("int").alias("output_dim"),
                    F.when(canon == "multimodal", modes).cast("int").alias("n_modes"))


# C8 ------------------------------------------------------------------------

SUPPORTED_FAMILIES = ["continuous", "categorical", "multimodal", "datetime", "ordinal", "binary"]


def validate_metadata(meta: DataFrame) -> DataFrame:
    """Type family supported, cardinality > 0 for categoricals, min/max
    swapped when reversed."""
    t = F.lower(F.trim("type"))
    ok_type = t.isin(SUPPORTED_FAMILIES)
    ok_card = F.when(t == "categorical", F.coalesce(F.col("cardinality") > 0, F.lit(False))).otherwise(True)
    return meta.select("feature", "type", ok_type.alias("type_supported"), ok_card.alias("cardinality_ok"),
                       F.least("min", "max").alias("min"), F.greatest("min", "max").alias("max"),
                       (F.col("min") > F.col("max")).alias("swapped"))


# C17 -----------------------------------------------------------------------

def class_imbalance(df: DataFrame, target: str, threshold: float = 0.1) -> DataFrame:
    """Minority class share below ``threshold``."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("cnt"))
    agg = counts.agg(F.sum("cnt").alias("n"), F.min("cnt").alias("min_cnt"),
                     F.min_by(F.col(target).cast("string"), F.struct("cnt", F.col(target).cast("string"))).alias("minority"),
                     F.count(F.lit(1)).alias("n_classes"))
    share = F.col("min_cnt") / F.col("n")
    return agg.select(F.lit(target).alias("target"), "n_classes", "minority", share.alias("minority_share"),
                      (share < threshold).alias("is_imbalanced"))
