"""Streaming extension: rules and temporal checks on a
``readStream`` of event files.

Every function builds a streaming plan; ``run_available`` drives it with
``trigger(availableNow=True)`` into a Parquet sink in the shared scratch
area (checkpointed, so a restarted query resumes exactly once) and
returns the sink as a batch DataFrame.  Batch = stream equality is the
test.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tabvet.operators.rules import RuleSet
from tabvet.sources.io import scratch_path


def event_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """A file stream over ``path`` (a directory, or files matched as a glob
    under their parent directory)."""
    import os
    p = path.rstrip("/")
    if p.endswith(".parquet") and not os.path.isdir(p):
        # a single file: match it as a glob under its directory
        base, glob = os.path.dirname(p), p[:-1] + "[" + p[-1] + "]"
        return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
                .option("basePath", base).parquet(glob))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(p)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over everything available and read the sink."""
    spark = stream.sparkSession
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_rules(stream: DataFrame, rules: RuleSet) -> DataFrame:
    """Stateless three-valued verdicts on every arriving row."""
    return rules.validate(stream)


def windowed_violations(stream: DataFrame, rules: RuleSet, ts: str, window: str = "1 hour",
                        watermark: str = "2 hours") -> DataFrame:
    """Violations per rule per tumbling event-time window, finalised
    once the watermark passes the window (append mode)."""
    v = rules.verdicts(stream)
    flags = F.array(*[F.when(c == F.lit(False), F.lit(n)) for n, c in v.items()])
    # watermarks need an instant-typed event time
    s = stream.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", watermark)
    long = s.select("_et", F.explode(F.array_compact(flags)).alias("rule"))
    return long.groupBy(F.window("_et", window).alias("w"), "rule").agg(F.count(F.lit(1)).alias("violations")) \
        .select(F.col("w.start").alias("window_start"), "rule", "violations")


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """Drop repeated events (same keys) within the watermark delay."""
    s = stream.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", watermark)
    return s.dropDuplicatesWithinWatermark(keys).drop("_et")


_SEQ_OUT = "user_id long, first_a timestamp_ntz, first_b timestamp_ntz, VALID_sequence boolean"
_SEQ_STATE = "first_a timestamp_ntz, first_b timestamp_ntz"


def _sequence_state(a: str, b: str):
    def fn(key, pdfs, state):
        fa, fb = (state.get if state.exists else (None, None))
        for pdf in pdfs:
            ta = pdf.loc[pdf["event_type"] == a, "ts"]
            tb = pdf.loc[pdf["event_type"] == b, "ts"]
            if len(ta):
                m = ta.min()
                fa = m if fa is None or pd.isna(fa) or m < fa else fa
            if len(tb):
                m = tb.min()
                fb = m if fb is None or pd.isna(fb) or m < fb else fb
        state.update((fa, fb))
        valid = True if (fa is None or fb is None or pd.isna(fa) or pd.isna(fb)) else bool(fa < fb)
        yield pd.DataFrame({"user_id": [key[0]], "first_a": [fa], "first_b": [fb], "VALID_sequence": [valid]})
    return fn


def sequence_state(stream: DataFrame, a: str, b: str) -> DataFrame:
    """F1 (A before B per user) as a stateful per-user operator; the
    state is the first time of each event type, the output the current
    verdict per user (update mode)."""
    return stream.groupBy("user_id").applyInPandasWithState(
        _sequence_state(a, b), _SEQ_OUT, _SEQ_STATE, "update", GroupStateTimeout.NoTimeout)


def run_update(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Drive an update-mode stream with foreachBatch: each micro-batch
    upserts the latest verdict per key into a batch table (last write per
    key wins, tracked by the batch id)."""
    spark = stream.sparkSession
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int):
        # a folder per batch, overwritten when the batch is tried again
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", ck).outputMode("update") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    keys = keys or ["user_id"]
    allv = spark.read.parquet(out)
    latest = allv.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return allv.join(latest, [*keys, "batch"]).drop("batch")
