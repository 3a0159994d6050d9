import pytest
from pyspark.sql import functions as F

from tabvet.operators import fidelity


@pytest.mark.parametrize("where", ["planning", "execution"])
def test_a_failing_metric_gives_its_error_row(spark, monkeypatch, where):
    def good(real, synth, numeric, categorical):
        return real.agg(F.avg("x").alias("value")).select(F.lit("x").alias("feature"), F.lit("mean").alias("metric"), "value")

    def bad(real, synth, numeric, categorical):
        if where == "planning":
            return real.select("no_such_column")
        return real.select(F.lit("x").alias("feature"), F.lit("bad").alias("metric"),
                           F.raise_error(F.lit("broken metric")).cast("double").alias("value"))

    monkeypatch.setattr(fidelity, "METRICS", {"bad": bad, "good": good})
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    out = {r["test"]: r for r in fidelity.audit(df, df, ["x"], []).collect()}
    assert out["good"]["value"] == 2.0 and out["good"]["error"] is None
    assert out["bad"]["value"] is None and out["bad"]["error"]
