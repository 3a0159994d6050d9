"""The shadow forests' rows are spread by their number, not by the files'."""

from pyspark.sql import functions as F

from tabvet.operators import privacy as PV


def test_rows_of_one_file_are_spread_by_their_values(spark):
    one = spark.range(120_000, numPartitions=1).select(
        (F.col("id") % 2).cast("double").alias("label"), (F.col("id") * 7 % 1009).cast("double").alias("x"))
    assert one.rdd.getNumPartitions() == 1
    spread = [PV._spread(df, 120_000, ["label", "x"]) for df in (one, one.repartition(5))]
    parts = [df.rdd.mapPartitions(lambda it: [[tuple(r) for r in it]]).collect() for df in spread]
    assert len(parts[0]) == 2 and all(parts[0]) and parts[0] == parts[1]
    assert PV._spread(one, 99_999, ["label", "x"]) is one


def test_no_part_grows_without_bound(spark):
    df = spark.range(1)
    assert PV._spread(df, 2_000_000, ["id"]).rdd.getNumPartitions() == PV.TASKS
    assert PV._spread(df, 54_000_000, ["id"]).rdd.getNumPartitions() == 54
