"""Session and shared-storage helpers.

Library code never builds its own session: every operator takes the
caller's DataFrames.  ``local_session`` exists for tests, the bench and
the CLI only.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabvet") -> SparkSession:
    """A local[N] session for tests and benchmarks (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TABVET_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Where the setting is absent, a local master gets a scratch folder of its
    own (driver and tasks share its disk); any other master must name a
    folder that driver and executors share, so this raises.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    require_local(spark.sparkContext.master)
    path = tempfile.mkdtemp(prefix="tabvet-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def require_local(master: str) -> None:
    """Raise unless driver and tasks run on one machine."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master})")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Sides of a join are broadcast up to this many bytes.
BROADCAST_BYTES = 128 << 20


def sized(side: DataFrame) -> DataFrame:
    """``side`` written once into the shared folder and marked for broadcast if
    its rows measure at most BROADCAST_BYTES (texts by their length, arrays of
    plain values by 16 bytes each, other nested values by their JSON text, other
    values by 16 bytes); beyond that the join shuffles."""
    spark = side.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/side-{uuid.uuid4().hex}"
    side.write.parquet(path)
    kept = spark.read.schema(side.schema).parquet(path)
    size = kept.agg(F.sum(sum((_bytes(f) for f in side.schema), F.lit(0)).cast("long"))).first()[0] or 0
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept


def _bytes(field: T.StructField) -> Column:
    """Bytes a value takes, about."""
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType,
                                                                          T.StructType, T.MapType)):
        return 16 * F.greatest(F.coalesce(F.size(col), F.lit(1)), F.lit(1))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
    return F.lit(16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
