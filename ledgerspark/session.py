"""What a session needs so that Python functions run on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, for sessions whose workers don't inherit PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerspark"), "ledgerspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("ledgerspark", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, one level down; a session on one machine without it gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as compressed Parquet into the shared folder, and read from there: several times smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a column of consecutive numbers from 1 in the given order: sorted by ranges, of which the driver sees one count each."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpoint(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    shifts, before = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect(), key=lambda r: r["_part"]):
        shifts.append((r["_part"], before + 1 - r["first"]))
        before += r["n"]
    table = F.broadcast(spark.createDataFrame(shifts, "_part int, _shift long"))
    return ranged.join(table, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
