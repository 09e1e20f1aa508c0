"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local master gets a new local folder; a cluster is an error, as its machines see no common one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallybridge-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` through a table in the shared folder: its plan is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallybridge/{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, order: list[Column | str], group: list[str] | None = None, **values: Column) -> DataFrame:
    """``df`` with running sums of ``values``, exclusive, in ``order`` within ``group``: ranges are summed first and no window holds more than one range of rows.

    Rows that are equal in ``order`` stand together in one range. One of the columns ``values`` may be called as an existing one, which it replaces.
    """
    spark, group = df.sparkSession, group or []
    taken = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a fixed part number, as a range that is computed again must not get other rows
    ranged = written(taken.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part", *group).agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    before = sums.select("_part", *group, *(F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in values))
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.withColumns({f"_w_{k}": F.coalesce(F.sum(f"_v_{k}").over(within), F.lit(0)) for k in values})
    same = met["_part"] == before["_part"]
    for g in group:
        same = same & met[g].eqNullSafe(before[g])
    return met.join(before, same).select(*(met[c] for c in df.columns if c not in values), *((F.col(f"_w_{k}") + F.col(f"_b_{k}")).alias(k) for k in values))
