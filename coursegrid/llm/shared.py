"""Helpers of several operators: row digests and files in the folder that all executors share."""

from __future__ import annotations

import tempfile

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settled(frame: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there: lineage ends, lost executors lose nothing.

    The folder is the one `spark.checkpoint.dir` names. Only a session on one machine may have none; it gets a temporary one.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one for a session on one machine without it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: its measure of how far work is to be spread."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with their place among those of equal keys, from 0, in a column `name`; no key is gathered in one task.

    Rows are dealt by ranges of keys and order, numbered within key and range, and moved on by the key's rows in the ranges
    before. The ranges come from a sample, so the dealt rows are written down first.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = settled(dealt).alias("r")
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_size").over(ahead), F.lit(0))).filter("_ahead > 0").alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_range"]])
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_inside", inside).alias("r").join(sizes, same, "left")
    number = (F.col("_inside") + F.coalesce("_ahead", F.lit(0))).cast("long")
    return placed.select(*[F.col(f"r.{c}") for c in rows.columns], number.alias(name))
