"""Places of rows in a total order, where an order has to be a column."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursegrid.sources.io import scratch_path


def placed(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Add the place of each row in the given order, from 1; rows with equal keys share a place.

    `order` says how each of `keys` sorts. A window over all rows would bring them into one task.
    Here the rows are counted per key, the counts are dealt out by ranges of the order and written to
    the shared folder, so that the ranges stay as they are, and summed up within and before each
    range. The places go back to the rows by a join on the keys, which the adaptive planner splits
    where a key is hot.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "order")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)

    def before(*sort) -> Window:
        return Window.orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)

    sizes = dealt.groupBy(F.col("_range").alias("_of")).agg(F.sum("_n").alias("_size"))
    ranges = sizes.select("_of", F.coalesce(F.sum("_size").over(before("_of")), F.lit(0)).alias("_ahead"))
    inside = F.sum("_n").over(before(*order).partitionBy("_range"))
    place = (F.coalesce("_inside", F.lit(0)) + F.col("_ahead") + 1).alias(name)
    places = (
        dealt.withColumn("_inside", inside)
        .join(ranges, F.col("_range") == F.col("_of"))
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], place)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(places, reduce(and_, same)).select(*rows.columns, name)
