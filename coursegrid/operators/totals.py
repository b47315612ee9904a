"""Group totals attached to every row of the group, safe for hot groups."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def with_group_totals(
    rows: DataFrame,
    keys: list[str],
    totals: dict[str, Column],
    *,
    spread_by: list[str],
    only: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Add to each row the group sums of the given expressions (null keys form a group).

    A window over the keys would bring a whole group into one task. Here every group is split
    over `salts` parts by a hash of `spread_by`: the parts are summed with map-side combine, the
    at most `salts` part sums of a group are added up, and the rows join on keys and part, so
    that no task sees more than one part of a group. `only` limits the rows that are summed
    and that receive a total; other rows get nulls.
    """
    part = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    parted = rows.withColumn("_part", part)
    summed = (parted if only is None else parted.filter(only)).groupBy(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_key_part")
    )
    part_sums = summed.agg(*[F.sum(expr).alias(name) for name, expr in totals.items()])
    group = Window.partitionBy(*[f"_key_{k}" for k in keys])
    group_sums = part_sums.select(
        *[f"_key_{k}" for k in keys],
        "_key_part",
        *[F.sum(name).over(group).alias(name) for name in totals],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    same.append(F.col("_part") == F.col("_key_part"))
    if only is not None:
        same.append(only)
    return parted.join(group_sums, reduce(and_, same), "left").select(*rows.columns, *totals)
