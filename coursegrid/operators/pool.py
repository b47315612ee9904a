"""Cross-listed sections: members of a pool share the pool's enrollment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursegrid.operators.clean import crosslisted, unite_course
from coursegrid.operators.totals import with_group_totals

POOL_KEYS = ["course_title", "section", "reporting_year"]


def _with_pool(rows: DataFrame, only=None) -> DataFrame:
    return with_group_totals(
        rows,
        POOL_KEYS,
        {
            "_pool": F.col("enrolled"),
            "_unknown": F.col("enrolled").isNull().cast("int"),
        },
        spread_by=["course_section_id"],
        only=only,
    )


def _pooled():
    """The pool's enrollment; null as soon as one member's enrollment is unknown."""
    return F.when(F.col("_unknown") == 0, F.col("_pool"))


def pooled_members(rows: DataFrame) -> DataFrame:
    """Cross-listed rows only, each with the enrollment of its whole pool."""
    members = _with_pool(crosslisted(rows)).withColumn("enrolled", _pooled())
    return unite_course(members.drop("_pool", "_unknown"))


def pool_crosslisted(rows: DataFrame) -> DataFrame:
    """All rows, the cross-listed ones with the enrollment of their pool, in one pass."""
    member = F.col("xlist_section1").isNotNull()
    pooled = _with_pool(rows, only=member).withColumn(
        "enrolled", F.when(member, _pooled()).otherwise(F.col("enrolled"))
    )
    return unite_course(pooled.drop("_pool", "_unknown"))


def with_yearly_capacity(rows: DataFrame) -> DataFrame:
    """Add to each row the capacity of its course and year, unknown capacities skipped."""
    keys = ["course", "reporting_year"]
    summed = with_group_totals(
        rows, keys, {"yearly_capacity": F.col("section_capacity")}, spread_by=["course_section_id"]
    )
    return summed.withColumn("yearly_capacity", F.coalesce("yearly_capacity", F.lit(0.0)))
