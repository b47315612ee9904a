"""Small dimensions derived from the facts: terms, years, choice lists, axis limits.

Their size is bounded by the number of years, so ordering them in one task is fine.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursegrid.functions.terms import FALL, SPRING, calendar_year, term_key, term_label
from coursegrid.operators.courses import choose, offered_terms
from coursegrid.operators.facts import course_years


def term_spine(facts: DataFrame, *, raw_terms: bool = False) -> DataFrame:
    """All fall and spring terms of the reporting years in the facts, offered or not."""
    halves = F.array(F.lit(FALL), F.lit(SPRING))
    pairs = facts.select("reporting_year").distinct().select(
        "reporting_year", F.explode(halves).alias("semester")
    )
    reporting, semester = F.col("reporting_year"), F.col("semester")
    year = reporting if raw_terms else calendar_year(reporting, semester)
    return pairs.select(
        term_label(reporting, semester, raw_terms).alias("term"),
        year.alias("year"),
        "semester",
        term_key(year, semester).alias("term_key"),
    )


def term_order(facts: DataFrame, *, raw_terms: bool = False) -> DataFrame:
    """Terms numbered by time, spring before fall of a calendar year, unknown years last."""
    by_time = Window.orderBy(
        F.asc_nulls_last("year"), F.desc("semester")
    )
    return term_spine(facts, raw_terms=raw_terms).withColumn(
        "term_order", F.dense_rank().over(by_time)
    )


def term_order_median(facts: DataFrame, *, excluded_terms=()) -> DataFrame:
    """Terms numbered by the median of their order value, ties by name."""
    medians = (
        offered_terms(facts, excluded_terms=excluded_terms)
        .groupBy("term")
        .agg(F.median("term_order").alias("median_order"))
    )
    by_median = Window.orderBy(F.asc_nulls_last("median_order"), "term")
    return medians.withColumn("term_order", F.dense_rank().over(by_median))


def year_spine(facts: DataFrame) -> DataFrame:
    """Every year from the first to the last known reporting year."""
    limits = facts.agg(
        F.min("reporting_year").alias("first_year"), F.max("reporting_year").alias("last_year")
    ).filter(F.col("first_year").isNotNull())
    return limits.select(
        F.explode(F.sequence("first_year", "last_year")).alias("reporting_year")
    )


def axis_limits(
    facts: DataFrame, courses=None, *, excluded_terms=(), excluded_years=()
) -> DataFrame:
    """Largest enrollment in a year and in a term, first and last year, in one pass.

    Over the chosen courses, or all. Excluded years and terms do not count for the largest
    enrollments; with nothing chosen that has facts, all limits are null.
    """
    halves = []
    for semester, half in ((FALL, "fall_enrolled"), (SPRING, "spring_enrolled")):
        term = term_label(F.col("reporting_year"), F.lit(semester))
        kept = ~term.isin(list(excluded_terms)) if excluded_terms else F.lit(True)
        halves.append(F.when(kept, F.col(half)))
    year = F.col("reporting_year")
    kept_year = ~year.isin(list(excluded_years)) if excluded_years else F.lit(True)
    return course_years(choose(facts, courses)).agg(
        F.max(F.when(kept_year, F.col("yearly_enrolled"))).alias("max_yearly_enrolled"),
        F.max(F.greatest(*halves)).alias("max_semester_enrolled"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
    )


def distinct_subjects(facts: DataFrame) -> DataFrame:
    return facts.select("subject").distinct()


def distinct_courses(facts: DataFrame) -> DataFrame:
    return facts.select("course").distinct()
