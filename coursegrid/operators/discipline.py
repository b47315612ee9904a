"""Enrollment by discipline: course level by year."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.functions.nulls import ratio, sum_all
from coursegrid.operators.courses import drop_values
from coursegrid.operators.facts import course_years, sections_in_year


def derived_level(course_number: Column) -> Column:
    """Level from the course number: hundreds, or thousands less one for long numbers."""
    number = course_number.try_cast("double")
    return (
        F.when(number >= 1000, F.floor(number / 1000) - 1)
        .when(number < 1000, F.floor(number / 100))
        .cast("int")
    )


def _by_level(facts: DataFrame, subjects, level: Column, excluded_terms, excluded_years):
    subjects = [subjects] if isinstance(subjects, str) else list(subjects)
    chosen = facts.filter(F.col("subject").isin(subjects))
    years = course_years(drop_values(chosen, "reporting_year", excluded_years))
    sums = years.groupBy(level.alias("course_level"), "reporting_year").agg(
        sum_all(F.col("yearly_enrolled")).alias("enrolled"),
        F.sum(sections_in_year(excluded_terms)).alias("total_sections"),
    )
    return sums.withColumn("avg_section", ratio(F.col("enrolled"), F.col("total_sections")))


def discipline_by_level(
    facts: DataFrame, subjects, *, excluded_terms=(), excluded_years=()
) -> DataFrame:
    """Enrollment, sections and average section size per course level and year.

    The null level is a group of its own; an unknown subject gives no rows.
    """
    return _by_level(facts, subjects, F.col("course_level"), excluded_terms, excluded_years)


def axis_limits(
    facts: DataFrame, subjects, *, excluded_terms=(), excluded_years=()
) -> DataFrame:
    """Largest enrollment of a level and year, first and last year of the chart."""
    levels = discipline_by_level(
        facts, subjects, excluded_terms=excluded_terms, excluded_years=excluded_years
    )
    return levels.agg(
        F.max("enrolled").alias("max_enrolled"),
        F.min("reporting_year").alias("first_year"),
        F.max("reporting_year").alias("last_year"),
    )


def discipline_derived_level(
    facts: DataFrame, subjects, *, max_level: int = 3, excluded_terms=(), excluded_years=()
) -> DataFrame:
    """The same with the level taken from the course number, up to `max_level`."""
    level = derived_level(F.col("course_number"))
    return _by_level(facts, subjects, level, excluded_terms, excluded_years).filter(
        F.col("course_level") <= max_level
    )
