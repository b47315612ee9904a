"""Course picker: courses by subject, average capacity and years offered."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursegrid.functions.nulls import half_even, none_if_zero, ratio
from coursegrid.functions.terms import FALL, SPRING, calendar_year, term_label
from coursegrid.operators.courses import drop_values, section_terms
from coursegrid.operators.facts import course_years, sections_in_year

# Sorts the null year after all others, as the facts are read in course and year order.
_LAST_YEAR = 2**31 - 1


def _rated_years(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """All course-years; section count and average capacity are null without sections."""
    years = course_years(facts).withColumn("total_sections", sections_in_year(excluded_terms))
    return years.withColumn(
        "avg_capacity", ratio(F.col("yearly_capacity"), F.col("total_sections"))
    )


def capacity_stats(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """Section count and average capacity of the course-years with sections."""
    rated = _rated_years(facts, excluded_terms).filter(F.col("total_sections").isNotNull())
    return rated.select(
        "course", "reporting_year", "total_sections", "yearly_capacity", "avg_capacity"
    )


def years_offered(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """Capacity stats with the number of years of each course (one row per year in a group)."""
    course = Window.partitionBy("course")
    return capacity_stats(facts, excluded_terms).withColumn(
        "total_years_offered", F.count(F.lit(1)).over(course)
    )


def total_offered(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """Offered sections with the number of them per course over all years.

    A window group has at most one row per domain section and year.
    """
    sections = section_terms(facts, excluded_terms).select(
        "course", "reporting_year", "term", "semester", "section"
    )
    course = Window.partitionBy("course")
    return sections.withColumn("total_offered", F.count(F.lit(1)).over(course))


def total_capacity(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """Average capacity times number of sections per course-year."""
    return capacity_stats(facts, excluded_terms).withColumn(
        "total_capacity", F.col("avg_capacity") * F.col("total_sections")
    )


def total_capacity_terms(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """Average capacity of the year times number of sections per course and term offered."""
    halves = [
        F.struct(
            F.lit(semester).alias("semester"),
            F.col(f"{half}_enrolled").alias("semester_enrolled"),
            none_if_zero(F.col(f"{half}_sections")).alias("term_sections"),
        )
        for semester, half in ((FALL, "fall"), (SPRING, "spring"))
    ]
    terms = (
        _rated_years(facts, excluded_terms)
        .select("course", "reporting_year", "avg_capacity", F.inline(F.array(*halves)))
        .filter(F.col("semester_enrolled") != 0)
        .withColumn("term", term_label(F.col("reporting_year"), F.col("semester")))
    )
    return drop_values(terms, "term", excluded_terms).select(
        "course",
        "term",
        calendar_year(F.col("reporting_year"), F.col("semester")).alias("year"),
        "semester_enrolled",
        "avg_capacity",
        F.col("term_sections").alias("total_sections"),
        (F.col("avg_capacity") * F.col("term_sections")).alias("total_capacity"),
    )


def section_weighted_capacity(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """Average capacity per course in which a year counts once per section.

    Years without sections count once in the divisor.
    """
    sections = F.col("total_sections")
    return (
        _rated_years(facts, excluded_terms)
        .groupBy("course")
        .agg(
            F.coalesce(F.sum(F.col("avg_capacity") * sections), F.lit(0.0)).alias("capacity"),
            F.sum(F.coalesce(sections, F.lit(1))).alias("weight"),
        )
        .select(
            "course", half_even(F.col("capacity") / F.col("weight")).alias("full_avg_capacity")
        )
    )


def rated_courses(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """Average capacity, subject and years offered per course.

    The average divides by all years of the course; subject and years offered are the values
    at its first year, so years offered is null where the first year has no sections.
    """
    first_year = F.coalesce("reporting_year", F.lit(_LAST_YEAR))
    at_first = F.min_by(
        F.struct("subject", F.col("total_sections").isNotNull().alias("offered")), first_year
    )
    return (
        _rated_years(facts, excluded_terms)
        .groupBy("course")
        .agg(
            half_even(
                F.coalesce(F.sum("avg_capacity"), F.lit(0.0)) / F.count(F.lit(1))
            ).alias("full_avg_capacity"),
            at_first.alias("first"),
            F.count("total_sections").alias("n_years"),
        )
        .select(
            "course",
            "full_avg_capacity",
            "first.subject",
            F.when(F.col("first.offered"), F.col("n_years")).alias("total_years_offered"),
        )
    )


def course_picker(
    facts: DataFrame, subject: str, *, min_capacity=6, min_years=3, excluded_terms=(), first_look=True
) -> DataFrame:
    """Courses of a subject by average capacity and number of years offered.

    Only courses with the subject in some row are rated. On stored facts that first look reads
    two columns, and its filter reaches the scan. Facts straight from raw rows would be derived
    twice for it; there `clean_registrations(about=...)` keeps other subjects out instead.
    """
    if first_look:
        of_subject = facts.filter(F.col("subject") == subject).select("course").distinct()
        facts = facts.join(of_subject, "course", "left_semi")
    return rated_courses(facts, excluded_terms).filter(
        (F.col("full_avg_capacity") >= min_capacity)
        & (F.col("subject") == subject)
        & (F.col("total_years_offered") >= min_years)
    )
