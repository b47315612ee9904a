"""Enrollment by course: section rows, per year, per term."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursegrid.functions.nulls import excluding, none_if_zero, ratio
from coursegrid.functions.terms import (
    FALL,
    SPRING,
    calendar_year,
    term_key,
    term_label,
    term_order,
)
from coursegrid.operators.facts import course_years, sections_in_year

LABEL_OFFSET = 5

# How the chart titles begin.
ENROLLMENT_TITLE = "Enrollment for "
CAPACITY_TITLE = "Course Capacity for "


def choose(rows: DataFrame, courses) -> DataFrame:
    """Keep the chosen courses: names, a predicate on `course`, or a table with that column."""
    if courses is None:
        return rows
    if isinstance(courses, Column):
        return rows.filter(courses)
    if isinstance(courses, DataFrame):
        return rows.join(courses.select("course"), "course", "left_semi")
    return rows.filter(F.col("course").isin(list(courses)))


def drop_values(rows: DataFrame, column: str, values) -> DataFrame:
    keep = excluding(F.col(column), values)
    return rows if keep is None else rows.filter(keep)


def offered_sections(sections: DataFrame, excluded_terms=()) -> DataFrame:
    """Sections with enrollment, with their display term (works on long and unpivoted facts)."""
    year, semester = F.col("reporting_year"), F.col("semester")
    offered = sections.filter(F.col("section_key").isNotNull() & (F.col("enrolled") != 0))
    return drop_values(
        offered.withColumns(
            {
                "semester_year": calendar_year(year, semester),
                "term": term_label(year, semester),
            }
        ),
        "term",
        excluded_terms,
    )


def section_terms(facts: DataFrame, excluded_terms=()) -> DataFrame:
    """One row per course, term and offered section."""
    return offered_sections(facts, excluded_terms).select(
        "course", "reporting_year", "semester_year", "term", "semester", "section", "enrolled",
        "subject", "course_level", "yearly_capacity",
    )


def sections_per_year(facts: DataFrame, excluded_terms=()) -> DataFrame:
    years = course_years(facts).withColumn("total_sections", sections_in_year(excluded_terms))
    return years.filter(F.col("total_sections").isNotNull()).select(
        "course", "reporting_year", "total_sections"
    )


def course_yearly(
    facts: DataFrame, courses=None, *, excluded_terms=(), excluded_years=()
) -> DataFrame:
    """Enrollment, capacity, section count and average section size per course and year."""
    years = drop_values(course_years(choose(facts, courses)), "reporting_year", excluded_years)
    counted = years.withColumn("total_sections", sections_in_year(excluded_terms))
    return counted.select(
        "course",
        "reporting_year",
        "yearly_enrolled",
        "yearly_capacity",
        "total_sections",
        ratio(F.col("yearly_enrolled"), F.col("total_sections")).alias("avg_section"),
    )


def course_terms(facts: DataFrame, *, raw_terms: bool = False) -> DataFrame:
    """One row per course and fall / spring term, terms without enrollment included."""
    halves = [
        F.struct(
            F.lit(semester).alias("semester"),
            F.col(f"{half}_enrolled").alias("semester_enrolled"),
            F.col(f"{half}_capacity").alias("semester_capacity"),
            none_if_zero(F.col(f"{half}_sections")).alias("total_sections"),
        )
        for semester, half in ((FALL, "fall"), (SPRING, "spring"))
    ]
    long = course_years(facts).select("course", "reporting_year", F.inline(F.array(*halves)))
    reporting, semester = F.col("reporting_year"), F.col("semester")
    year = reporting if raw_terms else calendar_year(reporting, semester)
    return long.withColumns({"term": term_label(reporting, semester, raw_terms), "year": year})


def semester_long(facts: DataFrame, *, raw_terms: bool = False) -> DataFrame:
    """Fall and spring totals as rows."""
    return course_terms(facts, raw_terms=raw_terms).select(
        "course", "reporting_year", "term", "year", "semester", "semester_enrolled"
    )


def offered_terms(
    facts: DataFrame, courses=None, *, excluded_terms=(), raw_terms: bool = False
) -> DataFrame:
    """Course-terms with enrollment, with section count, average size and order columns."""
    terms = course_terms(choose(facts, courses), raw_terms=raw_terms)
    terms = terms.filter(F.col("semester_enrolled") != 0)
    year, semester = F.col("year"), F.col("semester")
    return drop_values(terms, "term", excluded_terms).withColumns(
        {
            "avg_section": ratio(F.col("semester_enrolled"), F.col("total_sections")),
            "term_key": term_key(year, semester),
            "term_order": term_order(year, semester),
        }
    )


def course_semester(
    facts: DataFrame, courses=None, *, excluded_terms=(), raw_terms: bool = False
) -> DataFrame:
    """Enrollment, section count and average section size per course and term.

    `raw_terms` labels and orders the terms by reporting year, as the older notebooks do.
    """
    return offered_terms(
        facts, courses, excluded_terms=excluded_terms, raw_terms=raw_terms
    ).select(
        "course", "term", "term_key", "year", "semester", "term_order", "semester_enrolled",
        "total_sections", "avg_section",
    )


def sections_per_term(facts: DataFrame, excluded_terms=()) -> DataFrame:
    terms = drop_values(course_terms(facts), "term", excluded_terms)
    return terms.filter(F.col("total_sections").isNotNull()).select(
        "course", "term", "total_sections"
    )


def cumulative_sections(facts: DataFrame, courses=None, *, excluded_terms=()) -> DataFrame:
    """Running enrollment over the sections of a course and term.

    The window group has one row per domain section of a semester. Keying it by reporting year
    and semester instead of the term text keeps the partitioning of the facts.
    """
    in_term = (
        Window.partitionBy("course", "reporting_year", "semester")
        .orderBy("section")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return section_terms(choose(facts, courses), excluded_terms).select(
        "course",
        "term",
        "section",
        "enrolled",
        F.sum("enrolled").over(in_term).alias("cumulative_enrolled"),
    )


def section_marks(facts: DataFrame, courses=None, *, excluded_terms=()) -> DataFrame:
    """Cumulative marks with label position and chart title."""
    marks = cumulative_sections(facts, courses, excluded_terms=excluded_terms)
    placed = marks.withColumn("label_y", F.col("cumulative_enrolled") - LABEL_OFFSET)
    return titled(placed, ENROLLMENT_TITLE)


def titled(rows: DataFrame, prefix: str, of: Column | None = None) -> DataFrame:
    """Add the chart title: the prefix and the course, or another text."""
    return rows.withColumn("title", F.concat(F.lit(prefix), F.col("course") if of is None else of))


def preview(wide: DataFrame, rows: int = 6, columns: int = 5) -> DataFrame:
    """First rows and first columns of a table in course and year order."""
    return (
        wide.select(*wide.columns[:columns])
        .orderBy(F.asc_nulls_last("course"), F.asc_nulls_last("reporting_year"))
        .limit(rows)
    )


def extract_code(rows: DataFrame, pattern: str) -> DataFrame:
    """Courses with the part of their name that matches; null where nothing does."""
    return rows.select(
        "course", "reporting_year", F.regexp_substr("course", F.lit(pattern)).alias("course_code")
    )
