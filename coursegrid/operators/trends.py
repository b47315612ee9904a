"""Enrollment trends by course title, straight from the registrations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.functions.nulls import sum_all
from coursegrid.operators.clean import filter_subjects, split_input_term


def title_term(registrations: DataFrame, subjects=None) -> DataFrame:
    """Enrollment per title and input term; null where one enrollment is unknown.

    A title term with several reporting years has the latest known one.
    """
    rows = registrations if subjects is None else filter_subjects(registrations, subjects)
    return rows.groupBy("course_title", "acad_year_term").agg(
        sum_all(F.col("enrolled")).alias("enrolled"),
        F.max("reporting_year").alias("reporting_year"),
    )


def title_year(registrations: DataFrame, subjects=None) -> DataFrame:
    """Enrollment per title and reporting year, earliest first; titles make the order total."""
    return (
        title_term(registrations, subjects)
        .groupBy("course_title", "reporting_year")
        .agg(sum_all(F.col("enrolled")).alias("enrolled"))
        .orderBy(*earliest_first())
    )


def earliest_first() -> list[Column]:
    """The order of the title years: earliest year first, then by title."""
    return [F.asc_nulls_last("reporting_year"), F.asc_nulls_last("course_title")]


def title_term_split(registrations: DataFrame, subjects=None, semester=None) -> DataFrame:
    """Title terms with year and semester apart, for one semester if given."""
    rows = split_input_term(title_term(registrations, subjects))
    return rows if semester is None else rows.filter(F.col("semester") == semester)


def course_id_terms(registrations: DataFrame, course_id: int) -> DataFrame:
    """Enrollment per term of one course id."""
    return title_term(registrations.filter(F.col("course_id") == course_id))
