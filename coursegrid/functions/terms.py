"""Terms: split, label and order them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursegrid.functions.nulls import if_known, paste

FALL, SPRING = "FA", "SP"


def input_term_year(term: Column) -> Column:
    """`2020FA` -> `2020`."""
    return F.left(term, F.length(term) - 2)


def input_term_semester(term: Column) -> Column:
    """`2020FA` -> `FA`."""
    return F.right(term, F.lit(2))


def key_piece(key: Column, position: int) -> Column:
    """Piece of an underscore-separated key; null where it is missing."""
    return F.try_element_at(F.split(key, "_"), F.lit(position))


def calendar_year(reporting_year: Column, semester: Column) -> Column:
    """Spring belongs to the calendar year after the reporting year."""
    return if_known(semester.contains(SPRING), reporting_year + 1, reporting_year)


def term_label(reporting_year: Column, semester: Column, raw: bool = False) -> Column:
    """Display term, `2015_SP`; `raw` keeps the reporting year, as the older notebooks do."""
    year = reporting_year if raw else calendar_year(reporting_year, semester)
    return paste("_", year, semester)


def term_year(term: Column) -> Column:
    """First number in a display term; null for `NA_FA`."""
    return F.regexp_substr(term, F.lit("[0-9]+")).try_cast("int")


def term_semester(term: Column) -> Column:
    return F.when(term.contains(FALL), FALL).when(term.contains(SPRING), SPRING)


def term_order(year: Column, semester: Column) -> Column:
    """Order value that puts a fall term with the spring after it."""
    return F.when(semester == FALL, year + 1).when(semester == SPRING, year)


def term_key(term_calendar_year: Column, semester: Column) -> Column:
    """Integer that sorts display terms by time."""
    return term_calendar_year * 2 + F.when(semester == FALL, 1).otherwise(0)
