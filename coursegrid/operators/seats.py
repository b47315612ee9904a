"""Open seats: full flag, overenrollment, empty seats, gap-filled axes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.functions.nulls import if_known, ratio
from coursegrid.functions.terms import term_key, term_order, term_semester, term_year
from coursegrid.operators.courses import (
    choose,
    course_terms,
    course_yearly,
    drop_values,
    offered_terms,
)
from coursegrid.operators.spines import term_spine, year_spine
from coursegrid.schemas import MEASURES


# The texts of the full flag and of the seat classes in the functions below.


def full_flag(enrolled: Column, capacity: Column, sections: Column) -> Column:
    """Full when over capacity or within one seat per section of it."""
    within = (enrolled >= capacity - sections) & (enrolled <= capacity)
    return (
        F.when(enrolled > capacity, "Full")
        .when(within, "Full")
        .when(enrolled < capacity, "Not Full")
    )


def over_enrollment(enrolled: Column, capacity: Column) -> Column:
    return if_known(capacity < enrolled, enrolled - capacity, F.lit(0.0))


def empty_seats(enrolled: Column, capacity: Column) -> Column:
    return if_known(capacity > enrolled, capacity - enrolled, F.lit(0.0))


def enrolled_class(enrolled: Column, capacity: Column, sections: Column) -> Column:
    """Class of the enrollment layer."""
    within = (enrolled >= capacity - sections) & (enrolled <= capacity)
    return (
        F.when(enrolled > capacity, "Over Enrollment")
        .when(within, "Enrollment (full)")
        .when(enrolled < capacity, "Enrollment")
    )


def capacity_class(enrolled: Column, capacity: Column, sections: Column) -> Column:
    """Class of the capacity layer behind it."""
    within = (enrolled >= capacity - sections) & (enrolled <= capacity)
    return (
        F.when(enrolled > capacity, "Enrollment (full)")
        .when(enrolled < capacity - sections, "Empty Seats")
        .when(within, "Empty Seats")
    )


def seat_measures(rows: DataFrame, keys: list[str], enrolled: str, capacity: str) -> DataFrame:
    """Three rows per input row: overenrollments, empty seats and enrollments."""
    e, c = F.col(enrolled), F.col(capacity)
    ids = [*keys, "total_sections", "avg_section", "full_ind"]
    wide = rows.withColumns(
        {
            "full_ind": full_flag(e, c, F.col("total_sections")),
            "overenrollments": over_enrollment(e, c),
            "empty_seats": empty_seats(e, c),
            "enrollments": e,
        }
    )
    long = wide.unpivot(
        ids, ["overenrollments", "empty_seats", "enrollments"], "measure", "n_students"
    )
    measure = F.col("measure")
    order = F.when(measure == MEASURES[0], 1)
    for position, name in enumerate(MEASURES[1:], start=2):
        order = order.when(measure == name, position)
    return long.select(*ids, "measure", order.alias("measure_order"), "n_students")


def open_seats_yearly(
    facts: DataFrame, courses=None, *, excluded_terms=(), excluded_years=()
) -> DataFrame:
    years = course_yearly(
        facts, courses, excluded_terms=excluded_terms, excluded_years=excluded_years
    )
    return seat_measures(
        years, ["course", "reporting_year"], "yearly_enrolled", "yearly_capacity"
    )


def open_seats_semester(facts: DataFrame, courses=None, *, excluded_terms=()) -> DataFrame:
    terms = offered_terms(facts, courses, excluded_terms=excluded_terms)
    return seat_measures(terms, ["course", "term"], "semester_enrolled", "semester_capacity")


def completed_terms(facts: DataFrame, courses, *, excluded_terms=(), years=None) -> DataFrame:
    """The chosen courses over all terms; terms a course is not offered in have null measures.

    `years` is any table with the `reporting_year` values of the time axis, the facts unless
    given.
    """
    terms = course_terms(choose(facts, courses)).select(
        "course",
        "term",
        "semester_enrolled",
        "semester_capacity",
        "total_sections",
        ratio(F.col("semester_enrolled"), F.col("total_sections")).alias("avg_section"),
    )
    offered = F.col("semester_enrolled") != 0
    full = _complete(terms, offered, term_spine(facts if years is None else years), "term")
    named = full.withColumns(
        {"year": term_year(F.col("term")), "semester": term_semester(F.col("term"))}
    )
    known = drop_values(named.filter(F.col("year").isNotNull()), "term", excluded_terms)
    year, semester = F.col("year"), F.col("semester")
    return known.withColumns(
        {"term_key": term_key(year, semester), "term_order": term_order(year, semester)}
    )


def completed_years(
    facts: DataFrame,
    courses,
    *,
    excluded_terms=(),
    excluded_years=(),
    years=None,
    own_range: bool = False,
) -> DataFrame:
    """The chosen courses over all years from the first to the last; gaps have nulls.

    The years are those of `years` or of the facts; with `own_range` each course has those
    from its own first to its own last. A chosen course without facts has no rows.
    """
    yearly = course_yearly(facts, courses, excluded_terms=excluded_terms)
    spine = None if own_range else year_spine(facts if years is None else years)
    full = _complete(yearly, F.col("reporting_year").isNotNull(), spine, "reporting_year")
    return drop_values(full, "reporting_year", excluded_years)


def _complete(rows: DataFrame, present: Column, spine: DataFrame | None, axis: str) -> DataFrame:
    """Every course of the rows with every value of the spine, with nulls where no row is present.

    Without a spine, every whole number from the course's smallest to its largest. A course has at most one row per axis value, so its rows become one short map, which is
    looked up for each value: one pass over the rows and no join.
    """
    measures = [c for c in rows.columns if c not in ("course", axis)]
    entry = F.when(present, F.struct(axis, F.struct(*measures)))
    per_course = rows.groupBy("course").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_known"),
        F.min(axis).alias("_first"),
        F.max(axis).alias("_last"),
    )
    if spine is None:
        values = F.when(F.col("_first").isNotNull(), F.sequence("_first", "_last"))
    else:
        values = spine.agg(F.array_sort(F.collect_set(axis))).scalar()
    grid = per_course.select("course", F.explode(values).alias(axis), "_known")
    found = F.try_element_at("_known", F.col(axis)).alias("_found")
    return grid.select("course", axis, found).select("course", axis, "_found.*")


def seats_completed_terms(
    facts: DataFrame, courses, *, excluded_terms=(), years=None
) -> DataFrame:
    """Seat measures per term with gap rows."""
    full = completed_terms(facts, courses, excluded_terms=excluded_terms, years=years)
    return seat_measures(
        full,
        ["course", "term", "term_key", "term_order"],
        "semester_enrolled",
        "semester_capacity",
    )


def _with_classes(rows: DataFrame, enrolled: str, capacity: str) -> DataFrame:
    columns = F.col(enrolled), F.col(capacity), F.col("total_sections")
    return rows.withColumns(
        {"enrolled_class": enrolled_class(*columns), "capacity_class": capacity_class(*columns)}
    )


def seat_class_semester(
    facts: DataFrame, courses, *, excluded_terms=(), years=None
) -> DataFrame:
    """Gap-filled terms with the classes of both bar layers."""
    full = completed_terms(facts, courses, excluded_terms=excluded_terms, years=years)
    return _with_classes(full, "semester_enrolled", "semester_capacity")


def seat_class_yearly(
    facts: DataFrame, courses, *, excluded_terms=(), excluded_years=(), years=None
) -> DataFrame:
    """Gap-filled years with the classes of both bar layers."""
    full = completed_years(
        facts,
        courses,
        excluded_terms=excluded_terms,
        excluded_years=excluded_years,
        years=years,
    )
    return _with_classes(full, "yearly_enrolled", "yearly_capacity")
