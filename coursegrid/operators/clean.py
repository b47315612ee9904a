"""Section rows: scope, capacity, keys."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.functions.nulls import excluding, paste
from coursegrid.functions.terms import input_term_semester, input_term_year

USED_COLUMNS = [
    "acad_year_term", "reporting_year", "course_id", "course_name", "subject", "course_number",
    "course_title", "enrolled", "xlist_primary_course", "xlist_section1", "xlist_section2",
    "xlist_section3", "xlist_section4", "section_number", "course_level",
]


def normalize_capacity(capacity: DataFrame) -> DataFrame:
    """Rename to the join key and drop what is not used."""
    return capacity.withColumnsRenamed(
        {"section_id": "course_section_id", "section_name": "course_section_name"}
    ).drop("section_number", "unnamed_5")


def collapse_capacity(capacity: DataFrame) -> DataFrame:
    """One row per section id: number of records and their summed capacity.

    Joining this form keeps a registration row single where an id has many capacity records.
    Grouping by the id and its hash, and not by the id alone, makes Spark deal the collapsed
    rows out once more for the join. They are few, and only a join directly over two such
    exchanges lets the adaptive planner split a section id with very many registrations.
    """
    own = "course_section_id"
    collapsed = capacity.groupBy(own, F.xxhash64(own).alias("_spread")).agg(
        F.count(F.lit(1)).alias("capacity_records"),
        F.sum("section_capacity").alias("section_capacity"),
    )
    return collapsed.drop("_spread")


def join_capacity(registrations: DataFrame, capacity: DataFrame) -> DataFrame:
    """Left join on the section id; many capacity records for one id give many rows."""
    return registrations.join(capacity, "course_section_id", "left")


def filter_subjects(registrations: DataFrame, subjects) -> DataFrame:
    return registrations.filter(F.col("subject").isin(list(subjects)))


def filter_regular(registrations: DataFrame) -> DataFrame:
    """Regular sections are the ones without a schedule type."""
    return registrations.filter(F.col("schedule_type").isNull())


def exclude_input_terms(registrations: DataFrame, terms) -> DataFrame:
    keep = excluding(F.col("acad_year_term"), terms)
    return registrations if keep is None else registrations.filter(keep)


def crosslisted(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=["xlist_section1"])


def project_registrations(registrations: DataFrame) -> DataFrame:
    """The used columns, latest year first; the section id makes the order total."""
    return registrations.orderBy(*latest_first()).select(*USED_COLUMNS)


def latest_first() -> list[Column]:
    """The order of the section rows: latest year first, then by section id."""
    return [F.desc_nulls_last("reporting_year"), F.asc_nulls_last("course_section_id")]


def split_input_term(registrations: DataFrame) -> DataFrame:
    """Replace the input term by its year text and semester."""
    term = F.col("acad_year_term")
    return registrations.withColumns(
        {"term_year": input_term_year(term), "semester": input_term_semester(term)}
    ).drop("acad_year_term")


def unite_section(rows: DataFrame) -> DataFrame:
    """`FA` and `01` -> `FA_01`."""
    return rows.withColumn(
        "section", paste("_", F.col("semester"), F.col("section_number"))
    ).drop("semester", "section_number")


def unite_course(rows: DataFrame) -> DataFrame:
    """Course name and title -> one course text."""
    return rows.withColumn(
        "course", paste(": ", F.col("course_name"), F.col("course_title"))
    ).drop("course_name", "course_title")


def _possible_titles(course):
    """Texts that may be the title in `name: title`, where both may contain the separator."""
    pieces = F.split(course, ": ")
    starts = F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2)))
    later = F.transform(starts, lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), ": "))
    return F.when(F.size(pieces) > 1, later).otherwise(F.array().cast("array<string>"))


def filter_titles(registrations: DataFrame, courses) -> DataFrame:
    """Keep the titles of the chosen courses, given by name or as a table with a `course`.

    Cross-list pools share a title, so the facts of a chosen course are the same without the
    other titles. A missing title is written `NA` in a course and kept with that choice.
    """
    title = F.coalesce("course_title", F.lit("NA"))
    if isinstance(courses, DataFrame):
        titles = courses.select(F.explode(_possible_titles(F.col("course"))).alias("_title"))
        return registrations.join(titles.distinct(), title == F.col("_title"), "left_semi")
    pieces = [course.split(": ") for course in courses]
    titles = {": ".join(p[i:]) for p in pieces for i in range(1, len(p))}
    return registrations.filter(title.isin(sorted(titles)))


def courses_of_subjects(table: DataFrame, subjects) -> DataFrame:
    """Names and titles of the courses that have one of the subjects in some row."""
    subjects = [subjects] if isinstance(subjects, str) else list(subjects)
    return table.filter(F.col("subject").isin(subjects)).select("course_name", "course_title").distinct()


def filter_courses_and_pools(registrations: DataFrame, courses: DataFrame) -> DataFrame:
    """All rows of the given courses, and the cross-listed rows with their titles.

    A cross-list pool shares a title, so the facts of the given courses are the same without the
    other rows. Facts of other courses may be incomplete then.
    """
    named = courses.select(
        F.coalesce("course_title", F.lit("NA")).alias("_title"), F.col("course_name").alias("_name")
    ).distinct()
    same_title = F.coalesce("course_title", F.lit("NA")) == F.col("_title")
    needed = F.col("xlist_section1").isNotNull() | F.col("course_name").eqNullSafe(F.col("_name"))
    return registrations.join(named, same_title & needed, "left_semi")


def clean_registrations(
    registrations: DataFrame,
    capacity: DataFrame,
    *,
    subjects=None,
    regular_only: bool = True,
    excluded_terms=(),
    courses=None,
    about=None,
    catalogue: DataFrame | None = None,
    excluded_years=(),
    collapse: bool = False,
    source_order: str | None = None,
    complete: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Section rows in scope, with capacity and with the section key.

    The filters run on the registrations before the join. With `courses` or `excluded_years`
    only rows that facts of those courses and the other years need are read; questions still
    choose among the facts. `about` does the same for the courses that have one of these
    subjects in some row; a `catalogue` of courses with their subjects, if there is one, saves
    looking for them in the registrations. With `collapse`, a section id with
    many capacity records gives one row with their number and sum instead of many rows; the
    facts come out the same and no id can multiply rows. `source_order` names a column with the
    place of a row in its source; it is kept under that name and lets the facts carry first values.

    Where much of a row follows from narrow columns or is looked up, `registrations` may hold the
    narrow columns alone: `complete` makes whole registrations of such rows, keeps what else they
    have and runs after the capacity join, so that the join deals out narrow rows. Filters on the narrow
    columns still reach the scan.
    """
    if collapse:
        capacity = collapse_capacity(capacity)
    rows = registrations
    if complete is not None:
        rows = complete(join_capacity(registrations, capacity))
    rows = exclude_input_terms(rows, excluded_terms)
    if courses is not None:
        rows = filter_titles(rows, courses)
    if about is not None:
        whole = registrations if complete is None else complete(registrations)
        known = whole if catalogue is None else catalogue
        rows = filter_courses_and_pools(rows, courses_of_subjects(known, about))
    known_year = excluding(F.col("reporting_year"), excluded_years)
    if known_year is not None:
        rows = rows.filter(known_year)
    if regular_only:
        rows = filter_regular(rows)
    if subjects is not None:
        rows = filter_subjects(rows, subjects)
    if complete is None:
        rows = join_capacity(rows, capacity)
    columns = [c for c in USED_COLUMNS if c != "acad_year_term"]
    extra = ["capacity_records"] if collapse else []
    if source_order is not None:
        extra.append(F.col(source_order).alias("source_order"))
    rows = split_input_term(rows).select(
        "course_section_id", "term_year", "semester", *columns, "section_capacity", *extra
    )
    return unite_section(rows)
