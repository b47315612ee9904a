"""The registered queries, each over the whole given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursegrid.functions.nulls import paste
from coursegrid.operators import (
    clean,
    courses,
    discipline,
    facts,
    order,
    picker,
    pool,
    seats,
    spines,
    trends,
)
from coursegrid.plans.registrar import LABEL_SECTIONS, SHOW_SECTIONS, Registrar
from coursegrid.sources import demo, io

# Parameters of the questions on the given tables.
EXCLUDED_INPUT_TERMS = ("1998FA", "1999SP")
EXCLUDED_TERMS = ("1998_FA", "1999_SP")
EXCLUDED_YEARS = (1998,)
SUBJECT = "STANDARD"
SUBJECTS = ("STANDARD", "PROMO", "SMALL", "LARGE")
TITLE = "blue anvil"
# Courses chosen by name; the names are those of parts, so some of them are missing in small tables.
COURSES = tuple(f"{s}-{n}: {TITLE}" for s in ("PROMO", "STANDARD") for n in range(110, 510, 10))
CODE = "PROMO-1[0-9]0"
COURSE_ID = 96

TERMS = {"excluded_terms": EXCLUDED_TERMS}
TERMS_AND_YEARS = {"excluded_terms": EXCLUDED_TERMS, "excluded_years": EXCLUDED_YEARS}


class Tables:
    """The given tables as registrations, and the stages derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.registrations = demo.registrations(spark, folder)
        self.sections = demo.sections(spark, folder)
        self.raw_capacity = demo.capacity(spark, folder)

    @property
    def capacity(self) -> DataFrame:
        return clean.normalize_capacity(self.raw_capacity)

    def complete(self, rows: DataFrame) -> DataFrame:
        """Section rows as registrations."""
        return demo.with_courses(rows, demo.courses(self.spark, self.folder))

    @property
    def with_capacity(self) -> DataFrame:
        """The registrations with their capacity records; the join deals out narrow section rows."""
        rows = self.complete(clean.join_capacity(self.sections, self.capacity))
        return rows.select("course_section_id", *[c for c in rows.columns if c != "course_section_id"])

    @property
    def in_scope(self) -> DataFrame:
        """Registrations in scope without capacity: enough for the time axis."""
        terms = clean.exclude_input_terms(self.registrations, EXCLUDED_INPUT_TERMS)
        return clean.filter_regular(terms)

    def rows(self, *, collapse: bool = False) -> DataFrame:
        return clean.clean_registrations(
            self.sections,
            self.capacity,
            excluded_terms=EXCLUDED_INPUT_TERMS,
            collapse=collapse,
            complete=self.complete,
        )

    @property
    def facts(self) -> DataFrame:
        return facts.course_year_facts(self.rows(collapse=True))

    @property
    def first_value_facts(self) -> DataFrame:
        """Facts that carry the attributes of the first row, from rows that differ in them."""
        rows = clean.clean_registrations(
            demo.sections(self.spark, self.folder, own_levels=True),
            self.capacity,
            excluded_terms=EXCLUDED_INPUT_TERMS,
            collapse=True,
            source_order="source_order",
            complete=self.complete,
        )
        return facts.course_year_facts(rows)

    @property
    def registrar(self) -> Registrar:
        """The facade over the raw tables."""
        return Registrar.from_registrations(
            self.registrations,
            self.raw_capacity,
            excluded_input_terms=EXCLUDED_INPUT_TERMS,
            **TERMS_AND_YEARS,
        )

    @property
    def facts_and_years(self) -> tuple[DataFrame, DataFrame]:
        """The facts and the reporting years of their rows, from one scan."""
        return facts.facts_and_years(self.rows(collapse=True))

    def facts_of(self, courses=None, excluded_years=(), about=None) -> DataFrame:
        """Facts from no more rows than questions about some courses, years or subjects need."""
        rows = clean.clean_registrations(
            self.registrations,
            self.capacity,
            excluded_terms=EXCLUDED_INPUT_TERMS,
            courses=courses,
            about=about,
            catalogue=demo.courses(self.spark, self.folder),
            excluded_years=excluded_years,
            collapse=True,
        )
        return facts.course_year_facts(rows)

    @property
    def chosen(self) -> DataFrame:
        """The chosen courses as a table: all with the chosen title."""
        return demo.courses(self.spark, self.folder).filter(F.col("course_title") == TITLE).select(
            paste(": ", F.col("course_name"), F.col("course_title")).alias("course")
        )

    @property
    def subject_facts(self) -> DataFrame:
        """The older profile: a few subjects, all schedule types and terms."""
        rows = clean.clean_registrations(
            self.registrations,
            self.capacity,
            subjects=SUBJECTS,
            regular_only=False,
            collapse=True,
        )
        return facts.course_year_facts(rows)

    def csv_roundtrip(self) -> DataFrame:
        path = io.scratch_path(self.spark, "wide")
        io.write_wide_csv(facts.to_wide(self.facts), path)
        return io.read_wide_csv(self.spark, path)


def over_all_years(t: Tables, question, excluded: dict) -> DataFrame:
    """A gap-filled question on the chosen courses over the years of all rows."""
    table, years = t.facts_and_years
    return question(table, t.chosen, years=years, **excluded)


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # section rows
    "scan_registrations": lambda t: t.registrations,
    "scan_capacity": lambda t: t.capacity,
    "project_registration": lambda t: clean.project_registrations(t.registrations),
    "placed_registrations": lambda t: order.placed(
        t.registrations, ["reporting_year", "course_section_id"], clean.latest_first()
    ),
    "preview_top6": lambda t: courses.preview(facts.to_wide(t.facts)),
    "filter_subjects": lambda t: clean.filter_subjects(t.registrations, SUBJECTS),
    "filter_schedule_null": lambda t: clean.filter_regular(t.registrations),
    "exclude_terms": lambda t: clean.exclude_input_terms(t.registrations, EXCLUDED_INPUT_TERMS),
    "xlist_members": lambda t: clean.crosslisted(t.registrations),
    "split_term": lambda t: clean.split_input_term(t.registrations),
    "unite_course_section": lambda t: clean.unite_course(
        clean.unite_section(clean.split_input_term(t.registrations))
    ),
    "extract_course_code": lambda t: courses.extract_code(facts.course_years(t.facts), CODE),
    "join_capacity": lambda t: t.with_capacity,
    "clean_registrations": lambda t: t.rows(),
    "xlist_pooled": lambda t: pool.pooled_members(t.rows()),
    "xlist_combined": lambda t: pool.pool_crosslisted(t.rows()),
    "yearly_capacity": lambda t: pool.with_yearly_capacity(clean.unite_course(t.rows())),
    # course-years
    "section_pivot_capacity": lambda t: facts.section_pivot(t.facts, "capacity"),
    "section_pivot_enrolled": lambda t: facts.section_pivot(t.facts, "enrolled"),
    "list_cell_sum": lambda t: facts.list_cell_sum(clean.unite_course(t.rows())),
    "capacity_by_semester": lambda t: facts.capacity_by_semester(t.facts),
    "enrollment_totals": lambda t: facts.enrollment_totals(t.facts),
    "course_year_facts": lambda t: t.facts,
    "wide_facts": lambda t: facts.to_wide(t.facts),
    "wide_facts_subjects": lambda t: facts.to_wide(t.subject_facts),
    "wide_facts_first_values": lambda t: facts.to_wide(t.first_value_facts),
    "csv_roundtrip": lambda t: t.csv_roundtrip(),
    # sections and terms
    "section_long": lambda t: courses.section_terms(t.facts, EXCLUDED_TERMS),
    "section_long_from_wide": lambda t: courses.offered_sections(
        facts.from_wide(facts.to_wide(t.facts)), EXCLUDED_TERMS
    ),
    "semester_long": lambda t: courses.semester_long(t.facts),
    "semester_long_raw": lambda t: courses.semester_long(t.facts, raw_terms=True),
    "sections_per_year": lambda t: courses.sections_per_year(t.facts, EXCLUDED_TERMS),
    "sections_per_term": lambda t: courses.sections_per_term(t.facts, EXCLUDED_TERMS),
    "cumulative_sections": lambda t: courses.cumulative_sections(t.facts, **TERMS),
    "section_marks": lambda t: courses.section_marks(t.facts, **TERMS),
    # enrollment by course
    "course_yearly": lambda t: courses.course_yearly(
        t.facts_of(excluded_years=EXCLUDED_YEARS), **TERMS_AND_YEARS
    ),
    "course_semester": lambda t: courses.course_semester(t.facts, **TERMS),
    "course_semester_raw": lambda t: courses.course_semester(t.facts, raw_terms=True),
    "course_semester_selected": lambda t: courses.course_semester(
        t.facts_of(COURSES), COURSES, **TERMS
    ),
    "course_semester_joined": lambda t: courses.course_semester(
        t.facts_of(t.chosen), t.chosen, **TERMS
    ),
    # open seats
    "open_seats_yearly": lambda t: seats.open_seats_yearly(
        t.facts_of(excluded_years=EXCLUDED_YEARS), **TERMS_AND_YEARS
    ),
    "open_seats_semester": lambda t: seats.open_seats_semester(t.facts, **TERMS),
    "open_seats_titled": lambda t: courses.titled(
        seats.open_seats_semester(t.facts_of(t.chosen), t.chosen, **TERMS), courses.CAPACITY_TITLE
    ),
    "seat_class_yearly": lambda t: over_all_years(t, seats.seat_class_yearly, TERMS_AND_YEARS),
    "seat_class_semester": lambda t: over_all_years(t, seats.seat_class_semester, TERMS),
    "complete_years": lambda t: over_all_years(t, seats.completed_years, TERMS_AND_YEARS),
    "complete_years_own_range": lambda t: seats.completed_years(
        t.facts_of(t.chosen), t.chosen, own_range=True, **TERMS_AND_YEARS
    ),
    "complete_terms": lambda t: over_all_years(t, seats.seats_completed_terms, TERMS),
    "term_spine": lambda t: spines.term_spine(t.in_scope),
    "year_spine": lambda t: spines.year_spine(t.in_scope),
    # discipline
    "discipline_by_level": lambda t: discipline.discipline_by_level(
        t.facts_of(excluded_years=EXCLUDED_YEARS, about=SUBJECT), SUBJECT, **TERMS_AND_YEARS
    ),
    "discipline_guard": lambda t: discipline.discipline_by_level(
        t.facts_of(excluded_years=EXCLUDED_YEARS, about=["UNKNOWN", SUBJECT]),
        ["UNKNOWN", SUBJECT],
        **TERMS_AND_YEARS,
    ),
    "discipline_titled": lambda t: courses.titled(
        discipline.discipline_by_level(
            t.facts_of(excluded_years=EXCLUDED_YEARS, about=SUBJECT), SUBJECT, **TERMS_AND_YEARS
        ),
        courses.ENROLLMENT_TITLE,
        F.lit(SUBJECT),
    ),
    "discipline_derived_level": lambda t: discipline.discipline_derived_level(
        t.facts_of(about=SUBJECT), SUBJECT
    ),
    # picker
    "capacity_stats": lambda t: picker.capacity_stats(t.facts, EXCLUDED_TERMS),
    "years_offered": lambda t: picker.years_offered(t.facts, EXCLUDED_TERMS),
    "total_offered": lambda t: picker.total_offered(t.facts, EXCLUDED_TERMS),
    "total_offered_all_terms": lambda t: picker.total_offered(t.facts),
    "rated_courses": lambda t: picker.rated_courses(t.facts, EXCLUDED_TERMS),
    "course_picker": lambda t: picker.course_picker(
        t.facts_of(about=SUBJECT), SUBJECT, first_look=False, **TERMS
    ),
    "section_weighted_capacity": lambda t: picker.section_weighted_capacity(t.facts),
    "total_capacity": lambda t: picker.total_capacity(t.facts, EXCLUDED_TERMS),
    "total_capacity_terms": lambda t: picker.total_capacity_terms(t.facts, EXCLUDED_TERMS),
    # dimensions
    "term_order": lambda t: spines.term_order(t.in_scope),
    "term_order_raw": lambda t: spines.term_order(t.in_scope, raw_terms=True),
    "term_order_median": lambda t: spines.term_order_median(t.facts, **TERMS),
    "axis_limits": lambda t: spines.axis_limits(t.facts, **TERMS_AND_YEARS),
    "axis_limits_selected": lambda t: spines.axis_limits(
        t.facts_of(t.chosen), t.chosen, **TERMS_AND_YEARS
    ),
    "axis_limits_discipline": lambda t: discipline.axis_limits(
        t.facts_of(excluded_years=EXCLUDED_YEARS, about=SUBJECT), SUBJECT, **TERMS_AND_YEARS
    ),
    "distinct_subjects": lambda t: spines.distinct_subjects(clean.unite_course(t.in_scope)),
    "distinct_courses": lambda t: spines.distinct_courses(clean.unite_course(t.in_scope)),
    # title trends
    "title_term": lambda t: trends.title_term(t.registrations, SUBJECTS),
    "title_year": lambda t: trends.title_year(t.registrations, SUBJECTS),
    "placed_title_years": lambda t: order.placed(
        trends.title_year(t.registrations, SUBJECTS),
        ["reporting_year", "course_title"],
        trends.earliest_first(),
    ),
    "title_term_split": lambda t: trends.title_term_split(t.registrations, SUBJECTS, "FA"),
    "course_id_terms": lambda t: trends.course_id_terms(t.registrations, COURSE_ID),
    # the facade, one question per mode
    "mode_year": lambda t: t.registrar.open_seats("Year"),
    "mode_semester": lambda t: t.registrar.open_seats("Semester"),
    "mode_line": lambda t: t.registrar.enrollment_chart("Year", settings=[SHOW_SECTIONS])["line"],
    "mode_sections": lambda t: t.registrar.enrollment_chart(settings=[SHOW_SECTIONS])["sections"],
    "mode_labelled_sections": lambda t: t.registrar.enrollment_chart(
        settings=[SHOW_SECTIONS, LABEL_SECTIONS]
    )["sections"],
    "mode_title_year": lambda t: t.registrar.title_trend("Year", SUBJECTS),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: over(build) for name, build in _QUERIES.items()}
