"""Named questions over one set of facts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursegrid.functions.nulls import paste
from coursegrid.operators import courses, discipline, facts, picker, seats, spines, trends
from coursegrid.operators.clean import clean_registrations, courses_of_subjects, normalize_capacity
from coursegrid.schemas import (
    PANDEMIC_INPUT_TERMS,
    PANDEMIC_TERMS,
    PANDEMIC_YEARS,
    SECTION_DOMAIN,
)


# The settings of the enrollment chart.
SHOW_SECTIONS, LABEL_SECTIONS = "show class sections", "label sections"


def _by_year(time: str) -> bool:
    """Whether a time frame is the year; the other one is the semester, in any case of letters."""
    frame = time.lower()
    if frame not in ("year", "semester"):
        raise ValueError(f"time is 'year' or 'semester', not {time!r}")
    return frame == "year"


class Registrar:
    """Facts with the excluded terms and years every question shares.

    Answer many questions from facts that were written once (`sources.io.write_facts`), so that
    the wrangle does not run again for each.
    """

    def __init__(
        self,
        facts_table: DataFrame,
        *,
        excluded_terms=PANDEMIC_TERMS,
        excluded_years=PANDEMIC_YEARS,
        years: DataFrame | None = None,
        registrations: DataFrame | None = None,
    ):
        """`years`: table with the reporting years of the time axes, the facts unless given.

        `registrations`: the raw table, needed for the title trend only.
        """
        self.facts = facts_table
        self.years = facts_table if years is None else years
        self.registrations = registrations
        self.excluded_terms = tuple(excluded_terms)
        self.excluded_years = tuple(excluded_years)

    @classmethod
    def from_registrations(
        cls,
        registrations: DataFrame,
        capacity: DataFrame,
        *,
        subjects=None,
        regular_only: bool = True,
        excluded_input_terms=PANDEMIC_INPUT_TERMS,
        sections=SECTION_DOMAIN,
        chosen=None,
        about=None,
        source_order: str | None = None,
        **options,
    ) -> "Registrar":
        """Wrangle the raw tables (`schemas.REGISTRATIONS`, `schemas.CAPACITY`).

        With `chosen`, names or a table of courses, only what facts of these courses need is
        read; the questions are then about them, and so are the time axes. `about` does so for the
        courses that have one of these subjects in some row. `source_order` names a column with
        the place of a row in its source: course-years then carry the attributes of their first
        row, cross-listed rows before others, and not the smallest known ones.
        """
        rows = clean_registrations(
            registrations,
            normalize_capacity(capacity),
            subjects=subjects,
            regular_only=regular_only,
            excluded_terms=excluded_input_terms,
            courses=chosen,
            about=about,
            collapse=True,
            source_order=source_order,
        )
        table, years = facts.facts_and_years(rows, sections)
        if chosen is not None:
            table = courses.choose(table, chosen)
        if about is not None:
            named = courses_of_subjects(registrations, about)
            table = courses.choose(table, named.select(paste(": ", F.col("course_name"), F.col("course_title")).alias("course")))
        return cls(table, years=years, registrations=registrations, **options)

    @property
    def _terms(self) -> dict:
        return {"excluded_terms": self.excluded_terms}

    @property
    def _terms_and_years(self) -> dict:
        return {"excluded_terms": self.excluded_terms, "excluded_years": self.excluded_years}

    def register_views(self, prefix: str = "") -> None:
        """Temp views over the facts for SQL users."""
        self.facts.createOrReplaceTempView(f"{prefix}course_year_facts")
        self.enrollment("year").createOrReplaceTempView(f"{prefix}course_yearly")
        self.enrollment("semester").createOrReplaceTempView(f"{prefix}course_semester")

    def enrollment(self, time: str = "semester", chosen=None) -> DataFrame:
        """Enrollment by course, per `semester` or `year`."""
        if _by_year(time):
            return courses.course_yearly(self.facts, chosen, **self._terms_and_years)
        return courses.course_semester(self.facts, chosen, **self._terms)

    def section_marks(self, chosen=None) -> DataFrame:
        return courses.section_marks(self.facts, chosen, **self._terms)

    def open_seats(self, time: str = "semester", chosen=None) -> DataFrame:
        """Seat measures by course, per `semester` or `year`."""
        if _by_year(time):
            return seats.open_seats_yearly(self.facts, chosen, **self._terms_and_years)
        return seats.open_seats_semester(self.facts, chosen, **self._terms)

    def seat_classes(self, time: str = "semester", chosen=None) -> DataFrame:
        """Seat classes on a gap-free time axis."""
        if _by_year(time):
            return seats.seat_class_yearly(
                self.facts, chosen, years=self.years, **self._terms_and_years
            )
        return seats.seat_class_semester(self.facts, chosen, years=self.years, **self._terms)

    def completed_seats(
        self, time: str = "semester", chosen=None, *, own_range: bool = False
    ) -> DataFrame:
        """Seat measures on a gap-free time axis; for years also on each course's own range."""
        if _by_year(time):
            full = seats.completed_years(
                self.facts, chosen, years=self.years, own_range=own_range, **self._terms_and_years
            )
            keys = ["course", "reporting_year"]
            return seats.seat_measures(full, keys, "yearly_enrolled", "yearly_capacity")
        if own_range:
            raise ValueError("own_range is for years")
        return seats.seats_completed_terms(
            self.facts, chosen, years=self.years, **self._terms
        )

    def enrollment_chart(
        self, time: str = "semester", chosen=None, settings=()
    ) -> dict[str, DataFrame]:
        """The layers of the enrollment chart: `line`, and `sections` if they are to be shown.

        Sections are shown by semester only; they have a `label` if they are to be labelled.
        """
        unknown = set(settings) - {SHOW_SECTIONS, LABEL_SECTIONS}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        line = courses.titled(self.enrollment(time, chosen), courses.ENROLLMENT_TITLE)
        layers = {"line": line}
        if settings and not _by_year(time):
            marks = self.section_marks(chosen)
            labelled = marks.withColumn("label", marks["section"])
            layers["sections"] = labelled if LABEL_SECTIONS in settings else marks
        return layers

    def axis_limits(self, chosen=None) -> DataFrame:
        """Largest enrollments and the range of years over the chosen courses, or all."""
        return spines.axis_limits(self.facts, chosen, **self._terms_and_years)

    def discipline_limits(self, subjects) -> DataFrame:
        return discipline.axis_limits(self.facts, subjects, **self._terms_and_years)

    def title_trend(self, time: str = "semester", subjects=None) -> DataFrame:
        """Enrollment by course title, per input term or reporting year."""
        if self.registrations is None:
            raise ValueError("the title trend needs the registrations")
        trend = trends.title_year if _by_year(time) else trends.title_term
        return trend(self.registrations, subjects)

    def discipline(self, subjects) -> DataFrame:
        return discipline.discipline_by_level(self.facts, subjects, **self._terms_and_years)

    def pick_courses(self, subject: str, *, min_capacity=6, min_years=3) -> DataFrame:
        return picker.course_picker(
            self.facts, subject, min_capacity=min_capacity, min_years=min_years, **self._terms
        )

    def courses(self) -> DataFrame:
        return spines.distinct_courses(self.facts)

    def subjects(self) -> DataFrame:
        return spines.distinct_subjects(self.facts)

    def terms(self) -> DataFrame:
        return spines.term_order(self.facts)

    def wide(self) -> DataFrame:
        return facts.to_wide(self.facts)
