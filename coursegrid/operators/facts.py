"""Course-year facts: section rows -> one row per course, reporting year and section.

The long form is the primary one; the wide table with a column per section is an export.
"""

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursegrid.functions.nulls import none_if_zero, paste, sum_known
from coursegrid.functions.terms import FALL, SPRING, key_piece, term_label
from coursegrid.operators.clean import unite_course
from coursegrid.operators.totals import with_group_totals
from coursegrid.schemas import FACTS, SECTION_DOMAIN, wide_schema

ATTRIBUTES = ["subject", "course_number", "course_level"]
SOURCE_ORDER = "source_order"


def section_totals(rows: DataFrame, sections=SECTION_DOMAIN) -> DataFrame:
    """Collapse section rows to one row per course, year and section before anything else.

    Sections outside the domain become one null section. The result has few rows per group
    however hot a course is; all aggregates have fixed-width buffers and combine map-side. The
    rows of a group share their attributes, so the place of the first one is all that a
    `source_order` has to carry.
    """
    copies = (
        F.coalesce("capacity_records", F.lit(1)) if "capacity_records" in rows.columns else F.lit(1)
    )
    key = F.col("section")
    place = [F.min(SOURCE_ORDER).alias(SOURCE_ORDER)] if SOURCE_ORDER in rows.columns else []
    return rows.groupBy(
        "course_name",
        "course_title",
        "reporting_year",
        F.when(key.isin(list(sections)), key).alias("section_key"),
        F.col("xlist_section1").isNotNull().alias("is_crosslisted"),
        *ATTRIBUTES,
    ).agg(
        F.sum(copies).alias("n_rows"),
        F.sum(F.when(F.col("enrolled").isNull(), copies).otherwise(0)).alias("n_unknown"),
        sum_known(F.col("enrolled") * copies).alias("enrolled"),
        sum_known(F.col("section_capacity")).alias("capacity"),
        *place,
    )


def pool_section_totals(totals: DataFrame) -> DataFrame:
    """Cross-list pooling on collapsed rows.

    Every member row of a pool counts with the pool's enrollment, so a collapsed row counts
    `n_rows` times the pool sum; a pool with an unknown enrollment counts nothing.
    """
    member = F.col("is_crosslisted") & F.col("section_key").isNotNull()
    pooled = with_group_totals(
        totals,
        ["course_title", "section_key", "reporting_year"],
        {"_pool": F.col("enrolled"), "_unknown": F.col("n_unknown")},
        spread_by=["course_name"],
        only=member,
    )
    shared = F.when(F.col("_unknown") == 0, F.col("_pool") * F.col("n_rows")).otherwise(0.0)
    return pooled.withColumn(
        "enrolled", F.when(member, shared).otherwise(F.col("enrolled"))
    ).drop("_pool", "_unknown")


def course_year_facts(rows: DataFrame, sections=SECTION_DOMAIN) -> DataFrame:
    """Section rows (see `clean_registrations`) -> long course-year facts, schema `FACTS`.

    The collapsed rows are used twice, for the pools and for their members. Observing all their
    sums (readable as query metrics) keeps filters and column pruning from making the two uses
    different, so that Spark scans, joins and shuffles the registrations once and reuses it.

    One exchange by course and year serves the yearly capacity, the course attributes and the
    section sums; a course-year has at most one collapsed row per section, cross-list flag and
    attribute combination there. Where attributes differ within a course-year, the smallest known
    value is carried, or, if the rows have a `source_order`, the first value, even if it is null.
    """
    return facts_and_years(rows, sections)[0]


def facts_and_years(rows: DataFrame, sections=SECTION_DOMAIN) -> tuple[DataFrame, DataFrame]:
    """The facts, and the reporting years of all rows from the same collapsed rows.

    A question that needs both, like a gap-filled axis, scans the registrations once.
    """
    totals = section_totals(rows, sections)
    sums = [F.sum(m).alias(m) for m in ("n_rows", "n_unknown", "enrolled", "capacity")]
    if SOURCE_ORDER in totals.columns:
        sums.append(F.min(SOURCE_ORDER).alias(SOURCE_ORDER))
    collapsed = totals.observe(f"section_totals_{uuid.uuid4().hex}", *sums)
    return _facts(collapsed), collapsed.select("reporting_year").distinct()


def _facts(collapsed: DataFrame) -> DataFrame:
    totals = pool_section_totals(collapsed)
    united = totals.withColumn("course", paste(": ", F.col("course_name"), F.col("course_title")))
    by_course = united.repartition("course", "reporting_year")
    course_year = Window.partitionBy("course", "reporting_year")
    if SOURCE_ORDER in united.columns:
        first = F.min(_source_rank()).over(course_year)
        carried = [first[a].alias(a) for a in ATTRIBUTES]
    else:
        carried = [F.min(a).over(course_year).alias(a) for a in ATTRIBUTES]
    whole_year = by_course.select(
        "course",
        "reporting_year",
        "section_key",
        "enrolled",
        "capacity",
        F.sum("capacity").over(course_year).alias("yearly_capacity"),
        *carried,
    )
    facts = whole_year.groupBy(
        "course", "reporting_year", "section_key", "yearly_capacity", *ATTRIBUTES
    ).agg(
        F.sum(F.when(F.col("section_key").isNotNull(), F.col("enrolled"))).alias("enrolled"),
        F.sum("capacity").alias("capacity"),
    )
    key = F.col("section_key")
    return facts.withColumns(
        {"semester": key_piece(key, 1), "section": key_piece(key, 2)}
    ).select(*FACTS.fieldNames())


def _source_rank() -> Column:
    """Sorts the rows of a course-year as they stand after pooling, with their attributes.

    Cross-listed rows come first, then source order; rows without a place come last, and rows at
    one place by their attributes. The attributes of the smallest are the first ones, nulls included.
    """
    return F.struct(
        (~F.col("is_crosslisted")).alias("single"),
        F.col(SOURCE_ORDER).isNull().alias("unplaced"),
        SOURCE_ORDER,
        *ATTRIBUTES,
    )


def attribute_conflicts(rows: DataFrame) -> DataFrame:
    """Course-years whose rows differ in subject, number or level, with the number of values.

    The facts take the smallest known value there, or with a source order the first one; this
    tells where that choice mattered.
    """
    values = [F.collect_set(F.coalesce(F.col(a).cast("string"), F.lit("NA"))) for a in ATTRIBUTES]
    years = unite_course(rows).groupBy("course", "reporting_year").agg(
        *[F.size(v).alias(f"{a}_values") for v, a in zip(values, ATTRIBUTES)]
    )
    return years.filter(" OR ".join(f"{a}_values > 1" for a in ATTRIBUTES))


def _where(condition: Column, value: str) -> Column:
    return sum_known(F.when(condition, F.col(value)))


def course_years(facts: DataFrame) -> DataFrame:
    """One row per course and reporting year: enrollment, capacity and section counts.

    Everything the yearly, per-term, discipline and picker questions need comes from this one
    aggregate, so none of them joins.
    """
    fall, spring = F.col("semester") == FALL, F.col("semester") == SPRING
    offered = F.col("enrolled") != 0
    return facts.groupBy(
        "course", "reporting_year", "course_number", "subject", "yearly_capacity", "course_level"
    ).agg(
        _where(F.col("section_key").isNotNull(), "enrolled").alias("yearly_enrolled"),
        _where(fall, "enrolled").alias("fall_enrolled"),
        _where(spring, "enrolled").alias("spring_enrolled"),
        _where(fall, "capacity").alias("fall_capacity"),
        _where(spring, "capacity").alias("spring_capacity"),
        F.count(F.when(fall & offered, 1)).alias("fall_sections"),
        F.count(F.when(spring & offered, 1)).alias("spring_sections"),
    )


def sections_in_year(excluded_terms=()) -> Column:
    """Offered sections of a course-year outside the excluded terms; null if there are none."""
    counts = []
    for semester, count in ((FALL, "fall_sections"), (SPRING, "spring_sections")):
        sections = F.col(count)
        if excluded_terms:
            term = term_label(F.col("reporting_year"), F.lit(semester))
            sections = F.when(term.isin(list(excluded_terms)), 0).otherwise(sections)
        counts.append(sections)
    return none_if_zero(counts[0] + counts[1])


def enrollment_totals(facts: DataFrame) -> DataFrame:
    return course_years(facts).select(
        "course", "reporting_year", "yearly_enrolled", "fall_enrolled", "spring_enrolled"
    )


def capacity_by_semester(facts: DataFrame) -> DataFrame:
    return course_years(facts).select(
        "course", "reporting_year", "fall_capacity", "spring_capacity"
    )


def section_pivot(facts: DataFrame, value: str, sections=SECTION_DOMAIN) -> DataFrame:
    """One column per section with the summed value; 0 where a section is missing."""
    return (
        facts.groupBy("course", "reporting_year")
        .pivot("section_key", list(sections))
        .agg(F.sum(value))
        .na.fill(0.0, subset=list(sections))
    )


def list_cell_sum(rows: DataFrame) -> DataFrame:
    """Number of values and their sum per course, year and section cell.

    The cells are never gathered as lists: the sum of a list cell is the sum of its rows.
    """
    return rows.groupBy("course", "reporting_year", F.col("section").alias("section_key")).agg(
        F.count(F.lit(1)).alias("cell_size"),
        sum_known(F.col("section_capacity")).alias("cell_sum"),
    )


def to_wide(facts: DataFrame, sections=SECTION_DOMAIN) -> DataFrame:
    """The wide export: totals, one enrollment column per section, attributes, capacities.

    The totals are sums of their own, so that a query on them alone drops the section columns.
    """
    fall, spring = F.col("semester") == FALL, F.col("semester") == SPRING
    sums = facts.groupBy(
        "course", "reporting_year", "course_number", "subject", "yearly_capacity", "course_level"
    ).agg(
        _where(F.col("section_key").isNotNull(), "enrolled").alias("yearly_enrolled"),
        _where(fall, "enrolled").alias("fall_enrolled"),
        _where(spring, "enrolled").alias("spring_enrolled"),
        _where(fall, "capacity").alias("fall_capacity"),
        _where(spring, "capacity").alias("spring_capacity"),
        *[_where(F.col("section_key") == key, "enrolled").alias(key) for key in sections],
    )
    return sums.select(*wide_schema(sections).fieldNames())


def from_wide(wide: DataFrame, sections=SECTION_DOMAIN) -> DataFrame:
    """Unpivot the section columns of the wide table: one row per course, year and section."""
    long = wide.unpivot(
        ["course", "reporting_year", "subject", "course_level", "yearly_capacity"],
        list(sections),
        "section_key",
        "enrolled",
    )
    key = F.col("section_key")
    return long.withColumns({"semester": key_piece(key, 1), "section": key_piece(key, 2)})
