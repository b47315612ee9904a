"""Relations that hold for any input, and independence of row order and partitioning."""

import pytest
from pyspark.sql import functions as F

from coursegrid.operators import courses, facts, pool, seats
from coursegrid.plans.catalog import EXCLUDED_TERMS, Tables
from coursegrid.schemas import FACTS


@pytest.fixture(scope="module")
def tables(spark, folder):
    return Tables(spark, folder)


@pytest.fixture(scope="module")
def long(tables):
    return tables.facts.cache()


def test_facts_schema(long):
    assert [(f.name, f.dataType) for f in long.schema] == [(f.name, f.dataType) for f in FACTS]


def test_halves_add_up(long):
    years = facts.course_years(long)
    assert years.filter("fall_enrolled + spring_enrolled <> yearly_enrolled").isEmpty()


def test_last_mark_is_the_term_total(long):
    marks = courses.cumulative_sections(long).groupBy("course", "term").agg(
        F.max("cumulative_enrolled").alias("last")
    )
    terms = courses.course_semester(long)
    joined = marks.join(terms, ["course", "term"], "full")
    assert joined.filter("not (last <=> semester_enrolled)").isEmpty()


def test_seats_balance(long):
    wide = (
        seats.open_seats_yearly(long)
        .groupBy("course", "reporting_year")
        .pivot("measure", ["overenrollments", "empty_seats", "enrollments"])
        .agg(F.first("n_students"))
        .join(facts.course_years(long), ["course", "reporting_year"])
    )
    assert wide.filter("overenrollments * empty_seats <> 0").isEmpty()
    assert wide.filter(
        "enrollments - overenrollments + empty_seats <> yearly_capacity"
    ).isEmpty()


def test_term_sections_add_up_to_the_year(long):
    terms = courses.section_terms(long, EXCLUDED_TERMS).groupBy("course", "reporting_year").count()
    years = courses.sections_per_year(long, EXCLUDED_TERMS)
    joined = terms.join(years, ["course", "reporting_year"], "full")
    assert joined.filter("not (count <=> total_sections)").isEmpty()


def test_pooling_keeps_the_rows(tables):
    rows = tables.rows()
    assert pool.pool_crosslisted(rows).count() == rows.count()


def test_row_form_and_collapsed_form_agree(tables, long):
    """Facts summed from pooled rows are the facts made from collapsed rows."""
    rows = pool.pool_crosslisted(tables.rows())
    cells = rows.groupBy("course", "reporting_year", F.col("section").alias("section_key")).agg(
        F.sum("enrolled").alias("row_enrolled")
    )
    joined = long.join(cells, ["course", "reporting_year", "section_key"], "left")
    known = joined.filter(F.col("section_key").isNotNull())
    assert known.filter("not (enrolled <=> row_enrolled)").isEmpty()


def test_order_and_partitions_do_not_matter(tables, long):
    shuffled = tables.rows(collapse=True).orderBy(F.rand(7)).repartition(5)
    again = facts.course_year_facts(shuffled)
    columns = FACTS.fieldNames()
    assert again.select(columns).exceptAll(long.select(columns)).isEmpty()
    assert long.select(columns).exceptAll(again.select(columns)).isEmpty()


def test_wide_round_trip(long):
    back = courses.offered_sections(facts.from_wide(facts.to_wide(long)))
    direct = courses.offered_sections(long)
    columns = ["course", "reporting_year", "term", "section", "enrolled", "subject", "course_level"]
    assert back.select(columns).exceptAll(direct.select(columns)).isEmpty()
    assert direct.select(columns).exceptAll(back.select(columns)).isEmpty()
