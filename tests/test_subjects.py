"""Questions about a subject read the rows of its courses and of their pools only."""

import pytest
from pyspark.sql import functions as F

from coursegrid.operators import clean, discipline, facts, picker
from coursegrid.plans.catalog import SUBJECT, TERMS, TERMS_AND_YEARS, Tables, queries
from coursegrid.plans.registrar import Registrar
from coursegrid.sources import demo

BY_SUBJECT = ["course_picker", "discipline_by_level", "discipline_guard", "discipline_titled", "discipline_derived_level", "axis_limits_discipline"]


def listed(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("name", BY_SUBJECT)
def test_subject_stands_below_the_first_sum(spark, folder, name):
    plan = queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("CollectMetrics"):]
    below = below[below.index("Aggregate"):]
    assert "LeftSemi" in below and SUBJECT in below


def test_same_answers_as_from_all_rows(spark, folder):
    t = Tables(spark, folder)
    few = facts.course_year_facts(
        clean.clean_registrations(t.registrations, t.capacity, about=[SUBJECT], collapse=True)
    )
    every = facts.course_year_facts(clean.clean_registrations(t.registrations, t.capacity, collapse=True))
    assert few.count() < every.count()
    assert listed(picker.course_picker(few, SUBJECT, first_look=False, **TERMS)) == listed(
        picker.course_picker(every, SUBJECT, **TERMS)
    )
    assert listed(discipline.discipline_by_level(few, SUBJECT, **TERMS_AND_YEARS)) == listed(
        discipline.discipline_by_level(every, SUBJECT, **TERMS_AND_YEARS)
    )


def test_rows_kept(spark):
    rows = [
        ("A-1", "Pool", "S", None), ("B-1", "Pool", "T", "X1"), ("B-2", "Pool", "T", None), ("A-1", "Pool", "T", None),
        ("A-2", None, "S", None), ("C-1", None, "T", "X2"), ("C-1", "NA", "T", None), (None, "Other", "S", None), ("D", "Else", None, "X3"),
    ]
    table = spark.createDataFrame(rows, "course_name string, course_title string, subject string, xlist_section1 string")
    kept = clean.filter_courses_and_pools(table, clean.courses_of_subjects(table, "S"))
    assert listed(kept) == sorted((rows[i] for i in (0, 1, 3, 4, 5, 7)), key=str)


def test_a_registrar_about_a_subject(spark, folder):
    raw = demo.registrations(spark, folder), demo.capacity(spark, folder)
    few, every = Registrar.from_registrations(*raw, about=SUBJECT), Registrar.from_registrations(*raw)
    assert listed(few.discipline(SUBJECT)) == listed(every.discipline(SUBJECT))
    of_subject = clean.courses_of_subjects(raw[0], SUBJECT).select(F.concat_ws(": ", "course_name", "course_title").alias("course"))
    assert listed(few.facts.select("course").distinct()) == listed(every.facts.join(of_subject, "course", "left_semi").select("course").distinct())
