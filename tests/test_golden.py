"""Hand-computed results on the golden table."""

import golden
import pytest
from golden import CS, MATH, STAT
from pyspark.sql import functions as F

from coursegrid import Registrar
from coursegrid.operators import clean, courses, facts, picker, pool, seats, spines


@pytest.fixture(scope="module")
def rows(spark):
    return clean.clean_registrations(
        golden.registrations(spark),
        clean.normalize_capacity(golden.capacity(spark)),
        excluded_terms=("2020FA", "2021SP"),
    ).cache()


@pytest.fixture(scope="module")
def registrar(spark):
    made = Registrar.from_registrations(golden.registrations(spark), golden.capacity(spark))
    made.facts = made.facts.cache()
    return made


def one(df, *columns, **where):
    for name, value in where.items():
        df = df.filter(F.col(name) == value)
    (row,) = df.select(*columns).collect()
    return tuple(row)


def test_cleaning_drops_labs_and_excluded_terms(rows):
    assert sorted(r[0] for r in rows.select("course_section_id").collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_pool_members_share_their_enrollment(rows):
    got = {r.course: r.enrolled for r in pool.pooled_members(rows).collect()}
    assert got == {MATH: 13.0, CS: 13.0}


def test_pooling_keeps_all_rows(rows):
    pooled = pool.pool_crosslisted(rows)
    got = {r.course_section_id: r.enrolled for r in pooled.collect()}
    assert got == {1: 20.0, 2: 25.0, 3: 18.0, 4: 7.0, 5: 13.0, 6: 13.0, 7: 9.0}


def test_yearly_capacity_counts_sections_outside_the_domain(rows):
    capacity = pool.with_yearly_capacity(clean.unite_course(rows))
    assert {r.course: r.yearly_capacity for r in capacity.collect()} == {
        STAT: 90.0, MATH: 12.0, CS: 0.0,
    }


def test_course_year_totals(registrar):
    years = facts.course_years(registrar.facts)
    got = one(
        years, "yearly_enrolled", "fall_enrolled", "spring_enrolled", "yearly_capacity",
        "fall_capacity", "spring_capacity", course=STAT,
    )
    assert got == (63.0, 45.0, 18.0, 90.0, 46.0, 24.0)


def test_enrollment_by_year_and_term(registrar):
    yearly = one(registrar.enrollment("year"), "total_sections", "avg_section", course=STAT)
    assert yearly == (3, 21.0)
    # 22.5 rounds to the even neighbour
    fall = one(
        registrar.enrollment("semester"), "total_sections", "avg_section", course=STAT,
        term="2014_FA",
    )
    assert fall == (2, 22.0)


@pytest.mark.parametrize(
    "time, where, expected",
    [
        ("year", {"course": STAT}, ("Not Full", 63.0, 0.0, 27.0)),
        ("semester", {"course": STAT, "term": "2014_FA"}, ("Full", 45.0, 0.0, 1.0)),
        ("semester", {"course": STAT, "term": "2015_SP"}, ("Not Full", 18.0, 0.0, 6.0)),
        ("year", {"course": MATH}, ("Full", 13.0, 1.0, 0.0)),
        ("year", {"course": CS}, ("Full", 13.0, 13.0, 0.0)),
    ],
)
def test_open_seats(registrar, time, where, expected):
    table = registrar.open_seats(time)
    for name, value in where.items():
        table = table.filter(F.col(name) == value)
    got = {r.measure: (r.full_ind, r.n_students) for r in table.collect()}
    flag, enrolled, over, empty = expected
    assert got == {
        "enrollments": (flag, enrolled),
        "overenrollments": (flag, over),
        "empty_seats": (flag, empty),
    }


def test_section_marks(registrar):
    marks = registrar.section_marks([STAT]).orderBy("term", "section").collect()
    assert [(m.term, m.section, m.cumulative_enrolled, m.label_y) for m in marks] == [
        ("2014_FA", "01", 20.0, 15.0),
        ("2014_FA", "02", 45.0, 40.0),
        ("2015_SP", "01", 18.0, 13.0),
    ]
    assert marks[0].title == f"Enrollment for {STAT}"


def test_terms_in_time_order(registrar):
    got = [r.term for r in registrar.terms().orderBy("term_order").collect()]
    assert got == ["2014_FA", "2015_SP"]
    median = spines.term_order_median(registrar.facts).orderBy("term_order").collect()
    assert [r.term for r in median] == ["2014_FA", "2015_SP"]


def test_gap_rows_have_null_measures(registrar):
    table = seats.seats_completed_terms(registrar.facts, [MATH])
    gap = table.filter(F.col("term") == "2015_SP").collect()
    assert len(gap) == 3
    assert all(r.full_ind is None and r.n_students is None for r in gap)
    filled = {r.measure: r.n_students for r in table.filter(F.col("term") == "2014_FA").collect()}
    assert filled == {"enrollments": 13.0, "overenrollments": 1.0, "empty_seats": 0.0}


def test_gap_filled_years_span_all_courses(spark):
    extra = [*golden.ROWS, (10, "2017FA", 2017, "CS-140", "Intro", "01", 9.0, None, None)]
    made = Registrar.from_registrations(golden.registrations(spark, extra), golden.capacity(spark))
    classes = made.seat_classes("year", [MATH]).orderBy("reporting_year").collect()
    assert [r.reporting_year for r in classes] == [2014, 2015, 2016, 2017]
    assert (classes[0].enrolled_class, classes[0].capacity_class) == (
        "Over Enrollment", "Enrollment (full)",
    )
    assert classes[1].enrolled_class is None and classes[1].yearly_enrolled is None


def test_discipline(registrar):
    got = one(registrar.discipline("STAT"), "enrolled", "total_sections", "avg_section")
    assert got == (63.0, 3, 21.0)
    assert registrar.discipline("NONE").count() == 0


def test_course_picker(registrar):
    got = one(
        registrar.pick_courses("STAT", min_capacity=6, min_years=1),
        "course", "full_avg_capacity", "total_years_offered",
    )
    assert got == (STAT, 30.0, 1)
    assert registrar.pick_courses("STAT", min_capacity=6, min_years=3).count() == 0


def test_wide_export(registrar):
    row = registrar.wide().filter(F.col("course") == STAT).first()
    assert len(row) == 49
    assert (row.yearly_enrolled, row.FA_01, row.FA_02, row.SP_01, row.FA_23) == (63, 20, 25, 18, 0)


def test_views(registrar, spark):
    registrar.register_views("g_")
    got = spark.sql(f"SELECT yearly_enrolled FROM g_course_yearly WHERE course = '{STAT}'").first()
    assert got[0] == 63.0


def test_collapsed_and_bag_joins_give_the_same_facts(spark):
    """A section id with several capacity records counts its enrollment once per record."""
    registrations = golden.registrations(spark)
    pairs = [*golden.SECTION_CAPACITY.items(), (1, 5), (1, None), (6, 3), (6, 4)]
    capacity = clean.normalize_capacity(golden.capacity(spark, pairs))
    bag = clean.clean_registrations(registrations, capacity)
    assert bag.filter(F.col("course_section_id") == 1).count() == 3
    once = clean.clean_registrations(registrations, capacity, collapse=True)
    assert once.count() == registrations.filter("schedule_type is null").count()
    a, b = (sorted(map(tuple, facts.course_year_facts(r).collect()), key=str) for r in (bag, once))
    assert a == b
    years = facts.course_years(facts.course_year_facts(once)).filter("reporting_year = 2014")
    # STAT FA_01 counts 3 x 20; the pool is 8 + 2 x 5 and CS has two of its rows
    assert one(years, "fall_enrolled", "fall_capacity", course=STAT) == (85.0, 51.0)
    assert one(years, "fall_enrolled", course=MATH) == (18.0,)
    assert one(years, "fall_enrolled", course=CS) == (36.0,)


def test_course_choice_forms_agree(registrar, spark):
    by_list = courses.course_yearly(registrar.facts, [MATH]).collect()
    table = spark.createDataFrame([(MATH,)], "course string")
    assert courses.course_yearly(registrar.facts, table).collect() == by_list
    assert courses.course_yearly(registrar.facts, F.col("course") == MATH).collect() == by_list


def test_subject_profile_drops_pool_partners(spark):
    """Subjects are filtered before pooling, so partners in other subjects do not count."""
    made = Registrar.from_registrations(
        golden.registrations(spark), golden.capacity(spark), subjects=["MATH"], regular_only=False
    )
    assert one(facts.course_years(made.facts), "yearly_enrolled", course=MATH) == (8.0,)


def test_picker_needs_sections_in_the_first_year(spark):
    """Years offered is taken at the first year; without sections there the course drops out."""
    extra = [
        (11, "2012SU", 2011, "STAT-113", "Applied Statistics", "01", 4.0, None, None), *golden.ROWS
    ]
    made = Registrar.from_registrations(golden.registrations(spark, extra), golden.capacity(spark))
    got = one(
        picker.rated_courses(made.facts), "full_avg_capacity", "total_years_offered", course=STAT
    )
    # the year without sections still divides the average
    assert got == (15.0, None)


def test_time_frames(registrar):
    for time in ("Year", "year", "YEAR"):
        assert "reporting_year" in registrar.enrollment(time).columns
    assert "term" in registrar.open_seats("Semester").columns
    for question in (registrar.enrollment, registrar.open_seats, registrar.seat_classes, registrar.title_trend):
        with pytest.raises(ValueError, match="quarter"):
            question("quarter")


def test_title_trend_takes_the_latest_year(spark):
    rows = [
        (20, "2014FA", 2013, "A-1", "Logic", "01", 3.0, None, None),
        (21, "2014FA", 2014, "A-1", "Logic", "02", 4.0, None, None),
        (22, "2015SP", None, "A-1", "Logic", "01", 5.0, None, None),
        (23, "2012FA", 2012, "B-1", "Art", "01", 6.0, None, None),
        (24, "2014FA", 2014, "B-1", "Art", "01", 7.0, None, None),
    ]
    table = golden.registrations(spark, rows)
    made = Registrar.from_registrations(table, golden.capacity(spark))
    terms = {(r.course_title, r.acad_year_term): (r.enrolled, r.reporting_year) for r in made.title_trend().collect()}
    assert terms["Logic", "2014FA"] == (7.0, 2014)
    assert terms["Logic", "2015SP"] == (5.0, None)
    # earliest year first, ties by title, unknown years last
    years = [(r.course_title, r.reporting_year, r.enrolled) for r in made.title_trend("year").collect()]
    assert years == [("Art", 2012, 6.0), ("Art", 2014, 7.0), ("Logic", 2014, 7.0), ("Logic", None, 5.0)]


def test_projection_order(spark):
    rows = [
        (31, "2012FA", 2012, "A-1", "L", "01", 1.0, None, None),
        (33, "2014FA", 2014, "A-1", "L", "01", 1.0, None, None),
        (32, "2014FA", 2014, "A-1", "L", "02", 1.0, None, None),
        (34, "2011FA", None, "A-1", "L", "01", 1.0, None, None),
    ]
    got = clean.project_registrations(golden.registrations(spark, rows)).collect()
    assert [(r.reporting_year, r.section_number) for r in got] == [(2014, "02"), (2014, "01"), (2012, "01"), (None, "01")]


def test_axis_limits(registrar):
    limits = registrar.axis_limits([STAT]).first()
    assert (limits.max_yearly_enrolled, limits.max_semester_enrolled) == (63.0, 45.0)
    assert (limits.first_year, limits.last_year) == (2014, 2014)
    assert registrar.axis_limits().first().max_yearly_enrolled == 63.0
    assert tuple(registrar.axis_limits(["none"]).first()) == (None,) * 4
    assert tuple(registrar.discipline_limits("STAT").first()) == (63.0, 2014, 2014)


def test_own_range_of_years(spark):
    extra = [
        *golden.ROWS,
        (10, "2017FA", 2017, "CS-140", "Intro", "01", 9.0, None, None),
        (11, "2012FA", 2012, "CS-140", "Intro", "01", 9.0, None, None),
    ]
    made = Registrar.from_registrations(golden.registrations(spark, extra), golden.capacity(spark))

    def years(**options):
        rows = made.completed_seats("year", [MATH, "CS-140: Intro", "none"], **options).collect()
        return {(r.course, r.reporting_year) for r in rows}

    assert years() == {(c, y) for c in (MATH, "CS-140: Intro") for y in range(2012, 2018)}
    # a chosen course without facts has no rows
    assert years(own_range=True) == {(MATH, 2014)} | {("CS-140: Intro", y) for y in range(2012, 2018)}
    with pytest.raises(ValueError):
        made.completed_seats("semester", [MATH], own_range=True)


def test_chart_layers(registrar):
    plain = registrar.enrollment_chart("Semester", [STAT])
    assert set(plain) == {"line"} and plain["line"].first().title == f"Enrollment for {STAT}"
    shown = registrar.enrollment_chart("semester", [STAT], ["show class sections"])
    assert "label" not in shown["sections"].columns and shown["sections"].count() == 3
    labelled = registrar.enrollment_chart("semester", [STAT], ["show class sections", "label sections"])
    assert {r.label for r in labelled["sections"].collect()} == {"01", "02"}
    assert set(registrar.enrollment_chart("year", [STAT], ["label sections"])) == {"line"}
    with pytest.raises(ValueError):
        registrar.enrollment_chart("year", [STAT], ["other"])
    assert {r.course for r in registrar.courses().collect()} >= {STAT, MATH, CS}


@pytest.mark.parametrize("form", ["names", "table"])
def test_facts_of_chosen_courses_are_the_same(spark, registrar, form):
    """Pools reach over courses of one title, so a choice by title changes no fact."""
    chosen = [MATH, "A-1: B: C", "no separator"]
    extra = [*golden.ROWS, (40, "2014FA", 2014, "A-1", "B: C", "01", 3.0, None, None)]
    table = spark.createDataFrame([(c,) for c in chosen], "course string") if form == "table" else chosen
    registrations, capacity = golden.registrations(spark, extra), golden.capacity(spark)
    whole = Registrar.from_registrations(registrations, capacity).open_seats("semester", chosen)
    part = Registrar.from_registrations(registrations, capacity, chosen=table).open_seats("semester")
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))
    assert {r.course for r in part.collect()} == {MATH, "A-1: B: C"}


def test_attribute_conflicts_are_reported(rows):
    assert facts.attribute_conflicts(rows).isEmpty()
    odd = rows.withColumn("course_level", F.when(F.col("course_section_id") == 1, None).otherwise(F.col("course_level")))
    (found,) = facts.attribute_conflicts(odd).collect()
    assert (found.course, found.subject_values, found.course_level_values) == (STAT, 1, 2)
