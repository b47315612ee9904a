"""Facts that carry the attributes of the first row, and places in an order."""

import golden
import pytest
from pyspark.sql import functions as F

from coursegrid import Registrar
from coursegrid.operators import clean, facts, order
from coursegrid.schemas import REGISTRATIONS
from coursegrid.sources import io

NAMES = ["course_name", "course_title", "section_number", "xlist_section1", "subject", "course_level", "place"]
# One course-year each; the capacity table knows none of the sections.
ROWS = [
    ("A-1", "first is null", "01", None, "B", "9", 2),
    ("A-1", "first is null", "02", None, None, "8", 1),
    ("A-1", "first is null", "99", None, "A", "7", 3),
    ("A-2", "outside the domain", "99", None, "Z", None, 1),
    ("A-2", "outside the domain", "01", None, "A", "1", 2),
    ("A-3", "cross-listed first", "01", None, "A", "1", 1),
    ("A-3", "cross-listed first", "02", "X", "C", "3", 3),
    ("A-3", "cross-listed first", "02", "X", "B", "2", 2),
    ("A-4", "no place is last", "01", None, "A", "1", None),
    ("A-4", "no place is last", "01", None, "B", "2", 7),
    ("A-5", "one place", "01", None, "B", None, 4),
    ("A-5", "one place", "02", None, "A", "5", 4),
]
FIRST = {
    "A-1": (None, "8"), "A-2": ("Z", None), "A-3": ("B", "2"), "A-4": ("B", "2"), "A-5": ("A", "5"),
}
SMALLEST = {
    "A-1": ("A", "7"), "A-2": ("A", "1"), "A-3": ("A", "1"), "A-4": ("A", "1"), "A-5": ("A", "5"),
}


@pytest.fixture(scope="module")
def registrations(spark):
    rows = []
    for number, values in enumerate(ROWS):
        row = dict(zip(NAMES, values))
        full = golden.registration(
            course_section_id=100 + number, acad_year_term="2014FA", reporting_year=2014, enrolled=1.0, **row
        )
        rows.append((*full, row["place"]))
    return spark.createDataFrame(rows, f"{_ddl(REGISTRATIONS)}, place int").repartition(3)


def _ddl(schema):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def carried(table):
    years = table.select("course", "subject", "course_level").distinct().collect()
    assert len({r.course for r in years}) == len(years)
    return {r.course.split(":")[0]: (r.subject, r.course_level) for r in years}


def test_first_values(spark, registrations):
    capacity = golden.capacity(spark)
    first = Registrar.from_registrations(registrations, capacity, source_order="place").facts
    smallest = Registrar.from_registrations(registrations, capacity).facts
    assert carried(first) == FIRST and carried(smallest) == SMALLEST
    measures = ["course", "reporting_year", "section_key", "enrolled", "capacity", "yearly_capacity"]
    assert sorted(map(str, first.select(measures).collect())) == sorted(map(str, smallest.select(measures).collect()))
    assert first.columns == smallest.columns


def test_rows_stay_single_without_collapse(spark, registrations):
    capacity = clean.normalize_capacity(golden.capacity(spark))
    for collapse in (False, True):
        rows = clean.clean_registrations(registrations, capacity, collapse=collapse, source_order="place")
        assert carried(facts.course_year_facts(rows)) == FIRST


def test_place_in_parquet_files(spark, registrations, tmp_path):
    path = str(tmp_path / "registrations")
    sorted_rows = registrations.orderBy(F.asc_nulls_last("place"), "subject").drop("place")
    sorted_rows.coalesce(1).write.parquet(path)
    read = io.read_registrations(spark, path, source_order="row")
    assert read.columns == [*REGISTRATIONS.fieldNames(), "row"]
    made = Registrar.from_registrations(read, golden.capacity(spark), source_order="row")
    assert carried(made.facts) == FIRST
    with pytest.raises(ValueError, match="csv"):
        io.read_registrations(spark, "nowhere.csv", "csv", source_order="row")


def test_places(spark):
    rows = [(2, "b"), (1, "a"), (1, "a"), (None, "c"), (1, None), (2, "a"), (None, None), (2, "b")]
    frame = spark.createDataFrame(rows, "y int, t string").repartition(3)
    got = order.placed(frame, ["y", "t"], [F.desc_nulls_last("y"), F.asc_nulls_last("t")], "n")
    assert got.columns == ["y", "t", "n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[2], str(r))) == [
        (2, "a", 1), (2, "b", 2), (2, "b", 2), (1, "a", 4), (1, "a", 4), (1, None, 6), (None, "c", 7), (None, None, 8),
    ]
    assert order.placed(frame.limit(0), ["y", "t"], [F.asc("y"), F.asc("t")]).count() == 0


def test_places_follow_the_sorted_rows(spark):
    frame = golden.registrations(spark)
    sorted_ids = frame.orderBy(*clean.latest_first()).collect()
    keys = ["reporting_year", "course_section_id"]
    places = {r.course_section_id: r.place for r in order.placed(frame, keys, clean.latest_first()).collect()}
    assert [places[r.course_section_id] for r in sorted_ids] == list(range(1, len(golden.ROWS) + 1))


def test_one_key_on_most_rows(spark):
    """The places of a million rows at one key are found from its count alone."""
    frame = spark.range(1_000_000).select(F.when(F.col("id") < 10, F.col("id") - 5).otherwise(0).alias("k"))
    got = order.placed(frame, ["k"], [F.asc("k")]).groupBy("k").agg(F.min("place").alias("p"), F.count("*").alias("n"))
    assert {r.k: (r.p, r.n) for r in got.collect()} == {
        **{k: (k + 6, 1) for k in range(-5, 0)}, 0: (6, 999_991), **{k: (999_996 + k, 1) for k in range(1, 5)},
    }
