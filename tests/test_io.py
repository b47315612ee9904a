"""Readers and writers."""

import golden
import pytest
from pyspark.sql import functions as F

from coursegrid import Registrar
from coursegrid.operators import clean, facts
from coursegrid.schemas import FACTS, wide_schema
from coursegrid.sources import io


@pytest.fixture(scope="module")
def registrar(spark):
    nothing = (12, "2014SU", None, None, "No name", "01", 4.0, None, None)
    return Registrar.from_registrations(
        golden.registrations(spark, [*golden.ROWS, nothing]), golden.capacity(spark)
    )


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc", "json"])
def test_raw_tables(spark, tmp_path, fmt):
    made = {"r": golden.registrations(spark), "c": golden.capacity(spark)}
    for name, df in made.items():
        df.write.options(**io.CSV_OPTIONS).format(fmt).save(str(tmp_path / name))
    same(io.read_registrations(spark, str(tmp_path / "r"), fmt), made["r"])
    same(io.read_capacity(spark, str(tmp_path / "c"), fmt), made["c"])


def test_facts_are_partitioned_by_year(spark, tmp_path, registrar):
    path = str(tmp_path / "facts")
    io.write_facts(registrar.facts, path)
    stored = io.read_facts(spark, path)
    assert stored.columns == FACTS.fieldNames()
    same(stored, registrar.facts)
    one_year = facts.course_years(stored.filter("reporting_year = 2014"))
    plan = one_year._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "reporting_year" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    # questions over stored facts are the same
    again = Registrar(stored)
    same(again.open_seats("year"), registrar.open_seats("year"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        io.write_facts(registrar.facts, path)


def test_bucketed_facts_answer_without_a_shuffle(spark, registrar):
    io.save_facts_table(registrar.facts, "bucketed_facts", buckets=4)
    try:
        stored = Registrar(spark.table("bucketed_facts"))
        for question in (stored.open_seats("year"), stored.open_seats("semester")):
            assert "Exchange" not in question._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in stored.section_marks()._jdf.queryExecution().executedPlan().toString()
        same(stored.open_seats("year"), registrar.open_seats("year"))
    finally:
        spark.sql("DROP TABLE bucketed_facts")


def test_wide_csv(spark, tmp_path, registrar):
    path = str(tmp_path / "wide")
    io.write_wide_csv(registrar.wide(), path)
    header = spark.read.text(path).filter(F.col("value").startswith("course,")).first()[0]
    assert header.split(",") == wide_schema().fieldNames()
    same(io.read_wide_csv(spark, path), registrar.wide())


def test_wide_csv_reads_empty_text_as_null(spark, tmp_path):
    names = wide_schema().fieldNames()
    values = ["NA"] * len(names)
    values[0], values[names.index("subject")], values[1] = '"A, ""B"": C"', '""', "2014"
    (tmp_path / "in.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    row = io.read_wide_csv(spark, str(tmp_path / "in.csv")).first()
    assert (row.course, row.subject, row.reporting_year, row.FA_01) == ('A, "B": C', None, 2014, None)


def put(folder, name, *lines):
    (folder / name).mkdir(parents=True, exist_ok=True)
    path = folder / name / f"part-{len(list((folder / name).iterdir()))}.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(folder / name)


HEADER = "section_id,section_name,section_number,unnamed_5,section_capacity"


def test_csv_columns_are_found_by_name(spark, tmp_path, registrar):
    path = str(tmp_path / "wide")
    wide = registrar.wide()
    swapped = list(wide.columns)
    a, b = swapped.index("FA_01"), swapped.index("SP_01")
    swapped[a], swapped[b] = swapped[b], swapped[a]
    io.write_wide_csv(wide.select("*").select(*swapped, F.lit("x").alias("other")), path)
    same(io.read_wide_csv(spark, path), wide)


def test_csv_without_a_column_is_refused(spark, tmp_path):
    path = put(tmp_path, "c", "section_id,section_name,section_number,unnamed_5", "1,a,01,")
    with pytest.raises(ValueError, match="section_capacity"):
        io.read_capacity(spark, path, "csv")


def test_csv_files_with_different_headers_are_refused(spark, tmp_path):
    put(tmp_path, "c", HEADER, "1,a,01,,30")
    other = "section_name,section_id,section_number,unnamed_5,section_capacity"
    path = put(tmp_path, "c", other, "a,2,01,,30")
    with pytest.raises(Exception, match="header"):
        io.read_capacity(spark, path, "csv").collect()


@pytest.mark.parametrize("cells", ["1,a,01,,30 seats", "STAT-113-01-14FA,a,01,,30"])
def test_csv_cells_that_are_no_numbers_are_refused(spark, tmp_path, cells):
    path = put(tmp_path, "c", HEADER, "7,a,01,,NA", cells)
    with pytest.raises(Exception, match="not a value of type"):
        io.read_capacity(spark, path, "csv").collect()


def test_text_section_ids(spark, tmp_path):
    capacity = io.read_capacity(
        spark, put(tmp_path, "c", HEADER, "STAT-113-01-14FA,a,01,,30", "other,b,02,,9"), "csv", text_ids=True
    )
    rows = golden.registrations(spark).limit(1)
    texts = rows.withColumn("course_section_id", F.lit("STAT-113-01-14FA"))
    texts.write.options(**io.CSV_OPTIONS).csv(str(tmp_path / "r"))
    stored = io.read_registrations(spark, str(tmp_path / "r"), "csv", text_ids=True)
    cleaned = clean.clean_registrations(
        stored, clean.normalize_capacity(capacity), regular_only=False, collapse=True
    )
    assert [r.section_capacity for r in cleaned.collect()] == [30.0]


def test_a_year_is_not_bound_to_a_number_of_files(spark, tmp_path, registrar):
    years = registrar.facts.filter("reporting_year = 2014")
    many = years.crossJoin(spark.range(3000)).select(*FACTS.fieldNames())
    io.write_facts(many, str(tmp_path / "facts"), rows_per_file=2000)
    files = list((tmp_path / "facts" / "reporting_year=2014").glob("*.parquet"))
    assert len(files) >= many.count() / 2000
    assert io.read_facts(spark, str(tmp_path / "facts")).count() == many.count()


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert io.scratch_path(spark, "x").startswith(shared)
    assert io.scratch_path(spark, "x") != io.scratch_path(spark, "x")


def test_sections_parameter(spark):
    """A section domain of one's own: FA_18 counts when it is in it."""
    rows = clean.clean_registrations(
        golden.registrations(spark), clean.normalize_capacity(golden.capacity(spark)),
        excluded_terms=("2020FA",),
    )
    years = facts.course_years(facts.course_year_facts(rows, ("FA_01", "FA_18")))
    got = years.filter(F.col("course") == golden.STAT).first()
    assert (got.yearly_enrolled, got.fall_sections, got.yearly_capacity) == (29.0, 2, 90.0)
