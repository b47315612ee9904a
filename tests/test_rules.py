"""Null, rounding and term rules of the column helpers."""

import pytest
from pyspark.sql import functions as F

from coursegrid.functions import nulls, terms
from coursegrid.operators.discipline import derived_level
from coursegrid.operators.seats import capacity_class, empty_seats, enrolled_class, full_flag


def value(spark, column, **columns):
    """The column on a single row with the given (type, value) columns."""
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items()) or "_ int"
    data = [tuple(v for _, v in columns.values()) or (0,)]
    return spark.createDataFrame(data, schema).select(column).first()[0]


@pytest.mark.parametrize("x, expected", [(2.5, 2.0), (3.5, 4.0), (0.5, 0.0), (2.4, 2.0), (2.51, 3)])
def test_rounds_half_to_even(spark, x, expected):
    assert value(spark, nulls.half_even(F.col("x")), x=("double", x)) == expected


@pytest.mark.parametrize("x, expected", [(True, 1), (False, 0), (None, None)])
def test_if_known(spark, x, expected):
    got = value(spark, nulls.if_known(F.col("x"), F.lit(1), F.lit(0)), x=("boolean", x))
    assert got == expected


@pytest.mark.parametrize(
    "values, known, strict",
    [([1.0, None], 1.0, None), ([None], 0.0, None), ([1.0, 2.0], 3.0, 3.0)],
)
def test_sums(spark, values, known, strict):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = df.agg(nulls.sum_known(F.col("x")), nulls.sum_all(F.col("x"))).first()
    assert tuple(row) == (known, strict)


def test_paste_writes_nulls_as_text(spark):
    got = value(
        spark, nulls.paste("_", F.col("y"), F.col("s")), y=("int", None), s=("string", "FA")
    )
    assert got == "NA_FA"
    assert value(spark, terms.term_year(F.lit("NA_FA"))) is None
    assert value(spark, terms.term_year(F.lit("2015_SP"))) == 2015


def test_ratio_by_zero_or_null(spark):
    for divisor in (0, None):
        got = value(spark, nulls.ratio(F.lit(3.0), F.col("n")), n=("int", divisor))
        assert got is None


def test_input_terms_split_from_the_right(spark):
    assert value(spark, terms.input_term_year(F.lit("2020FA"))) == "2020"
    assert value(spark, terms.input_term_semester(F.lit("2020FA"))) == "FA"


def test_key_pieces(spark):
    assert value(spark, terms.key_piece(F.lit("FA_01"), 2)) == "01"
    assert value(spark, terms.key_piece(F.lit("FA"), 2)) is None


@pytest.mark.parametrize(
    "year, semester, raw, expected",
    [
        (2014, "FA", False, "2014_FA"),
        (2014, "SP", False, "2015_SP"),
        (2014, "SP", True, "2014_SP"),
        (None, "SP", False, "NA_SP"),
    ],
)
def test_term_labels(spark, year, semester, raw, expected):
    column = terms.term_label(F.col("y"), F.col("s"), raw)
    assert value(spark, column, y=("int", year), s=("string", semester)) == expected


@pytest.mark.parametrize(
    "number, level",
    [("113", 1), ("2103", 1), ("113L", None), (None, None), ("1000", 0), ("99", 0), ("480", 4)],
)
def test_derived_level(spark, number, level):
    assert value(spark, derived_level(F.col("n")), n=("string", number)) == level


@pytest.mark.parametrize(
    "enrolled, capacity, sections, flag, layers, over, empty",
    [
        (13.0, 12.0, 1, "Full", ("Over Enrollment", "Enrollment (full)"), 1.0, 0.0),
        (12.0, 12.0, 1, "Full", ("Enrollment (full)", "Empty Seats"), 0.0, 0.0),
        (11.0, 12.0, 1, "Full", ("Enrollment (full)", "Empty Seats"), 0.0, 1.0),
        (10.0, 12.0, 1, "Not Full", ("Enrollment", "Empty Seats"), 0.0, 2.0),
        (12.0, 12.0, None, None, (None, None), 0.0, 0.0),
        (10.0, 12.0, None, "Not Full", ("Enrollment", None), 0.0, 2.0),
        (10.0, None, 1, None, (None, None), None, None),
    ],
)
def test_seat_rules(spark, enrolled, capacity, sections, flag, layers, over, empty):
    row = {"e": ("double", enrolled), "c": ("double", capacity), "n": ("int", sections)}
    e, c, n = F.col("e"), F.col("c"), F.col("n")
    assert value(spark, full_flag(e, c, n), **row) == flag
    assert value(spark, enrolled_class(e, c, n), **row) == layers[0]
    assert value(spark, capacity_class(e, c, n), **row) == layers[1]
    assert value(spark, empty_seats(e, c), **row) == empty
    from coursegrid.operators.seats import over_enrollment

    assert value(spark, over_enrollment(e, c), **row) == over


def test_excluding_drops_nulls_only_when_it_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert nulls.excluding(F.col("x"), ()) is None
    assert [r.x for r in df.filter(nulls.excluding(F.col("x"), ["a"])).collect()] == ["b"]
