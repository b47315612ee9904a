"""Fixed table layouts and the section domain."""

from pyspark.sql import types as T

# The section columns of the wide facts, in file order.
SECTION_DOMAIN = (
    "FA_01", "FA_02", "FA_03", "FA_04", "FA_05", "FA_06", "FA_07", "FA_08", "FA_09", "FA_10",
    "SP_01", "SP_02", "SP_03", "SP_04", "SP_05", "SP_06", "SP_07", "SP_08", "SP_09",
    "SP_11", "SP_12", "SP_13", "SP_14", "SP_15", "SP_16", "SP_18", "SP_19",
    "FA_11", "FA_12", "FA_13", "FA_14", "FA_15", "FA_16", "FA_17",
    "FA_20", "FA_21", "FA_22", "FA_23",
)

# The terms and the reporting year left out because of the pandemic.
PANDEMIC_INPUT_TERMS = ("2020FA", "2021SP")
PANDEMIC_TERMS = ("2020_FA", "2021_SP")
PANDEMIC_YEARS = (2020,)

# Stacking order of the seat measures.
MEASURES = ("empty_seats", "overenrollments", "enrollments")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_STR, _INT, _LONG, _DBL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

REGISTRATIONS = _struct(
    ("acad_year_term", _STR),
    ("reporting_year", _INT),
    ("course_id", _LONG),
    ("course_section_id", _LONG),
    ("course_name", _STR),
    ("course_title", _STR),
    ("subject", _STR),
    ("course_number", _STR),
    ("section_number", _STR),
    ("enrolled", _DBL),
    ("xlist_primary_course", _STR),
    ("xlist_section1", _STR),
    ("xlist_section2", _STR),
    ("xlist_section3", _STR),
    ("xlist_section4", _STR),
    ("schedule_type", _STR),
    ("course_level", _STR),
)

# The capacity table as delivered; `normalize_capacity` brings it to the joined form.
CAPACITY = _struct(
    ("section_id", _LONG),
    ("section_name", _STR),
    ("section_number", _STR),
    ("unnamed_5", _STR),
    ("section_capacity", _DBL),
)



def with_text_ids(schema: T.StructType) -> T.StructType:
    """The layout with section ids that are texts."""
    ids = ("course_section_id", "section_id")
    return T.StructType(
        [T.StructField(f.name, _STR if f.name in ids else f.dataType, True) for f in schema]
    )


# Course-year facts, long form: one row per course, year and section of the domain, and one
# with a null section for all sections outside it, which has a capacity but no enrollment.
FACTS = _struct(
    ("course", _STR),
    ("reporting_year", _INT),
    ("semester", _STR),
    ("section", _STR),
    ("section_key", _STR),
    ("enrolled", _DBL),
    ("capacity", _DBL),
    ("yearly_capacity", _DBL),
    ("subject", _STR),
    ("course_number", _STR),
    ("course_level", _STR),
)


def wide_schema(sections=SECTION_DOMAIN) -> T.StructType:
    """Layout of the wide export for a section domain."""
    return _struct(
        ("course", _STR),
        ("reporting_year", _INT),
        ("yearly_enrolled", _DBL),
        ("fall_enrolled", _DBL),
        ("spring_enrolled", _DBL),
        *[(key, _DBL) for key in sections],
        ("course_number", _STR),
        ("subject", _STR),
        ("yearly_capacity", _DBL),
        ("course_level", _STR),
        ("fall_capacity", _DBL),
        ("spring_capacity", _DBL),
    )
