"""A small registration extract whose results are worked out by hand."""

from coursegrid.schemas import CAPACITY, REGISTRATIONS

COLUMNS = [
    "course_section_id", "acad_year_term", "reporting_year", "course_name", "course_title",
    "section_number", "enrolled", "xlist_section1", "schedule_type",
]
ROWS = [
    (1, "2014FA", 2014, "STAT-113", "Applied Statistics", "01", 20.0, None, None),
    (2, "2014FA", 2014, "STAT-113", "Applied Statistics", "02", 25.0, None, None),
    (3, "2015SP", 2014, "STAT-113", "Applied Statistics", "01", 18.0, None, None),
    (4, "2015SU", 2014, "STAT-113", "Applied Statistics", "01", 7.0, None, None),
    (5, "2014FA", 2014, "MATH-280", "Bridge", "01", 8.0, "X1", None),
    (6, "2014FA", 2014, "CS-280", "Bridge", "01", 5.0, "X1", None),
    (7, "2014FA", 2014, "STAT-113", "Applied Statistics", "18", 9.0, None, None),
    (8, "2014FA", 2014, "STAT-113", "Applied Statistics", "03", 15.0, None, "LAB"),
    (9, "2020FA", 2020, "STAT-113", "Applied Statistics", "01", 30.0, None, None),
]
SECTION_CAPACITY = {1: 22, 2: 24, 3: 24, 4: 10, 5: 12, 7: 10, 8: 15, 9: 30}

STAT = "STAT-113: Applied Statistics"
MATH = "MATH-280: Bridge"
CS = "CS-280: Bridge"


def registration(**values):
    """A full registration row; subject, number and level follow from the course name."""
    name = values.get("course_name")
    if name is not None:
        subject, number = name.split("-")
        values = {
            "subject": subject,
            "course_number": number,
            "course_level": number[0],
            "course_id": 1,
            **values,
        }
    return tuple(values.get(field) for field in REGISTRATIONS.fieldNames())


def registrations(spark, rows=None):
    rows = ROWS if rows is None else rows
    full = [registration(**dict(zip(COLUMNS, r))) for r in rows]
    return spark.createDataFrame(full, REGISTRATIONS)


def capacity(spark, pairs=None):
    pairs = list(SECTION_CAPACITY.items()) if pairs is None else pairs
    rows = [(i, f"S{i}", "01", None, None if c is None else float(c)) for i, c in pairs]
    return spark.createDataFrame(rows, CAPACITY)
