"""The given order tables in the shape of course registrations.

An order line is a section row: the part is the course, the order is the section, the quantity
is the enrollment and the ship date gives the term. Orders give the capacity records.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursegrid.schemas import CAPACITY, REGISTRATIONS

# Only the columns in use; a given schema saves the footer reads of schema inference.
LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)
PARTS = "p_partkey long, p_name string, p_type string, p_size int"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"


def courses(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as courses; the texts are made here, once per part and not per line."""
    parts = spark.read.schema(PARTS).parquet(f"{folder}/part.parquet")
    size = F.col("p_size")
    number = F.when(size <= 40, size * 10 + 100).otherwise(size * 50)
    level = F.when(number >= 1000, F.floor(number / 1000) - 1).otherwise(F.floor(number / 100))
    return parts.select(
        F.col("p_partkey").alias("course_id"),
        F.concat("p_type", F.lit("-"), number.cast("string")).alias("course_name"),
        F.col("p_name").alias("course_title"),
        F.col("p_type").alias("subject"),
        number.cast("string").alias("course_number"),
        level.cast("string").alias("course_level"),
    )


def sections(spark: SparkSession, folder: str, *, own_levels: bool = False) -> DataFrame:
    """Lines as section rows without the attributes of their courses and without texts made from other columns.

    They are narrow and of fixed width, since they are dealt out by section id and by course;
    `with_courses` makes registrations of them, before or after the capacity join. With `own_levels`
    each row states a level of its own, some none, and has its place in the source.
    """
    lines = spark.read.schema(LINES).parquet(f"{folder}/lineitem.parquet")
    columns = {
        "course_section_id": F.col("l_orderkey"),
        "course_id": F.col("l_partkey"),
        "enrolled": F.col("l_quantity"),
        "_number": (F.col("l_suppkey") % 24).cast("int"),
        "_month": F.trunc("l_shipdate", "month"),
        "_crosslisted": F.col("l_returnflag") == "R",
        "_lab": (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"),
    }
    if own_levels:
        columns["_own_level"] = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus"))
        columns["source_order"] = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lines.select(*[column.alias(name) for name, column in columns.items()])


def with_courses(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Section rows and `courses` -> registrations; columns that the rows have besides are kept behind them."""
    year, month = F.year("_month"), F.month("_month")
    semester = F.when(month <= 5, "SP").when(month <= 7, "SU").otherwise("FA")
    section = F.concat(F.lit("X"), F.col("course_section_id").cast("string"))
    no_text = F.lit(None).cast("string")
    columns = {
        "acad_year_term": F.concat(year.cast("string"), semester),
        "reporting_year": F.when(semester == "FA", year).otherwise(year - 1),
        "section_number": F.lpad(F.col("_number").cast("string"), 2, "0"),
        "xlist_primary_course": F.when(F.col("_crosslisted"), F.col("course_name")),
        "xlist_section1": F.when(F.col("_crosslisted"), section),
        "xlist_section2": no_text,
        "xlist_section3": no_text,
        "xlist_section4": no_text,
        "schedule_type": F.when(F.col("_lab"), "LAB"),
    }
    if "_own_level" in rows.columns:
        columns["course_level"] = F.concat("course_level", "_own_level")
    fields = REGISTRATIONS.fieldNames()
    fields += [c for c in rows.columns if c not in fields and not c.startswith("_")]
    return rows.join(known, "course_id").select(*[columns.get(f, F.col(f)).alias(f) for f in fields])


def registrations(spark: SparkSession, folder: str, *, own_levels: bool = False) -> DataFrame:
    """With `own_levels` each section row states a level of its own, some none, and has its place in
    the source in a column `source_order`, so that the rows of a course-year differ."""
    return with_courses(sections(spark, folder, own_levels=own_levels), courses(spark, folder))


def capacity(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.schema(ORDERS).parquet(f"{folder}/orders.parquet")
    key = F.col("o_orderkey")
    columns = {
        "section_id": key,
        "section_name": F.concat(F.lit("SEC-"), key.cast("string")),
        "section_number": F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"),
        "unnamed_5": F.lit(None).cast("string"),
        "section_capacity": F.when(
            F.col("o_orderstatus") != "P", (1 + key % 60).cast("double")
        ),
    }
    recorded = orders.filter(F.col("o_orderpriority") != "5-LOW")
    return recorded.select(*[columns[f].alias(f) for f in CAPACITY.fieldNames()])
