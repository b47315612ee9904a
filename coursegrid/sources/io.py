"""Readers and writers."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursegrid.schemas import (
    CAPACITY,
    FACTS,
    REGISTRATIONS,
    SECTION_DOMAIN,
    with_text_ids,
    wide_schema,
)

CSV_OPTIONS = {"header": True, "nullValue": "NA", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of a schema, found by their names in the header.

    Other columns are ignored, a missing one is an error, as is a file whose header differs
    from the first file's. A cell that is no value of its column's type is an error when the
    row is read.
    """
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path}: the header lacks {', '.join(missing)}")
    texts = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = spark.read.schema(texts).options(**CSV_OPTIONS, enforceSchema=False).csv(path)

    def value(field: T.StructField):
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return cell.alias(field.name)
        parsed = cell.try_cast(field.dataType)
        message = F.concat(
            F.lit(f"{field.name}: not a value of type {field.dataType.simpleString()}: "), cell
        )
        failed = F.raise_error(message).cast(field.dataType)
        return F.when(cell.isNotNull() & parsed.isNull(), failed).otherwise(parsed).alias(field.name)

    return rows.select(*[value(field) for field in schema])


def _read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def read_registrations(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    *,
    text_ids: bool = False,
    source_order: str | None = None,
) -> DataFrame:
    """`text_ids`: the section ids are texts, not numbers.

    `source_order` names a column to add with the place of a row: its file, by path, and its number
    there. Only Parquet files number their rows.
    """
    if source_order is not None and fmt != "parquet":
        raise ValueError(f"{fmt} files do not number their rows")
    schema = with_text_ids(REGISTRATIONS) if text_ids else REGISTRATIONS
    rows = _read(spark, path, schema, fmt)
    if source_order is None:
        return rows
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias(source_order)
    return rows.select(*schema.fieldNames(), place)


def read_capacity(
    spark: SparkSession, path: str, fmt: str = "parquet", *, text_ids: bool = False
) -> DataFrame:
    return _read(spark, path, with_text_ids(CAPACITY) if text_ids else CAPACITY, fmt)


def write_facts(facts: DataFrame, path: str, *, rows_per_file: int = 5_000_000) -> None:
    """Long facts as Parquet, partitioned by reporting year so that year filters prune.

    Spark brings the rows of a year together, in as many tasks as their measured size asks
    for, and no file gets more than `rows_per_file` rows.
    """
    facts.hint("rebalance", "reporting_year").write.mode("errorifexists").option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy("reporting_year").parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).parquet(path).select(*FACTS.fieldNames())


def save_facts_table(facts: DataFrame, table: str, *, buckets: int) -> None:
    """Long facts as a table bucketed by course and year.

    Questions group by course and year first; on this table they do so without a shuffle.
    Pick `buckets` so that one bucket fits a task. Bucketing with the same number of shuffle
    partitions writes one file per bucket.
    """
    keys = ["course", "reporting_year"]
    facts.repartition(buckets, *keys).write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(
        *keys
    ).saveAsTable(table)


def write_wide_csv(wide: DataFrame, path: str) -> None:
    """The wide export as CSV files; nulls are written as `NA`."""
    wide.write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)


def read_wide_csv(spark: SparkSession, path: str, sections=SECTION_DOMAIN) -> DataFrame:
    """Read the wide export; `NA` and empty texts are nulls."""
    schema = wide_schema(sections)
    wide = read_csv(spark, path, schema)
    texts = [f.name for f in schema if f.dataType.typeName() == "string"]
    return wide.withColumns({name: F.when(F.col(name) != "", F.col(name)) for name in texts})


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster, removed when the session's JVM ends.

    That folder is `spark.checkpoint.dir`. Only a session on this one machine may do without
    and gets a temporary folder; elsewhere each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="coursegrid-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
