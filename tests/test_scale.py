"""Hot keys and plan shapes: what must hold for large tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from coursegrid.functions.nulls import sum_all
from coursegrid.operators import clean, facts, pool
from coursegrid.operators.totals import with_group_totals
from coursegrid.plans.catalog import EXCLUDED_INPUT_TERMS, Tables, queries
from coursegrid.schemas import REGISTRATIONS


@pytest.fixture
def no_broadcast(spark):
    """Force the shuffled forms, with skew limits a small test reaches."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, setting in settings.items():
        spark.conf.set(key, setting)
    yield
    for key, setting in before.items():
        spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def hot_rows(spark, n=60_000):
    """A third of the rows share one title, section, year and section id; some keys are null."""
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(n).select(
        F.when(hot, "2014FA").when(i % 5 == 0, "2015SP").otherwise("2016FA").alias("acad_year_term"),
        F.when(hot, 2014).when(i % 5 == 0, 2014).when(i % 7 != 0, 2016).alias("reporting_year"),
        i.alias("course_id"),
        i.alias("course_section_id"),
        F.when(hot, F.concat(F.lit("HOT-"), i % 40))
        .otherwise(F.concat(F.lit("C-"), i % 500))
        .alias("course_name"),
        F.when(hot, "Seminar").when(i % 11 != 0, F.concat(F.lit("T"), i % 300)).alias("course_title"),
        F.lit("HOT").alias("subject"),
        F.lit("101").alias("course_number"),
        F.when(hot, "01").otherwise(F.lpad((i % 30).cast("string"), 2, "0")).alias("section_number"),
        (i % 17).cast("double").alias("enrolled"),
        F.lit(None).cast("string").alias("xlist_primary_course"),
        F.when(hot | (i % 2 == 0), "X").alias("xlist_section1"),
        *[F.lit(None).cast("string").alias(f"xlist_section{k}") for k in (2, 3, 4)],
        F.lit(None).cast("string").alias("schedule_type"),
        F.lit("1").alias("course_level"),
    ).select(*REGISTRATIONS.fieldNames())


def hot_capacity(spark, n=60_000):
    return spark.range(n).select(
        F.col("id").alias("course_section_id"),
        F.lit("S").alias("course_section_name"),
        (F.col("id") % 23).cast("double").alias("section_capacity"),
    )


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_hot_pool_equals_a_plain_window(spark, no_broadcast):
    rows = clean.clean_registrations(hot_rows(spark), hot_capacity(spark))
    members = clean.crosslisted(rows)
    window = Window.partitionBy(*pool.POOL_KEYS)
    plain = clean.unite_course(
        members.withColumn("enrolled", F.when(
            F.count("enrolled").over(window) == F.count(F.lit(1)).over(window),
            F.sum("enrolled").over(window),
        ))
    )
    got = pool.pooled_members(rows)
    same(got.select(sorted(got.columns)), plain.select(sorted(got.columns)))


def test_hot_facts_equal_row_sums(spark, no_broadcast):
    registrations, capacity = hot_rows(spark), hot_capacity(spark)
    rows = clean.clean_registrations(registrations, capacity)
    cells = (
        pool.pool_crosslisted(rows)
        .groupBy("course", "reporting_year", F.col("section").alias("section_key"))
        .agg(F.coalesce(F.sum("enrolled"), F.lit(0.0)).alias("enrolled"))
    )
    once = clean.clean_registrations(registrations, capacity, collapse=True)
    long = facts.course_year_facts(once).filter(F.col("section_key").isNotNull())
    columns = ["course", "reporting_year", "section_key", "enrolled"]
    keys = long.select("section_key").distinct()
    same(long.select(columns), cells.join(keys, "section_key", "left_semi").select(columns))


def test_strict_pool_with_unknown_enrollment(spark):
    rows = clean.clean_registrations(hot_rows(spark, 900), hot_capacity(spark, 900), collapse=True)
    holes = rows.withColumn(
        "enrolled", F.when(F.col("course_section_id") != 3, F.col("enrolled"))
    )
    long = facts.course_year_facts(holes)
    hot = long.filter(F.col("course").startswith("HOT-") & F.col("section_key").isNotNull())
    assert hot.filter("enrolled <> 0").isEmpty() and not hot.isEmpty()
    strict = holes.groupBy(*pool.POOL_KEYS).agg(sum_all(F.col("enrolled")).alias("e"))
    assert strict.filter("course_title = 'Seminar'").first().e is None


def test_group_totals_split_a_hot_group(spark):
    """No part of the split group holds more than a small share of it."""
    rows = spark.range(64_000).select(F.lit("hot").alias("k"), F.col("id"))
    totals = with_group_totals(rows, ["k"], {"n": F.lit(1)}, spread_by=["id"])
    assert totals.select("n").distinct().collect() == [(64_000,)]
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    largest = rows.groupBy(part).count().agg(F.max("count")).first()[0]
    assert largest < 64_000 / 64 * 1.25


def test_hot_section_id_is_split_by_the_join(spark, no_broadcast, tmp_path):
    """Both sides stored: a third of the registrations have one id, and no task joins a seventh."""
    rows = hot_rows(spark, 200_000).withColumn(
        "course_section_id",
        F.when(F.col("course_title") == "Seminar", 7).otherwise(F.col("course_section_id")),
    )
    # many map tasks and numbers that do not compress, as in large tables: a task's output is the smallest piece
    rows.withColumn("enrolled", F.rand(1)).repartition(24).write.parquet(str(tmp_path / "r"))
    hot_capacity(spark, 200_000).write.parquet(str(tmp_path / "c"))
    few = {"spark.sql.files.maxPartitionBytes": "100KB", "spark.sql.files.openCostInBytes": "100KB"}
    few |= {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in few}
    for key, setting in few.items():
        spark.conf.set(key, setting)
    try:
        shares, plan = shares_of_the_join(spark, tmp_path)
    finally:
        for key, setting in before.items():
            spark.conf.set(key, setting)
    assert sum(shares) == pytest.approx(1) and max(shares) < 0.15
    assert "skew=true" in plan


def shares_of_the_join(spark, tmp_path):
    """Share of the rows that each task of the capacity join makes, and the plan that ran."""
    cleaned = clean.clean_registrations(
        spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "c")), collapse=True
    )
    # a task's rows are counted in the stage of the join
    per_task = cleaned.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("section_capacity"), F.sum("enrolled")
    )
    return [r.n / 200_000 for r in per_task.collect()], executed(per_task)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_pair_joins(name, spark, folder):
    df = queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "InPandas"):
        assert word not in plan


def test_registrations_are_scanned_once(spark, folder):
    """Members and pools share the scan, the joins and the exchange of the collapsed rows."""
    plan = executed(queries()["open_seats_yearly"](spark, folder))
    assert plan.count("CollectMetrics") == 2
    assert plan.count("lineitem.parquet") == plan.count("orders.parquet") == 1


def test_scan_reads_only_used_columns_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "registrations")
    hot_rows(spark, 1000).write.parquet(path)
    stored = spark.read.schema(REGISTRATIONS).parquet(path)
    rows = clean.clean_registrations(
        stored, hot_capacity(spark, 1000), excluded_terms=("2020FA", "2021SP"), collapse=True
    )
    plan = facts.section_totals(rows)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    pushed = scan[scan.index("PushedFilters"):]
    assert "IsNull(schedule_type)" in pushed and "acad_year_term" in pushed
    read = scan[scan.index("ReadSchema"):]
    assert "xlist_section2" not in read and "course_id" not in read


def test_choices_reach_below_the_first_sum(spark, folder):
    """Title and year tests stand below the aggregate of the raw rows, on the scans or joins."""
    def below(name):
        text = queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        return text[text.index("CollectMetrics"):]

    chosen = below("course_semester_selected")
    assert "p_name" in chosen and "blue anvil" in chosen[chosen.index("Aggregate"):]
    for name in ("course_yearly", "open_seats_yearly", "discipline_by_level"):
        plan = below(name)
        assert "1998" in plan[plan.index("Aggregate"):].replace("1998FA", "")


def nodes(plan):
    """All nodes that ran, those of subqueries included; what is reused is not entered again."""
    kind = plan.getClass().getSimpleName()
    if kind in ("AdaptiveSparkPlanExec", "SubqueryAdaptiveBroadcastExec"):
        inner = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        inner = [plan.plan()]
    elif kind.startswith("Reused"):
        inner = []
    else:
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
        inner += [plan.subqueries().apply(i) for i in range(plan.subqueries().size())]
    return [plan, *(n for p in inner for n in nodes(p))]


@pytest.mark.parametrize("name", ["course_semester_selected", "complete_terms", "seat_class_yearly", "complete_years", "wide_facts_first_values"])
def test_choices_and_axes_scan_once(spark, folder, no_broadcast, name):
    df = queries()[name](spark, folder)
    df.collect()
    scans = {}
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            text = node.toString()
            scans[node.id()] = next(t for t in ("lineitem", "orders", "part") if f"/{t}.parquet" in text)
    assert sorted(scans.values()).count("lineitem") == sorted(scans.values()).count("orders") == 1


def odd_tables(spark, path, n=240):
    """Lines, parts and orders with null and unknown keys, null columns, and keys that come twice."""
    def unless(every, value):
        return F.when(F.col("id") % every != 0, value)

    i = F.col("id")
    day = F.timestamp_add("DAY", (i * 13).cast("int"), F.lit("1997-01-31 23:59:59").cast("timestamp_ntz"))
    tables = {
        "lineitem": spark.range(n).select(
            unless(13, i % 60).alias("l_orderkey"),
            unless(11, i % 40).alias("l_partkey"),
            unless(17, i * 7).alias("l_suppkey"),
            (i % 7 + 1).cast("int").alias("l_linenumber"),
            unless(19, (i % 50).cast("double")).alias("l_quantity"),
            unless(7, F.when(i % 3 == 0, "R").when(i % 3 == 1, "A").otherwise("N")).alias("l_returnflag"),
            unless(5, F.when(i % 2 == 0, "O").otherwise("F")).alias("l_linestatus"),
            unless(23, day).alias("l_shipdate"),
        ),
        "part": spark.range(36).select(
            unless(12, i % 30).alias("p_partkey"),
            unless(9, F.concat(F.lit("title "), i % 4)).alias("p_name"),
            unless(8, F.when(i % 2 == 0, "STANDARD").otherwise("PROMO")).alias("p_type"),
            unless(7, (i % 50).cast("int")).alias("p_size"),
        ),
        "orders": spark.range(70).select(
            unless(10, i % 50).alias("o_orderkey"),
            i.alias("o_custkey"),
            unless(6, F.when(i % 4 == 0, "P").otherwise("F")).alias("o_orderstatus"),
            unless(9, F.when(i % 5 == 0, "5-LOW").otherwise("1-URGENT")).alias("o_orderpriority"),
        ),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}.parquet")


NARROW_JOINS = ("join_capacity", "clean_registrations", "xlist_combined", "wide_facts", "wide_facts_first_values")


@pytest.mark.parametrize("name", NARROW_JOINS)
def test_the_capacity_join_deals_out_no_texts(name, spark, no_broadcast, tmp_path):
    odd_tables(spark, tmp_path)
    df = queries()[name](spark, str(tmp_path))
    df.collect()
    dealt = [
        node.output().mkString(",")
        for node in nodes(df._jdf.queryExecution().executedPlan())
        if node.getClass().getSimpleName() == "ShuffleExchangeExec"
        and node.outputPartitioning().toString().startswith("hashpartitioning(course_section_id")
    ]
    registrations = [columns for columns in dealt if "enrolled" in columns]
    assert registrations
    for text in ("course_name", "course_title", "subject", "section_number", "term", "xlist_section1"):
        assert not any(text in columns for columns in registrations)


@pytest.mark.parametrize("collapse", [False, True])
def test_rows_completed_after_the_join_are_the_same(spark, tmp_path, collapse):
    odd_tables(spark, tmp_path)
    t = Tables(spark, str(tmp_path))
    scope = {"excluded_terms": EXCLUDED_INPUT_TERMS, "excluded_years": (1999,), "subjects": ["PROMO", "SMALL"]}
    scope |= {"courses": ["PROMO-210: title 3", "PROMO-150: title 1"], "about": ["PROMO"], "collapse": collapse}
    for some in ({}, scope):
        late = clean.clean_registrations(t.sections, t.capacity, complete=t.complete, **some)
        early = clean.clean_registrations(t.registrations, t.capacity, **some)
        assert late.columns == early.columns and not late.isEmpty()
        same(late, early)
    joined = clean.join_capacity(t.registrations, t.capacity)
    assert t.with_capacity.schema == joined.schema
    same(t.with_capacity, joined)
