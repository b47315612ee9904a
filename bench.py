"""Benchmark: headline queries on the given tables, one JSON line on stdout.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default all)
BENCH_RUNS     timed runs per query after one warm-up of all, median taken (default 3)
BENCH_QUERIES  `headline` (default), `all`, or a comma-separated list
"""

import json
import os
import re
import statistics
import time

from coursegrid.plans import catalog
from coursegrid.plans.registrar import Registrar
from coursegrid.session import local_session
from coursegrid.sources import io

HEADLINE = [
    "open_seats_yearly", "open_seats_semester", "course_yearly", "course_semester",
    "section_marks", "discipline_by_level", "course_picker", "complete_terms", "wide_facts",
    "clean_registrations", "xlist_combined", "yearly_capacity", "title_year",
    "course_semester_joined",
]


def stored_questions(spark, folder):
    """The same questions over facts that were written once, as they would be asked in use."""
    path = io.scratch_path(spark, "facts")
    io.write_facts(catalog.Tables(spark, folder).facts, path)
    registrar = Registrar(
        io.read_facts(spark, path),
        excluded_terms=catalog.EXCLUDED_TERMS,
        excluded_years=catalog.EXCLUDED_YEARS,
    )
    return {
        "stored_open_seats_yearly": lambda: registrar.open_seats("year"),
        "stored_open_seats_semester": lambda: registrar.open_seats("semester"),
        "stored_discipline": lambda: registrar.discipline(catalog.SUBJECT),
        "stored_course_picker": lambda: registrar.pick_courses(catalog.SUBJECT),
    }


def seconds(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "headline")
    spark = local_session(cores, 8, **{"spark.driver.memory": "16g"})
    queries = catalog.queries()
    names = {"headline": HEADLINE, "all": list(queries)}.get(chosen) or chosen.split(",")
    jobs = {name: (lambda q=queries[name]: q(spark, folder)) for name in names}
    if chosen in ("headline", "all"):
        jobs.update(stored_questions(spark, folder))
    for build in jobs.values():
        seconds(build)
    times = {
        name: round(statistics.median(seconds(build) for _ in range(runs)), 3)
        for name, build in jobs.items()
    }
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total of the median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
