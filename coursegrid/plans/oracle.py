"""The registered queries as plain SQL over the given tables.

Written row by row, the way the questions read, and not the way the Spark plans run.
"""

from coursegrid.plans.catalog import (
    CODE,
    COURSE_ID,
    COURSES,
    EXCLUDED_INPUT_TERMS,
    EXCLUDED_TERMS,
    EXCLUDED_YEARS,
    SUBJECT,
    SUBJECTS,
    TITLE,
)
from coursegrid.schemas import SECTION_DOMAIN


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


DOMAIN = _texts(SECTION_DOMAIN)
INPUT_TERMS = _texts(EXCLUDED_INPUT_TERMS)
TERMS = _texts(EXCLUDED_TERMS)
YEARS = ", ".join(str(y) for y in EXCLUDED_YEARS)

_OF_SUBJECTS = f"subject IN ({_texts(SUBJECTS)})"
SCOPE = f"schedule_type IS NULL AND acad_year_term NOT IN ({INPUT_TERMS})"
# Queries with a scope of their own.
SCOPES = {"wide_facts_subjects": _OF_SUBJECTS}
# Each step may use the ones before it; `scope` is filled in per query.
STEPS = {
    "sized": """
        SELECT l.*, p.*, CAST(year(l_shipdate) AS INT) AS y, month(l_shipdate) AS m,
               CASE WHEN p_size <= 40 THEN p_size * 10 + 100 ELSE p_size * 50 END AS n
        FROM lineitem l JOIN part p ON l_partkey = p_partkey""",
    "reg": """
        SELECT CAST(y AS VARCHAR) || CASE WHEN m <= 5 THEN 'SP' WHEN m <= 7 THEN 'SU' ELSE 'FA' END
                   AS acad_year_term,
               CAST(CASE WHEN m >= 8 THEN y ELSE y - 1 END AS INT) AS reporting_year,
               p_partkey AS course_id, l_orderkey AS course_section_id,
               p_type || '-' || CAST(n AS VARCHAR) AS course_name, p_name AS course_title,
               p_type AS subject, CAST(n AS VARCHAR) AS course_number,
               lpad(CAST(l_suppkey % 24 AS VARCHAR), 2, '0') AS section_number,
               l_quantity AS enrolled,
               CASE WHEN l_returnflag = 'R' THEN p_type || '-' || CAST(n AS VARCHAR) END
                   AS xlist_primary_course,
               CASE WHEN l_returnflag = 'R' THEN 'X' || CAST(l_orderkey AS VARCHAR) END
                   AS xlist_section1,
               CAST(NULL AS VARCHAR) AS xlist_section2, CAST(NULL AS VARCHAR) AS xlist_section3,
               CAST(NULL AS VARCHAR) AS xlist_section4,
               CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'LAB' END AS schedule_type,
               CAST(CASE WHEN n >= 1000 THEN n // 1000 - 1 ELSE n // 100 END AS VARCHAR)
                   AS course_level
        FROM sized""",
    "cap": """
        SELECT o_orderkey AS course_section_id,
               'SEC-' || CAST(o_orderkey AS VARCHAR) AS course_section_name,
               CASE WHEN o_orderstatus <> 'P' THEN CAST(1 + o_orderkey % 60 AS DOUBLE) END
                   AS section_capacity
        FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "split": """
        SELECT * EXCLUDE (acad_year_term),
               substr(acad_year_term, 1, length(acad_year_term) - 2) AS term_year,
               right(acad_year_term, 2) AS semester
        FROM reg""",
    "clean": """
        SELECT reg.* EXCLUDE (acad_year_term, section_number, schedule_type), section_capacity,
               substr(acad_year_term, 1, length(acad_year_term) - 2) AS term_year,
               right(acad_year_term, 2) || '_' || section_number AS section
        FROM reg LEFT JOIN cap USING (course_section_id)
        WHERE {scope}""",
    "united": """
        SELECT * EXCLUDE (course_name, course_title),
               course_name || ': ' || course_title AS course
        FROM clean""",
    "pooled": """
        SELECT * EXCLUDE (course_name, course_title, enrolled),
               course_name || ': ' || course_title AS course,
               CASE WHEN count(*) OVER w = count(enrolled) OVER w THEN sum(enrolled) OVER w END
                   AS enrolled
        FROM clean WHERE xlist_section1 IS NOT NULL
        WINDOW w AS (PARTITION BY course_title, section, reporting_year)""",
    "combined": """
        SELECT * FROM pooled
        UNION ALL BY NAME
        SELECT * FROM united WHERE xlist_section1 IS NULL""",
    # one row per course, year and section, sections outside the domain included
    "cells": f"""
        SELECT course, reporting_year, section, section IN ({DOMAIN}) AS known,
               left(section, 2) AS semester, right(section, 2) AS number,
               coalesce(sum(enrolled), 0) AS enrolled,
               coalesce(sum(section_capacity), 0) AS capacity,
               min(subject) AS subject, min(course_number) AS course_number,
               min(course_level) AS course_level
        FROM combined GROUP BY course, reporting_year, section""",
    "years": """
        SELECT course, reporting_year, min(subject) AS subject,
               min(course_number) AS course_number, min(course_level) AS course_level,
               sum(capacity) AS yearly_capacity,
               coalesce(sum(enrolled) FILTER (known), 0) AS yearly_enrolled,
               coalesce(sum(enrolled) FILTER (known AND semester = 'FA'), 0) AS fall_enrolled,
               coalesce(sum(enrolled) FILTER (known AND semester = 'SP'), 0) AS spring_enrolled,
               coalesce(sum(capacity) FILTER (known AND semester = 'FA'), 0) AS fall_capacity,
               coalesce(sum(capacity) FILTER (known AND semester = 'SP'), 0) AS spring_capacity
        FROM cells GROUP BY course, reporting_year""",
    "all_sections": """
        SELECT c.course, c.reporting_year,
               CAST(CASE WHEN c.semester = 'SP' THEN c.reporting_year + 1
                         ELSE c.reporting_year END AS INT) AS semester_year,
               CAST(CASE WHEN c.semester = 'SP' THEN c.reporting_year + 1
                         ELSE c.reporting_year END AS VARCHAR) || '_' || c.semester AS term,
               c.semester, c.number AS section, c.section AS section_key, c.enrolled,
               y.subject, y.course_number, y.course_level, y.yearly_capacity
        FROM cells c JOIN years y USING (course, reporting_year)
        WHERE c.known AND c.enrolled <> 0""",
    "sections": f"SELECT * FROM all_sections WHERE term NOT IN ({TERMS})",
    "year_counts": """
        SELECT course, reporting_year, count(*) AS total_sections
        FROM sections GROUP BY course, reporting_year""",
    "term_counts": """
        SELECT course, term, count(*) AS total_sections FROM sections GROUP BY course, term""",
    "yearly": f"""
        SELECT course, reporting_year, yearly_enrolled, yearly_capacity, total_sections,
               round_even(yearly_enrolled / total_sections, 0) AS avg_section
        FROM years LEFT JOIN year_counts USING (course, reporting_year)
        WHERE reporting_year NOT IN ({YEARS})""",
    "halves": """
        SELECT course, reporting_year, 'FA' AS semester, reporting_year AS year,
               CAST(reporting_year AS VARCHAR) || '_FA' AS term,
               fall_enrolled AS semester_enrolled, fall_capacity AS semester_capacity
        FROM years
        UNION ALL
        SELECT course, reporting_year, 'SP', CAST(reporting_year + 1 AS INT),
               CAST(reporting_year + 1 AS VARCHAR) || '_SP', spring_enrolled, spring_capacity
        FROM years""",
    "semesterly": f"""
        SELECT course, term, CAST(year * 2 + (semester = 'FA')::INT AS INT) AS term_key, year,
               semester, CAST(year + (semester = 'FA')::INT AS INT) AS term_order,
               semester_enrolled, semester_capacity, total_sections,
               round_even(semester_enrolled / total_sections, 0) AS avg_section
        FROM halves LEFT JOIN term_counts USING (course, term)
        WHERE semester_enrolled <> 0 AND term NOT IN ({TERMS})""",
    "terms": """
        SELECT DISTINCT term, year, semester,
               CAST(year * 2 + (semester = 'FA')::INT AS INT) AS term_key
        FROM halves""",
    "raw_terms": """
        SELECT DISTINCT CAST(reporting_year AS VARCHAR) || '_' || semester AS term,
               reporting_year AS year, semester,
               CAST(reporting_year * 2 + (semester = 'FA')::INT AS INT) AS term_key
        FROM halves""",
    "chosen": f"""
        SELECT DISTINCT p_type || '-' || CAST(n AS VARCHAR) || ': ' || p_name AS course
        FROM sized WHERE p_name = '{TITLE}'""",
    "chosen_courses": "SELECT DISTINCT course FROM years JOIN chosen USING (course)",
    "all_years": """
        SELECT CAST(unnest(range(min(reporting_year), max(reporting_year) + 1)) AS INT)
                   AS reporting_year
        FROM years""",
    "full_years": f"""
        SELECT course, reporting_year, yearly_enrolled, yearly_capacity, total_sections, avg_section
        FROM (SELECT * FROM chosen_courses, all_years)
        LEFT JOIN yearly USING (course, reporting_year)
        WHERE reporting_year NOT IN ({YEARS})""",
    "full_terms": f"""
        SELECT course, t.term, t.year, t.semester, t.term_key,
               CAST(t.year + (t.semester = 'FA')::INT AS INT) AS term_order,
               semester_enrolled, semester_capacity, total_sections, avg_section
        FROM (SELECT * FROM chosen_courses, terms) t
        LEFT JOIN (SELECT course, term, semester_enrolled, semester_capacity, total_sections,
                          avg_section FROM semesterly) USING (course, term)
        WHERE t.term NOT IN ({TERMS})""",
    "stats": """
        SELECT course, reporting_year, total_sections, yearly_capacity,
               round_even(yearly_capacity / total_sections, 0) AS avg_capacity
        FROM years JOIN year_counts USING (course, reporting_year)""",
    "offered": "SELECT *, count(*) OVER (PARTITION BY course) AS total_years_offered FROM stats",
    "rated": """
        SELECT course,
               round_even(coalesce(sum(avg_capacity), 0) / count(*), 0) AS full_avg_capacity,
               arg_min(subject, reporting_year) AS subject,
               arg_min_null(total_years_offered, reporting_year) AS total_years_offered
        FROM years LEFT JOIN offered USING (course, reporting_year) GROUP BY course""",
}

# Steps in place of others, where section rows state levels of their own and first values count.
FIRST_VALUES = {
    "reg": {
        "stated": STEPS["reg"].replace("FROM sized", ", l_linenumber, l_linestatus FROM sized"),
        "reg": """
        SELECT * EXCLUDE (l_linestatus)
               REPLACE (CASE WHEN l_linenumber % 3 <> 0 THEN course_level || l_linestatus END
                        AS course_level)
        FROM stated""",
    },
    "years": {
        "known_years": STEPS["years"],
        "first_rows": """
        SELECT course, reporting_year, subject, course_number, course_level
        FROM united
        QUALIFY row_number() OVER (
            PARTITION BY course, reporting_year
            ORDER BY xlist_section1 IS NULL, course_section_id * 8 + l_linenumber,
                     course_level NULLS FIRST) = 1""",
        "years": """
        SELECT k.* REPLACE (f.subject AS subject, f.course_number AS course_number,
                            f.course_level AS course_level)
        FROM known_years k JOIN first_rows f USING (course, reporting_year)""",
    },
}
REPLACED = {"wide_facts_first_values": FIRST_VALUES}

WIDE_CELLS = ", ".join(
    f"coalesce(sum(enrolled) FILTER (section = '{k}'), 0) AS {k}" for k in SECTION_DOMAIN
)
CAPACITY_CELLS = ", ".join(
    f"coalesce(sum(capacity) FILTER (section = '{k}'), 0) AS {k}" for k in SECTION_DOMAIN
)
WIDE = f"""
    SELECT * FROM years JOIN
    (SELECT course, reporting_year, {WIDE_CELLS} FROM cells GROUP BY course, reporting_year)
    USING (course, reporting_year)"""


def _seats(source: str, keys: str, enrolled: str, capacity: str) -> str:
    flag = f"""CASE WHEN {enrolled} > {capacity} THEN 'Full'
                    WHEN {enrolled} BETWEEN {capacity} - total_sections AND {capacity} THEN 'Full'
                    WHEN {enrolled} < {capacity} THEN 'Not Full' END"""
    measures = {
        "empty_seats": f"CASE WHEN {capacity} > {enrolled} THEN {capacity} - {enrolled} "
        f"WHEN {capacity} <= {enrolled} THEN 0 END",
        "overenrollments": f"CASE WHEN {capacity} < {enrolled} THEN {enrolled} - {capacity} "
        f"WHEN {capacity} >= {enrolled} THEN 0 END",
        "enrollments": enrolled,
    }
    return " UNION ALL ".join(
        f"SELECT {keys}, total_sections, avg_section, {flag} AS full_ind, '{name}' AS measure, "
        f"CAST({i} AS INT) AS measure_order, CAST({value} AS DOUBLE) AS n_students FROM {source}"
        for i, (name, value) in enumerate(measures.items(), start=1)
    )


def _classes(source: str, enrolled: str, capacity: str) -> str:
    within = f"{enrolled} BETWEEN {capacity} - total_sections AND {capacity}"
    return f"""
        SELECT *, CASE WHEN {enrolled} > {capacity} THEN 'Over Enrollment'
                       WHEN {within} THEN 'Enrollment (full)'
                       WHEN {enrolled} < {capacity} THEN 'Enrollment' END AS enrolled_class,
                  CASE WHEN {enrolled} > {capacity} THEN 'Enrollment (full)'
                       WHEN {enrolled} < {capacity} - total_sections THEN 'Empty Seats'
                       WHEN {within} THEN 'Empty Seats' END AS capacity_class
        FROM {source}"""


def _discipline(level: str, sections: str, subject: str, where: str) -> str:
    return f"""
        SELECT course_level, reporting_year, enrolled, total_sections,
               round_even(enrolled / total_sections, 0) AS avg_section
        FROM (SELECT {level} AS course_level, reporting_year, sum(yearly_enrolled) AS enrolled
              FROM years WHERE subject = '{subject}' GROUP BY 1, 2) e
        LEFT JOIN (SELECT {level} AS lvl, reporting_year AS ry, count(*) AS total_sections
                   FROM {sections} WHERE subject = '{subject}' GROUP BY 1, 2) s
        ON lvl IS NOT DISTINCT FROM course_level AND ry IS NOT DISTINCT FROM reporting_year
        WHERE {where}"""


_LEVEL = """CAST(CASE WHEN TRY_CAST(course_number AS DOUBLE) >= 1000
                      THEN floor(TRY_CAST(course_number AS DOUBLE) / 1000) - 1
                      ELSE floor(TRY_CAST(course_number AS DOUBLE) / 100) END AS INT)"""
_USED = """acad_year_term, reporting_year, course_id, course_name, subject, course_number,
           course_title, enrolled, xlist_primary_course, xlist_section1, xlist_section2,
           xlist_section3, xlist_section4, section_number, course_level"""
_TITLES = """SELECT course_title, acad_year_term,
                    CASE WHEN count(*) = count(enrolled) THEN sum(enrolled) END AS enrolled,
                    max(reporting_year) AS reporting_year
             FROM reg WHERE {where} GROUP BY course_title, acad_year_term"""

QUERIES = {
    "scan_registrations": "SELECT * FROM reg",
    "scan_capacity": "SELECT * FROM cap",
    "project_registration": f"SELECT {_USED} FROM reg ORDER BY reporting_year DESC",
    "preview_top6": """SELECT course, reporting_year, yearly_enrolled, fall_enrolled,
        spring_enrolled FROM years ORDER BY course, reporting_year LIMIT 6""",
    "filter_subjects": f"SELECT * FROM reg WHERE {_OF_SUBJECTS}",
    "filter_schedule_null": "SELECT * FROM reg WHERE schedule_type IS NULL",
    "exclude_terms": f"SELECT * FROM reg WHERE acad_year_term NOT IN ({INPUT_TERMS})",
    "xlist_members": "SELECT * FROM reg WHERE xlist_section1 IS NOT NULL",
    "split_term": "SELECT * FROM split",
    "unite_course_section": """
        SELECT * EXCLUDE (semester, section_number, course_name, course_title),
               semester || '_' || section_number AS section,
               course_name || ': ' || course_title AS course FROM split""",
    "extract_course_code": f"""SELECT course, reporting_year,
        nullif(regexp_extract(course, '{CODE}'), '') AS course_code FROM years""",
    "join_capacity": "SELECT * FROM reg LEFT JOIN cap USING (course_section_id)",
    "clean_registrations": "SELECT * FROM clean",
    "xlist_pooled": "SELECT * FROM pooled",
    "xlist_combined": "SELECT * FROM combined",
    "yearly_capacity": """SELECT *, coalesce(sum(section_capacity)
        OVER (PARTITION BY course, reporting_year), 0) AS yearly_capacity FROM united""",
    "section_pivot_capacity": f"""SELECT course, reporting_year, {CAPACITY_CELLS}
        FROM cells GROUP BY course, reporting_year""",
    "section_pivot_enrolled": f"""SELECT course, reporting_year, {WIDE_CELLS}
        FROM cells GROUP BY course, reporting_year""",
    "list_cell_sum": """SELECT course, reporting_year, section AS section_key,
        len(list(coalesce(section_capacity, -1))) AS cell_size,
        coalesce(list_sum(list(section_capacity)), 0) AS cell_sum
        FROM united GROUP BY course, reporting_year, section""",
    "capacity_by_semester":
        "SELECT course, reporting_year, fall_capacity, spring_capacity FROM years",
    "enrollment_totals": """SELECT course, reporting_year, yearly_enrolled, fall_enrolled,
        spring_enrolled FROM years""",
    "course_year_facts": """
        SELECT c.course, c.reporting_year, CASE WHEN known THEN c.semester END AS semester,
               CASE WHEN known THEN c.number END AS section,
               CASE WHEN known THEN c.section END AS section_key,
               CASE WHEN known THEN sum(c.enrolled) END AS enrolled,
               sum(c.capacity) AS capacity, min(y.yearly_capacity) AS yearly_capacity,
               min(y.subject) AS subject, min(y.course_number) AS course_number,
               min(y.course_level) AS course_level
        FROM cells c JOIN years y USING (course, reporting_year)
        GROUP BY c.course, c.reporting_year, known, CASE WHEN known THEN c.semester END,
                 CASE WHEN known THEN c.number END, CASE WHEN known THEN c.section END""",
    "wide_facts": WIDE,
    "wide_facts_subjects": WIDE,
    "csv_roundtrip": WIDE,
    "wide_facts_first_values": WIDE,
    "placed_registrations": """SELECT *, rank() OVER (
        ORDER BY reporting_year DESC NULLS LAST, course_section_id NULLS LAST) AS place FROM reg""",
    "section_long": """SELECT course, reporting_year, semester_year, term, semester, section,
        enrolled, subject, course_level, yearly_capacity FROM sections""",
    "section_long_from_wide": "SELECT * EXCLUDE (course_number) FROM sections",
    "semester_long": """SELECT course, reporting_year, term, year, semester, semester_enrolled
        FROM halves""",
    "semester_long_raw": """SELECT course, reporting_year,
        CAST(reporting_year AS VARCHAR) || '_' || semester AS term, reporting_year AS year,
        semester, semester_enrolled FROM halves""",
    "sections_per_year": "SELECT * FROM year_counts",
    "sections_per_term": "SELECT * FROM term_counts",
    "cumulative_sections": """SELECT course, term, section, enrolled, sum(enrolled)
        OVER (PARTITION BY course, term ORDER BY section) AS cumulative_enrolled FROM sections""",
    "section_marks": """SELECT *, cumulative_enrolled - 5 AS label_y,
        'Enrollment for ' || course AS title
        FROM (SELECT course, term, section, enrolled, sum(enrolled)
              OVER (PARTITION BY course, term ORDER BY section) AS cumulative_enrolled
              FROM sections)""",
    "course_yearly": "SELECT * FROM yearly",
    "course_semester": "SELECT * EXCLUDE (semester_capacity) FROM semesterly",
    "course_semester_raw": """
        SELECT course, CAST(reporting_year AS VARCHAR) || '_' || semester AS term,
               CAST(reporting_year * 2 + (semester = 'FA')::INT AS INT) AS term_key,
               reporting_year AS year, semester,
               CAST(reporting_year + (semester = 'FA')::INT AS INT) AS term_order,
               semester_enrolled, total_sections,
               round_even(semester_enrolled / total_sections, 0) AS avg_section
        FROM halves LEFT JOIN (SELECT course, term, count(*) AS total_sections
                               FROM all_sections GROUP BY course, term) USING (course, term)
        WHERE semester_enrolled <> 0""",
    "course_semester_selected": f"""SELECT * EXCLUDE (semester_capacity) FROM semesterly
        WHERE course IN ({_texts(COURSES)})""",
    "course_semester_joined":
        "SELECT * EXCLUDE (semester_capacity) FROM semesterly SEMI JOIN chosen USING (course)",
    "open_seats_titled": f"""
        SELECT *, 'Course Capacity for ' || course AS title FROM (
        {_seats("semesterly", "course, term", "semester_enrolled", "semester_capacity")})
        SEMI JOIN chosen USING (course)""",
    "open_seats_yearly":
        _seats("yearly", "course, reporting_year", "yearly_enrolled", "yearly_capacity"),
    "open_seats_semester":
        _seats("semesterly", "course, term", "semester_enrolled", "semester_capacity"),
    "seat_class_yearly": _classes("full_years", "yearly_enrolled", "yearly_capacity"),
    "seat_class_semester": _classes("full_terms", "semester_enrolled", "semester_capacity"),
    "complete_years": "SELECT * FROM full_years",
    "complete_years_own_range": f"""
        SELECT course, reporting_year, yearly_enrolled, yearly_capacity, total_sections, avg_section
        FROM (SELECT course, CAST(unnest(range(min(reporting_year), max(reporting_year) + 1)) AS INT)
                         AS reporting_year
              FROM years SEMI JOIN chosen USING (course) GROUP BY course)
        LEFT JOIN yearly USING (course, reporting_year) WHERE reporting_year NOT IN ({YEARS})""",
    "complete_terms": _seats(
        "full_terms",
        "course, term, term_key, term_order",
        "semester_enrolled",
        "semester_capacity",
    ),
    "term_spine": "SELECT * FROM terms",
    "year_spine": "SELECT * FROM all_years",
    "discipline_by_level": _discipline(
        "course_level", "sections", SUBJECT, f"reporting_year NOT IN ({YEARS})"
    ),
    "discipline_guard": _discipline(
        "course_level", "sections", SUBJECT, f"reporting_year NOT IN ({YEARS})"
    ).replace(f"subject = '{SUBJECT}'", f"subject IN ('{SUBJECT}', 'UNKNOWN')"),
    "discipline_titled": f"""SELECT *, 'Enrollment for {SUBJECT}' AS title FROM (
        {_discipline("course_level", "sections", SUBJECT, f"reporting_year NOT IN ({YEARS})")})""",
    "discipline_derived_level": _discipline(_LEVEL, "all_sections", SUBJECT, "course_level <= 3"),
    "capacity_stats": "SELECT * FROM stats",
    "years_offered": "SELECT * FROM offered",
    "total_offered": """SELECT course, reporting_year, term, semester, section,
        count(*) OVER (PARTITION BY course) AS total_offered FROM sections""",
    "total_offered_all_terms": """SELECT course, reporting_year, term, semester, section,
        count(*) OVER (PARTITION BY course) AS total_offered FROM all_sections""",
    "rated_courses": "SELECT * FROM rated",
    "course_picker": f"""SELECT * FROM rated WHERE full_avg_capacity >= 6
        AND subject = '{SUBJECT}' AND total_years_offered >= 3""",
    "section_weighted_capacity": """
        SELECT course,
               round_even(coalesce(sum(avg_capacity), 0) / count(*), 0) AS full_avg_capacity
        FROM years LEFT JOIN
             (SELECT course, reporting_year, round_even(yearly_capacity / count(*)
                         OVER (PARTITION BY course, reporting_year), 0) AS avg_capacity
              FROM all_sections) USING (course, reporting_year)
        GROUP BY course""",
    "total_capacity": "SELECT *, avg_capacity * total_sections AS total_capacity FROM stats",
    "total_capacity_terms": f"""
        SELECT course, term, year, semester_enrolled, avg_capacity, t.total_sections,
               avg_capacity * t.total_sections AS total_capacity
        FROM halves LEFT JOIN (SELECT course, reporting_year, avg_capacity FROM stats)
                    USING (course, reporting_year)
        LEFT JOIN term_counts t USING (course, term)
        WHERE semester_enrolled <> 0 AND term NOT IN ({TERMS})""",
    "term_order": """SELECT *, CAST(dense_rank() OVER (ORDER BY term_key) AS INT) AS term_order
        FROM terms""",
    "term_order_raw": """SELECT *, CAST(dense_rank() OVER (ORDER BY year, semester DESC) AS INT)
        AS term_order FROM raw_terms""",
    "term_order_median": """
        SELECT term, median_order,
               CAST(row_number() OVER (ORDER BY median_order, term) AS INT) AS term_order
        FROM (SELECT term, median(term_order) AS median_order FROM semesterly GROUP BY term)""",
    "axis_limits": f"""
        SELECT (SELECT max(yearly_enrolled) FROM yearly) AS max_yearly_enrolled,
               (SELECT max(semester_enrolled) FROM halves WHERE term NOT IN ({TERMS}))
                   AS max_semester_enrolled,
               min(reporting_year) AS first_year, max(reporting_year) AS last_year FROM years""",
    "axis_limits_selected": f"""
        SELECT (SELECT max(yearly_enrolled) FROM yearly SEMI JOIN chosen USING (course))
                   AS max_yearly_enrolled,
               (SELECT max(semester_enrolled) FROM halves SEMI JOIN chosen USING (course)
                WHERE term NOT IN ({TERMS})) AS max_semester_enrolled,
               min(reporting_year) AS first_year, max(reporting_year) AS last_year
        FROM years SEMI JOIN chosen USING (course)""",
    "axis_limits_discipline": f"""
        SELECT max(enrolled) AS max_enrolled, min(reporting_year) AS first_year,
               max(reporting_year) AS last_year
        FROM ({_discipline("course_level", "sections", SUBJECT, f"reporting_year NOT IN ({YEARS})")})""",
    "distinct_subjects": "SELECT DISTINCT subject FROM years",
    "distinct_courses": "SELECT DISTINCT course FROM years",
    "title_term": _TITLES.format(where=_OF_SUBJECTS),
    "title_year": f"""
        SELECT course_title, reporting_year,
               CASE WHEN count(*) = count(enrolled) THEN sum(enrolled) END AS enrolled
        FROM ({_TITLES.format(where=_OF_SUBJECTS)}) GROUP BY course_title, reporting_year""",
    "title_term_split": f"""
        SELECT * EXCLUDE (acad_year_term), left(acad_year_term, 4) AS term_year,
               right(acad_year_term, 2) AS semester
        FROM ({_TITLES.format(where=_OF_SUBJECTS)}) WHERE acad_year_term LIKE '%FA'""",
    "course_id_terms": _TITLES.format(where=f"course_id = {COURSE_ID}"),
}
_CHART = "'Enrollment for ' || course AS title"
QUERIES |= {
    "placed_title_years": f"""SELECT *, rank() OVER (
        ORDER BY reporting_year NULLS LAST, course_title NULLS LAST) AS place
        FROM ({QUERIES["title_year"]})""",
    "mode_year": QUERIES["open_seats_yearly"],
    "mode_semester": QUERIES["open_seats_semester"],
    "mode_line": f"SELECT *, {_CHART} FROM yearly",
    "mode_sections": QUERIES["section_marks"],
    "mode_labelled_sections": f"SELECT *, section AS label FROM ({QUERIES['section_marks']})",
    "mode_title_year": QUERIES["title_year"],
}


def oracle_sql() -> dict[str, str]:
    sql = {}
    for name, body in QUERIES.items():
        steps = {}
        for step, text in STEPS.items():
            steps |= REPLACED.get(name, {}).get(step, {step: text})
        steps["clean"] = steps["clean"].format(scope=SCOPES.get(name, SCOPE))
        listed = ",\n".join(f"{step} AS ({text})" for step, text in steps.items())
        sql[name] = f"WITH {listed}\n{body}"
    return sql
