"""Secret scans over a ledger of contents.

Every version of every path is addressed by the SHA-256 of its content. The ledger has one row per content and scan: which
rule versions were applied and what they found. A scan reads only the contents for which some rule version is not in the
ledger, and evaluates only those rules. Findings are joined back to all paths that hold, or ever held, the content.

Copies are folded to one row per content before any text is shuffled, so a content that a third of the paths share is
scanned once and travels once per task. Everything is built-in SQL functions.

Defined cases: a null content is the empty content; a null path is a path of its own rows; each input row gets one result
row, so repeated rows are repeated in the result and cost no further scan; an empty text has no findings; an empty table
gives an empty ledger and result; input columns other than path and content are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.llm.shared import settled


class Rule(NamedTuple):
    """Leftmost non-overlapping matches whose group `part` has `least` characters; `hint` must hold for any match."""

    kind: str
    version: int
    pattern: str
    part: int
    least: int
    hints: tuple[str, ...] = ()
    any_case: bool = False


# The kinds in their listed order, their patterns and least lengths.
BASE = (
    Rule(
        "assign",
        1,
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
        ("passw", "secret", "token", "api"),
        any_case=True,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", 1, "[0-9a-f]+", 0, 24),
)
#: What the scan finds beyond the base kinds.
MORE = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("PRIVATE KEY",)),
    Rule("hub", 1, "gh[pousr]_[A-Za-z0-9]+", 0, 40, ("gh",)),
)
RULES = BASE + MORE

SPAN = "struct<start:int,rank:int,end:int,kind:string,version:int>"
SPANS = f"array<{SPAN}>"
#: What stands in a text in place of a secret.
MARK = "<secret>"
LEDGER = f"blob binary, scanned array<string>, spans {SPANS}"


def blob(content: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")), 256))


def label(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Sorted spans of a rule's matches: the text between matches and the matches themselves add up to positions."""
    # A run of one character class matches from its start to its end, so its least length can go into the pattern.
    run = rule.part == 0 and rule.pattern.endswith("]+")
    fixed = rule.pattern[: rule.pattern.rindex("[")] if run else ""
    pattern = f"{rule.pattern[:-1]}{{{rule.least - len(_plain(fixed))},}}" if run else rule.pattern
    none = F.array().cast(SPANS)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # A match by itself matches again in the same way, so its group need not be looked for in the whole text.
    part = (lambda w: F.length(F.regexp_extract(w, pattern, rule.part))) if rule.part else F.length
    found = F.transform(whole, lambda w: F.struct(F.length(w).alias("n"), part(w).alias("part")))
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), found.alias("hit"))
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.coalesce(x["hit"]["n"], F.lit(0))
        keep = F.coalesce(x["hit"]["part"] >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(s["out"], F.array(span(start, end)))).otherwise(s["out"]).alias("out"))

    def span(start: Column, end: Column) -> Column:
        named = (start, "start"), (F.lit(rank), "rank"), (end, "end"), (F.lit(rule.kind), "kind"), (F.lit(rule.version), "version")
        return F.struct(*[c.alias(n) for c, n in named])

    # Each group of matches from 0, then moved on by the length of the groups before: linear in the number of matches.
    def moved(groups: Column) -> Column:
        before = totals_before(F.transform(groups, lambda g: g["at"]), F.lit(0), lambda a, b: a + b)
        return F.zip_with(groups, before, lambda g, o: F.transform(g["out"], lambda s: span(s["start"] + o, s["end"] + o)))

    spans = F.flatten(once(F.transform(in_groups(parts), lambda g: F.aggregate(g, state, step)), moved))
    folded = F.lower(text) if rule.any_case else text
    likely = F.lit(False) if rule.hints else text.rlike(pattern)
    for hint in rule.hints:
        likely = likely | folded.contains(hint)
    return F.when(likely, spans).otherwise(none)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it stands in there, inside further functions too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_groups(items: Column) -> Column:
    """An array cut into about as many groups as each group has items: folds that append copy what they have so far."""

    def cut(items: Column) -> Column:
        n = F.size(items)
        step = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step), lambda i: F.slice(items, i + 1, step))

    return once(items, cut)


def totals_before(numbers: Column, first: Column, add) -> Column:
    """For each of some numbers, `first` and the numbers before it, put together by `add`."""
    state = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        numbers, state, lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"]
    )


def _plain(fixed: str) -> str:
    """One character for each character class with its repetition: the least length of a pattern's fixed part."""
    out, inside = "", False
    for c in fixed:
        if c == "[":
            out, inside = out + "x", True
        elif c == "]":
            inside = False
        elif not inside:
            out += c
    return out


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, content_col: str = "text") -> DataFrame:
    """New ledger rows: for each content with an unseen rule version, those rule versions and what they found."""
    text = F.coalesce(F.col(content_col), F.lit(""))
    contents = versions.select(blob(text).alias("blob"), text.alias("content")).groupBy("blob").agg(
        F.first("content").alias("content")
    )
    if ledger is None:
        seen = F.array().cast("array<string>")
    else:
        before = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
        contents = contents.join(before, "blob", "left")
        seen = F.coalesce(F.col("seen"), F.array().cast("array<string>"))
    labels = F.array(*[F.lit(label(r)) for r in rules])
    todo = contents.select("blob", "content", F.array_except(labels, seen).alias("todo")).filter(F.size("todo") > 0)
    found = [
        F.when(F.array_contains("todo", label(r)), spans_of(F.col("content"), r, rank)).otherwise(F.array().cast(SPANS))
        for rank, r in enumerate(rules)
    ]
    return todo.select("blob", F.col("todo").alias("scanned"), F.array_sort(F.concat(*found)).alias("spans"))


def findings(
    versions: DataFrame, ledger: DataFrame, rules=RULES, path_col: str = "path", content_col: str = "text"
) -> DataFrame:
    """`path, blob, spans` for every input row: the findings of the given rule versions in its content, sorted.

    Findings are few. Grouped by the content and its hash, they are dealt out once more for the join, which then stands
    directly over two exchanges, so that Spark can split a content that very many paths hold.
    """
    current = F.array(*[F.lit(label(r)) for r in rules])
    by_blob = (
        ledger.select("blob", F.filter("spans", lambda s: F.array_contains(current, F.concat_ws(":", s["kind"], s["version"]))).alias("spans"))
        .filter(F.size("spans") > 0)
        .groupBy("blob", F.xxhash64("blob").alias("spread"))
        .agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
        .drop("spread")
    )
    rows = versions.select(F.col(path_col).alias("path"), blob(F.col(content_col)).alias("blob"))
    return rows.join(by_blob, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )


def joined(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every span, or run of overlapping spans, replaced by `mark`."""

    def of_group(g: Column, start: Column) -> Column:
        """From the end of the spans before the group to the end of its own, cut out once, so that no span counts from the text's start."""
        end = F.array_max(F.transform(g, lambda s: s["end"]))
        before = totals_before(F.transform(g, lambda s: s["end"]), start, F.greatest)

        def pieces(own: Column) -> Column:
            piece = lambda s, at: F.when(
                s["start"] >= at, F.concat(F.substring(own, at - start + 1, s["start"] - at), F.lit(mark))
            ).otherwise("")
            return F.array_join(F.zip_with(g, before, piece), "")

        return once(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))), pieces)

    def of_all(groups: Column) -> Column:
        last = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda s: s["end"])))
        tail = F.substring(text, F.array_max(last) + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(groups, totals_before(last, F.lit(0), F.greatest), of_group), ""), tail)

    return F.when(F.size(spans) > 0, once(in_groups(spans), of_all)).otherwise(text)


def redact(documents: DataFrame, ledger: DataFrame | None = None, rules=RULES, text_col: str = "text") -> DataFrame:
    """The input rows and columns, every secret in `text_col` replaced; a null text stays null."""
    fresh = settled(scan(documents, ledger, rules, text_col))
    known = fresh if ledger is None else ledger.unionByName(fresh)
    by_blob = findings(documents, known, rules, text_col, text_col).select("blob", "spans").filter(F.size("spans") > 0)
    names = documents.columns
    left = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), blob(F.col(text_col)).alias("blob"))
    both = left.join(by_blob.dropDuplicates(["blob"]), "blob", "left")
    text = F.col("row")[text_col]
    clean = F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans")))
    return both.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
