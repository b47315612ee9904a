"""Quality rules: a threshold table compiled into one projection over a document's text.

`RULES` is the table: each row names a ratio, and the bounds within which a document is kept. `assess` turns the
table into one Spark projection of built-in functions; nothing is joined, shuffled or run in Python.

Defined cases: a null text counts as empty; an empty text has no words and fails `min_words`; rows are judged one by one,
so repeated rows and repeated or null ids give one result row each; an empty table gives an empty result; input columns
other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the word rule, the counted symbols, the usual function words of four languages.
SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": "the of and to a in is it that for on as with was by this from are or an be at not",
    "de": "der die das und in zu den von mit ist im für auf sich ein eine dem des nicht als",
    "fr": "de la le et les des un une en est que dans qui du sur pour par au pas ne",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


class Rule(NamedTuple):
    """Keep a document if `low <= ratio <= high`; `base` rules also set `base_failed`."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    base: bool = False


#: Bounds on whole-number ratios are compared as products, so no division rounds.
RULES = (
    Rule("min_words", "n_words", low=50, base=True),
    Rule("repeated_words", "n_repeat_words / n_words", high=0.5, base=True),
    Rule("word_length", "word_chars / n_words", low=2, high=20),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("exclamations", "n_exclamations / n_words", high=0.3),
    Rule("stop_words", "n_stop_words / n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines / n_lines", high=0.9),
)


def bound(value: Column, name: str, body) -> Column:
    """`body` of a value that is computed once, however often `body` uses it (one-element array, one lambda)."""
    return F.transform(F.array(value), body)[0].alias(name)


def count_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Number of words that lie in a window of `size` words found twice or more in the array."""

    def covered(hashes: Column) -> Column:
        marks = bound(
            F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            "marks",
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"])),
                    lambda e: e["i"],
                )
            ),
        )
        steps = bound(
            marks,
            "steps",
            lambda m: F.transform(m, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(m, i + 1) - p, F.lit(size)))),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    windows = F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - size),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return bound(
        windows,
        "repeated",
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


def _counts(text: Column) -> Column:
    stops = sorted({v for line in STOP_WORDS.values() for w in line.split() for v in (w, w.capitalize(), w.upper())})

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return F.struct(
        bound(words_of(text), "w", of_words),
        bound(lines, "l", of_lines),
        count_of(text, SYMBOLS).alias("n_symbols"),
        count_of(text, "!").alias("n_exclamations"),
    )


def compiled(rules, counts: dict[str, Column]) -> Column:
    """True if every rule holds. A ratio over nothing has no value and fails no rule."""
    verdict = F.lit(True)
    for rule in rules:
        above, _, below = (part.strip() for part in rule.ratio.partition("/"))
        over = counts[below] if below else F.lit(1)
        if rule.low is not None:
            verdict = verdict & (counts[above] >= over * F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (counts[above] <= over * F.lit(rule.high))
    return verdict


def assess(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: the counts, `base_failed` and `kept` (every rule of the table holds)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = documents.select(F.col(id_col).alias("doc_id"), _counts(text).alias("c"))
    names = {"w": ("n_words", "word_chars", "n_repeat_words", "n_stop_words"), "l": ("n_lines", "n_dup_lines", "n_bullet_lines")}
    counts = {n: F.col(f"c.{part}.{n}") for part, own in names.items() for n in own}
    counts |= {n: F.col(f"c.{n}") for n in ("n_symbols", "n_exclamations")}
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return at.select(
        "doc_id",
        *[counts[n].alias(n) for n in shown],
        (~compiled([r for r in rules if r.base], counts)).alias("base_failed"),
        compiled(rules, counts).alias("kept"),
        *[c.alias(n) for n, c in counts.items() if n not in shown],
    )
