"""Quality rules as a short-circuit cascade of native expressions.

A rule rejects rows by one Boolean expression. Each rule's cost and rejection rate are
estimated on a seeded sample of bounded expected size; the cascade asks the rules in the
order of rejections per second, and an expression runs only for rows that no earlier rule
has rejected. The order changes the work, never the verdict: a row is kept if no rule
rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.llm.storage import saved

SAMPLE_ROWS = 2_000
_SPACES = "\t\n\x0b\x0c\r "
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def _without(column: Column, characters: str) -> Column:
    for c in characters:
        column = F.replace(column, F.lit(c), F.lit(""))
    return column


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)``.

    Words are runs of anything but ASCII space; ``word_chars`` counts their code points,
    ``n_symbols`` the characters ``#*$%&|<>``, ``n_lines`` the lines with a word,
    ``n_dup_lines`` those equal to an earlier line, ``n_repeat_words`` the words inside
    three-word windows that occur twice or more in the text. Windows are compared by 64-bit
    hashes within a text. A null text has none of all; rows are taken one by one, so repeated
    ids and empty tables are fine, and other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    rows = rows.withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(_SPACES))) > 0)
    )
    rows = rows.withColumn(
        "grams",
        F.expr(
            "transform(slice(words, 1, greatest(size(words) - 2, 0)),"
            " (w, i) -> xxhash64(w, words[i + 1], words[i + 2]))"
        ),
    )
    rows = rows.select(
        id_col,
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.col("grams")).alias("grams"),
    )
    # only texts with a repeated window sort their windows
    rows = rows.withColumn("sorted", F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    rows = rows.withColumn(
        "places",
        F.expr(
            "sort_array(transform(filter(sorted, (x, i) -> (i > 0 AND x.g = sorted[greatest(i - 1, 0)].g)"
            " OR (i < size(sorted) - 1 AND x.g = sorted[least(i + 1, size(sorted) - 1)].g)), x -> x.i))"
        ),
    ).drop("sorted", "grams")
    covered = F.expr(
        "aggregate(transform(places, (x, i) -> if(i < size(places) - 1,"
        " least(3, places[least(i + 1, size(places) - 1)] - x), 3)), 0L, (a, x) -> a + x)"
    )
    spaces = F.octet_length("text") - F.octet_length(_without(F.col("text"), _SPACES))
    symbols = F.octet_length("text") - F.octet_length(_without(F.col("text"), _SYMBOLS))
    return rows.select(
        id_col,
        "text",
        "n_words",
        (F.char_length("text") - spaces).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        "n_lines",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def default_rules(min_words: int = 50, repeat_percent: int = 50) -> list[Rule]:
    """Rules over the columns of ``measure``; clean prose is far from every bound."""
    words = F.col("n_words")
    capitals = F.length(F.regexp_replace("text", r"\P{Lu}+", ""))
    return [
        Rule("short", words < min_words),
        Rule("repetitive", 100 * F.col("n_repeat_words") > repeat_percent * words),
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("short_words", F.col("word_chars") < 2 * words),
        Rule("long_words", F.col("word_chars") > 15 * words),
        Rule("shouting", 2 * capitals > F.col("word_chars")),
    ]


def order_rules(rows: DataFrame, rules: list[Rule], id_col: str, sample_rows: int = SAMPLE_ROWS,
                seed: int = 3) -> list[Rule]:
    """The rules by rejections per second on about ``sample_rows`` rows, best first."""
    share = min(1.0, sample_rows / max(1, rows.select(id_col).count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 32)
    sample = saved(rows.where(draw <= int(share * 0xFFFFFFFF)))
    gain = {}
    for rule in rules:
        start = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.rejects)).first()[0]
        gain[rule.name] = rejected / (time.perf_counter() - start)
    return sorted(rules, key=lambda rule: -gain[rule.name])


def cascade(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with ``rejected_by``, the first of the rules to reject a row, or null. A rule
    that gives null does not reject."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return rows.withColumn("rejected_by", verdict)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            rules: list[Rule] | None = None) -> DataFrame:
    """The measures of every document, ``base_failed`` (too short or repetitive) and ``kept``."""
    rows = measure(docs, id_col, text_col)
    rules = order_rules(rows, default_rules() if rules is None else rules, id_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        cascade(rows, rules)
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & F.col("rejected_by").isNull())
        .drop("text")
    )
