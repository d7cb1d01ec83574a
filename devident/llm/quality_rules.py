"""Quality rules as one projection.

A table of thresholds is compiled into one chain of Spark projections over built-in functions. It has
no user function, no join and no exchange: each text is measured and judged where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devident.llm.text import SPACE

# fixed values: frequent function words of the four languages
STOP_WORDS = sorted(
    set(
        (
            "the of and to in is that for with was on as by are be at this it from have not or an a "
            "der die und den von zu das mit sich des auf für ist im dem nicht ein als auch es "
            "de la le et les un une du que est pour qui dans par sur au pas plus en "
            "el y los se del las por con su para una al lo como"
        ).split()
    )
)

WINDOW = 5
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words",
)


@dataclass(frozen=True)
class Rule:
    """`measure`, an expression over the counts, must lie within [low, high]; judged from `from_words` words on."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 1


BASE_RULES = (
    Rule("length", "n_words", low=10, from_words=0),
    Rule("repetition", "100.0D * n_repeat_words / n_words", high=20),
)
RULES = (
    Rule("word_length", "CAST(word_chars AS DOUBLE) / n_words", low=2.0, high=20.0),
    Rule("symbols", "CAST(n_symbols AS DOUBLE) / n_words", high=0.25),
    Rule("stop_words", "CAST(n_stop_words AS DOUBLE) / n_words", low=0.01, from_words=50),
    Rule("repeated_lines", "CAST(n_dup_lines AS DOUBLE) / n_lines", high=0.5),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the counts that the rules use, all of them long.

    n_words, word_chars (code points in words), n_symbols, n_stop_words, n_lines (with a word),
    n_dup_lines (equal to an earlier line) and n_repeat_words: words in windows of five that occur
    twice or more in the text. Windows are compared by a 64-bit hash of their words' 64-bit hashes,
    sorted with their places; only texts with a repeated hash are sorted. A NULL or empty text has
    zero of everything. Columns that start with `_qr_` are taken by this function while it works; columns with the names of
    the counts are replaced.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    places = F.greatest(F.size("_qr_hashes") - (WINDOW - 1), F.lit(0))
    split = (
        docs.withColumn("_qr_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
        .withColumn("_qr_words", F.filter(F.split("_qr_text", SPACE), lambda w: w != ""))
        .withColumn(
            "_qr_lines",
            F.filter(F.split("_qr_text", "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != ""),
        )
        .withColumn("_qr_hashes", F.transform("_qr_words", lambda w: F.xxhash64(w)))
    )
    counted = split.withColumn(
        "_qr_windows",
        F.transform(F.arrays_zip(*[F.slice("_qr_hashes", i + 1, places) for i in range(WINDOW)]), lambda z: F.xxhash64(z)),
    ).select(
        *columns,
        "_qr_windows",
        F.size("_qr_words").cast("long").alias("n_words"),
        F.length(F.array_join("_qr_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_qr_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(F.filter("_qr_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("_qr_lines").cast("long").alias("n_lines"),
        (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long").alias("n_dup_lines"),
    )
    placed = counted.withColumn(
        "_qr_placed",
        F.when(
            F.size(F.array_distinct("_qr_windows")) < F.size("_qr_windows"),
            F.sort_array(F.expr("arrays_zip(_qr_windows, sequence(0, size(_qr_windows) - 1))")),
        ),
    )
    neighbour = "get(_qr_placed, i {} 1)._qr_windows <=> x._qr_windows"
    starts = placed.withColumn(
        "_qr_starts",
        F.expr(
            "sort_array(transform("
            f"filter(_qr_placed, (x, i) -> {neighbour.format('-')} OR {neighbour.format('+')}), x -> x[\"1\"]))"
        ),
    )
    # a start covers five words, less those that the start before it covers
    covered = F.expr(
        "coalesce(aggregate(_qr_starts, named_struct('n', 0, 'end', 0), "
        f"(a, x) -> named_struct('n', a.n + least({WINDOW}, x + {WINDOW} - a.end), 'end', x + {WINDOW}), a -> a.n), 0)"
    )
    # through a generator, so that a filter on a count isn't pushed below and doesn't count again
    return starts.select(
        *columns,
        F.inline(F.array(F.struct(*COUNTS[:-1], covered.cast("long").alias(COUNTS[-1])))),
    )


def passes(rule: Rule) -> Column:
    """Whether a row passes a rule; a text below `from_words` words passes it."""
    value = F.expr(rule.measure)
    bounds = [value >= rule.low] if rule.low is not None else []
    bounds += [value <= rule.high] if rule.high is not None else []
    ok = reduce(lambda a, b: a & b, bounds)
    return ok if not rule.from_words else F.when(F.col("n_words") < rule.from_words, True).otherwise(ok)


def judge(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """The frame with its counts, `base_failed` and `kept`.

    `base_failed`: a base rule fails; `kept`: no rule fails. NULL and empty texts fail by length. Columns with the names of the new
    ones are replaced.
    """
    failed = reduce(lambda a, b: a | b, [~passes(r) for r in base])
    ok = reduce(lambda a, b: a & b, [passes(r) for r in rules], ~F.col("base_failed"))
    return measured(docs, text).withColumn("base_failed", failed).withColumn("kept", ok)
