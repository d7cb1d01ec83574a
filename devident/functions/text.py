"""Text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from devident.fixed_values import CREATED_FORMAT, RUN_STAMP_FORMAT, WHITE_SPACE


def strip(c: Column) -> Column:
    """Remove white space of every Unicode kind from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(c: Column) -> Column:
    """The text, or NULL when it is empty."""
    return F.nullif(c, F.lit(""))


def matched(c: Column, pattern: str, group: int) -> Column:
    """A capture, or NULL when the pattern does not match or captures nothing."""
    return filled(F.regexp_extract(c, pattern, group))


def created_stamp(now: str | None = None) -> Column:
    """Creation time as text; `now` fixes it for reproducible jobs."""
    return F.lit(now) if now else F.date_format(F.current_timestamp(), CREATED_FORMAT)


def run_stamp(now: str | None = None) -> Column:
    """Run time as ISO-8601 text with offset; `now` fixes it."""
    return F.lit(now) if now else F.date_format(F.current_timestamp(), RUN_STAMP_FORMAT)
