"""One description of a column for both engines: the Spark column, and the SQL that DuckDB is given to check it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


class Dual(NamedTuple):
    """``make`` builds the column, which needs a session; the SQL is there without one."""

    make: Callable[[], Column]
    sql: str

    @property
    def column(self) -> Column:
        return self.make()


def count(pattern: str, of: str = "html") -> Dual:
    """How often ``pattern`` occurs."""
    return Dual(lambda: F.regexp_count(F.col(of), F.lit(pattern)), f"len(regexp_extract_all({of}, {quoted(pattern)}))")


def test(pattern: str, of: str = "html") -> Dual:
    """Whether ``pattern`` occurs."""
    return Dual(lambda: F.col(of).rlike(pattern), f"regexp_matches({of}, {quoted(pattern)})")


def every(pattern: str, group: int = 1, of: str = "html") -> Dual:
    """The ``group`` of every occurrence."""
    return Dual(lambda: F.regexp_extract_all(F.col(of), F.lit(pattern), F.lit(group)), f"regexp_extract_all({of}, {quoted(pattern)}, {group})")


def first(pattern: str, group: int = 1, of: str = "html") -> Dual:
    """The ``group`` of the first occurrence, else empty."""
    return Dual(lambda: F.regexp_extract(F.col(of), pattern, group), f"regexp_extract({of}, {quoted(pattern)}, {group})")


def replaced(of: Dual, pattern: str, by: str) -> Dual:
    """All occurrences replaced."""
    return Dual(lambda: F.regexp_replace(of.column, pattern, by), f"regexp_replace({of.sql}, {quoted(pattern)}, {quoted(by)}, 'g')")


def named(name: str) -> Dual:
    return Dual(lambda: F.col(name), name)


def both(text: str) -> Dual:
    """An expression that reads the same in both engines."""
    return Dual(lambda: F.expr(text), text)


def any_of(tests: list[Dual]) -> Dual:
    return Dual(lambda: reduce(lambda x, y: x | y, [t.column for t in tests]), "(" + " OR ".join(t.sql for t in tests) + ")")


def all_of(tests: list[Dual]) -> Dual:
    return Dual(lambda: reduce(lambda x, y: x & y, [t.column for t in tests]), "(" + " AND ".join(t.sql for t in tests) + ")")


def labels(rules: list[tuple[str, Dual]]) -> Dual:
    """The labels of the rules that hold, in order of the rules."""
    sql = "list_filter([" + ", ".join(f"CASE WHEN {t.sql} THEN {quoted(name)} END" for name, t in rules) + "], lambda x: x IS NOT NULL)"
    return Dual(lambda: F.array_compact(F.array(*[F.when(t.column, F.lit(name)) for name, t in rules])), sql)


def first_label(rules: list[tuple[str, Dual]]) -> Dual:
    """The label of the first rule that holds, else null."""
    sql = "CASE " + " ".join(f"WHEN {t.sql} THEN {quoted(name)}" for name, t in rules) + " END"
    return Dual(lambda: F.coalesce(*[F.when(t.column, F.lit(name)) for name, t in rules]), sql)
