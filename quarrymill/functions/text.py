"""Text expressions: slugs, heading text, scalars, search terms. Both engines' forms stand side by side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dual import Dual, quoted, replaced
from .urls import lower



def trimmed(x: Dual) -> Dual:
    return replaced(x, r"^\s+|\s+$", "")


def kebab(x: Dual) -> Dual:
    """An anchor: lower case; what isn't an ASCII word character, white space or hyphen goes; runs become one hyphen."""
    y = replaced(replaced(lower(x), r"[^A-Za-z0-9_\s-]", ""), r"[-\s]+", "-")
    return replaced(y, "^-+|-+$", "")


def slug_nav(x: Dual) -> Dual:
    """A path segment: spaces become hyphens, everything but a-z, 0-9 and hyphens goes, one hyphen at each end is cut."""
    y = replaced(replaced(lower(trimmed(x)), r"\s+", "-"), "[^a-z0-9-]", "")
    return replaced(replaced(y, "-+", "-"), "^-|-$", "")


def slug_plain(x: Dual) -> Dual:
    """A file name: every run of other characters becomes one hyphen."""
    return replaced(replaced(lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def heading_text(x: Dual) -> Dual:
    """Visible text of a heading: zero-width characters go, blank lines too; equal lines are one, others are joined."""
    y = replaced(x, "[​-‍﻿]", "")
    spark = lambda: F.filter(F.transform(F.split(y.column, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    duck = f"list_filter(list_transform(string_split({y.sql}, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
    column = lambda: F.when(F.size(F.array_distinct(spark())) == 1, F.element_at(spark(), 1)).otherwise(F.array_join(spark(), " "))
    return Dual(column, f"CASE WHEN len(list_distinct({duck})) = 1 THEN ({duck})[1] ELSE coalesce(array_to_string({duck}, ' '), '') END")


def yaml_value(x: Dual) -> Dual:
    """A quoted scalar: double quotes, single ones if the text has double, else double with escapes."""
    def column() -> Column:
        c, double, single = x.column, F.lit('"'), F.lit("'")
        return (
            F.when(~F.contains(c, double), F.concat(double, c, double))
            .when(~F.contains(c, single), F.concat(single, c, single))
            .otherwise(F.concat(double, F.replace(c, double, F.lit('\\"')), double))
        )

    sql = f"""CASE WHEN NOT contains({x.sql}, '"') THEN '"' || {x.sql} || '"' WHEN NOT contains({x.sql}, '''') THEN '''' || {x.sql} || '''' ELSE '"' || replace({x.sql}, '"', '\\"') || '"' END"""
    return Dual(column, sql)


#: Names of languages as code fences give them, and as they are written.
LANGUAGES = {"js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "sh": "bash", "shell": "bash", "yml": "yaml", "md": "markdown", "cs": "csharp", "c++": "cpp", "golang": "go", "kt": "kotlin", "rs": "rust"}


def language(x: Dual) -> Dual:
    low = lower(x)
    pairs = lambda: F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in LANGUAGES.items())
    return Dual(lambda: F.coalesce(F.try_element_at(pairs(), low.column), low.column), f"CASE {low.sql} {cases} ELSE {low.sql} END")


def occurrences(of: Column, word: str) -> Column:
    """How often ``word`` occurs, not overlapping."""
    return ((F.length(of) - F.length(F.replace(of, F.lit(word), F.lit("")))) / len(word)).cast("long")


def occurrences_sql(of: str, word: str) -> str:
    return f"CAST((length({of}) - length(replace({of}, {quoted(word)}, ''))) // {len(word)} AS BIGINT)"


def human(x: Dual) -> Dual:
    """A label from a key: hyphens and underscores become spaces."""
    return replaced(x, "[-_]+", " ")


def utf16_key(x: Column) -> Column:
    """Bytes that sort as the text does by UTF-16 units: characters beyond the basic plane come before those from U+E000 on."""
    return F.encode(x, "UTF-16BE")


def utf16_units(x: str) -> str:
    """The same order in SQL: the text's UTF-16 units as numbers."""
    return f"list_transform(flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) >= 65536 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END)), lambda u: CAST(u AS INTEGER))"


def by_locale(x: Column) -> Column:
    """Text that compares by the root locale: accents after their letters, cases together."""
    return F.collate(x, "UNICODE")
