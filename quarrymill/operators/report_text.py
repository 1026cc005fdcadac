"""The scoping report as text: sections of conditional lines over one row of judged facts. A section without lines isn't told.

Every condition and line is an expression that reads the same in both engines; lists are as short as what they are made of (kinds, or the first of a ranking).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .site_report import ATTENTION, FACTORS, S

RULE, EDGE = "-" * 43, "=" * 43
#: Rows of a ranking that the text shows.
DOMAINS = 15


def some(label: str, n: str, after: str = "") -> tuple[str, str]:
    """A line with a number, left out where it is 0."""
    return f"{n} > 0", f"'  {label}: ' || {S(n)}" + (f" || '{after}'" if after else "")


def joined(parts: list[tuple[str, str, str]]) -> str:
    """Texts (when, before, number) of those that hold, by commas."""
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {n} > 0 THEN '{before}' || {S(n)} || '{after}' END" for before, n, after in parts) + ")"


TWICE = lambda x: S(f"CAST({x} AS DOUBLE)")
PERCENT = lambda x: S(f"CAST(floor({x} * 100 + 0.5) AS INT)")
VARIANTS = joined([(f"{v.capitalize()} (", f"callout_{v}", ")") for v in ("note", "warning", "tip", "info", "danger", "check")])
_impact = lambda n, w, high, medium: "'LOW'" if high is None else f"CASE WHEN {w} * {n} > {high} THEN 'HIGH' WHEN {w} * {n} > {medium} THEN 'MEDIUM' ELSE 'LOW' END"
#: The report's sections and lines in order. ``{words}`` stands for the words with their thousands set apart.
SECTIONS: list[tuple[str, list[tuple[str, str]]]] = [
    ("POINTS OF ATTENTION", [(f"{n} > 0", f"'  [{k.upper()}] ' || {d}") for k, n, d in ATTENTION]),
    ("EMBEDDED VIDEOS", [("video_list <> ''", "'  ' || replace(video_list, ', ', chr(10) || '  ')")]),
    ("API DOCUMENTATION", [("TRUE", "CASE WHEN api_ref_kinds > 0 THEN '  ' || replace(api_ref_list, '; ', chr(10) || '  ') ELSE '  No API documentation detected' END")]),
    ("PLATFORM COMPONENTS", [
        ("callout_total > 0", f"'  Callouts: ' || {S('callout_total')} || ' — ' || {VARIANTS}"), some("Tabs", "tab_components", " → Tabs"), some("Code Groups", "code_groups", " → CodeGroup"), some("Accordions", "accordion_components", " → Accordion / AccordionGroup"),
        some("Cards", "cards", " → Card / CardGroup"), some("Steps", "steps", " → Steps / Step"), some("Definitions", "definitions", " → ResponseField / ParamField"), some("Embeds", "embeds", " → Frame"),
    ]),
    ("CONTENT SELECTOR", [
        ("match_rate IS NOT NULL", f"'  Match rate: ' || {PERCENT('match_rate')} || '% (' || {S('CAST(floor(match_rate * total_pages + 0.5) AS BIGINT)')} || '/' || {S('total_pages')} || ' pages)'"),
        ("match_rate < 0.8", "'  ⚠ Low match rate — content selector may need adjustment'"),
    ]),
    ("CUSTOM WEB COMPONENTS", [("custom_lines <> ''", "custom_lines")]),
    ("SPECIAL CONTENT", [
        some("Third-party embeds", "embeds"), ("embed_list <> ''", "'    - ' || replace(embed_list, ', ', chr(10) || '    - ')"), some("Math content (MathJax/KaTeX)", "math", " elements"),
        some("Diagrams (Mermaid/PlantUML/etc.)", "diagrams", " elements"), some("Code playgrounds", "code_playgrounds"), some("API reference pages", "api_reference_pages"),
    ]),
    ("CONTENT COMPLEXITY", [
        ("TRUE", "'  Total words: ' || {words}"), ("TRUE", f"'  Code blocks: ' || {S('code_blocks')}"), ("TRUE", f"'  Tables: ' || {S('tables')}"), ("TRUE", f"'  Images: ' || {S('images')}"),
        ("h1 + h2 + h3 + h4 + h5 + h6 > 0", f"'  Headings: ' || {joined([(f'H{i}: ', f'h{i}', '') for i in range(1, 7)])}"),
        ("ordered_lists + unordered_lists > 0", f"'  Lists: ' || {joined([('Ordered: ', 'ordered_lists', ''), ('Unordered: ', 'unordered_lists', '')])}"),
    ]),
    ("INTERACTIVE ELEMENTS", [some("Tabs", "tabs"), some("Accordions", "accordions"), some("Tooltips", "tooltips"), ("downloads > 0", f"'  Download links: ' || {S('downloads')} || ' — ' || download_list"), some("Forms", "forms"), some("Non-video iframes", "iframes")]),
    ("API & PLAYGROUND", [some("OpenAPI/Swagger specs", "spec_links"), some("API playgrounds", "api_playgrounds"), some("GraphQL explorers", "graphql_explorers")]),
    ("SITE STRUCTURE", [("avg_breadcrumb > 0", f"'  Avg breadcrumb depth: ' || {S('avg_breadcrumb')}"), ("has_pagination", "'  Pagination: detected'"), ("has_language_switcher", "'  Multi-language: detected'")]),
    ("MIGRATION ASSESSMENT", [
        ("TRUE", f"'  Complexity score: ' || {S('score')} || '/100 (' || level || ')'"), ("TRUE", f"'  Readiness score: ' || {S('readiness')} || '/100'"), ("TRUE", f"'  Supported components: ' || {TWICE('supported_share')} || '%'"),
        ("TRUE", f"'  Custom work required: ' || {TWICE('custom_share')} || '%'"), ("TRUE", f"'  Clean pages (no special components): ' || {S('clean_pages')}"), ("TRUE", f"'  Complex pages (3+ component types): ' || {S('complex_pages')}"),
        ("score > 0", "'  Complexity factors:'"), *[(f"{n} > 0", f"'    [' || {_impact(n, w, high, medium)} || '] {name}: ' || {S(n)} || ' {words}'") for name, n, w, high, medium, words in FACTORS],
    ]),
    ("TOP EXTERNAL LINK DOMAINS", [("domain_lines <> ''", "domain_lines")]),
]
#: How DuckDB sets thousands apart.
WORDS_SQL = "format('{:,}', word_count)"
HEAD = [f"'{EDGE}'", "'  PROJECT SCOPING REPORT'", f"'{EDGE}'", "''", f"'Total pages: ' || {S('total_pages')}", f"'Sites analyzed: ' || {S('sites')}", "''"]


def lines_of(frame: DataFrame, text: Column, order: Column, out: str) -> DataFrame:
    """One row: the texts of a short ranking, a line each."""
    return frame.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "\n").alias(out))


def written(judged: DataFrame, custom: DataFrame, domains: DataFrame, sites: DataFrame) -> DataFrame:
    """(text): the report of judged facts, custom components (name, total), ranked domains (domain, links, rank), and the sites (one row for each)."""
    row = judged.crossJoin(lines_of(custom, F.concat(F.lit("  <"), "name", F.lit(">: "), F.col("total").cast("string"), F.lit(" instances")), F.struct(-F.col("total"), "name"), "custom_lines"))  # one row by one row
    first = domains.filter(F.col("rank") <= DOMAINS)
    row = row.crossJoin(lines_of(first, F.concat(F.lit("  "), "domain", F.lit(": "), F.col("links").cast("string"), F.lit(" links")), F.col("rank"), "domain_lines")).crossJoin(sites.agg(F.count("*").alias("sites")))
    parts = [F.array(*[F.expr(x) for x in HEAD])]
    for title, lines in SECTIONS:
        told = F.array_compact(F.array(*[F.when(F.expr(when), F.expr(x.replace("{words}", "format_number(word_count, 0)"))) for when, x in lines]))
        parts.append(F.when(F.size(told) > 0, F.concat(F.array(F.lit(RULE), F.lit(title), F.lit(RULE)), told, F.array(F.lit("")))).otherwise(F.array().cast("array<string>")))
    return row.select(F.array_join(F.concat(*parts, F.array(F.lit(EDGE))), "\n").alias("text"))


def written_sql(row: str) -> str:
    """The same of a SQL table expression of one row with ``custom_lines``, ``domain_lines`` and ``sites``."""
    parts = [f"[{', '.join(HEAD)}]"]
    for title, lines in SECTIONS:
        told = "list_filter([" + ", ".join(f"CASE WHEN {when} THEN {x.replace('{words}', WORDS_SQL)} END" for when, x in lines) + "], lambda x: x IS NOT NULL)"
        parts.append(f"CASE WHEN len({told}) > 0 THEN list_concat(list_concat(['{RULE}', '{title}', '{RULE}'], {told}), ['']) ELSE CAST([] AS VARCHAR[]) END")
    return f"SELECT array_to_string(flatten([{', '.join(parts)}, ['{EDGE}']]), chr(10)) AS text FROM {row}"
