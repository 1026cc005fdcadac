"""Writing results: JSON and markdown reports, changed documents, move plans. Never over what was read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import doctree


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_changed(before: DataFrame, after: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Documents (path, content) whose content changed; written to ``path`` as Parquet unless dry."""
    changed = after.select("path", "content").join(before.select("path", F.col("content").alias("_old")), "path", "left").filter(~F.col("content").eqNullSafe(F.col("_old"))).drop("_old")
    if not dry_run:
        changed.write.mode("overwrite").parquet(path)
    return changed


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents (path, content) as files at their paths below ``path``, a folder or a URI; all of them or none."""
    doctree.write(docs.select("path", "content"), path if "://" in path else f"file://{os.path.abspath(path)}")


def link_markdown(results: DataFrame) -> DataFrame:
    """(path, section): a links report as markdown, a row per file that failed and one (path empty) at the head; in order of path they are the report."""
    count = lambda s: F.count_if(F.col("status") == s).cast("string")
    head = results.agg(
        F.lit("").alias("path"),
        F.concat(F.lit("# Link report\n\n- Total: "), F.count("*").cast("string"), F.lit("\n- Success: "), count("success"), F.lit("\n- Failure: "), count("failure"), F.lit("\n- Error: "), count("error"), F.lit("\n"), F.when(F.count_if(F.col("status") != "success") == 0, "\nAll links are valid.\n").otherwise("")).alias("section"),
    )
    bad = results.filter("status <> 'success'").select("path", "line", "href", F.concat(F.lit("- line "), "line", F.lit(": `"), "href", F.lit("`")).alias("row"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "href", "row"))), lambda x: x["row"]), "\n")
    files = bad.groupBy("path").agg(listed.alias("rows")).select("path", F.concat(F.lit("\n## "), "path", F.lit("\n\n"), "rows", F.lit("\n")).alias("section"))
    return head.unionByName(files)


def parse_summary(results: DataFrame) -> DataFrame:
    """total, valid, errors, failed of a check (path, status)."""
    valid = F.count_if(F.col("status") == "valid")
    return results.agg(F.count("*").alias("total"), valid.alias("valid"), (F.count("*") - valid).alias("errors"), F.coalesce(F.bool_or(F.col("status") != "valid"), F.lit(False)).alias("failed"))


def fallback_markdown(df: DataFrame) -> DataFrame:
    """Each row as fenced JSON."""
    return df.select(F.concat(F.lit("```json\n"), F.to_json(F.struct(*df.columns)), F.lit("\n```")).alias("report"))


def external_stub(title: str, url: str) -> str:
    """A page that stands for an external link in a menu."""
    return f'---\ntitle: "{title}"\nurl: "{url}"\n---\n'
