"""Samples of components found on pages, summed up for each kind with a bounded state.

Counts combine before they are shuffled. The smallest urls are ranked where they lie first, so at most ``URLS`` of each kind
leave a task, and no list of all samples is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Urls that a kind shows.
URLS = 10
#: An opening tag with its attributes; its class and id.
TAG, CLASS, ID = r"<([a-z][a-z0-9-]*)((?:\s[^<>]*)?)>", r'\sclass="\s*([^"\s]+)', r'\sid="([^"\s]+)"'


def found(pages: DataFrame) -> DataFrame:
    """(url, type, hint, high, page_id, pos): each opening tag of pages (page_id, url, html). The hint is its id, else first class, else tag; it is sure if it has either."""
    each = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("pos", "_tag"))
    own, css = F.regexp_extract("_tag", ID, 1), F.regexp_extract("_tag", CLASS, 1)
    kind = F.regexp_extract("_tag", TAG, 1)
    hint = F.when(own != "", F.concat(F.lit("#"), own)).when(css != "", F.concat(F.lit("."), css)).otherwise(kind)
    return each.select("url", kind.alias("type"), hint.alias("hint"), ((own != "") | (css != "")).alias("high"), "page_id", "pos")


def by_page(samples: DataFrame) -> DataFrame:
    """(type, url, n, high, hint) of samples (url, type, hint, high, page_id, pos): the first hint by id or class, else the first at all."""
    first = lambda when: F.min(F.when(when, F.struct("page_id", "pos", "hint")))["hint"]
    best = F.coalesce(first(F.col("hint").rlike("^[.#]")), first(F.col("hint").isNotNull()))
    return samples.groupBy("type", "url").agg(F.count("*").alias("n"), F.count_if("high").alias("high"), best.alias("hint"))


def by_type(pages: DataFrame) -> DataFrame:
    """(type, total, high, low, pages, page_urls) of ``by_page``: sums, and the ``URLS`` smallest urls in order."""
    sums = pages.groupBy("type").agg(F.sum("n").alias("total"), F.sum("high").alias("high"), F.sum(F.col("n") - F.col("high")).alias("low"), F.count("*").alias("pages"))
    least = pages.select("type", "url").withColumn("_rank", F.row_number().over(W.partitionBy("type").orderBy("url"))).filter(F.col("_rank") <= URLS)
    urls = least.groupBy("type").agg(F.array_sort(F.collect_list("url")).alias("page_urls"))
    return sums.join(urls, "type").select("type", "total", "high", "low", "pages", "page_urls")
