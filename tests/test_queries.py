"""Registered queries against DuckDB on the smallest tables, by the driver's rules: rows, columns, values in any order."""

import math
import os

import duckdb
import pytest

from quarrymill import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Some of each kind; QUARRYMILL_ALL=1 runs them all.
SOME = "page_features_core page_callout_variants page_platform_format page_api_score page_is_doc page_url_normalized page_url_parts page_nondoc_flag site_summary external_domains_topk tag_topk_per_page migration_complexity review_pages link_edges crawl_reachable meta_tags katex_errors broken_images resume_antijoin resume_merge batch_numbers doc_search_filtered doc_lookup_multi text_slugs text_headings mdx_headings mdx_link_validation mdx_fuzzy_heading heading_match_by_ordinal fix_redirects fix_h1 nav_paths nav_promotions walk_links broken_link_report session_cookies sitemap_urls link_report_markdown changed_documents consecutive_groups shape_topk_per_group shape_batches detected_specs api_endpoints_by_path embedded_specs search_table_function get_table_function list_table_function docs_tree_round_trip fix_anchor_content edits_applied link_headers site_link_headers nav_json_round_trip nav_json_moved component_samples_by_page component_samples names_by_utf16 sidebar_links fix_redirects_moved import_targets image_targets page_categories external_link_texts meta_values katex_summary fix_totals content_component_totals page_component_lists api_tool_pages api_tried_pages api_type_counts spec_urls crawl_totals selector_match_rates compatibility_rows migration_readiness site_structure scoping_report_text".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()) if os.environ.get("QUARRYMILL_ALL") else SOME)
def test_equal(spark, duck, name):
    made = registry.queries()[name](spark, DATA)
    columns = sorted(made.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(plain(v) for v in r) for r in want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False, name=None))


def test_names_without_session():
    """Names and SQL can be had before there is a session."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0
