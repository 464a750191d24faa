"""Registered queries against their SQL at the smallest scale. BRIEFLOOM_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, check

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("text_units", "points_packed", "head_tail", "segment_offsets", "offset_verify", "node_paths", "finding_summary", "time_share",
          "allocate_blocks", "page_pack", "page_coalesce", "plan_slides", "navigation_pages", "paragraphs_joined", "caption_nearest",
          "bind_layouts", "hit_test", "lasso", "latest_values", "split_blocks", "merge_blocks", "containment", "rule_pick",
          "stream_latest", "stream_undo_redo", "script_export")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = tuple(QUERIES) if os.environ.get("BRIEFLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_check_names_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    message, _, good = check(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert good, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
