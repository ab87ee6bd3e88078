"""Queries against their SQL on the smallest tables: some headline ones; all of them with PAGEMASK_ALL=1."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

DATA = "/root/testdata/sf0.001"
HEAD = ["s3_page_text", "t2_wildcard", "t3_search_terms", "t10_merge_rects", "d8_scan_doses", "g4_gap_scan", "r2_mark_redacted", "r8_stream_boxes", "a3_section_range", "a12_parse_detections", "m13_match_tables", "m15_anchors", "s7_read_project"]
SQL = {n: s for n, s in entry.oracle_sql().items() if not n.startswith(("op", "pipeline"))}


@pytest.mark.skipif(not Path(DATA).exists(), reason="sample tables aren't there")
@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("PAGEMASK_ALL") else HEAD)
def test_query(spark, name):
    compare(spark, DATA, entry.queries()[name], SQL[name])


@pytest.mark.skipif(not Path(DATA).exists(), reason="sample tables aren't there")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["file_name", "term", "n_hits", "context_chars"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
