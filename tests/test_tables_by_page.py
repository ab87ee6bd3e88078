"""Cells that are dealt by page stay where they are: plans of the table operators, and their results on odd grids."""

from __future__ import annotations

import re

from pagemask.operators import transfer as tr
from pagemask.sources.layout import store_by_page

SCHEMA = "file_name string, page int, table_idx int, row_idx int, col_idx int, x0 double, y0 double, x1 double, y1 double, text string"


def grid(spark, rows, gap=()):
    """Two tables of a page, of 3 columns; without the places of gap."""
    return spark.createDataFrame([("f", p, t, r, c, 60.0 * c, 14.0 * r + 400 * t, 60.0 * c + 60, 14.0 * r + 14 + 400 * t, f"t{t} r{r} c{c}") for p in (1, 2) for t in (0, 1) for r in range(rows) for c in range(3) if (r, c) not in gap], SCHEMA)


def exchanges(df):
    return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_stored_cells_are_not_shuffled(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = store_by_page(grid(spark, 5), f"file://{tmp_path}/cells")
        boxes = store_by_page(spark.createDataFrame([("b", "f", 1, 65.0, 15.0, 20.0, 9.0)], "id string, file_name string, page int, x double, y double, w double, h double"), f"file://{tmp_path}/boxes")
        assert exchanges(tr.table_fingerprint(cells)) == 0
        assert exchanges(tr.containing_cell(boxes, cells)) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_shuffle_of_other_cells(spark):
    assert exchanges(tr.table_fingerprint(grid(spark, 5))) == 1


def test_gaps_have_no_neighbours(spark):
    got = {(r.page, r.table_idx, r.row_idx, r.col_idx): r for r in tr._neighbours(grid(spark, 3, {(1, 1)})).collect()}
    assert got[1, 0, 0, 1].down is None and got[1, 0, 2, 1].up is None and got[1, 0, 1, 0].right is None and got[1, 0, 1, 2].left is None
    assert got[1, 1, 0, 0].left is None and got[1, 1, 0, 0].right == "t1 r0 c1" and got[1, 1, 0, 2].right is None and got[2, 0, 1, 0].down == "t0 r2 c0" and got[1, 0, 2, 0].down is None


def test_key_cells_that_the_target_lacks_count_as_unlike(spark):
    whole, less = grid(spark, 4), grid(spark, 4).filter("row_idx < 2")
    score = {(r.s_page, r.s_table): r.score for r in tr.match_tables(whole, less, pages=0).collect()}
    # two of five key cells have a place, and those have half or all of their neighbours
    assert len(score) == 4 and all(0.40 <= s < 0.95 for s in score.values())
    assert all(round(r.score, 6) == 1.0 for r in tr.match_tables(whole, whole, pages=0).collect())


def test_reconstruct_reads_offsets_of_the_references(spark):
    cells = grid(spark, 3)
    boxes = spark.createDataFrame([("b", "f", 1, 65.0, 15.0, 20.0, 9.0)], "id string, file_name string, page int, x double, y double, w double, h double")
    refs = tr.containing_cell(boxes, cells)
    moved = tr._neighbours(cells.selectExpr("file_name", "page", "table_idx", "row_idx", "col_idx", "x0 + 5 AS x0", "y0 + 3 AS y0", "x1 + 5 AS x1", "y1 + 3 AS y1", "text"))
    found = moved.filter("page = 1 AND table_idx = 0 AND row_idx = 1 AND col_idx = 1").selectExpr("'b' AS id", "*")
    r = tr.reconstruct(found, refs).first()
    assert (r.x, r.y, r.w, r.h) == (70.0, 18.0, 20.0, 9.0)
