"""Cells are matched page by page: no pair of a reference and a cell is a row, and the best cell is that of all pairs."""

from __future__ import annotations

import random

from pagemask.functions.similarity import Cells, cell
from pagemask.operators import transfer as tr
from tests.test_tables_by_page import grid

WEIGHTS = (5.0, 1.0, 1.0, 1.0, 1.0)


def brute(refs, cells, least, full):
    out = {}
    for r, ref in enumerate(refs):
        scores = []
        for c in cells:
            total = 5.0 * cell(ref[0], c[0])
            for x, y in zip(ref[1:], c[1:]):
                total += cell(x, y)
            scores.append(total)
        first = next((c for c, s in enumerate(scores) if s >= full), None)
        best = max(range(len(cells)), key=lambda c: (scores[c], -c))
        c = first if first is not None else best
        if scores[c] >= least:
            out[r] = c, scores[c]
    return out


def test_best_cells_are_those_of_all_pairs(monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab1 2É") for _ in range(rng.randint(0, 6)))
    row = lambda: tuple(rng.choice([word(), "17", "1997-01-17", "a b 1 2", ""]) for _ in range(5))
    for at_once in (1, 200_000):
        monkeypatch.setattr(Cells, "AT_ONCE", at_once)
        for _ in range(30):
            cells = [row() for _ in range(25)]
            refs = [row() for _ in range(10)] + [(*c[:3], *row()[3:]) for c in cells[:5]]
            for least, full in ((3.5, 8.0), (3.5, 6.0)):
                got = {r: (c, s) for r, c, _, s in Cells(WEIGHTS, least, full).best(refs, cells)}
                assert got == brute(refs, cells, least, full)


def test_pairs_are_no_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = grid(spark, 5)
        boxes = spark.createDataFrame([(f"b{r}", "f", 1, 65.0, 15.0 + 14 * r, 20.0, 9.0) for r in range(3)], "id string, file_name string, page int, x double, y double, w double, h double")
        found = tr.match_cells(tr.containing_cell(boxes, cells), cells)
        assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.id: (r.page, r.table_idx, r.row_idx, r.col_idx) for r in found.collect()} == {f"b{k}": (1, 0, k + 1, 1) for k in range(3)}
        content = tr.match_cell_content(boxes.selectExpr("id", "file_name", "page", "concat('t1 r', substr(id, 2), ' c2') AS text"), cells)
        assert {r.id: (r.page, r.table_idx, r.row_idx, r.col_idx) for r in content.collect()} == {f"b{k}": (1, 1, k, 2) for k in range(3)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
