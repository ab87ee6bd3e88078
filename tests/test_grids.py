"""Tables are matched as one row a page: no pair of cells is a row, and scores are those of all pairs."""

from __future__ import annotations

import random

import pytest

from pagemask.functions.grids import by_table, look_up, table_scores
from pagemask.functions.similarity import cell, indel
from pagemask.operators import transfer as tr
from pagemask.plans.detect_queries import cells, dest_cells, tables
from pagemask.sources.layout import Views
from tests.test_tables_by_page import SCHEMA

STEP = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}


def odd_grid(seed, page, sizes):
    """Tables of several sizes with gaps, missing texts and words that are nearly alike."""
    rng = random.Random(seed)
    words = ["alpha beta gamma", "alpha beta gamma delta", "12345", "112345", "1234", "54321", "  alpha ", "ALPHA", "É", "", None, "a b", "1997-01-17", "1997-01-18", "xalphabet"]
    rows = []
    for t, (n, m) in enumerate(sizes):
        rows += [("f", page, t, r, c, 60.0 * c, 14.0 * r, 60.0 * c + 60, 14.0 * r + 14, rng.choice(words)) for r in range(n) for c in range(m) if rng.random() < 0.9]
    return rows


def keyed(rows):
    out = {}
    for _, page, t, r, c, *_, text in rows:
        out.setdefault((page, t), {})[r, c] = text
    return out


def brute(source, target, pages):
    out = {}
    for (s_page, s_table), s in keyed(source).items():
        rows, cols = max(r for r, _ in s) + 1, max(c for _, c in s) + 1
        keys = [k for k in s if (k[0] in (0, rows - 1) and k[1] in (0, cols - 1)) or k == (rows // 2, cols // 2)]
        for (page, table), t in keyed(target).items():
            if abs(page - s_page) > pages:
                continue
            total = 0.0
            for k in keys:
                if k in t:
                    there = good = 0
                    for dr, dc in STEP.values():
                        a, b = (g.get((k[0] + dr, k[1] + dc)) for g in (s, t))
                        if a is not None and b is not None:
                            there, good = there + 1, good + (cell(a, b) > 0.85)
                    total += 0.5 * (cell(s[k] or "", t[k] or "") > 0.85) + 0.5 * (good / there if there else 0.0)
            heads = []
            for k in s:
                if k[0] == 0 and k in t:
                    a, b = (s[k] or "").strip(" "), (t[k] or "").strip(" ")
                    heads.append(1.0 if a == b == "" else 0.0 if not a or not b else indel(a, b) / 100)
            near = lambda i, n: max(0.0, 1 - abs(max(k[i] for k in t) + 1 - n) / 5)
            out[s_page, s_table, page, table] = tuple(round(x, 9) for x in ((near(0, rows) + near(1, cols)) / 2, sum(heads) / len(heads) if heads else 1.0, total / len(keys) if keys else 0.0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_are_those_of_all_pairs(spark, seed):
    source = [r for p in (1, 2, 4) for r in odd_grid(seed + p, p, [(5, 4), (9, 9), (1, 1), (12, 3)])]
    target = [r for p in (1, 3, 5) for r in odd_grid(seed + 1 + p % 2, p, [(5, 4), (9, 9), (2, 2), (11, 3)])]
    got = table_scores(spark.createDataFrame(source, SCHEMA), spark.createDataFrame(target, SCHEMA), 2).collect()
    assert {(r.s_page, r.s_table, r.page, r.table_idx): (round(r.structure, 9), round(r.headers, 9), round(r.adjacency, 9)) for r in got} == brute(source, target, 2)


def test_cells_of_tables_are_no_rows(spark):
    """Neither the pairs of cells nor a call for each text."""
    frame = spark.createDataFrame(odd_grid(3, 1, [(5, 4)]), SCHEMA)
    plan = tr.match_tables(frame, frame)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "inline" not in plan


def test_repeated_cells_meet_all_of_their_place(spark):
    one = [("f", 1, 0, r, c, 0.0, 0.0, 1.0, 1.0, f"{r} {c}") for r in range(2) for c in range(2)]
    other = [*one, ("f", 1, 0, 0, 0, 0.0, 0.0, 1.0, 1.0, "else"), ("f", 1, None, 0, 0, 0.0, 0.0, 1.0, 1.0, "0 0")]
    got = {r.table_idx: r for r in table_scores(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(other, SCHEMA), 0).collect()}
    # five heads: two of place (0, 0), one of them with another text
    assert set(got) == {0, None} and round(got[0].headers, 6) == round((2 + indel("0 0", "else") / 100) / 3, 6) and got[0].adjacency < 1.0


@pytest.mark.parametrize("moved", [False, True])
def test_tables_hold_the_cells(spark, moved):
    v = Views(spark, "/root/testdata/sf0.001")
    own = dest_cells(v) if moved else cells(v)
    at = ["file_name", "page", "table_idx", "row_idx", "col_idx", "x0", "y0", "x1", "y1", "text"]
    opened = tables(v, moved).selectExpr("file_name", "page", "table_idx", "inline(cells)").select(*at)
    assert own.select(*at).exceptAll(opened).count() == 0 and opened.count() == own.count()
    assert by_table(own).count() == tables(v, moved).count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_ordered_in_rows(spark):
    """No window over cells or references, on either side: a page's cells are one row."""
    frame = spark.createDataFrame(odd_grid(3, 1, [(5, 4)]), SCHEMA)
    boxes = spark.createDataFrame([("b", "f", 1, 0, 65.0, 15.0, 20.0, 9.0, "12345")], "id string, file_name string, page int, table_idx int, x double, y double, w double, h double, text string")
    matches = spark.createDataFrame([("f", 1, 0, 1, 0)], "file_name string, s_page int, s_table int, page int, table_idx int")
    refs = tr.containing_cell(boxes, frame)
    for made in (refs, tr.anchor_cells(frame, frame, matches), tr.match_cell_content(boxes, frame), look_up(boxes.selectExpr("id", "file_name", "page", "table_idx AS t", "1 AS r", "1 AS c"), frame, ("t", "r", "c"))):
        assert "Window" not in plan_of(made)
    assert plan_of(tr.match_cells(refs, frame)).count("Window [") == 1  # the best of several pages


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_anchors_are_those_of_all_key_cells(spark, seed):
    sizes = [(5, 4), (9, 9), (1, 1), (2, 3)]
    source, target = odd_grid(seed, 1, sizes), odd_grid(seed, 2, sizes) if seed == 1 else odd_grid(seed + 7, 2, sizes[1:])
    target = [(*r[:5], r[5] + 3.0, *r[6:9], r[9].upper() if r[9] else r[9]) for r in target]
    pairs = [("f", 1, t, 2, u) for t, u in ((0, 0), (1, 1), (2, 2), (3, 0), (0, 2), (7, 0), (1, 7))]
    s, t = keyed(source), keyed(target)
    plain = lambda x: x.strip(" ").lower()
    want = {}
    for _, _, st, _, tt in pairs:
        a, b = s.get((1, st), {}), t.get((2, tt), {})
        if not a:
            continue
        rows, cols = max(r for r, _ in a) + 1, max(c for _, c in a) + 1
        for k in a:
            if k in b and ((k[0] in (0, rows - 1) and k[1] in (0, cols - 1)) or k == (rows // 2, cols // 2)):
                n = 2 * (plain(a[k] or "") == plain(b[k] or ""))
                for d, e in STEP.values():
                    x, y = (g.get((k[0] + d, k[1] + e)) for g in (a, b))
                    n += bool(x is not None and y and plain(x) == plain(y))
                if n >= 2:
                    want[st] = max(want.get(st, (0, 0, 0)), (n, -k[0], -k[1]))
    matches = spark.createDataFrame(pairs, "file_name string, s_page int, s_table int, page int, table_idx int")
    got = {r.s_table: (r.anchor, r.dx) for r in tr.anchor_cells(spark.createDataFrame(source, SCHEMA), spark.createDataFrame(target, SCHEMA), matches).collect()}
    assert got == {st: (n, 3.0) for st, (n, *_) in want.items()} and (got or seed > 1)


def test_the_first_alike_cell_of_a_page(spark):
    grid = odd_grid(5, 1, [(6, 4), (6, 4)])
    texts = [w for *_, w in odd_grid(6, 1, [(6, 4)])]
    boxes = spark.createDataFrame([(f"b{i}", "f", 1, w) for i, w in enumerate(texts)], "id string, file_name string, page int, text string")
    want = {}
    for i, w in enumerate(texts):
        for f, p, t, r, c, *_, x in sorted(grid, key=lambda g: g[1:5]):
            if cell(w or "", x or "") >= 0.85:
                want[f"b{i}"] = (p, t, r, c)
                break
    got = {r.id: (r.page, r.table_idx, r.row_idx, r.col_idx) for r in tr.match_cell_content(boxes, spark.createDataFrame(grid, SCHEMA), pages=0).collect()}
    assert got == want and 5 < len(want)
