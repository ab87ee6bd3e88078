"""Boxes are suppressed page by page without a call for each page."""

from __future__ import annotations

import random

from pagemask.operators import transfer

SCHEMA = "id string, file_name string, page int, seq long, x double, y double, w double, h double"


def brute(boxes):
    """The greedy order, box by box."""
    kept = []
    for b in sorted(boxes, key=lambda b: (b[1], b[2], b[3], b[0])):
        x, y, w, h = b[4:]
        cut = [max(0, min(x + w, k[4] + k[6]) - max(x, k[4])) * max(0, min(y + h, k[5] + k[7]) - max(y, k[5])) for k in kept if k[1:3] == b[1:3]]
        if not (w * h > 0 and any(c >= 0.5 * w * h for c in cut)):
            kept.append(b)
    return {b[0] for b in kept}


def test_few_and_many_boxes_of_a_page(spark):
    r = random.Random(7)
    sizes = {("a", 1): 3, ("a", 2): 64, ("b", 1): 65, ("b", 2): 300, ("c", 1): 1}
    boxes = [(f"{f}{p}#{k}", f, p, k // 2, float(r.randrange(120)), float(r.randrange(120)), float(r.randrange(0, 40)), float(r.randrange(0, 20))) for (f, p), n in sizes.items() for k in range(n)]
    got = transfer.suppress_overlaps(spark.createDataFrame(boxes, SCHEMA), spark.createDataFrame([], SCHEMA))
    assert got.columns == ["id", "file_name", "page", "seq", "x", "y", "w", "h"]
    assert {x.id for x in got.collect()} == brute(boxes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
