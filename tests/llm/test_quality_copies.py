"""Quality rules where a host holds many near copies of one text."""

from __future__ import annotations

import random

import corpus_pipeline
from pagemask.llm import quality
from tests.llm.test_operators import DATA, SCHEMA


def test_near_copies_do_not_reject_each_other(spark):
    rng = random.Random(6)
    line = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(8))
    text = [line() for _ in range(14)]
    rows = []
    for i in range(120):  # each copy has another line changed, or two
        copy = list(text)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(14)] = line()
        rows.append((i, "\n".join(copy), None, "h", 0))
    notice = ["all rights of this page are kept by us", "write to us for the terms of any use"]
    rows += [(200 + i, "\n".join([*notice, line(), line(), line()]), None, "h", 0) for i in range(40)]
    rows += [(300 + i, "\n".join([*notice, *notice[:1] * 3, f"page {i}"]), None, "h", 0) for i in range(10)]
    d = spark.createDataFrame(rows, SCHEMA)
    j = {r.doc_id: r for r in quality.quality_rules(d, merge_copies=True).collect()}
    assert all(j[i].kept and not j[i].removed_lines for i in range(120))
    assert all(j[200 + i].kept and j[200 + i].removed_lines == [0, 1] for i in range(40))
    assert not any(j[300 + i].kept for i in range(10))
    kept = corpus_pipeline.quality(spark, d, DATA)
    assert {r.doc_id for r in kept.collect()} == {*range(120), *range(200, 240)}
    assert len([r for r in quality.quality_rules(d).collect() if r.kept and r.doc_id < 120]) < 120
