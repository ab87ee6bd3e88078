"""The pipeline's near-dedup goes through the trie join of SimHash fingerprints; an exact check follows."""

from __future__ import annotations

import random

import corpus_pipeline
from pagemask.llm import near_copies


def copies(n: int = 6) -> list[tuple[int, str]]:
    """Texts of 3,000 words, each with a copy that differs in one of them."""
    rng = random.Random(3)
    rows = []
    for k in range(n):
        t = [f"w{rng.randrange(9000)}" for _ in range(3000)]
        rows += [(10 * k, " ".join(t)), (10 * k + 1, " ".join([*t[:1500], "changed", *t[1501:]]))]
    return rows


def test_fingerprints_alone_lead_to_copies(spark, monkeypatch):
    rows = copies()
    d = spark.createDataFrame([*rows, (900, ""), (901, None), (902, "quite another")], "doc_id long, text string")
    monkeypatch.setattr(near_copies, "buckets", lambda sh: [])
    assert near_copies.without_near_copies(d).count() == len(rows) + 2
    kept = sorted(r.doc_id for r in near_copies.without_near_copies(d, errors=3).collect())
    assert kept == [10 * k for k in range(len(rows) // 2)] + [900, 902]


def test_stage_joins_the_tries(spark, monkeypatch):
    seen = []
    real = near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda nodes, errors: (seen.append(errors), real(nodes, errors))[1])
    d = spark.createDataFrame(copies(3), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect()) == [0, 10, 20] and seen == [3]
