"""Near copies against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pagemask.llm import near_copies, simhash
from tests.llm.test_operators import DATA, ODD, docs, empty, here


def brute_roots(texts):
    def grams(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or (a & b and 10 * len(a & b) >= 8 * len(a | b))]
    a, b = np.array(pairs or np.zeros((0, 2)), dtype=int).T
    return simhash._roots(len(texts), a, b)


def classes(ids, roots):
    out = {}
    for i, r in zip(ids, roots):
        out.setdefault(r, []).append(-1 if i is None else i)
    return sorted(sorted(x) for x in out.values())


@pytest.mark.parametrize("left, right", [(500, 2000), (3, 7)])
def test_near_copies(spark, left, right, monkeypatch):
    """Groups whose copies are linked to each other but not all to the first, and pairs on both sides of 0.8."""
    monkeypatch.setattr(near_copies, "LEFT", left)
    monkeypatch.setattr(near_copies, "RIGHT", right)
    rng = random.Random(11)
    rows = []
    for _ in range(6):
        t = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 150))]
        for _ in range(15):
            rows.append((len(rows) + 10, " ".join(t), None, None, 0))
            t = list(rng.choice([t, rows[-1][1].split(" ")]))
            for _ in range(rng.randint(1, 2)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(5000)}"
    rng.shuffle(rows)
    all_rows = rows + ODD
    roots = brute_roots([t or "" for _, t, *_ in all_rows])
    assert 10 < len(set(roots)) < 80
    d = docs(spark, all_rows)
    got = near_copies.near_copies(d).collect()
    assert classes([r.doc_id for r in got], [r.root for r in got]) == classes([i for i, *_ in all_rows], roots)
    kept = near_copies.without_near_copies(d)
    assert kept.count() == len(set(roots)) and kept.columns == d.columns
    assert near_copies.near_copies(empty(spark)).count() == 0


@here
def test_near_dedup_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in rows.collect()]
    first = {}
    for root, (i, _) in zip(brute_roots([t for _, t in texts]), texts):
        first[root] = min(first.get(root, i), i)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, DATA).collect()) == sorted(first.values())


def passage_texts(n: int, seed: int = 5) -> list[str]:
    """n texts that share a passage of 120 words and have 40 to 60 words of their own; every tenth text has a near copy."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(120)]
    texts = []
    for k in range(n):
        own = [f"o{rng.randrange(10**9)}" for _ in range(rng.randint(40, 60))]
        texts.append(own[:20] + passage + own[20:])
        if k % 10 == 0:
            t = list(texts[-1])
            t[5] = "changed"
            texts.append(t)
    return [" ".join(t) for t in texts]


def test_a_shared_passage_costs_no_more_than_its_texts(spark):
    """The rows that are verified follow the number of texts, not its square; the classes are those of brute force."""
    made = {}
    for n in (150, 300):
        texts = passage_texts(n)
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        seen = []
        real = near_copies._verified
        near_copies._verified = lambda rows, sets, least: (seen.append(rows.count()), real(rows, sets, least))[1]
        try:
            got = near_copies.near_copies(d).collect()
        finally:
            near_copies._verified = real
        made[n] = sum(seen)
        if n == 150:
            assert classes([r.doc_id for r in got], [r.root for r in got]) == classes(range(len(texts)), brute_roots(texts))
        else:  # each text with a copy, and no other
            assert len({r.root for r in got}) == n
    assert made[300] < 3 * made[150]


@pytest.mark.parametrize("left, right", [(3, 7)])
def test_mixtures_of_common_lines(spark, left, right, monkeypatch):
    """Texts whose rarest shingles are shared, too: many groups that are linked or nearly so."""
    monkeypatch.setattr(near_copies, "LEFT", left)
    monkeypatch.setattr(near_copies, "RIGHT", right)
    rng = random.Random(8)
    lines = [" ".join(f"l{rng.randrange(400)}" for _ in range(14)) for _ in range(14)]
    texts = ["\n".join(rng.sample(lines, rng.choice([9, 10, 11, 12]))) for _ in range(120)]
    texts += ["\n".join([*lines[:10], x]) for x in lines[10:]] + ["\n".join(lines[:10])]
    got = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = classes(range(len(texts)), brute_roots(texts))
    assert classes([r.doc_id for r in got], [r.root for r in got]) == want and 20 < len(want) < len(texts)


def test_rare_shingles_meet_every_pair(spark):
    """All pairs at 0.8 share a shingle of both prefixes."""
    rng = np.random.default_rng(3)
    base = [rng.choice(10**6, size=rng.integers(1, 60), replace=False) for _ in range(12)]
    sets = [np.unique(np.r_[rng.choice(b, max(1, len(b) - k), replace=False), np.arange(30)[: 3 * k]]) for b in base for k in range(5)]
    frame = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "node long, set array<long>")
    by = {}
    for r in near_copies.rare_shingles(frame.select("node"), frame, 0.8).collect():
        by.setdefault(r.bucket, set()).add(r.node)
    met = {(a, b) for ns in by.values() for a in ns for b in ns if a < b}
    near = {(a, b) for b in range(len(sets)) for a in range(b) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))}
    assert near and near <= met
