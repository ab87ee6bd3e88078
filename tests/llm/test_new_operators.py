"""Periodic runs, document fingerprints and whitening against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemask.llm import near_copies, periodic_runs, sketches, whitening
from pagemask.llm.queries import QUERIES
from tests.llm.test_operators import DATA, ODD, docs, empty, here

# ---- periodic runs


def brute_runs(w: list, least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """start, length and period of all runs, by following each period through the text."""
    out, n = [], len(w)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, repeats * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_collapsed(w: list[str], runs) -> str:
    gone = {k for start, size, q in runs for k in range(start + q, start + size)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("least, repeats", [(6, 4), (4, 2), (1, 2), (10, 3)])
def test_runs_of_random_words(least, repeats):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.choice([0, 1, 3, 8, 20, 60, 200]), rng.choice([1, 2, 3, 5])
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 8 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            texts.append(w)
        got = periodic_runs.runs_of(np.array([x for t in texts for x in t], np.int64), np.cumsum([0] + [len(t) for t in texts]), least, repeats)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t, least, repeats)]


def test_runs_that_meet_classes_of_many_positions():
    # classes of which the smaller one has positions on both sides of the larger one's
    w = [2] * 6 + [0, 1] * 9 + [2] * 7 + [0, 1] * 5 + [0]
    got = periodic_runs.runs_of(np.array(w), np.array([0, len(w)]), 1, 2)
    assert [tuple(r[1:]) for r in got.tolist()] == brute_runs(w, 1, 2)
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.array(w), np.array([0, len(w)]), 6, 1)


def test_periodic_runs_on_odd_rows(spark):
    rows = [*ODD, (8, "a b a b a b a b a b\tc", None, None, 0), (9, " x\x1cy  x\x1cy\nx\x1cy x\x1cy x\x1cy x\x1cy ", None, None, 0)]
    got = periodic_runs.periodic_runs(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.collapsed) for r in got) == Counter((i, len(split(t)), brute_collapsed(split(t), brute_runs(split(t)) if len(split(t)) < 100 else [(0, 30_000, 1)])) for i, t, *_ in rows)
    assert [tuple(x) for r in got if r.doc_id == 4 for x in r.runs] == [(0, 30_000, 1)]
    assert periodic_runs.periodic_runs(empty(spark)).collect() == []


@here
def test_op11(spark):
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        w = split(r.text)
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        runs = brute_runs(w) if n < 3000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r.doc_id] = (len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert len(got) == 200 and len(want) > 150 and {i: got[i] for i in want} == want
    assert sum(x[0] > 0 for x in want.values()) > 10


# ---- document fingerprints


def test_sketches_merge_and_estimate():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    whole, part = " ".join(words), " ".join(words[1000:2500])
    a, b = sketches.sketch(whole), sketches.sketch(part)
    true = near_copies.shingles(whole)
    assert set(a) == {h for h in true if h < 1 << 61} and abs(len(a) * 8 / len(true) - 1) < 0.15
    assert len(np.intersect1d(a, b)) >= 0.99 * len(b)  # all of the part is in the whole, though it is four times as long
    assert abs(sketches.likeness_of(a, b) - 0.25) < 0.05
    short = sketches.sketch("one two")
    assert len(short) == 1 and len(sketches.sketch(" \t")) == 0 and sketches.likeness_of(short, sketches.sketch("ONE  two")) == 1
    assert sketches.likeness_of(sketches.sketch(""), short) == 0 and sketches.likeness_of(sketches.sketch(""), sketches.sketch(" ")) == 1


def test_merged_sketches_are_those_of_the_whole(spark):
    rng = random.Random(4)
    texts = {g: [" ".join(f"{g}{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 30, 400]))) for _ in range(8)] for g in "abc"} | {"tiny": ["one two", "three", ""], "none": ["", None]}
    rows = [(i, t, None, g, 0) for i, (g, t) in enumerate((g, t) for g, ts in texts.items() for t in ts)]
    d = docs(spark, rows)
    its = sketches.fingerprints(d).join(d.select("doc_id", "source"), "doc_id")
    got = {r.source: list(np.array(r.sketch, np.int64).view(np.uint64)) for r in sketches.merged(its, ["source"]).collect()}
    for g, ts in texts.items():
        every = np.unique(np.concatenate([near_copies.shingles(t or "") for t in ts]))
        low = [h for h in every if h < 1 << 61]
        assert got[g] == (low or list(every[:1]))
    both = sketches.fingerprints(spark.createDataFrame([(1, texts["a"][0] + " x y z"), (2, "")], "doc_id long, text string")).alias("l")
    r = both.select(sketches.containment(F.col("sketch"), F.col("sketch")).alias("c"), sketches.likeness(F.col("sketch"), F.col("sketch")).alias("j")).collect()
    assert [tuple(x) for x in r] == [(1.0, 1.0), (None, 1.0)]


def brute_next(rows) -> list[tuple]:
    """doc_id, edited text, near_edited and near_next of rows (id, text) with different ids."""
    order = sorted(((i, t or "") for i, t in rows if i is not None), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, hashlib.sha256(edited.encode()).hexdigest(), sketches.likeness_of(sketches.sketch(t), sketches.sketch(edited)), sketches.likeness_of(sketches.sketch(t), sketches.sketch(after))))
    return out


@pytest.mark.parametrize("n, rows", [(1, 5), (2, 1), (60, 7), (60, 100)])
def test_every_document_meets_the_next(spark, n, rows):
    rng = random.Random(n)
    d = [(rng.choice([-1, 1]) * k * k, " ".join(rng.choices(["été", "x", "中", "word", "\U0001f600"], k=rng.randint(0, 40))) if k % 9 else None, None, None, 0) for k in range(1, n + 1)]
    got = sketches.with_next(docs(spark, d).repartition(5), range_rows=rows).collect()
    assert sorted((r.doc_id, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(brute_next((i, t) for i, t, *_ in d))
    assert {r.doc_id: r.n_chars for r in got} == {i: len(t or "") for i, t, *_ in d}


def test_fingerprints_on_odd_rows(spark):
    d = docs(spark)
    got = sketches.with_next(d, range_rows=2).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t, *_ in ODD)
    (null,) = [r for r in got if r.doc_id is None]
    text = next(t for i, t, *_ in ODD if i is None)
    assert null.near_next is None and null.edited_sha256 == hashlib.sha256(text[: len(text) - len(text) // 2].encode()).hexdigest()
    # rows of one id follow each other; the two equal ones are their own likeness
    assert sorted(r.near_next for r in got if r.doc_id == 5)[-1] == 1.0
    assert sketches.with_next(empty(spark)).collect() == [] and sketches.fingerprints(empty(spark)).collect() == []
    only = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert [r.near_next for r in sketches.with_next(only).collect()] == [None, None]


@here
def test_op12(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_fingerprints"](spark, DATA).collect()}
    assert sorted((r.doc_id, r.edited_sha256, r.near_edited, r.near_next) for r in got.values()) == sorted(brute_next(rows))
    by_text: dict = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for r in got.values() if r.n_chars > 2000]
    assert all(len(r.fingerprint) % 16 == 0 and 0 <= r.near_next <= 1 for r in got.values()) and np.mean([r.near_edited > r.near_next for r in long]) > 0.9


# ---- whitening


def brute_whitened(rows, components: int, counts: bool = False):
    """vec_id, component, n, deviation, explained, whitened (up to its sign) of rows (vec_id, entries)."""
    good = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in good] if counts else sorted({x for _, x in good})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    y = np.array([[c * n - s for c, s in zip(x, sums)] for x in fit], dtype=np.float64) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in good:
        d = [c * n - s for c, s in zip(x, sums)]
        for k in range(min(components, int((e > 1e-12 * e[0]).sum()))):
            out.append((i, k + 1, n, sum(c * c for c in d), e[k] / e.sum(), float(np.array(d, np.float64) @ u[:, k]) / n / math.sqrt(e[k])))
    return out


def same_whitening(got, want):
    """Compares rows of (vec_id, component, n, deviation, explained, whitened), each component up to its sign."""
    key = lambda r: (r[0], r[1], round(abs(r[5]), 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    g, w, at = np.array([r[5] for r in got]), np.array([r[5] for r in want]), np.array([r[1] for r in got])
    assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=1e-9)
    for k in set(at.tolist()):
        assert np.allclose(g[at == k], w[at == k], atol=1e-8) or np.allclose(g[at == k], -w[at == k], atol=1e-8)


def listed(frame):
    return [(r.vec_id, k + 1, r.n, r.deviation, r.explained[k], w) for r in frame.collect() for k, w in enumerate(r.whitened)]


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_by_brute_force(spark, weights):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 7)) * np.arange(7, 0, -1)
    rows = [(int(i), [float(c) for c in base[i % 60]]) for i in range(100)] + [(200 + i, [float(c) for c in base[3]]) for i in range(80)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("rows", F.lit("clash")).repartition(6)
    got = whitening.whitened(d, 5, weights)
    same_whitening(listed(got), brute_whitened(rows, 5, weights == "counts"))
    assert got.first().identity_error < 1e-9


def test_whitening_on_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (None, [3.0, 1.0, 0.5]), (2, [0.0, -1.0, 9.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 0.0, 0.0]), (7, []), (8, [1e30, 0.0, 0.0]), (9, [1.0, 2.0])]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = listed(whitening.whitened(frame(rows)))
    assert Counter(r[0] for r in got) == {1: 4, None: 2, 2: 2}  # three distinct vectors have two components
    same_whitening([(r[0] or 0, *r[1:]) for r in got], [(r[0] or 0, *r[1:]) for r in brute_whitened(rows[:4], 16)])
    (one, two) = whitening.whitened(frame([(1, v), (2, v)])).collect()
    assert one.whitened == two.whitened == [] and one.n == 1 and one.deviation == 0 and one.identity_error is None
    assert whitening.whitened(frame([])).collect() == [] and whitening.whitened(frame([(1, None)])).collect() == []
    with pytest.raises(ValueError):
        whitening.whitened(frame(rows), weights="some")


def test_exact_deviations_leave_64_bits():
    n, x = 3_000_000_019, np.array([[1_000_040, 1_000_000], [999_000, 1_000_001]])
    centre = whitening.Centre(n, [1_000_001 * n + 17, 1_000_000 * n + n - 1])
    exact = [sum((int(a) * n - s) ** 2 for a, s in zip(row, centre.sums)) for row in x]
    assert centre.deviations(x) == [e if e < 1 << 63 else None for e in exact] == [None, None]
    small = whitening.Centre(1000, [1_000_001 * 1000 + 17, 999_999_999])
    assert small.deviations(x) == [sum((int(a) * 1000 - s) ** 2 for a, s in zip(row, small.sums)) for row in x]


@here
def test_op13(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = QUERIES["op13_whitening"](spark, DATA).collect()
    same_whitening([(r.vec_id, r.component, r.n, r.deviation, r.explained, r.whitened) for r in got], brute_whitened(rows, 16))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
