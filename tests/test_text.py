from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemask.functions import similarity as sim
from pagemask.functions import text as tx
from pagemask.operators import doses
from pagemask.operators.search import active_terms, group_occurrences, merge_rects, merge_rects_prev, wildcard_matches


def context(text, start, end, least=80, radius=300):
    """Brute force of the sentence rule."""
    low = max(0, start - radius)
    cuts = [text[low:start].rfind(b) for b in tx.BREAKS]
    a = low + max(cuts) + 2 if max(cuts) >= 0 else max(0, start - least)
    ahead = [i for i in (text[end : end + radius].find(b) for b in tx.BREAKS) if i >= 0]
    z = end + min(ahead) + 1 if ahead else min(len(text), end + least)
    lack = max(0, least - (z - a))
    return text[max(0, a - lack // 2) : min(len(text), z + lack - lack // 2)].strip()


def test_sentence_context(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        t = "".join(rng.choice("abcd    .?!;") for _ in range(rng.randint(1, 700)))
        s = rng.randrange(len(t))
        rows.append((t, s, min(len(t), s + rng.randint(1, 9))))
    df = spark.createDataFrame(rows, "t string, s int, e int").select("t", "s", "e", tx.sentence_context(F.col("t"), F.col("s"), F.col("e")).alias("c"))
    for r in df.collect():
        assert r.c == context(r.t, r.s, r.e).strip(" ")


def test_wildcards(spark):
    pages = spark.createDataFrame([("a.pdf", 1, "Abcde abc xabc été C++ (x) acb aXXb")], "file_name string, page int, text string")
    terms = spark.createDataFrame([("abc*", True), ("*", True), ("a*b", True), (" ", True), ("été", True), ("xabc", False)], "term string, active boolean")
    got = {(r.term, r.match, r.start) for r in wildcard_matches(pages, terms).collect()}
    text = pages.first().text
    want = set()
    for t in ("abc*", "*", "a*b", "été"):
        p = r"\b" + r"\w*".join(map(re.escape, t.split("*"))) + r"\b"
        want |= {(t, m[0], m.start()) for m in re.finditer(p, text, re.I) if m[0]}
    assert got == want
    assert active_terms(terms).count() == 4


@pytest.mark.parametrize(("spec", "pages", "error"), [("1-3,7", [1, 2, 3, 7], None), (" 2 , 2", [2], None), ("3-1", None, "descending range"), ("a", None, "not a page number"), ("11", None, "out of range"), ("", None, "empty")])
def test_page_spec(spark, spec, pages, error):
    r = spark.createDataFrame([(spec,)], "s string").select(tx.parse_page_spec(F.col("s"), F.lit(10)).alias("p")).first().p
    assert (r.pages, r.error) == (pages, error)


@pytest.mark.parametrize(("token", "hit"), [("100mg", True), ("50-100mg/kg", True), ("1,000.5mL", True), ("5", False), ("mg", False), ("10µg", True), ("12xmg", False)])
def test_combined_dose(spark, token, hit):
    assert spark.createDataFrame([(token,)], "t string").select(doses.is_combined_dose(F.col("t"))).first()[0] is hit


def test_merge_rules(spark):
    rows = [("f", 1, "k", float(x0), float(y0), float(x1), y0 + 10.0) for x0, y0, x1 in [(0, 0, 10), (20, 0, 30), (40.01, 0, 50), (52, 4.99, 60), (0, 40, 10), (12, 45, 20)]]
    hits = spark.createDataFrame(rows, "file_name string, page int, key string, x0 double, y0 double, x1 double, y1 double")
    a = sorted((r.x0, r.y0, r.x1) for r in merge_rects(hits).collect())
    assert a == [(0.0, 0.0, 30.0), (0.0, 40.0, 10.0), (12.0, 45.0, 20.0), (40.01, 0.0, 60.0)]
    assert merge_rects_prev(hits).count() == 6
    assert {r.occurrence for r in group_occurrences(hits).collect()} == {1, 2}


def test_similarity():
    rng = random.Random(2)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert sim.lcs(a, b) == brute(a, b)
    assert sim.token_set("a b", "b a c") == 100.0 and sim.indel("", "") == 100.0 and sim.partial("bc", "abcd") == 100.0
    assert sim.cell("a b c d", "a b c e") == 0.875 and sim.cell("", "x") == 0.0
