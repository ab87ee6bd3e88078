"""Searches of many terms against each term's pattern held against every page."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemask.functions.text import literal_pattern, match_list, wildcard_pattern
from pagemask.operators import search, sections
from tests.conftest import line_words

TEXTS = [
    "The patient's dose of ABC-123 was 5 mg/kg; C++ and c# (x) of the_study", "of  the of the OF the\tend of", "Straße STRASSE STRAẞE ſee see K k Å å", "ΟΔΟΣ οδος οδοσ Σ σ ς", "İstanbul istanbul ISTANBUL ıi Iı",
    "x² x ½x 2x_y foo_bar foo-bar foobar ‿a‿ a", "été ÉTÉ été eté naïve", "中文 文中文 的", "++ + (+) --- - *** a*b ab a\\b [a] {a} ^a$ a|b a.b a?b", "", "   ", "ﬁne fine ﬁ fi ŉ ʼn",
]
ODD = ["erin", "of the", "of", "the", "*", "**", "* *", "a*", "*a", "*a*", "a*b", "+", "++", "-", "C++", "(x)", "abc-1*", "abc-123", "c", "c#", "x", "x²", "2x_y", "foo*", "*bar", "foo-*", "of*the", "straße", "strasse", "ß", "ss", "see", "ſee", "k", "K", "å",
       "οδος", "*ς", "σ", "σ*", "istanbul", "İstanbul", "i", "ı", "I*", "été", "e", "é*", "文", "中*", "的", "---", "*-*", "fi", "ﬁ", "ŉ", "n", "a|b", "a.b", "a\\b", "[a]", "5 mg", "patient's", "s dose", "nothing", "of nothing", "zzz*", "mg/kg;", " ", "_*", "*_*", "½x", "x_y"]


def brute(pages, terms, pattern):
    t = terms.filter(F.col("active") & (F.trim("term") != "")).select("term", pattern.alias("p"))
    return sorted(pages.crossJoin(t).select("file_name", "page", "term", F.inline(match_list(F.col("text"), F.col("p")))).collect())


def random_terms(rng, texts, n):
    out = []
    for _ in range(n):
        t = rng.choice([x for x in texts if len(x) > 4])
        a = rng.randrange(len(t) - 1)
        piece = t[a : a + rng.randint(1, 12)]
        if rng.random() < 0.4:
            k = rng.randrange(len(piece) + 1)
            piece = piece[:k] + "*" + piece[k + rng.randint(0, 2) :]
        out.append(rng.choice([str.upper, str.lower, str])(piece))
    return out


@pytest.mark.parametrize("wildcard", [True, False])
def test_every_match_of_every_term(spark, wildcard):
    rng = random.Random(5)
    pages = spark.createDataFrame([(f"{i}.pdf", 1 + i % 3, t) for i, t in enumerate(TEXTS)], "file_name string, page int, text string")
    names = [*dict.fromkeys(ODD + random_terms(rng, TEXTS, 150))]
    terms = spark.createDataFrame([(t, i % 17 != 3) for i, t in enumerate(names)] + [("erin", False), ("", True)], "term string, active boolean")
    pattern = wildcard_pattern(F.col("term")) if wildcard else literal_pattern(F.col("term"))
    got = search._exploded(pages, search.active_terms(terms), pattern, wildcard).select("file_name", "page", "term", "start", "stop", "match")
    want = brute(pages, terms, pattern)
    have = sorted(got.collect())
    assert (set(want) - set(have), set(have) - set(want)) == (set(), set()) and have == want and len(want) > 300
    twice = spark.createDataFrame([("of", True), ("of", True), ("of*", True)], "term string, active boolean")
    assert search._exploded(pages, twice, pattern, wildcard).filter("term = 'of'").count() == 2 * len([r for r in brute(pages, twice.distinct(), pattern) if r.term == "of"])


def test_titles_by_many_terms(spark):
    rng = random.Random(6)
    toc = spark.createDataFrame([(f"{i}.pdf", k, 1, t, 1) for i, t in enumerate(TEXTS * 2) for k in range(2)], "file_name string, toc_index int, level int, title string, page int")
    names = ODD + random_terms(rng, TEXTS, 60)
    rng.shuffle(names)
    terms = spark.createDataFrame([(t, True, i) for i, t in enumerate(names)], "term string, active boolean, ord int")
    got = {(r.file_name, r.toc_index): r.term for r in sections.bookmark_terms(toc, terms).collect()}
    hit = F.when(F.contains("term", F.lit("*")), F.regexp_like("title", wildcard_pattern(F.col("term")))).otherwise(F.contains(F.lower("title"), F.lower("term")))
    want = toc.crossJoin(terms.filter(F.trim("term") != "")).filter(hit).groupBy("file_name", "toc_index").agg(F.min_by("term", "ord").alias("term")).collect()
    assert got == {(r.file_name, r.toc_index): r.term for r in want} and len(got) > 15
    first = sections.bookmark_terms(toc, terms, " FI")
    assert {r.term for r in first.filter(F.contains(F.lower("title"), F.lit(" fi"))).collect()} == {" FI"}


def test_ten_thousand_terms_meet_pages_by_equal_keys(spark):
    words = line_words(spark, [f"alpha beta{k} gamma, delta-{k % 7}" for k in range(40)])
    terms = spark.createDataFrame([(t, True, k) for k in range(5000) for t in (f"beta{k}", f"*a{k} gam*")], "term string, active boolean, ord int")
    found = search.search_terms(words, terms.filter("NOT contains(term, '*')"))
    wild = search.wildcard_matches(search.page_text(words), terms)
    # 'beta1' stands within 'beta10' and so on
    assert found.count() == sum(f"beta{k}" in f"beta{j}" for k in range(5000) for j in range(40)) and wild.count() == 80
    for df in (found, wild):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
