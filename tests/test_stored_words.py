"""Words that are stored by page meet boxes, hits and texts without a shuffle of the words."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagemask.operators import gaps, search, transfer
from pagemask.sources.layout import page_text, sample_boxes, store_by_page, word_offsets
from tests.conftest import line_words


def exchanged(df) -> bool:
    """Whether stored words are shuffled or broadcast: above a scan of theirs an exchange comes before any join, group or window."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    above: list[tuple[int, str]] = []
    for x in lines:
        above = [a for a in above if a[0] < depth(x)]
        if "FileScan" in x and "by_page_" in x and re.search(r"\bx0#|\bword_no#|\bline_no#", x):
            first = next((step for _, step in reversed(above) if re.search("Exchange|Join|Aggregate|Window", step)), "")
            if "Exchange" in first:
                return True
        above.append((depth(x), x))
    return False


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    texts = [" ".join(f"Word{(i * 7 + k) % 23} internationally" for k in range(30)) for i in range(20)]
    w = line_words(spark, texts)
    path = tmp_path_factory.mktemp("stored")
    words = store_by_page(w, f"file://{path}/words", 8)
    boxes = store_by_page(sample_boxes(words), f"file://{path}/boxes", 8)
    return w, words, boxes


def test_a_bucket_is_one_file(stored):
    w, words, boxes = stored
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, w.collect())) and boxes.count() > 50
    assert words.select(F.input_file_name().alias("f")).distinct().count() <= 8
    assert words.schema == w.schema or [f.dataType for f in words.schema] == [f.dataType for f in w.schema]


def test_plans_without_a_shuffle_of_the_words(spark, stored):
    _, words, boxes = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = words.filter("word_no = 1").select("file_name", "page", F.col("text").alias("probe"), "x0", "y0", "x1", "y1")
        terms = spark.createDataFrame([("word3", True), ("word5 inter", True)], "term string, active boolean")
        texts = search.text_under_boxes(boxes, words)
        plans = {
            "g1": texts, "g5": gaps.is_covered(hits, boxes), "g6": gaps.gap_context(hits.withColumnRenamed("probe", "match_text"), words), "t6": search.rect_offsets(boxes, words),
            "offsets": word_offsets(words), "pages": page_text(words), "m3": transfer.split_by_lines(boxes, words), "m5": transfer.text_coverage(boxes, words), "m4": transfer.box_text_context(boxes, words),
            "t3": search.search_terms(words, terms, dehyphenate=False),
        }
        for name, df in plans.items():
            df.collect()
            assert not exchanged(df), name
        other = words.select("x0", "text").join(words.groupBy("text").count(), "text")
        other.collect()
        assert exchanged(other)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
