"""Lines are dealt by page before they become words: no shuffle of words follows."""

from __future__ import annotations

from pagemask.sources.layout import page_text, word_offsets, words_from_text


def shuffled_as_lines(df) -> bool:
    """Whether the only shuffle lies below the cut into words."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate posexplode(filter(split(") < plan.index("Exchange hashpartitioning")


def docs(spark):
    return spark.createDataFrame([(i, "one two ntst\nthree four\n" * 7) for i in range(5)], "doc_id long, text string")


def test_words_are_not_shuffled(spark):
    words = words_from_text(docs(spark))
    assert shuffled_as_lines(words)
    assert shuffled_as_lines(page_text(words))
    assert shuffled_as_lines(word_offsets(words))


def test_words_stay_the_same(spark):
    rows = words_from_text(docs(spark)).filter("file_name = 'doc_1.pdf' AND page = 3").orderBy("block_no", "line_no", "word_no").collect()
    assert [(r.block_no, r.word_no, r.x0, r.y0, r.text) for r in rows][:4] == [(0, 0, 72.0, 72.0, "one"), (0, 1, 96.0, 72.0, "two"), (0, 2, 120.0, 72.0, "ntst"), (1, 0, 72.0, 84.0, "three")]
