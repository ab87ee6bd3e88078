"""Lengths and hashes of prompts, without the prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemask.operators import detect as dt


def test_digests_are_those_of_the_prompts(spark, monkeypatch):
    texts = ["plain", "ünï\ncodé 𝄞", "", None]
    chunks = spark.createDataFrame([(f"f{i % 7}", 1 + 5 * (i // 7), 5 * (1 + i // 7), "Intro" if i % 2 else "", texts[i % 4]) for i in range(30)], "file_name string, start_page int, end_page int, section_title string, text string")
    contexts = spark.createDataFrame([(f"f{i}", "titlé" if i % 3 == 0 else None, "toc" if i % 2 else "", "") for i in range(6)], "file_name string, title_text string, toc_text string, outline string")
    library = spark.range(40).select(F.concat(F.lit("item é "), "id").alias("redacted_text"), F.lit("c").alias("context"))
    for most, group, known in ((200, 500, library), (200, 10**9, library), (10**6, 10**9, library), (200, 500, library.limit(0))):
        monkeypatch.setattr(dt, "GROUP_CHARS", group)
        want = dt.build_prompts(chunks, contexts, known, most=most).select("file_name", "start_page", "library_block", F.length("prompt").alias("n"), F.sha1("prompt").alias("digest"))
        got = dt.prompt_digests(chunks, contexts, known, most=most)
        assert got.schema.simpleString() == want.schema.simpleString()
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, want.collect())) and len(rows) == 30 * dt.library_blocks(known, most)[1]


def test_no_prompt_is_a_row(spark):
    chunks = spark.createDataFrame([("f", 1, 5, "", "text")], "file_name string, start_page int, end_page int, section_title string, text string")
    contexts = chunks.select("file_name", *[F.lit("").alias(c) for c in ("title_text", "toc_text", "outline")])
    library = spark.range(40).select(F.concat(F.lit("item "), "id").alias("redacted_text"))
    plan = dt.prompt_digests(chunks, contexts, library, most=200)._jdf.queryExecution().executedPlan().toString()
    assert "sha1" not in plan and "_salt" in plan and "Join" not in plan.split("MapInArrow")[0]
