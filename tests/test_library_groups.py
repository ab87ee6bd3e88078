"""A chunk is shuffled once for a group of library blocks, not once for each block."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemask.operators import detect as dt


def _tables(spark):
    chunks = spark.range(40).select(F.concat(F.lit("f"), "id").alias("file_name"), F.lit(1).alias("start_page"), F.lit(5).alias("end_page"), F.lit("").alias("section_title"), F.col("id").cast("string").alias("text"))
    contexts = chunks.select("file_name", *[F.lit("").alias(c) for c in ("title_text", "toc_text", "outline")])
    library = spark.range(60).select(F.concat(F.lit("item "), "id").alias("redacted_text"), F.lit("c").alias("context"), F.lit("k").alias("category"), F.lit("j").alias("justification"))
    return chunks, contexts, library


def test_chunks_are_shuffled_once_a_group(spark, monkeypatch):
    chunks, contexts, library = _tables(spark)
    blocks, n = dt.library_blocks(library, 500)
    assert n > 5
    monkeypatch.setattr(dt, "GROUP_CHARS", 1_000)
    plan = dt._with_library(chunks, library, 500)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_group" in plan and "hashpartitioning(library_block" not in plan
    text = {r.block: r.library for r in blocks.collect()}
    for per in (1, 1_000, 10**9):
        monkeypatch.setattr(dt, "GROUP_CHARS", per)
        rows = dt.build_prompts(chunks, contexts, library, most=500).collect()
        assert sorted((r.file_name, r.library_block) for r in rows) == sorted((f"f{i}", b) for i in range(40) for b in range(n))
        assert all("Known items:\n" + text[r.library_block] in r.prompt for r in rows if r.library_block in text)
