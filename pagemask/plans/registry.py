"""All queries of the library's own operators, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from pagemask.plans import detect_queries, io_queries, scan_queries, search_queries, state_queries, transfer_queries  # noqa: F401  they fill the registry
from pagemask.plans.register import ORACLES, QUERIES


def flagship(spark, sf_dir: str):
    """Wildcard search with context over all pages, rolled up per file and term."""
    from pyspark.sql import functions as F

    from pagemask.functions.text import sentence_context
    from pagemask.operators.search import wildcard_matches
    from pagemask.sources.layout import Views

    v = Views(spark, sf_dir)
    hits = wildcard_matches(v.pages, v.terms).withColumn("context", sentence_context(F.col("text"), F.col("start"), F.col("stop")))
    return hits.groupBy("file_name", "term").agg(F.count("*").alias("n_hits"), F.sum(F.length("context")).alias("context_chars"))
