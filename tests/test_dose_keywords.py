from __future__ import annotations

from pyspark.sql import functions as F

from pagemask.operators.doses import KEYWORDS, has_dose_keyword


def test_the_context_is_made_once_for_all_keywords(spark):
    rows = spark.createDataFrame([(["Give", "it", "DAILY"],), (["nothing", "here"],), (["", None],), (None,)], "around array<string>").repartition(2)
    context = rows.withColumn("context", F.array_join("around", " "))
    found = context.select("context", has_dose_keyword(F.col("context")).alias("hit"))
    # within the test of a keyword stands what was computed before, not how the context is made
    plan = found.select("hit")._jdf.queryExecution().optimizedPlan().toString()
    tested = plan[plan.lower().index("contains(") :]
    assert "lower(" not in tested and "array_join(" not in tested, plan
    assert {r.context: r.hit for r in found.collect()} == {"Give it DAILY": True, "nothing here": False, "": False, None: None}


def test_every_keyword_is_found_within_words(spark):
    rows = spark.createDataFrame([(f"x{k.upper()}y",) for k in KEYWORDS] + [("nn zz",)], "context string")
    got = {r.context: r.hit for r in rows.select("context", has_dose_keyword(F.col("context")).alias("hit")).collect()}
    assert got == {c: c != "nn zz" for c in got} and len(got) == len(KEYWORDS) + 1
