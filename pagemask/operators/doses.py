"""Dose statements in page words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.functions.geometry import rect
from pagemask.functions.text import clean_token, let
from pagemask.sources.layout import PAGE, READING

# Units, number forms, structural references and clinical keywords.
UNITS = ["mg", "g", "kg", "ng", "mcg", "ug", "µg", "mL", "ml", "L", "l", "IU", "iu", "mmol", "mEq", "meq"]
AMOUNT = r"(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:[.,][0-9]+)?"
PER = r"(?:/[A-Za-zµ^0-9]+)?"
STRUCTURAL = [
    r"\bpage\s+\d", r"\bp\.\s*\d", r"\bsection\s+\d", r"\btable\s+\d", r"\bfigure\s+\d", r"\bfig\.\s*\d", r"\bappendix\s+\d",
    r"\bchapter\s+\d", r"\bversion\s+\d", r"\bv\d+\.\d+", r"\bitem\s+\d", r"\bline\s+\d", r"\bref\.\s*\d", r"\breference\s+\d",
]
KEYWORDS = [
    "dose", "doses", "dosing", "dosage", "administered", "administer", "administration", "received", "receive", "receives", "given",
    "give", "gives", "inject", "injected", "injection", "infuse", "infused", "infusion", "oral", "orally", "intravenous", "iv",
    "subcutaneous", "sc", "im", "daily", "weekly", "monthly", "twice", "once", "bid", "tid", "qid", "mg/kg", "mg/m2", "units/kg",
    "tablet", "tablets", "capsule", "capsules", "treatment", "therapy", "regimen", "patient", "patients", "subject", "subjects",
    "concentration", "plasma", "serum", "blood",
]

_RANGE = rf"{AMOUNT}(?:\s*[-–]\s*{AMOUNT})?"
_UNIT = "(?:" + "|".join(UNITS) + ")"


def is_combined_dose(c: Column) -> Column:
    """One token such as 100mg or 50-100mg/kg."""
    return F.regexp_like(c, F.lit(f"^{_RANGE}{_UNIT}{PER}$"))


def is_amount(c: Column) -> Column:
    return F.regexp_like(c, F.lit(f"^{_RANGE}$"))


def is_unit(c: Column) -> Column:
    return F.regexp_like(c, F.lit(f"^{_UNIT}{PER}$"))


def not_structural(context: Column) -> Column:
    """False where the context names a page, table, section or the like by number."""
    return ~F.regexp_like(context, F.lit("(?iU)" + "|".join(STRUCTURAL)))


def has_dose_keyword(context: Column) -> Column:
    """Whether any keyword occurs in the context, also within words. The context is made and lowered once, not for each keyword; a keyword that holds another one is found by that."""
    least = [k for k in KEYWORDS if not any(o != k and o in k for o in KEYWORDS)]
    return let(F.lower(context), lambda c: F.exists(F.array(*[F.lit(k) for k in least]), lambda k: F.contains(c, k)))


def dose_matches(words: DataFrame, n: int = 8) -> DataFrame:
    """A row per dose: the first word's row with match, span (1 or 2 tokens), after (the next word's place) and context: n raw tokens before
    and after the match.

    A unit can't begin a match, so matches never overlap and a look at the next word is enough. One shuffle, by page.
    """
    if n < 0:
        raise ValueError("the context can't be negative")
    page = W.partitionBy(*PAGE).orderBy(*READING)
    w = words.withColumn("clean", clean_token(F.col("text")))
    w = w.withColumns({"next": F.lead("clean").over(page), "after": F.lead(F.struct("block_no", "line_no", "x0", "y0", "x1", "y1")).over(page)})
    around = F.collect_list("text").over(page.rowsBetween(-n, n + 1))
    place = F.row_number().over(page)
    span = F.when(is_combined_dose(F.col("clean")), 1).when(is_amount(F.col("clean")) & is_unit(F.col("next")), 2)
    w = w.withColumns({"around": around, "place": place, "span": span}).filter("span IS NOT NULL")
    before = F.least(F.lit(n), F.col("place") - 1)
    context = F.array_join(F.slice("around", 1, before + F.col("span") + n), " ")
    return w.withColumns({"match": F.when(F.col("span") == 1, F.col("clean")).otherwise(F.concat_ws(" ", "clean", "next")), "context": context}).drop("around", "next", "clean")


def dose_rects(matches: DataFrame) -> DataFrame:
    """matches with rects: one rectangle for each visual line that a match touches."""
    own, after = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col("after")[c] for c in ("x0", "y0", "x1", "y1")]
    one_line = (F.col("block_no") == F.col("after")["block_no"]) & (F.col("line_no") == F.col("after")["line_no"])
    both = rect(*[F.least(a, b) for a, b in zip(own[:2], after[:2])], *[F.greatest(a, b) for a, b in zip(own[2:], after[2:])])
    rects = F.when(F.col("span") == 1, F.array(rect(*own))).when(one_line, F.array(both)).otherwise(F.array(rect(*own), rect(*after)))
    return matches.withColumn("rects", rects).drop("after")


def scan_doses(words: DataFrame, context_words: int = 8, smart: bool = True, require_keyword: bool = False) -> DataFrame:
    """Result rows of all doses: file_name, page, match, term, category, context, rects."""
    m = dose_matches(words, context_words)
    if smart:
        m = m.filter(not_structural(F.col("context")))
    if require_keyword:
        m = m.filter(has_dose_keyword(F.col("context")))
    return dose_rects(m).select(*PAGE, "match", F.lit("CCI:dosing").alias("term"), F.lit("dosage").alias("category"), "context", "rects")
