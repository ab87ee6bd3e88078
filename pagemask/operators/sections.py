"""Bookmarks, sections and page chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.functions.text import escape, wildcard_pattern
from pagemask.operators.term_index import candidates


def section_title(pages: DataFrame, toc: DataFrame, level1: bool = True) -> DataFrame:
    """pages (file_name, page) with section_title: the last entry, in list order, before the first one that lies behind the page.

    Exact for lists whose pages aren't sorted: an entry counts while no entry up to it has a later page.
    """
    t = toc.filter("level = 1") if level1 else toc
    high = F.max("page").over(W.partitionBy("file_name").orderBy("toc_index").rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("_high", high).select(F.col("file_name").alias("_f"), "toc_index", "title", "_high")
    joined = pages.join(t, (F.col("file_name") == F.col("_f")) & (F.col("_high") <= F.col("page")), "left")
    return joined.groupBy("file_name", "page").agg(F.coalesce(F.max_by("title", "toc_index"), F.lit("")).alias("section_title"))


def sections(toc: DataFrame, files: DataFrame) -> DataFrame:
    """file_name, start_page, end_page, title of the level-1 bookmarks' sections; an untitled one before the first; the whole file where there are none."""
    w = W.partitionBy("file_name").orderBy("page", "toc_index")
    t = toc.filter("level = 1").join(files.select("file_name", "total_pages"), "file_name")
    t = t.withColumns({"next": F.lead("page").over(w), "n": F.row_number().over(w)})
    own = t.select("file_name", F.col("page").alias("start_page"), F.greatest(F.col("page"), F.coalesce(F.col("next") - 1, "total_pages")).alias("end_page"), "title")
    lead = t.filter("n = 1 AND page > 1").select("file_name", F.lit(1).alias("start_page"), (F.col("page") - 1).alias("end_page"), F.lit("").alias("title"))
    rest = files.join(toc.filter("level = 1").select("file_name").distinct(), "file_name", "left_anti").select("file_name", F.lit(1).alias("start_page"), F.col("total_pages").alias("end_page"), F.lit("").alias("title"))
    return own.unionByName(lead).unionByName(rest)


def section_range(pages: DataFrame, toc: DataFrame, files: DataFrame) -> DataFrame:
    """pages with start_page, end_page and title of their section, by an as-of look at the sorted level-1 bookmarks."""
    b = toc.filter("level = 1").select("file_name", "page", "title", F.lit(True).alias("mark"), "toc_index")
    p = pages.select("file_name", "page", F.lit(None).cast("string").alias("title"), F.lit(False).alias("mark"), F.lit(None).cast("int").alias("toc_index")).distinct()
    order = [F.col("page"), F.col("mark").desc(), F.col("toc_index")]
    back = W.partitionBy("file_name").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("file_name").orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    here = F.when(F.col("mark"), F.struct(F.col("page").alias("start"), "title"))
    u = b.unionByName(p).withColumns({"at": F.last(here, True).over(back), "next": F.first(F.when(F.col("mark"), F.col("page")), True).over(ahead)}).filter(~F.col("mark"))
    u = u.join(files.select("file_name", "total_pages"), "file_name")
    return u.select("file_name", "page", F.coalesce("at.start", F.lit(1)).alias("start_page"), F.coalesce(F.col("next") - 1, "total_pages").alias("end_page"), F.coalesce("at.title", F.lit("")).alias("section_title"))


def section_chunk(ranged: DataFrame, size: int = 5) -> DataFrame:
    """Rows of section_range with chunk_start and chunk_end: cuts of `size` pages from the section's start; short sections whole."""
    length = F.col("end_page") - F.col("start_page") + 1
    k = F.floor((F.col("page") - F.col("start_page")) / size).cast("int")
    start = F.when(length <= size, F.col("start_page")).otherwise(F.col("start_page") + size * k)
    return ranged.withColumns({"chunk_start": start, "chunk_end": F.when(length <= size, F.col("end_page")).otherwise(F.least("end_page", start + size - 1))})


def chunk_pages(pages: DataFrame, size: int = 5) -> DataFrame:
    """file_name, start_page, end_page, text: `size` pages each, every page followed by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(ordered, lambda p: F.concat(p["text"], F.lit("\n\n"))), "")
    k = F.floor((F.col("page") - 1) / size).cast("int")
    return pages.groupBy("file_name", (k * size + 1).alias("start_page")).agg(F.max("page").alias("end_page"), text.alias("text"))


def document_context(pages: DataFrame, toc: DataFrame, files: DataFrame) -> DataFrame:
    """file_name, title_text (pages 1 and 2), toc_text (the rest of the front matter) and outline of the bookmarks.

    The front matter ends before the first level-1 bookmark, at page 8 or the last; without bookmarks at page 5. Files without front text are left out.
    """
    first = toc.filter("level = 1").groupBy("file_name").agg(F.min("page").alias("first"))
    cut = files.select("file_name", "total_pages").join(first, "file_name", "left")
    cut = cut.select("file_name", F.greatest(F.lit(1), F.least(F.coalesce(F.col("first") - 1, F.lit(5)), "total_pages", F.lit(8))).alias("cut"))
    p = pages.join(cut, "file_name").filter("page <= cut")
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))

    def joined(keep):
        return F.array_join(F.transform(F.filter(ordered, keep), lambda x: x["text"]), "\n\n")

    front = p.groupBy("file_name").agg(joined(lambda x: x["page"] <= 2).alias("title_text"), joined(lambda x: x["page"] > 2).alias("toc_text"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "title", F.lit(" (p."), F.col("page").cast("string"), F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct("toc_index", line.alias("line"))))
    outline = toc.groupBy("file_name").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("outline"))
    return front.filter("title_text <> '' OR toc_text <> ''").join(outline, "file_name", "left").withColumn("outline", F.coalesce("outline", F.lit("")))


def bookmark_ranges(toc: DataFrame, files: DataFrame) -> DataFrame:
    """toc with end_page: the page before the next entry of any level, never before its own; the last page for the last."""
    t = toc.join(files.select("file_name", "total_pages"), "file_name")
    end = F.greatest(F.col("page"), F.coalesce(F.lead("page").over(W.partitionBy("file_name").orderBy("toc_index")) - 1, "total_pages"))
    return t.withColumn("end_page", end).select(*toc.columns, "end_page")


def bookmark_terms(toc: DataFrame, terms: DataFrame, filter_text: str = "") -> DataFrame:
    """toc entries with the first matching term: the filter text, then active terms in order; with * as whole words, else anywhere."""
    spark = toc.sparkSession
    t = terms.filter(F.col("active") & (F.trim("term") != "")).select("term", "ord")
    if filter_text.strip():
        t = spark.createDataFrame([(filter_text, -1)], "term string, ord int").unionByName(t)
    hit = F.when(F.contains("term", F.lit("*")), F.regexp_like("title", wildcard_pattern(F.col("term")))).otherwise(F.contains(F.lower("title"), F.lower("term")))
    # a term with a star is a pattern of whole words, any other one is found anywhere
    met = candidates(toc, ["file_name", "toc_index"], t, F.contains("term", F.lit("*")), "title").join(t, "term")
    joined = toc.join(met, ["file_name", "toc_index"]).filter(hit)
    return joined.groupBy("file_name", "toc_index", "title").agg(F.min_by("term", "ord").alias("term"))


def redact_titles(matched: DataFrame, whole: bool = False) -> DataFrame:
    """new_title of matched entries (title, term): the term without * replaced by a bar, ignoring case; or the whole title by CCI."""
    bar = F.regexp_replace("title", F.concat(F.lit("(?iu)"), escape(F.regexp_replace("term", r"\*", ""))), F.lit("█████"))
    return matched.withColumn("new_title", F.lit("CCI") if whole else bar)


def apply_toc_edits(toc: DataFrame, edits: DataFrame) -> DataFrame:
    """toc with edited titles by index."""
    e = edits.select("file_name", "toc_index", "new_title")
    return toc.join(e, ["file_name", "toc_index"], "left").withColumn("title", F.coalesce("new_title", "title")).select(*toc.columns)


def redact_bookmark_pages(toc: DataFrame, files: DataFrame, words: DataFrame, term: str, dehyphenate: bool = True) -> DataFrame:
    """Boxes of a term on all pages of each bookmark, one batch for each bookmark. dehyphenate: as in search_terms."""
    from pagemask.operators.search import term_boxes

    ranges = bookmark_ranges(toc, files).select(F.col("file_name").alias("_f"), "toc_index", F.explode(F.sequence("page", "end_page")).alias("_p"))
    hit = term_boxes(words, term, dehyphenate).join(ranges, (F.col("file_name") == F.col("_f")) & (F.col("page") == F.col("_p")))
    return hit.select("file_name", "page", "x", "y", "w", "h", F.concat_ws("#", F.lit("bookmark"), "file_name", F.col("toc_index").cast("string")).alias("batch_id"))
