"""Results, redaction boxes and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.operators.detect import locate
from pagemask.operators.search import text_under_boxes
from pagemask.operators.sections import section_title

DISMISS = ["file_name", "page", "match_text", "term"]


def match_key(c: str = "match") -> Column:
    return F.lower(F.trim(c))


# ---- filters


def filter_results(results: DataFrame, category: str, show_dismissed: bool = False, term: str = "", text: str = "") -> DataFrame:
    """Rows of a category; a term narrows matches only ("", all: no narrowing), free text narrows gaps only."""
    out = results.filter(F.col("category") == category)
    if not show_dismissed:
        out = out.filter(~F.col("dismissed"))
    if category == "matches" and term.strip().lower() not in ("", "all", "all selected terms"):
        out = out.filter(F.col("term") == term)
    if category == "gap" and text:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "file_name", "match", "context")), F.lit(text.lower())))
    return out


def filter_for_export(results: DataFrame, dismissed: DataFrame, term: str = "", text: str = "", show_doses: bool = True) -> DataFrame:
    """Rows to export: not dismissed by key, of one term, with the text, with or without doses."""
    out = without_dismissed(results, dismissed)
    if term.strip().lower() not in ("", "all", "all selected terms"):
        out = out.filter(F.col("term") == term)
    if not show_doses:
        out = out.filter(F.col("category") != "dosage")
    if text:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "term", "match", "context")), F.lit(text.lower())))
    return out


def highlight_mode(term: str) -> str:
    return "all" if term.strip().lower() in ("", "all") else "single"


def highlight(results: DataFrame, file_name: str, page: int, mode: str = "all", term: str = "", category: str | None = None) -> DataFrame:
    """Results to highlight on a page: neither redacted nor dismissed; `single` keeps those whose term or match equals the term."""
    if mode == "none":
        return results.limit(0)
    out = results.filter((F.col("file_name") == file_name) & (F.col("page") == page) & ~F.col("redacted") & ~F.col("dismissed"))
    if category:
        out = out.filter(F.col("category") == category)
    if mode == "single":
        out = out.filter((F.lower("term") == term.lower()) | (F.lower("match") == term.lower()))
    return out


def filter_files(files: DataFrame, text: str) -> DataFrame:
    return files.filter(F.contains(F.lower("file_name"), F.lit(text.lower())))


def filter_by_verdict(rollup: DataFrame, status: str) -> DataFrame:
    """Roll-up rows whose term shows a status label."""
    return rollup.filter(F.contains("term", F.lit(status)))


# ---- dismissing and redacting


def without_dismissed(results: DataFrame, dismissed: DataFrame) -> DataFrame:
    d = dismissed.select(*[F.col(c).alias("_" + c) for c in DISMISS])
    same = (F.col("file_name") == F.col("_file_name")) & (F.col("page") == F.col("_page")) & (match_key() == F.col("_match_text")) & F.col("term").eqNullSafe(F.col("_term"))
    return results.join(d, same, "left_anti")


def mark_dismissed(results: DataFrame, dismissed: DataFrame) -> DataFrame:
    """results with dismissed set by key."""
    d = dismissed.select(*[F.col(c).alias("_" + c) for c in DISMISS]).distinct().withColumn("_hit", F.lit(True))
    same = (F.col("file_name") == F.col("_file_name")) & (F.col("page") == F.col("_page")) & (match_key() == F.col("_match_text")) & F.col("term").eqNullSafe(F.col("_term"))
    return results.join(d, same, "left").withColumn("dismissed", F.col("_hit").isNotNull()).select(*results.columns)


def mark_redacted(results: DataFrame, boxes: DataFrame) -> DataFrame:
    """results with redacted and batch_id of the first box of the same file, page, term and text that has a batch."""
    b = boxes.filter(F.coalesce(F.length("batch_id"), F.lit(0)) > 0)
    b = b.groupBy(F.col("file_name").alias("_f"), F.col("page").alias("_p"), F.col("term").alias("_t"), match_key().alias("_m")).agg(F.min_by("batch_id", "seq").alias("_batch"))
    same = (F.col("file_name") == F.col("_f")) & (F.col("page") == F.col("_p")) & (F.col("term") == F.col("_t")) & (match_key() == F.col("_m"))
    out = results.join(b, same, "left")
    return out.withColumns({"redacted": F.col("_batch").isNotNull(), "batch_id": F.coalesce("_batch", "batch_id")}).select(*results.columns)


def dismiss(results: DataFrame, boxes: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results with the keys dismissed (no longer redacted, no batch), and boxes without the batches these had. What was dismissed stays so."""
    hit = mark_dismissed(results.withColumn("_was", F.col("dismissed")), keys)
    gone = hit.filter(F.col("dismissed") & F.col("batch_id").isNotNull()).select(F.col("file_name").alias("_f"), F.col("batch_id").alias("_b")).distinct()
    left = boxes.join(gone, (F.col("file_name") == F.col("_f")) & (F.col("batch_id") == F.col("_b")), "left_anti")
    cleared = {"redacted": F.col("redacted") & ~F.col("dismissed"), "batch_id": F.when(~F.col("dismissed"), F.col("batch_id")), "dismissed": F.col("dismissed") | F.col("_was")}
    return hit.withColumns(cleared).select(*results.columns), left


def restore(dismissed: DataFrame, keys: DataFrame) -> DataFrame:
    """The dismissed keys without some."""
    return dismissed.join(keys.select(*DISMISS), DISMISS, "left_anti")


def redact(results: DataFrame, toc: DataFrame) -> DataFrame:
    """Boxes of results: one for each rectangle, one batch id for each result, with the page's section title. Results without
    rectangles give none."""
    batch = F.concat_ws("#", F.lit("batch"), "id")
    titles = section_title(results.select("file_name", "page").distinct(), toc)
    b = results.filter(F.size("rects") > 0).withColumn("batch_id", batch).join(titles, ["file_name", "page"], "left")
    b = b.select("id", "file_name", "page", "term", "match", "context", "batch_id", "section_title", F.posexplode("rects").alias("n", "r"))
    return b.select(F.concat_ws("#", "id", F.col("n").cast("string")).alias("id"), "file_name", "page", "r.x", "r.y", "r.w", "r.h", F.lit("highlight").alias("selection_mode"), "term", "match", "context", "batch_id", "section_title")


def bulk_redact(results: DataFrame) -> DataFrame:
    """file_name, id and action: per file, redact what isn't dismissed or redacted; where nothing is left to redact, un-redact all."""
    live = results.filter(~F.col("dismissed"))
    todo = F.max((~F.col("redacted")).cast("int")).over(W.partitionBy("file_name"))
    a = live.withColumn("_todo", todo)
    return a.filter((F.col("_todo") == 0) | ~F.col("redacted")).select("file_name", "id", F.when(F.col("_todo") == 1, "redact").otherwise("unredact").alias("action"))


def unredact(boxes: DataFrame, results: DataFrame, batches: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """boxes without those of the batches (file_name, batch_id) and ids, and results with these batches cleared."""
    left = boxes.join(batches, ["file_name", "batch_id"], "left_anti").join(ids, "id", "left_anti")
    hit = batches.select(F.col("file_name").alias("_f"), F.col("batch_id").alias("_b")).distinct()
    r = results.join(hit, (F.col("file_name") == F.col("_f")) & (F.col("batch_id") == F.col("_b")), "left")
    r = r.withColumns({"redacted": F.when(F.col("_b").isNotNull(), False).otherwise(F.col("redacted")), "batch_id": F.when(F.col("_b").isNull(), F.col("batch_id"))})
    return left, r.select(*results.columns)


def repeat_boxes(boxes: DataFrame, pages: Column) -> DataFrame:
    """Each box repeated on a list of pages under one batch id."""
    return boxes.withColumns({"page": F.explode(pages), "batch_id": F.concat_ws("#", F.lit("repeat"), "id")})


# ---- files


def add_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """files and those of new whose path isn't there yet; of equal new paths the first in order (ord) counts."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("file_path").orderBy("ord"))).filter("_n = 1")
    return files.select("file_name", "file_path").unionByName(first.join(files, "file_path", "left_anti").select("file_name", "file_path"))


def remove_files(files: DataFrame, boxes: DataFrame, toc_edits: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, boxes and bookmark edits without the files of `gone`."""
    return tuple(x.join(gone, "file_name", "left_anti") for x in (files, boxes, toc_edits))


def split_missing(selection: DataFrame, files: DataFrame) -> DataFrame:
    """A saved selection with `present`."""
    return selection.join(files.select("file_name", F.lit(True).alias("_there")), "file_name", "left").withColumn("present", F.col("_there").isNotNull()).drop("_there")


# ---- roll-ups


def batch_bounds(boxes: DataFrame) -> DataFrame:
    """file_name, page, batch (or _unique_<id>), number of boxes and bounding box."""
    batch = F.coalesce(F.nullif("batch_id", F.lit("")), F.concat(F.lit("_unique_"), "id"))
    x1, y1 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy("file_name", "page", batch.alias("batch")).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), x1.alias("x1"), y1.alias("y1"))


def disclosure_candidates(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Boxes to check for public disclosure: no side over 1000, the first of each batch, with text (the match, else what is under it)."""
    b = boxes.filter((F.col("w") <= 1000) & (F.col("h") <= 1000))
    batch = F.coalesce(F.nullif("batch_id", F.lit("")), F.concat(F.lit("_unique_"), "id"))
    first = b.withColumn("_n", F.row_number().over(W.partitionBy("file_name", batch).orderBy("seq"))).filter("_n = 1").drop("_n")
    t = text_under_boxes(first, words).withColumn("text", F.trim(F.coalesce(F.nullif("match", F.lit("")), "text")))
    return t.filter(F.length("text") > 0)


def disclosure_rollup(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """One row for each batch: file_name, batch, page and match of the first box, contexts joined, and a status label in term.

    boxes may have verdict, confidence and n_sources (of the check); rank orders public, not found, uncertain, not checkable, not checked.
    """
    batch = F.coalesce(F.nullif("batch_id", F.lit("")), F.concat(F.lit("_unique_"), "id"))
    t = text_under_boxes(boxes, words)
    shown = F.coalesce(F.nullif("match", F.lit("")), F.nullif(F.trim("text"), F.lit("")), F.concat(F.lit("[Redaction at ("), F.round("x").cast("int"), F.lit(", "), F.round("y").cast("int"), F.lit(")]")))
    t = t.withColumns({"batch": batch, "shown": shown})
    firsts = F.array_sort(F.collect_list(F.struct("seq", "page", "shown", F.coalesce(F.nullif("term", F.lit("")), F.lit("manual")).alias("source"), F.coalesce("context", "shown").alias("context"))))
    checked = F.min_by(F.struct("verdict", "confidence", "n_sources"), F.when(F.col("verdict").isNotNull(), F.col("seq")))
    g = t.groupBy("file_name", "batch").agg(firsts.alias("all"), checked.alias("v"))
    verdict = F.upper(F.col("v.verdict"))
    percent = F.concat(F.lit("✓ PUBLIC ("), F.bround(F.col("v.confidence") * 100).cast("int").cast("string"), F.lit("%)"), F.when(F.col("v.n_sources") > 1, F.concat(F.lit(" · "), F.col("v.n_sources").cast("string"), F.lit(" sources"))).otherwise(F.lit("")))
    label = F.when(verdict.isNull(), "○ Not Checked").when(verdict == "DISCLOSED", percent).when(verdict == "NOT_FOUND", "⚠ NOT FOUND").when(verdict == "UNCERTAIN", "⚠ UNCERTAIN").otherwise("⊘ NOT CHECKABLE")
    rank = F.when(verdict.isNull(), 5).when(verdict == "DISCLOSED", 1).when(verdict == "NOT_FOUND", 2).when(verdict == "UNCERTAIN", 3).otherwise(4)
    one = F.get("all", F.lit(0))
    return g.select(
        "file_name", "batch", one["page"].alias("page"), one["shown"].alias("match"), F.concat(label, F.lit(" | "), one["source"]).alias("term"),
        F.array_join(F.transform("all", lambda x: x["context"]), "   |   ").alias("context"), rank.alias("rank"),
    )


def file_status(files: DataFrame, boxes: DataFrame, toc_edits: DataFrame, save_status: DataFrame) -> DataFrame:
    """file_name, n_boxes, n_edits, pending (work that isn't saved) and a label."""
    b = boxes.groupBy("file_name").agg(F.count("*").alias("n_boxes"))
    e = toc_edits.groupBy("file_name").agg(F.count("*").alias("n_edits"))
    out = files.select("file_name").join(b, "file_name", "left").join(e, "file_name", "left").join(save_status.select("file_name", "saved"), "file_name", "left")
    out = out.withColumns({"n_boxes": F.coalesce("n_boxes", F.lit(0)), "n_edits": F.coalesce("n_edits", F.lit(0))})
    pending = ((F.col("n_boxes") + F.col("n_edits")) > 0) & ~F.coalesce("saved", F.lit(False))
    label = F.concat(F.col("n_boxes").cast("string"), F.lit(" redactions · "), F.col("n_edits").cast("string"), F.lit(" TOC edits"))
    return out.select("file_name", "n_boxes", "n_edits", pending.alias("pending"), label.alias("label"))


def result_summary(results: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: found, dismissed, all_redacted and a count for each category; files without results have zeros."""
    live = ~F.col("dismissed")
    s = results.groupBy("file_name").agg(
        F.count_if(live).alias("found"), F.count_if(F.col("dismissed")).alias("n_dismissed"), F.coalesce(F.bool_and(F.when(live, F.col("redacted"))), F.lit(False)).alias("all_redacted"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("matches", "dosage", "ai", "gap")],
    )
    zeros = {c: 0 for c in s.columns if c not in ("file_name", "all_redacted")}
    return files.select("file_name").join(s, "file_name", "left").fillna(zeros).fillna({"all_redacted": False})


def ordered_results(results: DataFrame) -> DataFrame:
    """results by file, page and height on the page."""
    return results.orderBy("file_name", "page", F.coalesce(F.get("rects", F.lit(0))["y"], F.lit(0.0)), "id")


def term_options(results: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that are defined and found, without the dose term, sorted."""
    return results.select("term").distinct().join(terms.select("term"), "term", "left_semi").filter(F.col("term") != "CCI:dosing").orderBy("term")


def restore_results(results: DataFrame, boxes: DataFrame, dismissed: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Saved results with dismissed by key, and redacted if any box of the file (on any page) has the result's batch id. With words,
    model detections (category ai) get their rectangles anew; where the text isn't found they keep those they have."""
    b = boxes.select(F.col("file_name").alias("_f"), F.col("batch_id").alias("_b")).distinct()
    r = mark_dismissed(results, dismissed).join(b, (F.col("file_name") == F.col("_f")) & (F.col("batch_id") == F.col("_b")), "left")
    r = r.withColumn("redacted", F.col("_b").isNotNull()).select(*results.columns)
    if words is None:
        return r
    ai = r.filter("category = 'ai'").select("id", "file_name", "page", F.col("match").alias("text"), "context")
    found = locate(ai, words).select(F.col("id").alias("_id"), F.col("rects").alias("_rects"))
    return r.join(found, F.col("id") == F.col("_id"), "left").withColumn("rects", F.coalesce("_rects", "rects")).select(*results.columns)


def restored_counts(results: DataFrame) -> DataFrame:
    """One row: how many model detections have rectangles (restored), and how many have none (failed)."""
    there = F.coalesce(F.size("rects"), F.lit(0)) > 0
    return results.filter("category = 'ai'").agg(F.count_if(there).alias("restored"), F.count_if(~there).alias("failed"))


# ---- action log


def replay_actions(actions: DataFrame) -> DataFrame:
    """Current boxes after a log of add, edit and remove (seq orders it): a box is there if its last add follows its last remove;
    its geometry is that of the last edit after this add, else the add's. Delivering an entry twice changes nothing."""
    key = ["file_name", "box_id"]
    added = F.max(F.when(F.col("action") == "add", F.col("seq")))
    removed = F.max(F.when(F.col("action") == "remove", F.col("seq")))
    ends = actions.groupBy(*key).agg(added.alias("added"), removed.alias("removed")).filter("added > coalesce(removed, -1)").select(*key, "added")
    live = actions.join(ends, key).filter((F.col("seq") >= F.col("added")) & F.col("action").isin("add", "edit"))
    return live.groupBy(*key).agg(F.max_by(F.struct("page", "x", "y", "w", "h"), "seq").alias("b"), F.max("seq").alias("seq")).select(*key, "b.*", "seq")


# ---- terms and library


def import_terms(rows: DataFrame) -> DataFrame:
    """term and ord of an imported sheet (ord, value): the first row may be a header; trimmed; blanks dropped."""
    first = rows.agg(F.min("ord").alias("_first"))
    t = rows.crossJoin(F.broadcast(first)).withColumn("term", F.trim("value"))
    header = (F.col("ord") == F.col("_first")) & F.lower("term").isin("term", "terms", "search term")
    return t.filter(~header & (F.length("term") > 0)).select("term", "ord")


def merge_terms(existing: DataFrame, imported: DataFrame, mode: str = "merge") -> DataFrame:
    """Terms after an import: those not present (ignoring case; of equal ones the first) are added as active; `replace` takes the
    import as it is."""
    new = imported.select("term", F.lit(True).alias("active"), "ord")
    if mode == "replace":
        return new
    new = new.withColumn("_n", F.row_number().over(W.partitionBy(F.lower("term")).orderBy("ord"))).filter("_n = 1").drop("_n")
    old = existing.select(F.lower("term").alias("_t")).distinct()
    return existing.select("term", "active", "ord").unionByName(new.join(old, F.lower("term") == F.col("_t"), "left_anti"))


def load_library(rows: DataFrame) -> DataFrame:
    """redacted_text, context, category of a sheet whose columns are told by their headers, row by row: a blank cell is passed over for
    the next column of the same kind; without any, the first value over ten characters is the text. Rows without text are dropped."""

    def first(*hints: str) -> Column:
        cells = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in rows.columns if any(h in c.lower() for h in hints)]
        return F.coalesce(*cells, F.lit(None).cast("string"))

    every = F.filter(F.array(*[F.trim(F.col(c).cast("string")) for c in rows.columns]), lambda x: F.length(x) > 10)
    text = F.coalesce(first("redact", "text", "cci", "content", "snippet"), F.get(every, F.lit(0)))
    out = rows.select(text.alias("redacted_text"), F.coalesce(first("context"), F.lit("")).alias("context"), F.coalesce(first("type", "category", "bookmark"), F.lit("")).alias("category"))
    return out.filter(F.col("redacted_text").isNotNull())
