"""Sources and sinks: file lists, exports and mark-up manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, selected: DataFrame | None = None, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """file_name and file_path of all files of a pattern (.pdf in any case) below a folder, or of the selected names. Contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    files = found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("file_path"))
    return files if selected is None else files.join(selected.select("file_name").distinct(), "file_name", "left_semi")


def export_rows(results: DataFrame) -> DataFrame:
    """The export's columns that results have, in order."""
    return results.select(*[c for c in ("file_name", "page", "term", "match", "context") if c in results.columns])


def export_results(results: DataFrame, path: str) -> bool:
    """Writes the export as CSV with a header; nothing is written for no rows. Says whether it wrote."""
    if results.isEmpty():
        return False
    export_rows(results).write.mode("overwrite").csv(path, header=True)
    return True


def redaction_manifest(boxes: DataFrame, files: DataFrame, toc: DataFrame, toc_edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two mark-up records for each box on an existing page (a red frame of 1.5 pt, and a transparent redaction area), and the bookmarks to write."""
    b = boxes.join(files.select("file_name", "total_pages"), "file_name").filter("page BETWEEN 1 AND total_pages")

    def record(kind, color, width, fill):
        return F.struct(F.lit(kind).alias("kind"), F.lit(color).alias("color"), F.lit(width).alias("border"), F.lit(fill).alias("fill"))

    marks = b.select(
        F.concat(F.lit("REDACTED_"), "file_name").alias("output_name"), "file_name", "page", "id", "x", "y", "w", "h",
        F.inline(F.array(record("square", "red", 1.5, "none"), record("redact", "none", 0.0, "transparent"))),
    )
    edited = toc.join(toc_edits.select("file_name", "toc_index", "new_title"), ["file_name", "toc_index"], "left").withColumn("title", F.coalesce("new_title", "title")).select(*toc.columns)
    return marks, edited


def review_manifest(boxes: DataFrame, files: DataFrame) -> DataFrame:
    """One comment for each group (file, page, batch or own id): a highlight with all quads; or, where the group's first box is a rectangle,
    one note for each box."""
    key = F.coalesce(F.nullif("batch_id", F.lit("")), F.concat(F.lit("_unique_"), "id"))
    b = boxes.join(files.select("file_name", "total_pages"), "file_name").filter("page BETWEEN 1 AND total_pages").withColumn("batch", key)
    quads = F.array_sort(F.collect_list(F.struct("seq", "selection_mode", "match", "x", "y", "w", "h")))
    g = b.groupBy("file_name", "page", "batch").agg(quads.alias("q"))
    notes = F.transform("q", lambda q: F.array(q))
    parts = F.when(F.get("q", F.lit(0))["selection_mode"] == "rectangle", notes).otherwise(F.array("q"))
    kind = F.when(F.get("q", F.lit(0))["selection_mode"] == "rectangle", "note").otherwise("highlight")
    return g.select("file_name", "page", "batch", kind.alias("kind"), F.posexplode(parts).alias("n", "quads")).withColumn("text", F.get("quads", F.lit(0))["match"])


def save_plan(boxes: DataFrame, toc_edits: DataFrame, path_map: DataFrame) -> DataFrame:
    """file_name, file_path, output_name and error of every file with a box or a bookmark edit, in order of name."""
    names = boxes.select("file_name").union(toc_edits.select("file_name")).distinct()
    p = names.join(path_map.select("file_name", "file_path"), "file_name", "left")
    error: Column = F.when(F.col("file_path").isNull(), F.concat(F.lit("File not found: "), "file_name"))
    return p.select("file_name", "file_path", F.when(F.col("file_path").isNotNull(), F.concat(F.lit("REDACTED_"), "file_name")).alias("output_name"), error.alias("error")).orderBy("file_name")


def build_path_map(files: DataFrame, results: DataFrame) -> DataFrame:
    """file_name and file_path: the project's files, and of the results those that it lacks."""
    u = files.select("file_name", "file_path", F.lit(0).alias("p")).unionByName(results.select("file_name", "file_path", F.lit(1).alias("p")).filter("file_path IS NOT NULL"))
    return u.groupBy("file_name").agg(F.min_by("file_path", F.struct("p", "file_path")).alias("file_path"))
