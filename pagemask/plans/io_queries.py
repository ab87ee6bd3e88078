"""Queries of project files, exports and manifests, and of the streams run over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemask.plans.register import query
from pagemask.plans.state_queries import actions, edits
from pagemask.plans.views_sql import VIEWS
from pagemask.sources import io, project
from pagemask.sources.layout import stream_dir
from pagemask.streaming.jobs import box_state, fold_actions, stream_boxes

_PLAIN = "id, file_name, page, x, y, w, h, selection_mode, match, term, batch_id, context"
VIEWS["drafts"] = (["results"], """
  drafts AS (SELECT match AS text, file_name, page, file_path, 'high' AS confidence, category, term AS justification, context, page % 7 = 0 AS dismissed FROM results WHERE category = 'ai')""")


def _drafts(v):
    """Detections: the results of a model's finds."""
    r = v.results.filter("category = 'ai'")
    return r.select(F.col("match").alias("text"), "file_name", "page", "file_path", F.lit("high").alias("confidence"), "category", F.col("term").alias("justification"), "context", "dismissed")


def _frames(v):
    """A whole project: all boxes, edits, dismissed keys, results, detections, terms and files of the sample."""
    boxes = v.boxes.withColumns({
        "pd_check_result": F.when(F.col("seq") % 10 == 0, F.struct(F.lit("public").alias("verdict"), F.col("match").alias("claim"), F.lit(0.5).alias("confidence"))),
        "repeat_pages": F.when(F.col("seq") % 7 == 0, F.array("page", F.col("page") + 1)), "rects": F.lit("not saved"),
    })
    summaries = v.files.select("file_name", F.create_map(F.lit("doc_type"), F.lit("report"), F.lit("summary"), F.col("file_path")).alias("summary"))
    return {
        "boxes": boxes, "toc_edits": edits(v), "dismissed": v.dismissed, "results": v.results, "detections": _drafts(v), "terms": v.terms, "summaries": summaries,
        "files": v.files.select("file_path"), "auto_batches": v.boxes.filter("seq % 3 = 0").select("batch_id").distinct(),
        "settings": v.spark.createDataFrame([("/corpus", None)], "folder string, ai_library_path string"),
    }


def _saved(v, *names, least=3):
    """The tables of a project that was written to files and read again; names: those that are saved, all if none is named. In `least` documents, or as many as its size takes."""
    path = stream_dir(v.spark) + "/project"
    frames = _frames(v)
    some = {k: f for k, f in frames.items() if not names or k in names}
    project.write_project(some, path, max(least, project.shares(some)))
    return project.read_project(v.spark, path)


query("s1_list_files")(lambda v: io.list_files(v.spark, v.dir, pattern="*.parquet"))
query("s7_read_project", "boxes", f"SELECT {_PLAIN} FROM boxes")(lambda v: _saved(v, "boxes")["boxes"].select(*_PLAIN.split(", ")))
query("s7_project_dismissed", "dismissed", "SELECT * FROM dismissed")(lambda v: _saved(v, "dismissed", least=1)["dismissed"])
query("s7_project_edits", "edits", "SELECT * FROM edits")(lambda v: _saved(v, "toc_edits", least=1)["toc_edits"])
query("s7_project_results", "results", "SELECT id, file_name, file_path, page, match, term, category, context, coalesce(batch_id, '') AS batch_id, redacted, dismissed FROM results")(lambda v: _saved(v, "results")["results"])
query("s7_project_detections", "drafts", "SELECT text, file_name, page, file_path, confidence, category, justification, context, false AS redacted, dismissed, '' AS batch_id, 0 AS n_rects FROM drafts")(
    lambda v: _saved(v, "detections")["detections"].withColumn("n_rects", F.size("rects")).drop("rects"))
@query("s7_project_lists", "terms files boxes", """SELECT 'term' AS kind, term AS a, active::VARCHAR AS b, ord - 1 AS n FROM terms UNION ALL SELECT 'file', file_path, NULL, NULL FROM files
UNION ALL SELECT 'batch', batch_id, NULL, NULL FROM (SELECT DISTINCT batch_id FROM boxes WHERE seq % 3 = 0) UNION ALL SELECT 'summary', file_name, 'report ' || file_path, NULL FROM files UNION ALL SELECT 'folder', '/corpus', NULL, NULL""")
def _(v):
    t = _saved(v, "terms", "files", "auto_batches", "summaries", "settings")
    row = lambda kind, df, a, b=F.lit(None), n=F.lit(None): df.select(F.lit(kind).alias("kind"), a.alias("a"), b.cast("string").alias("b"), n.cast("int").alias("n"))
    c = F.col
    out = row("term", t["terms"], c("term"), c("active"), c("ord")).unionByName(row("file", t["files"], c("file_path"))).unionByName(row("batch", t["auto_batches"], c("batch_id")))
    return out.unionByName(row("summary", t["summaries"], c("file_name"), F.concat_ws(" ", c("summary")["doc_type"], c("summary")["summary"]))).unionByName(row("folder", t["settings"], c("folder")))


@query("s8_round_trip", "boxes", f"""SELECT {_PLAIN}, CASE WHEN seq % 10 = 0 THEN 'public ' || match || ' ' || 0.5::VARCHAR END AS verdict, CASE WHEN seq % 7 = 0 THEN [page, page + 1] ELSE [] END AS repeat_pages FROM boxes""")
def _(v):
    b, c = _saved(v)["boxes"], F.col("pd_check_result")
    return b.select(*_PLAIN.split(", "), F.when(c.isNotNull(), F.concat_ws(" ", c["verdict"], c["claim"], c["confidence"].cast("string"))).alias("verdict"), "repeat_pages")


@query("s8_project_json", "boxes dismissed edits", """SELECT file_name, (SELECT count(*) FROM boxes b WHERE b.file_name = n.file_name) AS n_boxes, (SELECT count(DISTINCT page) FROM boxes b WHERE b.file_name = n.file_name) AS n_pages,
  (SELECT count(*) FROM edits b WHERE b.file_name = n.file_name) AS n_edits FROM (SELECT file_name FROM boxes UNION SELECT file_name FROM edits) n""")
def _(v):
    """What stands in the documents' text, counted from it."""
    frames, path = _frames(v), stream_dir(v.spark) + "/project"
    project.write_project(frames, path, max(2, project.shares(frames)))
    count = lambda key: project.documents(v.spark, path).select(F.explode(key).alias("file_name", "v"))
    b = count("project_redactions").select("file_name", F.aggregate(F.map_values("v"), F.lit(0), lambda n, x: n + F.size(x)).alias("b"), F.size("v").alias("p"))
    e = count("project_toc_redactions").select("file_name", F.size("v").alias("e"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return b.join(e, "file_name", "full").select("file_name", n("b").alias("n_boxes"), n("p").alias("n_pages"), n("e").alias("n_edits"))


query("s9_export", "results", "SELECT file_name, page, term, match, context FROM results")(lambda v: io.export_rows(v.results))
query("s10_redaction_manifest", "boxes files", "SELECT 'REDACTED_' || file_name AS output_name, id, page, unnest(['square', 'redact']) AS kind, unnest([1.5, 0.0])::DOUBLE AS border FROM boxes JOIN files USING (file_name) WHERE page <= total_pages")(
    lambda v: io.redaction_manifest(v.boxes, v.files, v.toc, edits(v))[0].select("output_name", "id", "page", "kind", "border"))
query("s10_manifest_toc", "toc edits", "SELECT file_name, toc_index, coalesce(new_title, title) AS title FROM toc LEFT JOIN edits USING (file_name, toc_index)")(
    lambda v: io.redaction_manifest(v.boxes, v.files, v.toc, edits(v))[1].select("file_name", "toc_index", "title"))
query("s11_review_manifest", "boxes", """WITH g AS (SELECT *, arg_min(selection_mode, seq) OVER (PARTITION BY file_name, page, batch_id) AS mode FROM boxes)
SELECT file_name, page, batch_id AS batch, 'note' AS kind, 1 AS n_quads, match AS text FROM g WHERE mode = 'rectangle'
UNION ALL SELECT file_name, page, batch_id, 'highlight', count(*), arg_min(match, seq) FROM g WHERE mode <> 'rectangle' GROUP BY ALL""")(
    lambda v: io.review_manifest(v.boxes, v.files).select("file_name", "page", "batch", "kind", F.size("quads").alias("n_quads"), "text"))
query("s12_save_plan", "boxes edits files", """WITH n AS (SELECT file_name FROM boxes UNION SELECT file_name FROM edits), p AS (SELECT * FROM files WHERE total_pages <> 2)
SELECT n.file_name, file_path, CASE WHEN file_path IS NOT NULL THEN 'REDACTED_' || n.file_name END AS output_name, CASE WHEN file_path IS NULL THEN 'File not found: ' || n.file_name END AS error FROM n LEFT JOIN p USING (file_name)""")(
    lambda v: io.save_plan(v.boxes, edits(v), v.files.filter("total_pages <> 2")))
query("s13_path_map", "files results", """WITH f AS (SELECT file_name, file_path FROM files WHERE total_pages <> 2) SELECT * FROM f UNION ALL SELECT DISTINCT file_name, file_path FROM results WHERE file_name NOT IN (SELECT file_name FROM f)""")(
    lambda v: io.build_path_map(v.files.filter("total_pages <> 2"), v.results))
_REPLAY = """
WITH e AS (SELECT file_name, box_id, max(seq) FILTER (action = 'add') AS a, max(seq) FILTER (action = 'remove') AS r FROM actions GROUP BY ALL),
l AS (SELECT x.* FROM actions x JOIN e USING (file_name, box_id) WHERE e.a > coalesce(e.r, -1) AND x.seq >= e.a AND x.action IN ('add', 'edit'))
SELECT file_name, box_id, arg_max(page, seq) AS page, arg_max(x, seq) AS x, max(seq) AS seq FROM l GROUP BY ALL"""


@query("r8_fold_actions", "actions", _REPLAY)
def _(v):
    from pagemask.operators.state import replay_actions

    a = actions(v.table("events"))
    parts = [a.filter(f"seq % 3 = {k}") for k in (2, 0, 1)]
    kept = None
    for p in parts:
        kept = fold_actions(kept, p.unionByName(p))
    return replay_actions(kept).select("file_name", "box_id", "page", "x", "seq")


@query("r8_stream_boxes", "actions", _REPLAY)
def _(v):
    from pagemask.operators.state import replay_actions

    path = stream_dir(v.spark)
    schema = v.table("events").schema
    live = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(v.dir + "/events.parquet*")
    stream_boxes(actions(live), path + "/state", path + "/checkpoint", once=True).awaitTermination()
    state = box_state(v.spark, path + "/state")
    return replay_actions(state.read(state.last())).select("file_name", "box_id", "page", "x", "seq")
