"""Queries of filters, redaction state, roll-ups, files, bookmarks and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemask.operators import sections as sec
from pagemask.operators import state as st
from pagemask.plans.register import query
from pagemask.plans.views_sql import VIEWS

_R = ["id", "file_name", "page", "match", "term", "category", "batch_id", "redacted", "dismissed"]
_RS = "id, file_name, page, match, term, category, batch_id, redacted, dismissed"

VIEWS["verdicts"] = (["boxes"], """
  verdicts AS (SELECT *, CASE seq % 5 WHEN 0 THEN 'disclosed' WHEN 1 THEN 'not_found' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'not_checkable' END AS verdict, (seq % 100) / 100.0 AS confidence, (seq % 3)::INT AS n_sources FROM boxes)""")
VIEWS["actions"] = ([], """
  actions AS (SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'add' WHEN 2 THEN 'remove' WHEN 4 THEN 'add' ELSE 'edit' END AS action, 'doc_' || (user_id % 50) || '.pdf' AS file_name, 'b' || (event_id * 7 % 97) AS box_id,
    (event_id % 9 + 1)::INT AS page, value AS x, value + 1 AS y, (event_id % 50 + 1)::DOUBLE AS w, 10.0::DOUBLE AS h FROM events)""")
VIEWS["edits"] = (["toc"], """
  edits AS (SELECT file_name, toc_index, 'CCI ' || toc_index AS new_title FROM toc WHERE toc_index % 4 = 1)""")


def verdicts(v):
    s = F.col("seq") % 5
    verdict = F.when(s == 0, "disclosed").when(s == 1, "not_found").when(s == 2, "uncertain").when(s == 3, "not_checkable")
    return v.boxes.withColumns({"verdict": verdict, "confidence": (F.col("seq") % 100) / 100.0, "n_sources": (F.col("seq") % 3).cast("int")})


def actions(e):
    """An action log of the events table (or of a stream of it)."""
    k = F.col("event_id") % 5
    return e.select(
        F.col("event_id").alias("seq"), F.when(k.isin(0, 4), "add").when(k == 2, "remove").otherwise("edit").alias("action"),
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("doc_"), (F.col("user_id") % 50).cast("string"), F.lit(".pdf")).alias("file_name"), F.concat(F.lit("b"), (F.col("event_id") * 7 % 97).cast("string")).alias("box_id"),
        (F.col("event_id") % 9 + 1).cast("int").alias("page"), F.col("value").alias("x"), (F.col("value") + 1).alias("y"), (F.col("event_id") % 50 + 1).cast("double").alias("w"), F.lit(10.0).alias("h"),
    )


def edits(v):
    return v.toc.filter("toc_index % 4 = 1").select("file_name", "toc_index", F.concat(F.lit("CCI "), F.col("toc_index").cast("string")).alias("new_title"))


query("f2_filter_matches", "results", f"SELECT {_RS} FROM results WHERE category = 'matches' AND NOT dismissed AND term = 'the'")(lambda v: st.filter_results(v.results, "matches", term="the").select(*_R))
query("f2_filter_gaps", "results", f"SELECT {_RS} FROM results WHERE category = 'gap' AND contains(lower(file_name || ' ' || match || ' ' || context), 'tion')")(lambda v: st.filter_results(v.results, "gap", True, text="Tion").select(*_R))
query("f3_export_filter", "results dismissed", f"SELECT {_RS} FROM results r WHERE category <> 'dosage' AND contains(lower(term || ' ' || match || ' ' || context), 'an') AND NOT EXISTS (SELECT 1 FROM dismissed d WHERE d.file_name = r.file_name AND d.page = r.page AND d.match_text = lower(trim(r.match)) AND d.term = r.term)")(
    lambda v: st.filter_for_export(v.results, v.dismissed, "all", "AN", show_doses=False).select(*_R))
query("f4_highlight", "results", f"SELECT {_RS} FROM results WHERE file_name = 'doc_10.pdf' AND page = 1 AND NOT redacted AND NOT dismissed")(
    lambda v: st.highlight(v.results, "doc_10.pdf", 1, st.highlight_mode(" All ")).select(*_R))
query("f6_by_verdict", "verdicts", "SELECT file_name, count(*) AS n FROM (SELECT file_name, batch_id, arg_min(verdict, seq) FILTER (verdict IS NOT NULL) AS v FROM verdicts GROUP BY ALL) WHERE v = 'not_found' GROUP BY file_name")(
    lambda v: st.filter_by_verdict(st.disclosure_rollup(verdicts(v), v.words), "NOT FOUND").groupBy("file_name").agg(F.count("*").alias("n")))
query("f7_disclosure_candidates", "boxes", "SELECT id, file_name, page, trim(match) AS text FROM boxes WHERE trim(match) <> '' QUALIFY row_number() OVER (PARTITION BY file_name, batch_id ORDER BY seq) = 1")(
    lambda v: st.disclosure_candidates(v.boxes, v.words).select("id", "file_name", "page", "text"))
query("f8_filter_files", "files", "SELECT * FROM files WHERE contains(file_name, '_1')")(lambda v: st.filter_files(v.files, "_1"))

query("r1_mark_dismissed", "results dismissed", "SELECT id, (d.term IS NOT NULL) AS dismissed FROM results r LEFT JOIN dismissed d ON d.file_name = r.file_name AND d.page = r.page AND d.match_text = lower(trim(r.match)) AND d.term = r.term")(
    lambda v: st.mark_dismissed(v.results, v.dismissed).select("id", "dismissed"))
query("r2_mark_redacted", "results boxes", """WITH b AS (SELECT file_name, page, term, lower(trim(match)) AS m, arg_min(batch_id, seq) AS batch FROM boxes GROUP BY ALL)
SELECT r.id, b.batch IS NOT NULL AS redacted, coalesce(b.batch, r.batch_id) AS batch_id FROM results r LEFT JOIN b ON b.file_name = r.file_name AND b.page = r.page AND b.term = r.term AND b.m = lower(trim(r.match))""")(
    lambda v: st.mark_redacted(v.results, v.boxes).select("id", "redacted", "batch_id"))


@query("r3_dismiss", "results boxes dismissed", """
WITH gone AS (SELECT DISTINCT r.file_name, r.batch_id FROM results r JOIN dismissed d ON d.file_name = r.file_name AND d.page = r.page AND d.match_text = lower(trim(r.match)) AND d.term = r.term WHERE r.batch_id IS NOT NULL)
SELECT id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_name = b.file_name AND g.batch_id = b.batch_id)""")
def _(v):
    return st.dismiss(v.results, v.boxes, v.dismissed)[1].select("id")


query("r3_dismiss_results", "results dismissed", """SELECT id, r.dismissed OR d.term IS NOT NULL AS dismissed, (length(match) % 2 = 0) AND d.term IS NULL AS redacted, CASE WHEN d.term IS NULL THEN batch_id END AS batch_id
FROM results r LEFT JOIN dismissed d ON d.file_name = r.file_name AND d.page = r.page AND d.match_text = lower(trim(r.match)) AND d.term = r.term""")(
    lambda v: st.dismiss(v.results.withColumn("redacted", F.length("match") % 2 == 0), v.boxes, v.dismissed)[0].select("id", "dismissed", "redacted", "batch_id"))


query("r3_restore", "dismissed", "SELECT * FROM dismissed WHERE page % 2 = 1")(lambda v: st.restore(v.dismissed, v.dismissed.filter("page % 2 = 0")))
_TITLE = "coalesce((SELECT arg_max(t.title, t.toc_index) FROM toc t WHERE t.file_name = {0}.file_name AND t.level = 1 AND t.page <= {0}.page), '')"
query("r4_redact", "results toc", f"SELECT id || '#0' AS id, file_name, page, rects[1].x AS x, rects[1].w AS w, match, 'batch#' || id AS batch_id, {_TITLE.format('r')} AS section_title FROM results r")(
    lambda v: st.redact(v.results, v.toc).select("id", "file_name", "page", "x", "w", "match", "batch_id", "section_title"))
query("r4_bulk_redact", "results", """WITH a AS (SELECT *, length(match) % 3 = 0 AS red FROM results WHERE NOT dismissed), t AS (SELECT *, bool_or(NOT red) OVER (PARTITION BY file_name) AS todo FROM a)
SELECT file_name, id, CASE WHEN todo THEN 'redact' ELSE 'unredact' END AS action FROM t WHERE NOT todo OR NOT red""")(
    lambda v: st.bulk_redact(v.results.withColumn("redacted", F.length("match") % 3 == 0)))


@query("r5_unredact", "boxes results", "SELECT id FROM boxes WHERE seq % 4 <> 0 AND batch_id NOT IN (SELECT batch_id FROM boxes WHERE seq % 7 = 0)")
def _(v):
    b = v.boxes
    return st.unredact(b, v.results, b.filter("seq % 7 = 0").select("file_name", "batch_id").distinct(), b.filter("seq % 4 = 0").select("id"))[0].select("id")


@query("r5_unredact_results", "boxes results", """WITH g AS (SELECT DISTINCT file_name, batch_id FROM boxes WHERE seq % 7 = 0)
SELECT id, g.batch_id IS NULL AS redacted, CASE WHEN g.batch_id IS NULL THEN r.batch_id END AS batch_id FROM results r LEFT JOIN g ON g.file_name = r.file_name AND g.batch_id = r.batch_id""")
def _(v):
    b = v.boxes
    return st.unredact(b, v.results.withColumn("redacted", F.lit(True)), b.filter("seq % 7 = 0").select("file_name", "batch_id").distinct(), b.filter("seq % 4 = 0").select("id"))[1].select("id", "redacted", "batch_id")


query("r6_add_files", "files", "SELECT file_name, file_path FROM files")(
    lambda v: st.add_files(v.files.filter("total_pages > 1"), v.files.withColumn("ord", F.col("total_pages")).unionByName(v.files.withColumn("ord", F.lit(99)))))
query("r6_remove_files", "files boxes", "SELECT id FROM boxes JOIN files USING (file_name) WHERE total_pages <> 3")(
    lambda v: st.remove_files(v.files, v.boxes, edits(v), v.files.filter("total_pages = 3").select("file_name"))[1].select("id"))
query("r6_remove_edits", "files edits", "SELECT e.* FROM edits e JOIN files USING (file_name) WHERE total_pages <> 3")(
    lambda v: st.remove_files(v.files, v.boxes, edits(v), v.files.filter("total_pages = 3").select("file_name"))[2])
query("r6_split_missing", "files toc", "SELECT file_name, file_name IN (SELECT file_name FROM files WHERE total_pages > 2) AS present FROM (SELECT DISTINCT file_name FROM toc)")(
    lambda v: st.split_missing(v.toc.select("file_name").distinct(), v.files.filter("total_pages > 2")))
query("r7_repeat_boxes", "boxes files", "SELECT b.id, unnest(range(1, total_pages + 1))::INT AS page, 'repeat#' || b.id AS batch_id FROM boxes b JOIN files f USING (file_name)")(
    lambda v: st.repeat_boxes(v.boxes.join(v.files, "file_name"), F.sequence(F.lit(1), F.col("total_pages"))).select("id", "page", "batch_id"))
query("r8_replay", "actions", """
WITH e AS (SELECT file_name, box_id, max(seq) FILTER (action = 'add') AS a, max(seq) FILTER (action = 'remove') AS r FROM actions GROUP BY ALL),
l AS (SELECT x.* FROM actions x JOIN e USING (file_name, box_id) WHERE e.a > coalesce(e.r, -1) AND x.seq >= e.a AND x.action IN ('add', 'edit'))
SELECT file_name, box_id, arg_max(page, seq) AS page, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(w, seq) AS w, arg_max(h, seq) AS h, max(seq) AS seq FROM l GROUP BY ALL""")(lambda v: st.replay_actions(actions(v.table("events"))))
query("r9_batch_bounds", "boxes", "SELECT file_name, page, batch_id AS batch, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM boxes GROUP BY ALL")(lambda v: st.batch_bounds(v.boxes))
query("r10_disclosure_rollup", "verdicts", """
WITH g AS (SELECT file_name, batch_id AS batch, arg_min(page, seq) AS page, arg_min(match, seq) AS match, arg_min(term, seq) AS source, string_agg(context, '   |   ' ORDER BY seq) AS context,
  arg_min(verdict, seq) FILTER (verdict IS NOT NULL) AS v, arg_min(confidence, seq) FILTER (verdict IS NOT NULL) AS c, arg_min(n_sources, seq) FILTER (verdict IS NOT NULL) AS n FROM verdicts GROUP BY ALL)
SELECT file_name, batch, page, match, context, CASE v WHEN 'disclosed' THEN 1 WHEN 'not_found' THEN 2 WHEN 'uncertain' THEN 3 WHEN 'not_checkable' THEN 4 ELSE 5 END AS rank,
  CASE v WHEN 'disclosed' THEN '✓ PUBLIC (' || round_even(c * 100, 0)::INT || '%)' || CASE WHEN n > 1 THEN ' · ' || n || ' sources' ELSE '' END WHEN 'not_found' THEN '⚠ NOT FOUND' WHEN 'uncertain' THEN '⚠ UNCERTAIN' WHEN 'not_checkable' THEN '⊘ NOT CHECKABLE' ELSE '○ Not Checked' END || ' | ' || source AS term FROM g""")(
    lambda v: st.disclosure_rollup(verdicts(v), v.words))
query("r11_file_status", "files boxes edits", """SELECT f.file_name, coalesce(b.n, 0) AS n_boxes, coalesce(e.n, 0) AS n_edits, coalesce(b.n, 0) + coalesce(e.n, 0) > 0 AND total_pages <> 2 AS pending, coalesce(b.n, 0) || ' redactions · ' || coalesce(e.n, 0) || ' TOC edits' AS label
FROM files f LEFT JOIN (SELECT file_name, count(*) AS n FROM boxes GROUP BY 1) b USING (file_name) LEFT JOIN (SELECT file_name, count(*) AS n FROM edits GROUP BY 1) e USING (file_name)""")(
    lambda v: st.file_status(v.files, v.boxes, edits(v), v.files.select("file_name", (F.col("total_pages") == 2).alias("saved"))))
query("r12_summary", "files results", """SELECT f.file_name, coalesce(found, 0) AS found, coalesce(nd, 0) AS n_dismissed, coalesce(ar, false) AS all_redacted, coalesce(m, 0) AS n_matches, coalesce(d, 0) AS n_dosage, coalesce(a, 0) AS n_ai, coalesce(g, 0) AS n_gap
FROM files f LEFT JOIN (SELECT file_name, count(*) FILTER (NOT dismissed) AS found, count(*) FILTER (dismissed) AS nd, bool_and(length(match) % 3 = 0) FILTER (NOT dismissed) AS ar, count(*) FILTER (category = 'matches') AS m, count(*) FILTER (category = 'dosage') AS d, count(*) FILTER (category = 'ai') AS a, count(*) FILTER (category = 'gap') AS g FROM results GROUP BY 1) r USING (file_name)""")(
    lambda v: st.result_summary(v.results.withColumn("redacted", F.length("match") % 3 == 0), v.files))
query("r13_ordered", "results", "SELECT id, file_name, page, rects[1].y AS y FROM results ORDER BY file_name, page, y")(lambda v: st.ordered_results(v.results).select("id", "file_name", "page", F.get("rects", F.lit(0))["y"].alias("y")))
query("r14_term_options", "results boxes", "SELECT DISTINCT term FROM results WHERE term IN (SELECT term FROM boxes)")(lambda v: st.term_options(v.results, v.boxes.select("term")))
query("r15_restore", "results boxes dismissed", """SELECT r.id, d.term IS NOT NULL AS dismissed, EXISTS (SELECT 1 FROM boxes b WHERE b.file_name = r.file_name AND b.batch_id = r.batch_id) AS redacted
FROM results r LEFT JOIN dismissed d ON d.file_name = r.file_name AND d.page = r.page AND d.match_text = lower(trim(r.match)) AND d.term = r.term""")(lambda v: st.restore_results(v.results, v.boxes, v.dismissed).select("id", "dismissed", "redacted"))
query("r15_locate_again", "results", "SELECT id, length(match) % 7 > 0 AS restored FROM results WHERE category = 'ai'")(
    lambda v: st.restore_results(_lost(v), v.boxes, v.dismissed, v.words).filter("category = 'ai'").select("id", (F.coalesce(F.size("rects"), F.lit(0)) > 0).alias("restored")))
query("r15_restored_counts", "results", "SELECT count(*) FILTER (length(match) % 7 > 0) AS restored, count(*) FILTER (length(match) % 7 = 0) AS failed FROM results WHERE category = 'ai'")(
    lambda v: st.restored_counts(st.restore_results(_lost(v), v.boxes, v.dismissed, v.words)))


def _lost(v):
    """Results without rectangles, some with a text that no page has."""
    return v.results.withColumns({"rects": F.lit(None).cast("array<struct<x:double,y:double,w:double,h:double>>"), "match": F.when(F.length("match") % 7 == 0, F.lit("\u2460\u2461\u2462\u2463\u2464\u2465\u2466")).otherwise(F.col("match"))})


query("r16_section_title", "toc", f"SELECT p.file_name, p.page, {_TITLE.format('p')} AS section_title FROM (SELECT DISTINCT file_name, page FROM toc) p")(lambda v: sec.section_title(v.toc.select("file_name", "page"), v.toc))

query("s4_library", "boxes", "SELECT CASE WHEN seq % 3 = 0 THEN context ELSE match END AS redacted_text, '' AS context, term AS category FROM boxes")(
    lambda v: st.load_library(v.boxes.select(F.when(F.col("seq") % 3 != 0, F.col("match")).otherwise(F.lit("  ")).alias("Redacted text"), F.col("context").alias("CCI snippet"), F.col("term").alias("Category"))))
_NTH = "row_number() OVER (PARTITION BY file_name ORDER BY page, block_no, line_no, word_no) AS ord"
query("s5_import_terms", "words", f"SELECT trim(text) AS term, ord FROM (SELECT text, {_NTH} FROM words)")(
    lambda v: st.import_terms(_ranked(v).select("ord", F.concat(F.lit(" "), "text").alias("value")).unionByName(v.spark.createDataFrame([(-1, "Search Term"), (0, "  ")], "ord int, value string"))))
query("s6_merge_terms", "words terms", f"""
WITH i AS (SELECT text AS term, file_name, {_NTH} FROM words), f AS (SELECT lower(term) AS key, min(ord) AS ord FROM i GROUP BY 1)
SELECT term, active, ord FROM terms UNION ALL SELECT key, true, ord FROM f WHERE key NOT IN (SELECT lower(term) FROM terms)""")(
    lambda v: st.merge_terms(v.terms, _ranked(v).select(F.lower("text").alias("term"), "ord")).withColumn("ord", F.col("ord").cast("long")))


def _ranked(v):
    """All words with their number in their document."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file_name").orderBy("page", "block_no", "line_no", "word_no")
    return v.words.withColumn("ord", F.row_number().over(w))


query("a1_chunks", "pages", "SELECT file_name, (page - 1) // 5 * 5 + 1 AS start_page, max(page) AS end_page, string_agg(text || chr(10) || chr(10), '' ORDER BY page) AS text FROM pages_t GROUP BY file_name, (page - 1) // 5")(lambda v: sec.chunk_pages(v.pages))
_SECT = """
l1 AS (SELECT t.*, total_pages, lead(t.page) OVER (PARTITION BY file_name ORDER BY t.page, toc_index) AS nxt, row_number() OVER (PARTITION BY file_name ORDER BY t.page, toc_index) AS n FROM toc t JOIN files USING (file_name) WHERE level = 1 AND t.page > 1)"""
query("a2_sections", "toc files", f"""WITH {_SECT}
SELECT file_name, page AS start_page, greatest(page, coalesce(nxt - 1, total_pages)) AS end_page, title FROM l1
UNION ALL SELECT file_name, 1, page - 1, '' FROM l1 WHERE n = 1 UNION ALL SELECT file_name, 1, total_pages, '' FROM files WHERE file_name NOT IN (SELECT file_name FROM l1)""")(lambda v: sec.sections(v.toc.filter("page > 1"), v.files))
_RANGE = f"""{_SECT},
pr AS (SELECT DISTINCT t.file_name, t.page, total_pages FROM toc t JOIN files USING (file_name)),
rg AS (SELECT p.file_name, p.page, coalesce((SELECT max(page) FROM l1 WHERE l1.file_name = p.file_name AND l1.page <= p.page), 1) AS start_page,
  coalesce((SELECT min(page) FROM l1 WHERE l1.file_name = p.file_name AND l1.page > p.page) - 1, total_pages) AS end_page,
  coalesce((SELECT arg_max(title, page) FROM l1 WHERE l1.file_name = p.file_name AND l1.page <= p.page), '') AS section_title FROM pr p)"""
query("a3_section_range", "toc files", f"WITH {_RANGE} SELECT * FROM rg")(lambda v: sec.section_range(v.toc, v.toc.filter("page > 1"), v.files))
query("a4_section_chunk", "toc files", f"""WITH {_RANGE} SELECT file_name, page, CASE WHEN end_page - start_page + 1 <= 2 THEN start_page ELSE start_page + (page - start_page) // 2 * 2 END AS chunk_start,
CASE WHEN end_page - start_page + 1 <= 2 THEN end_page ELSE least(end_page, start_page + (page - start_page) // 2 * 2 + 1) END AS chunk_end FROM rg""")(
    lambda v: sec.section_chunk(sec.section_range(v.toc, v.toc.filter("page > 1"), v.files), 2).select("file_name", "page", "chunk_start", "chunk_end"))
query("a5_document_context", "toc files pages", f"""WITH {_SECT},
cut AS (SELECT file_name, greatest(1, least(coalesce((SELECT min(page) FROM l1 WHERE l1.file_name = f.file_name) - 1, 5), total_pages, 8)) AS cut FROM files f),
fr AS (SELECT file_name, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page) FILTER (page <= 2), '') AS title_text, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page) FILTER (page > 2), '') AS toc_text FROM pages_t JOIN cut USING (file_name) WHERE page <= cut GROUP BY file_name),
ol AS (SELECT file_name, string_agg(repeat('  ', level - 1) || title || ' (p.' || page || ')', chr(10) ORDER BY toc_index) AS outline FROM toc WHERE page > 1 GROUP BY file_name)
SELECT fr.*, coalesce(outline, '') AS outline FROM fr LEFT JOIN ol USING (file_name)""")(lambda v: sec.document_context(v.pages, v.toc.filter("page > 1"), v.files))
query("b1_bookmark_ranges", "toc files", "SELECT t.*, greatest(t.page, coalesce(lead(t.page) OVER (PARTITION BY file_name ORDER BY toc_index) - 1, total_pages)) AS end_page FROM toc t JOIN files USING (file_name)")(lambda v: sec.bookmark_ranges(v.toc, v.files))
query("b2_bookmark_terms", "toc", """
SELECT file_name, toc_index, title, CASE WHEN contains(lower(title), 'eau') THEN 'Eau' WHEN regexp_matches(lower(title), '(^|[^\\p{L}\\p{M}\\p{N}_])than') THEN 'than*' WHEN contains(lower(title), 'erin') THEN 'erin' WHEN contains(lower(title), 'of the') THEN 'of the' WHEN regexp_matches(lower(title), 'tion($|[^\\p{L}\\p{M}\\p{N}_])') THEN '*tion' END AS term FROM toc
WHERE term IS NOT NULL""")(lambda v: sec.bookmark_terms(v.toc, v.terms, "Eau"))
query("b3_redact_titles", "toc", "SELECT file_name, toc_index, regexp_replace(title, '(?i)the', '█████', 'g') AS new_title FROM toc WHERE contains(lower(title), 'the')")(
    lambda v: sec.redact_titles(v.toc.filter(F.contains(F.lower("title"), F.lit("the"))).withColumn("term", F.lit("*the"))).select("file_name", "toc_index", "new_title"))
query("b4_apply_edits", "toc edits", "SELECT t.file_name, t.toc_index, level, coalesce(new_title, title) AS title, page FROM toc t LEFT JOIN edits USING (file_name, toc_index)")(lambda v: sec.apply_toc_edits(v.toc, edits(v)))
query("b5_redact_bookmark_pages", "toc words", """SELECT file_name, page, round(x0 + 6.0 * (instr(lower(text), 'ntst') - 1), 6) AS x, 'bookmark#' || file_name || '#' || (page - 1) AS batch_id FROM words WHERE contains(lower(text), 'ntst')""")(
    lambda v: sec.redact_bookmark_pages(v.toc, v.files, v.words, "ntst", dehyphenate=False).select("file_name", "page", F.round("x", 6).alias("x"), "batch_id"))
