"""Queries of the transfer between two versions of a document."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.functions.grids import look_up
from pagemask.operators import transfer as tr
from pagemask.plans.detect_queries import cells, dest_cells, tables
from pagemask.plans.register import query
from pagemask.plans.views_sql import VIEWS
from pagemask.sources.layout import page_text, read_words, stream_dir, words_from_text

VIEWS["annots"] = ([], """
  annots AS (SELECT event_id AS annot_id, 'doc_' || (user_id % 50) || '.pdf' AS file_name, (event_id % 4 + 1)::INT AS page, CASE WHEN event_id % 7 = 0 THEN 4 WHEN event_id % 4 = 0 THEN 25 WHEN event_id % 4 = 1 THEN 8 WHEN event_id % 4 = 2 THEN 13 ELSE 9 END AS annot_type,
    CASE WHEN event_id % 7 = 0 THEN 'Note' WHEN event_id % 4 = 1 THEN 'Redact' WHEN event_id % 4 = 3 THEN 'My redaction' END AS subject, (event_id % 400)::DOUBLE AS ax, (event_id % 600)::DOUBLE AS ay, 4 * (event_id % 3) AS nv FROM events)""")
VIEWS["drawings"] = ([], """
  drawings AS (SELECT 'doc_' || (event_id % 40) || '.pdf' AS file_name, (event_id // 40 % 3 + 1)::INT AS page, event_id AS drawing_id, (event_id * 37 % 500)::DOUBLE AS x0, (event_id * 53 % 700)::DOUBLE AS y0, (event_id * 37 % 500 + 20)::DOUBLE AS x1, (event_id * 53 % 700 + 10)::DOUBLE AS y1 FROM events)""")
VIEWS["amended"] = ([], r"""
  am_lines AS (SELECT 'doc_' || doc_id || '.pdf' AS file_name, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(substr(text, instr(text, chr(10)) + 1), chr(10)) AS l FROM documents)),
  am_tokens AS (SELECT file_name, i // 5 + 1 AS page, i % 5 AS block_no, unnest(range(len(t))) AS k, unnest(t) AS text0 FROM (SELECT file_name, i, list_filter(regexp_split_to_array(line, '[ \t\r]+'), lambda x: x <> '') AS t FROM am_lines)),
  am_xy AS (SELECT *, k // 12 AS line_no, k % 12 AS word_no, 72.0::DOUBLE + 6.0 * coalesce(sum(length(text0) + 1) OVER (PARTITION BY file_name, page, block_no, k // 12 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x0,
    72.0::DOUBLE + 12.0 * (dense_rank() OVER (PARTITION BY file_name, page ORDER BY block_no, k // 12) - 1)::DOUBLE AS y0, row_number() OVER (PARTITION BY file_name, page ORDER BY block_no, k) AS nth FROM am_tokens),
  amended AS (SELECT file_name, page, block_no, line_no, word_no, x0, y0, x0 + 6.0 * length(text0) AS x1, y0 + 10.0 AS y1, CASE WHEN nth % 17 = 0 THEN 'x' || text0 ELSE text0 END AS text FROM am_xy),
  am_off AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY file_name, page ORDER BY block_no, line_no, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM amended),
  am_pages AS (SELECT file_name, page, string_agg(text, ' ' ORDER BY block_no, line_no, word_no) AS text FROM amended GROUP BY file_name, page)""")
VIEWS["drawn"] = (["drawings"], """
  dbox AS (SELECT drawing_id::VARCHAR AS id, file_name, page, x0 - 60 AS x, y0 - 60 AS y FROM drawings WHERE drawing_id % 11 = 0),
  dg AS (SELECT b.id, b.x, b.y, count(*) AS count, count(*) FILTER (d.x0 < b.x + 150 AND d.x1 > b.x AND d.y0 < b.y + 150 AND d.y1 > b.y) AS hit, min(d.x0) AS x0, min(d.y0) AS y0, max(d.x1) AS x1, max(d.y1) AS y1
    FROM dbox b JOIN drawings d ON b.file_name = d.file_name AND b.page = d.page AND d.x0 <= b.x + 180 AND d.x1 >= b.x - 30 AND d.y0 <= b.y + 180 AND d.y1 >= b.y - 30 GROUP BY b.id, b.x, b.y),
  dhit AS (SELECT * FROM dg WHERE greatest(0, least(x1, x + 150) - greatest(x0, x)) * greatest(0, least(y1, y + 150) - greatest(y0, y)) / ((x1 - x0) * (y1 - y0)) >= 0.8)""")
VIEWS["tboxes"] = (["cells"], """
  tboxes AS (SELECT concat_ws('#', file_name, page, table_idx, row_idx) AS id, file_name, page, table_idx, row_idx AS seq, x0 + 2 AS x, y0 + 2 AS y, CASE row_idx % 3 WHEN 0 THEN 50.0 WHEN 1 THEN 70.0 ELSE 110.0 END::DOUBLE AS w, CASE WHEN row_idx % 4 = 3 THEN 20.0 ELSE 9.0 END::DOUBLE AS h, text, k
    FROM cells WHERE row_idx > 0 AND col_idx = 1)""")
VIEWS["bounds"] = (["cells"], """
  sb AS (SELECT file_name, page, table_idx, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM cells GROUP BY ALL),
  db AS (SELECT file_name, page, table_idx, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM dest GROUP BY ALL)""")
# The key cells of each table with their neighbours, by equal places only.
VIEWS["keys"] = (["cells"], """
  nb AS (SELECT *, lag(text) OVER c AS up, lead(text) OVER c AS down, lag(text) OVER r AS "left", lead(text) OVER r AS "right" FROM cells WINDOW c AS (PARTITION BY file_name, page, table_idx, col_idx ORDER BY row_idx), r AS (PARTITION BY file_name, page, table_idx, row_idx ORDER BY col_idx)),
  dn AS (SELECT *, lag(text) OVER c AS up, lead(text) OVER c AS down, lag(text) OVER r AS "left", lead(text) OVER r AS "right" FROM dest WINDOW c AS (PARTITION BY file_name, page, table_idx, col_idx ORDER BY row_idx), r AS (PARTITION BY file_name, page, table_idx, row_idx ORDER BY col_idx)),
  sz AS (SELECT file_name, page, table_idx, max(row_idx) + 1 AS r FROM cells GROUP BY ALL),
  fp AS (SELECT n.* FROM nb n JOIN sz USING (file_name, page, table_idx) WHERE (row_idx IN (0, r - 1) AND col_idx IN (0, 3)) OR (row_idx = r // 2 AND col_idx = 2))""")
VIEWS["sboxes"] = (["boxes"], """
  u0 AS (SELECT b.id, w.* FROM boxes b JOIN words w ON b.file_name = w.file_name AND b.page = w.page
    AND greatest(0, least(w.x1, b.x + b.w) - greatest(w.x0, b.x)) * greatest(0, least(w.y1, b.y + b.h) - greatest(w.y0, b.y)) >= 0.5 * (w.x1 - w.x0) * (w.y1 - w.y0)),
  sboxes AS (SELECT b.*, u.text FROM boxes b LEFT JOIN (SELECT id, string_agg(text, ' ' ORDER BY block_no, line_no, word_no) AS text FROM u0 GROUP BY id) u USING (id))""")


def annots(v):
    e = v.table("events")
    k, n = F.col("event_id"), (4 * (F.col("event_id") % 3)).cast("int")
    kind = F.when(k % 7 == 0, 4).when(k % 4 == 0, 25).when(k % 4 == 1, 8).when(k % 4 == 2, 13).otherwise(9)
    subject = F.when(k % 7 == 0, "Note").when(k % 4 == 1, "Redact").when(k % 4 == 3, "My redaction")
    x, y = (k % 400).cast("double"), (k % 600).cast("double")
    vert = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((x + 10 * (i % 2)).alias("x"), (y + 5 * (F.floor(i / 2) % 2) + 12 * F.floor(i / 4)).alias("y")))
    return e.select(
        k.alias("annot_id"), F.concat(F.lit("doc_"), (F.col("user_id") % 50).cast("string"), F.lit(".pdf")).alias("file_name"), (k % 4 + 1).cast("int").alias("page"), kind.alias("annot_type"), subject.alias("subject"),
        F.struct(x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 8).alias("y1")).alias("rect"), F.when(n > 0, vert).alias("vertices"),
    )


def drawings(v, shift=0.0):
    k = F.col("event_id")
    x, y = (k * 37 % 500).cast("double") + shift, (k * 53 % 700).cast("double") + shift
    return v.table("events").select(F.concat(F.lit("doc_"), (k % 40).cast("string"), F.lit(".pdf")).alias("file_name"), (F.floor(k / 40) % 3 + 1).cast("int").alias("page"), k.alias("drawing_id"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 10).alias("y1"))


def table_boxes(v):
    own = F.filter("cells", lambda c: (c["row_idx"] > 0) & (c["col_idx"] == 1))
    c, n = tables(v).select("file_name", "page", "table_idx", F.inline(own)), F.col("row_idx") % 3
    wide = F.when(n == 0, 50.0).when(n == 1, 70.0).otherwise(110.0)
    return c.select(
        F.concat_ws("#", "file_name", "page", "table_idx", "row_idx").alias("id"), "file_name", "page", "table_idx", F.col("row_idx").alias("seq"), (F.col("x0") + 2).alias("x"), (F.col("y0") + 2).alias("y"),
        wide.alias("w"), F.when(F.col("row_idx") % 4 == 3, 20.0).otherwise(9.0).alias("h"), "text",
    )


def source_boxes(v):
    from pagemask.operators.search import text_under_boxes

    return text_under_boxes(v.boxes, v.words)


def amended(v):
    """Words of the next version: the first line dropped, every 17th word of a page changed."""
    d = v.table("documents").withColumn("text", F.expr("substring(text, locate('\n', text) + 1)"))
    w = words_from_text(d)
    n = F.row_number().over(W.partitionBy("file_name", "page").orderBy("block_no", "line_no", "word_no"))
    return w.withColumn("text", F.when(n % 17 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))


def window(v):
    return tr.page_window(v.files, v.files.withColumn("total_pages", F.greatest(F.lit(1), F.col("total_pages") - F.col("total_pages") % 2)))


def matches(v):
    return tr.match_tables(tables(v), tables(v, moved=True))


query("m1_classify_annotations", "annots", "SELECT annot_id, CASE WHEN annot_type = 25 THEN 'type25' WHEN lower(subject) = 'redact' THEN 'subject' WHEN contains(lower(subject), 'redact') THEN 'subject_part' ELSE 'stamp' END AS label FROM annots WHERE annot_type <> 4")(
    lambda v: tr.classify_annotations(annots(v)).select("annot_id", "label"))
query("m2_annotation_boxes", "annots", """SELECT annot_id, 0::INT AS n, ax AS x, ay AS y, 30.0::DOUBLE AS w, 8.0::DOUBLE AS h, 'rectangle' AS selection_mode FROM annots WHERE nv = 0
UNION ALL SELECT annot_id, q::INT, ax, ay + 12 * q, 10.0, 5.0, 'highlight' FROM (SELECT *, unnest(range(nv // 4)) AS q FROM annots)""")(
    lambda v: tr.annotation_boxes(annots(v)).select("annot_id", "n", "x", "y", "w", "h", "selection_mode"))
query("m3_split_by_lines", "sboxes", """SELECT id, (row_number() OVER (PARTITION BY id ORDER BY block_no, line_no))::INT AS n, min(x0) AS x, min(y0) AS y, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM u0 GROUP BY id, block_no, line_no""")(lambda v: tr.split_by_lines(v.boxes, v.words))
query("m4_box_text_context", "sboxes pages", r"""
WITH t AS (SELECT s.id, trim(s.text) AS text, p.text AS f, instr(lower(p.text), lower(trim(s.text))) AS whole, array_to_string(string_split(trim(s.text), ' ')[1:3], ' ') AS head FROM sboxes s JOIN pages_t p USING (file_name, page)),
a AS (SELECT *, CASE WHEN whole > 0 THEN whole ELSE instr(lower(f), lower(head)) END AS p, CASE WHEN whole > 0 THEN length(text) ELSE length(head) END AS n FROM t),
c AS (SELECT *, greatest(1, p - 50) AS low, least(length(f), p + n - 1 + 50) AS high FROM a),
x AS (SELECT *, substr(f, low, high - low + 1) AS raw FROM c)
SELECT id, text, CASE WHEN high < length(f) THEN regexp_replace(CASE WHEN low > 1 THEN regexp_replace(raw, '^[^ ]* ', '') ELSE raw END, ' [^ ]*$', '') ELSE CASE WHEN low > 1 THEN regexp_replace(raw, '^[^ ]* ', '') ELSE raw END END AS context FROM x WHERE p > 0""")(
    lambda v: tr.box_text_context(v.boxes, v.words))
query("m5_text_coverage", "sboxes", """WITH k AS (SELECT file_name, page, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY ALL)
SELECT b.id, round(least(1.0, sum(greatest(0, least(k.x1, b.x + b.w) - greatest(k.x0, b.x)) * greatest(0, least(k.y1, b.y + b.h) - greatest(k.y0, b.y))) / (b.w * b.h)), 6) AS coverage, true AS has_text FROM boxes b JOIN k USING (file_name, page) GROUP BY b.id, b.w, b.h""")(
    lambda v: tr.text_coverage(v.boxes, v.words).select("id", F.round("coverage", 6).alias("coverage"), "has_text"))
def _mixed(v):
    """Boxes over tables, over drawings and over text."""
    columns = ["id", "file_name", "page", "x", "y", "w", "h"]
    return table_boxes(v).select(*columns).unionByName(_drawn(v).select(*columns)).unionByName(v.boxes.select(*columns))


# A box is a table's if one covers 80 % of it; a drawing's if it hits five drawings and covers 80 % of those near it; else a text's; drawings' boxes over text are both.
query("m6_classify_boxes", "tboxes drawn boxes bounds", """
WITH kt AS (SELECT t.id FROM tboxes t JOIN sb b ON t.file_name = b.file_name AND t.page = b.page AND greatest(0, least(t.x + t.w, b.x1) - greatest(t.x, b.x0)) * greatest(0, least(t.y + t.h, b.y1) - greatest(t.y, b.y0)) >= 0.8 * t.w * t.h),
kb AS (SELECT file_name, page, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY ALL),
tx AS (SELECT DISTINCT d.id FROM dbox d JOIN kb k ON k.file_name = d.file_name AND k.page = d.page AND k.x0 < d.x + 150 AND k.x1 > d.x AND k.y0 < d.y + 150 AND k.y1 > d.y)
SELECT id, CASE WHEN id IN (SELECT id FROM kt) THEN 'TABLE' ELSE 'TEXT' END AS kind FROM tboxes UNION ALL SELECT id, 'TEXT' FROM boxes
UNION ALL SELECT id, 'DRAWING' FROM dhit WHERE hit >= 5 UNION ALL SELECT id, 'TEXT' FROM dbox WHERE id NOT IN (SELECT id FROM dhit WHERE hit >= 5) OR id IN (SELECT id FROM tx)""")(
    lambda v: tr.classify_boxes(_mixed(v), cells(v), drawings(v), v.words))
query("m7_table_hits", "tboxes bounds", """
WITH b AS (SELECT t.id, t.file_name, t.page, s.table_idx, greatest(x, s.x0) AS a, greatest(y, s.y0) AS b, least(x + w, s.x1) AS c, least(y + h, s.y1) AS d FROM tboxes t JOIN sb s ON t.file_name = s.file_name AND t.page = s.page AND x < s.x1 AND x + w > s.x0 AND y < s.y1 AND y + h > s.y0)
SELECT b.id, b.table_idx, count(*) FILTER (greatest(0, least(c, x1) - greatest(a, x0)) * greatest(0, least(d, y1) - greatest(b, y0)) > 0.2 * (c - a) * (d - b)) AS n_cells
FROM b JOIN cells USING (file_name, page, table_idx) GROUP BY b.id, b.table_idx""")(lambda v: tr.table_hits(table_boxes(v), cells(v)))
query("m7_subtract_rect", "tboxes", """WITH b AS (SELECT id, x, y, w, h, x + 20 AS a, x + 30 AS c, y + 3 AS b, y + 8.5 AS d FROM tboxes)
SELECT id, 'top' AS side, x AS x0, y AS y0, x + w AS x1, b AS y1 FROM b UNION ALL SELECT id, 'left', x, b, a, d FROM b UNION ALL SELECT id, 'right', c, b, x + w, d FROM b UNION ALL SELECT id, 'bottom', x, d, x + w, y + h FROM b WHERE h > 10""")(
    lambda v: tr.subtract_rect(table_boxes(v).withColumns({"tx0": F.col("x") + 20, "tx1": F.col("x") + 30, "ty0": F.col("y") + 3, "ty1": F.col("y") + 8.5})))


def _drawn(v):
    return drawings(v).filter("drawing_id % 11 = 0").select(F.col("drawing_id").cast("string").alias("id"), "file_name", "page", F.col("drawing_id").alias("seq"), (F.col("x0") - 60).alias("x"), (F.col("y0") - 60).alias("y"), F.lit(150.0).alias("w"), F.lit(150.0).alias("h"))


query("m8_drawing_overlap", "drawn", "SELECT id, count, x0, y0, x1, y1, greatest(0, least(1, (x - x0) / (x1 - x0))) AS rx0, greatest(0, least(1, (y + 150 - y0) / (y1 - y0))) AS ry1 FROM dhit WHERE hit >= 3")(
    lambda v: tr.drawing_overlap(_drawn(v), drawings(v), cells(v), least=3).select("id", "count", "x0", "y0", "x1", "y1", "rx0", "ry1"))
query("m9_drawing_clusters")(lambda v: tr.drawing_clusters(drawings(v)))
query("m9_cluster_totals", "drawings", "SELECT file_name, page, count(*) AS n, min(x0) AS x0, max(y1) AS y1 FROM drawings GROUP BY ALL")(
    lambda v: tr.drawing_clusters(drawings(v)).groupBy("file_name", "page").agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("y1").alias("y1")))
query("m10_signature", "drawings", "SELECT file_name, page, printf('count:%d|w:%.1f|h:%.1f|aspect:%.2f|density:%.4f', count(*), max(x1) - min(x0), max(y1) - min(y0), (max(x1) - min(x0)) / (max(y1) - min(y0)), count(*) / ((max(x1) - min(x0)) * (max(y1) - min(y0)))) AS sig FROM drawings GROUP BY ALL")(
    lambda v: _page_shape(v).select("file_name", "page", tr.cluster_signature(*[F.col(c) for c in ("n", "x0", "y0", "x1", "y1")]).alias("sig")))


def _page_shape(v, shift=0.0):
    g = drawings(v, shift).groupBy("file_name", "page").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.withColumn("cluster", F.lit(0))


query("m10_parse_signature", "drawings", "SELECT file_name, page, count(*)::DOUBLE AS n FROM drawings GROUP BY ALL")(
    lambda v: _page_shape(v).select("file_name", "page", tr.parse_signature(tr.cluster_signature(*[F.col(c) for c in ("n", "x0", "y0", "x1", "y1")]))["count"].alias("n")))
_MC = """WITH g AS (SELECT file_name, page, count(*)::DOUBLE AS n, min(x0) AS x0, min(y0) AS y0, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM drawings GROUP BY ALL),
j AS (SELECT s.file_name, s.page AS s_page, t.page, 1 - abs(s.n - t.n) / greatest(s.n, t.n) AS c, (1 - abs(s.w - t.w) / greatest(s.w, t.w) + 1 - abs(s.h - t.h) / greatest(s.h, t.h)) / 2 AS d,
  1 - abs(s.w / s.h - t.w / t.h) / greatest(s.w / s.h, t.w / t.h) AS a, 1 - (abs(s.x0 - t.x0 - 5) / 595 + abs(s.y0 - t.y0 - 5) / 842) / 2 AS p,
  1 - abs(s.n / (s.w * s.h) - t.n / (t.w * t.h)) / greatest(s.n / (s.w * s.h), t.n / (t.w * t.h)) AS q FROM g s JOIN g t ON s.file_name = t.file_name AND abs(s.page - t.page) <= 1)
"""
query("m11_match_clusters", "drawings", _MC + "SELECT file_name, s_page, page, round(0.3 * d + 0.2 * a + 0.3 * p + 0.2 * c, 6) AS score FROM j WHERE 0.3 * d + 0.2 * a + 0.3 * p + 0.2 * c >= 0.65 AND least(d, a, p, c) >= 0.5 QUALIFY row_number() OVER (PARTITION BY file_name, s_page ORDER BY 0.3 * d + 0.2 * a + 0.3 * p + 0.2 * c DESC, page) = 1")(
    lambda v: tr.match_clusters(_page_shape(v), _page_shape(v, 5.0), 1).select("file_name", "s_page", "page", F.round("score", 6).alias("score")))
query("m11_match_clusters_density", "drawings", _MC + "SELECT file_name, s_page, page, round(0.2 * c + 0.3 * d + 0.2 * a + 0.3 * q, 6) AS score FROM j QUALIFY row_number() OVER (PARTITION BY file_name, s_page ORDER BY round(0.2 * c + 0.3 * d + 0.2 * a + 0.3 * q, 12) DESC, page) = 1")(
    lambda v: tr.match_clusters(_page_shape(v), _page_shape(v, 5.0), 1, "density").select("file_name", "s_page", "page", F.round("score", 6).alias("score")))
query("m12_fingerprint", "keys", 'SELECT file_name, page, table_idx, row_idx, col_idx, text, up, down, "left", "right" FROM fp')(lambda v: tr.table_fingerprint(cells(v)))


def _titles(v, own):
    """A title for each table that names its order: on both sides of every file but each third."""
    t = tables(v, moved=not own)
    k = F.regexp_extract("file_name", "([0-9]+)", 1).cast("long")
    return t.select("file_name", "page", "table_idx", F.when(k % 3 > 0, F.concat(F.lit("Lines of order "), F.col("k").cast("string"))).alias("title"))


# Each table's own next version stands in the other place of the next page, among up to three others with equal headers.
_OWN = "SELECT DISTINCT file_name, page AS s_page, table_idx AS s_table, page + 1 AS page, 1 - table_idx AS table_idx FROM cells"
query("m13_match_tables", "cells", _OWN)(lambda v: matches(v).drop("score"))
query("m13_match_tables_titles", "cells", _OWN)(lambda v: tr.match_tables(tables(v), tables(v, moved=True), variant="older", source_titles=_titles(v, True), target_titles=_titles(v, False)).drop("score"))
query("m13_match_tables_older", "cells", _OWN)(lambda v: tr.match_tables(tables(v), tables(v, moved=True), variant="older").drop("score"))
_BOTH = "b.id, d.file_name, d.page, b.page AS s_page, b.table_idx AS s_table, s.x0 AS sx0, s.y0 AS sy0, s.x1 AS sx1, s.y1 AS sy1, d.x0 AS tx0, d.y0 AS ty0, d.x1 AS tx1, d.y1 AS ty1, b.x, b.y, b.w, b.h FROM tboxes b JOIN sb s ON b.file_name = s.file_name AND b.page = s.page AND b.table_idx = s.table_idx JOIN db d ON d.file_name = s.file_name AND d.page = s.page + 1 AND d.table_idx = 1 - s.table_idx"
query("m14_relative", "tboxes bounds", f"""WITH j AS (SELECT {_BOTH})
SELECT id, round(tx0 + (x - sx0) * (tx1 - tx0) / (sx1 - sx0), 6) AS x, round(ty0 + (y - sy0) * (ty1 - ty0) / (sy1 - sy0), 6) AS y, round(w * (tx1 - tx0) / (sx1 - sx0), 6) AS w, round(h * (ty1 - ty0) / (sy1 - sy0), 6) AS h FROM j""")(lambda v: _relative(v))


def _truth(v):
    """The matches as the next version is made."""
    return tables(v).select("file_name", F.col("page").alias("s_page"), F.col("table_idx").alias("s_table"), (F.col("page") + 1).alias("page"), (1 - F.col("table_idx")).alias("table_idx"))


def _relative(v):
    def bounds(c, p, own):
        return tr.table_bounds(c).select(*[F.col(a).alias(b) for a, b in zip(tr.TABLE, own)], *[F.col(k).alias(p + k) for k in ("x0", "y0", "x1", "y1")])

    own = ["file_name", "s_page", "s_table"]
    b = table_boxes(v).withColumnsRenamed({"page": "s_page", "table_idx": "s_table"}).join(_truth(v), own)
    b = b.join(bounds(cells(v), "s", own), own).join(bounds(dest_cells(v), "t", tr.TABLE), tr.TABLE)
    return tr.transfer_relative(b).select("id", *[F.round(c, 6).alias(c) for c in "xywh"])


_ANCHOR = """
an AS (SELECT s.file_name, s.page AS s_page, s.table_idx AS s_table, s.row_idx, s.col_idx, d.x0 - s.x0 AS dx, d.y0 - s.y0 AS dy, CASE WHEN lower(d.text) = lower(s.text) THEN 2 ELSE 0 END
    + CASE WHEN d.up <> '' AND lower(d.up) = lower(s.up) THEN 1 ELSE 0 END + CASE WHEN d.down <> '' AND lower(d.down) = lower(s.down) THEN 1 ELSE 0 END + CASE WHEN d."left" <> '' AND lower(d."left") = lower(s."left") THEN 1 ELSE 0 END + CASE WHEN d."right" <> '' AND lower(d."right") = lower(s."right") THEN 1 ELSE 0 END AS anchor
  FROM fp s JOIN dn d ON d.file_name = s.file_name AND d.page = s.page + 1 AND d.table_idx = 1 - s.table_idx AND d.row_idx = s.row_idx AND d.col_idx = s.col_idx),
ba AS MATERIALIZED (SELECT * FROM an WHERE anchor >= 2 QUALIFY row_number() OVER (PARTITION BY file_name, s_page, s_table ORDER BY anchor DESC, row_idx, col_idx) = 1)"""
query("m15_anchors", "keys", f"WITH {_ANCHOR} SELECT file_name, s_page, s_table, anchor, dx, dy FROM ba")(lambda v: tr.anchor_cells(tables(v), tables(v, moved=True), _truth(v)).select("file_name", "s_page", "s_table", "anchor", "dx", "dy"))


def _emptied(v):
    """The next version, where the tables of every fourth file have lost all texts: they have no anchor."""
    lost = F.regexp_extract("file_name", "([0-9]+)", 1).cast("long") % 4 == 0
    return tables(v, True, lambda text, row, col: F.when(lost, F.concat(F.lit("#"), row.cast("string"), F.lit("#"), col.cast("string"))).otherwise(text))


query("m15_transfer_anchored", "keys tboxes bounds", f"""WITH {_ANCHOR}, j AS MATERIALIZED (SELECT {_BOTH}), lost AS (SELECT *, regexp_extract(file_name, '([0-9]+)', 1)::BIGINT % 4 = 0 AS gone FROM j)
SELECT l.id, l.file_name, l.page, round(CASE WHEN gone THEN tx0 + (l.x - sx0) * (tx1 - tx0) / (sx1 - sx0) ELSE l.x + a.dx END, 6) AS x, round(CASE WHEN gone THEN ty0 + (l.y - sy0) * (ty1 - ty0) / (sy1 - sy0) ELSE l.y + a.dy END, 6) AS y,
  round(CASE WHEN gone THEN l.w * (tx1 - tx0) / (sx1 - sx0) ELSE l.w END, 6) AS w, CASE WHEN gone THEN 'relative' ELSE 'anchor' END AS how
FROM lost l JOIN ba a ON a.file_name = l.file_name AND a.s_page = l.s_page AND a.s_table = l.s_table""")(
    lambda v: tr.transfer_anchored(table_boxes(v), tables(v), _emptied(v), _truth(v)).select("id", "file_name", "page", *[F.round(c, 6).alias(c) for c in "xyw"], "how"))
query("m16_containing_cell", "tboxes keys", """
WITH o AS (SELECT t.id, n.table_idx, n.row_idx, n.col_idx, n.text, n.up, n.down, n."left", n."right", t.x - n.x0 AS dx, t.y - n.y0 AS dy, greatest(0, least(t.x + t.w, n.x1) - greatest(t.x, n.x0)) * greatest(0, least(t.y + t.h, n.y1) - greatest(t.y, n.y0)) AS cut
  FROM tboxes t JOIN nb n ON n.file_name = t.file_name AND n.page = t.page)
SELECT id, table_idx, row_idx, col_idx, text, up, down, "left", "right", dx, dy FROM o WHERE cut > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cut DESC, row_idx, col_idx) = 1""")(
    lambda v: tr.containing_cell(table_boxes(v), tables(v)).select("id", "table_idx", "row_idx", "col_idx", "text", *tr.SIDES, "dx", "dy"))


def _cell_matches(v):
    return tr.match_cells(tr.containing_cell(table_boxes(v), tables(v)), tables(v, moved=True))


query("m17_match_cells")(lambda v: _cell_matches(v).select("id", "page", "table_idx", "row_idx", "col_idx", F.round("score", 4).alias("score")))
query("m18_cell_content")(lambda v: tr.match_cell_content(table_boxes(v), tables(v, moved=True)))


def _true_cells(v):
    """Each reference with its own cell of the next version."""
    refs = tr.containing_cell(table_boxes(v), tables(v))
    offsets = ["w", "h", "dx", "dy", *[f"{s}_d{c}" for s in tr.SIDES for c in "xy"]]
    own = refs.select("id", "file_name", (F.col("page") + 1).alias("page"), (1 - F.col("table_idx")).alias("_t"), F.col("row_idx").alias("_r"), F.col("col_idx").alias("_c"), *offsets)
    return tr.reconstruct(look_up(own, tables(v, moved=True), ("_t", "_r", "_c")))


# The mean of where the cell (weight 5) and each neighbour (weight 1) put the box: columns are stretched by 1.25, rows only moved.
query("m19_reconstruct", "tboxes keys", """
WITH o AS (SELECT t.id, t.page, t.x, t.y, t.w, t.h, n.file_name, n.table_idx, n.row_idx, n.col_idx, n.x0, greatest(0, least(t.x + t.w, n.x1) - greatest(t.x, n.x0)) * greatest(0, least(t.y + t.h, n.y1) - greatest(t.y, n.y0)) AS cut,
  n."left" IS NOT NULL AS l, n."right" IS NOT NULL AS r, n.up IS NOT NULL AS u, n.down IS NOT NULL AS d FROM tboxes t JOIN nb n ON n.file_name = t.file_name AND n.page = t.page),
c AS (SELECT * FROM o WHERE cut > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cut DESC, row_idx, col_idx) = 1)
SELECT id, page + 1 AS page, round(x + 7 + 0.25 * x0 + 0.25 * 60 * (r::INT - l::INT) / (5 + l::INT + r::INT + u::INT + d::INT), 4) AS x, round(y + 11 - 5 * table_idx, 4) AS y, w, h FROM c""")(
    lambda v: _true_cells(v).select("id", "page", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "w", "h"))
query("m20_page_window", "files", "WITH t AS (SELECT *, greatest(1, total_pages - total_pages % 2) AS t FROM files) SELECT file_name, t - total_pages AS page_offset, CASE WHEN t = total_pages THEN 2 ELSE abs(t - total_pages) END AS radius, t AS target_pages FROM t")(window)
query("m21_text_exact", "sboxes files amended", """
WITH t AS (SELECT file_name, total_pages, greatest(1, total_pages - total_pages % 2) AS n FROM files),
q AS (SELECT s.id AS b_id, s.file_name, lower(trim(s.text)) AS needle, unnest(range(greatest(1, s.page - r), greatest(greatest(1, s.page - r), least(n, s.page + r)) + 1)) AS page
  FROM sboxes s JOIN (SELECT *, CASE WHEN n = total_pages THEN 2 ELSE abs(n - total_pages) END AS r FROM t) w USING (file_name) WHERE length(trim(s.text)) >= 3),
p0 AS (SELECT b_id, file_name, page, length(needle) AS k, string_split(lower(text), needle) AS parts FROM q JOIN am_pages USING (file_name, page) WHERE contains(lower(text), needle)),
p1 AS (SELECT b_id, file_name, page, k, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * k + 1 AS p FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM p0)),
ln AS (SELECT b_id, p1.file_name, p1.page, p, block_no, line_no, min(x0 + (x1 - x0) / length(o.text) * greatest(0, p - 1 - start)) AS x0, min(y0) AS y0, max(x1 - (x1 - x0) / length(o.text) * greatest(0, start + length(o.text) - (p - 1 + k))) AS x1, max(y1) AS y1
  FROM p1 JOIN am_off o ON o.file_name = p1.file_name AND o.page = p1.page AND start < p - 1 + k AND start + length(o.text) > p - 1 GROUP BY ALL)
SELECT b_id, file_name, page::INT AS page, round(x0, 6) AS x0, y0, round(x1, 6) AS x1, y1 FROM ln""")(lambda v: _exact(v.stored()).withColumns({c: F.round(c, 6) for c in ("x0", "x1")}))


def _exact(v):
    return tr.transfer_text_exact(source_boxes(v), amended(v), window(v))


def _fuzzy(v):
    v = v.stored()
    path = stream_dir(v.spark)
    amended(v).write.parquet(path)
    s, t, w = source_boxes(v), read_words(v.spark, path), window(v)
    return tr.transfer_text_fuzzy(s, tr.transfer_text_exact(s, t, w), t, w)


query("m22_text_fuzzy")(lambda v: _fuzzy(v).select("b_id", "page", F.round("ratio", 4).alias("ratio"), "x0", "y0"))
query("m23_match_lines")(lambda v: tr.match_lines(source_boxes(v), amended(v), window(v)).withColumn("score", F.round("score", 4)))
query("m24_amend_prompts", "sboxes amended", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY seq) AS n FROM sboxes),
i AS (SELECT file_name, string_agg(n || '. ' || text || ' [' || coalesce(context, '') || ']', chr(10) ORDER BY n) AS items FROM n GROUP BY file_name),
p AS (SELECT file_name, string_agg('[PAGE ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS pages FROM am_pages GROUP BY file_name),
t AS (SELECT file_name, concat_ws(chr(10) || chr(10), 'Find each item in the new version.', items, pages, 'Reply with {"matches": [{"source", "text", "page"}]}.') AS prompt FROM i JOIN p USING (file_name))
SELECT file_name, length(prompt) AS n, sha1(prompt) AS digest FROM t""")(lambda v: tr.amend_prompts(source_boxes(v), page_text(amended(v))).select("file_name", F.length("prompt").alias("n"), F.sha1("prompt").alias("digest")))


def _replies(v):
    b = source_boxes(v).filter("length(text) > 2 AND text NOT LIKE '%\"%'")
    item = F.to_json(F.struct(F.col("text").alias("source"), "text", F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("page")).alias("page")))
    return b.groupBy("file_name").agg(F.concat(F.lit('```json\n{"matches": ['), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]}\n```")).alias("response"))


query("m24_parse_matches", "sboxes", """SELECT s.file_name, (SELECT arg_min(id, seq) FROM sboxes o WHERE o.file_name = s.file_name AND o.text = s.text) AS id, text, page FROM sboxes s WHERE length(text) > 2 AND NOT contains(text, '"') AND seq % 3 <> 0""")(
    lambda v: tr.parse_amend_matches(_replies(v), source_boxes(v)).select("file_name", "id", "text", "page"))
def _doubled(v):
    """Each box, and again, wider, after all others; the boxes are made once for both."""
    b, again = v.boxes.withColumn("again", F.explode(F.array(F.lit(False), F.lit(True)))), F.col("again")
    more = {"id": F.concat("id", F.lit("~")), "seq": F.col("seq") + 1_000_000, "w": F.col("w") * 1.5}
    return b.withColumns({c: F.when(again, e).otherwise(F.col(c)) for c, e in more.items()}).drop("again")


query("m25_suppress")(lambda v: tr.suppress_overlaps(_doubled(v), v.boxes.filter("seq % 3 = 0")).select("id"))
query("m26_finalize", "sboxes", "SELECT id, CASE WHEN h * (seq % 4) > 20 THEN 'rectangle' ELSE 'highlight' END AS selection_mode FROM sboxes WHERE length(trim(text)) >= 3")(
    lambda v: tr.finalize_boxes(source_boxes(v).withColumn("h", F.col("h") * (F.col("seq") % 4))).select("id", "selection_mode"))
query("m27_stats", "boxes", "SELECT file_name, page, count(*) FILTER (seq % 4 <> 0) AS matched, count(*) FILTER (seq % 4 = 0) AS missed, count(*) AS total FROM boxes GROUP BY GROUPING SETS ((file_name, page), ())")(
    lambda v: tr.transfer_stats(v.boxes, v.boxes.filter("seq % 4 <> 0").select(F.col("id").alias("b_id"))))
