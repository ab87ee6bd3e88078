"""Queries of tables, prompts, replies and located detections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.operators import detect as dt
from pagemask.operators import sections as sec
from pagemask.plans.register import query
from pagemask.plans.views_sql import VIEWS
from pagemask.sources.layout import stream_dir

# Four orders make a file: two pages with two tables of equal headers each. In the next version the two tables of a page have changed places,
# all pages come one later, the grid is moved and stretched, and some texts differ.
VIEWS["cells"] = ([], """
  c0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
  c1 AS (SELECT l_orderkey AS k, n AS row_idx, [l_partkey::VARCHAR, l_quantity::INT::VARCHAR, l_returnflag, strftime(l_shipdate, '%Y-%m-%d')] AS vals FROM c0
    UNION ALL SELECT DISTINCT l_orderkey, 0, ['part', 'quantity', 'flag', ''] FROM lineitem),
  c2 AS (SELECT k, row_idx, unnest(range(4)) AS col_idx, unnest(vals) AS text FROM c1),
  cells AS (SELECT 'orders_' || (k // 4) || '.pdf' AS file_name, (1 + k % 4 // 2)::INT AS page, (k % 2)::INT AS table_idx, row_idx::INT AS row_idx, col_idx::INT AS col_idx, 72.0::DOUBLE + 60 * col_idx AS x0, 100.0::DOUBLE + 14 * row_idx + 400 * (k % 2) AS y0,
    132.0::DOUBLE + 60 * col_idx AS x1, 114.0::DOUBLE + 14 * row_idx + 400 * (k % 2) AS y1, text, k FROM c2),
  dest AS (SELECT file_name, page + 1 AS page, 1 - table_idx AS table_idx, row_idx, col_idx, x0 * 1.25 + 7 AS x0, y0 + 11 - 5 * table_idx AS y0, x1 * 1.25 + 7 AS x1, y1 + 11 - 5 * table_idx AS y1,
    CASE WHEN k % 5 = 0 AND row_idx = 1 AND col_idx = 0 THEN 'x' || text ELSE text END AS text FROM cells),
  lines_c AS (SELECT file_name, page, table_idx, row_idx, list(text ORDER BY col_idx) AS line FROM cells GROUP BY ALL),
  tables AS (SELECT file_name, page, table_idx, list(line ORDER BY row_idx)[1] AS headers, list(line ORDER BY row_idx)[2:] AS rows, count(*) - 1 AS row_count, 4 AS col_count FROM lines_c GROUP BY ALL)""")
VIEWS["dets"] = (["results"], """
  dets AS (SELECT id, file_name, page, match AS text, context FROM results WHERE category = 'ai')""")


def cells(v, moved=False):
    """The cells of the tables, or those of the next version. Lines are dealt by their page, before they are made into cells: what is grouped or joined by page or table
    needs no shuffle of cells."""
    k, page, table = F.col("k"), 1 + F.floor(F.col("k") % 4 / 2), F.col("k") % 2
    place = {"file_name": F.concat(F.lit("orders_"), F.floor(k / 4).cast("string"), F.lit(".pdf")), "page": (page + int(moved)).cast("int"), "table_idx": (1 - table if moved else table).cast("int")}
    li = v.table("lineitem").withColumn("k", F.col("l_orderkey")).withColumns(place).repartition("file_name", "page")
    n = F.row_number().over(W.partitionBy("file_name", "page", "table_idx", "k").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    vals = F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    row = lambda n, vals: F.struct(n.alias("row_idx"), vals.alias("vals"))
    line, head = row(F.col("n"), vals), row(F.lit(0), F.array(*[F.lit(x) for x in ("part", "quantity", "flag", "")]))
    rows = li.withColumn("n", n).select(*place, "k", F.inline(F.when(F.col("n") == 1, F.array(head, line)).otherwise(F.array(line))))
    c = rows.select(*place, "k", "row_idx", F.posexplode("vals").alias("col_idx", "text"))
    x, y = F.lit(72.0) + 60.0 * F.col("col_idx"), F.lit(100.0) + 14.0 * F.col("row_idx") + 400.0 * table
    at = {"x0": x, "y0": y, "x1": x + 60, "y1": y + 14}
    if moved:
        down = 11 - 5.0 * table
        at = {"x0": x * 1.25 + 7, "y0": y + down, "x1": (x + 60) * 1.25 + 7, "y1": y + 14 + down}
    return c.select(*place, "row_idx", "col_idx", *[e.alias(name) for name, e in at.items()], "text", "k")


def tables(v, moved=False, changed=None):
    """`cells`, or `dest_cells` where moved, as one row a table with an array of them, made from lines: no cell is a row of its own. changed: a function of a table's columns and its
    cells' place that gives other texts."""
    k, page, table = F.col("k"), 1 + F.floor(F.col("k") % 4 / 2), F.col("k") % 2
    place = {"file_name": F.concat(F.lit("orders_"), F.floor(k / 4).cast("string"), F.lit(".pdf")), "page": (page + int(moved)).cast("int"), "table_idx": (1 - table if moved else table).cast("int")}
    li = v.table("lineitem").withColumn("k", F.col("l_orderkey")).withColumns(place).repartition("file_name", "page")
    vals = F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", vals.alias("vals"))
    li = li.groupBy(*place, "k").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    head = F.array(F.array(*[F.lit(x) for x in ("part", "quantity", "flag", "")]))

    def cell(text, row, col):
        x, y = F.lit(72.0) + 60.0 * col, F.lit(100.0) + 14.0 * row + 400.0 * table
        at = {"x0": x, "y0": y, "x1": x + 60, "y1": y + 14}
        if moved:
            down = 11 - 5.0 * table
            at = {"x0": x * 1.25 + 7, "y0": y + down, "x1": (x + 60) * 1.25 + 7, "y1": y + 14 + down}
            text = F.when((k % 5 == 0) & (row == 1) & (col == 0), F.concat(F.lit("x"), text)).otherwise(text)
        text = changed(text, row, col) if changed else text
        return F.struct(row.alias("row_idx"), col.alias("col_idx"), *[e.alias(name) for name, e in at.items()], text.alias("text"))

    rows = F.transform(F.concat(head, F.col("lines.vals")), lambda vals, row: F.transform(vals, lambda text, col: cell(text, row, col)))
    return li.select(*place, "k", F.flatten(rows).alias("cells"))


def dest_cells(v):
    text = F.when((F.col("k") % 5 == 0) & (F.col("row_idx") == 1) & (F.col("col_idx") == 0), F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    return cells(v, moved=True).withColumn("text", text)


def detections(v):
    return v.results.filter("category = 'ai'").select("id", "file_name", "page", F.col("match").alias("text"), "context")


def replies(v):
    """Model replies for each page: plain and fenced JSON arrays, and a broken one."""
    d = detections(v)
    item = F.to_json(F.struct(F.col("text"), F.col("page"), F.when(F.length("text") % 2 == 0, F.lit("high")).alias("confidence")))
    r = d.groupBy("file_name", "page").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]")).alias("j"))
    text = F.when(F.col("page") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "j", F.lit("\n```"))).when(F.col("page") % 5 == 0, F.lit("[{broken")).otherwise(F.col("j"))
    return r.select("file_name", F.col("page").alias("start_page"), text.alias("response"))


query("a6_inventory", "cells", """SELECT file_name, string_agg('- Table ' || n || ' (Page ' || page || ', 4 columns x ' || row_count || ' rows)', chr(10) ORDER BY n) || chr(10) || 'Total: ' || count(*) || ' tables' AS inventory
FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY page, table_idx) AS n FROM tables) GROUP BY file_name""")(
    lambda v: dt.table_inventory(dt.shape_tables(cells(v)).withColumn("title", F.lit(""))))
query("a7_shape_tables", "cells", "SELECT file_name, page, table_idx, headers, rows, row_count::INT AS row_count, col_count FROM tables")(lambda v: dt.shape_tables(cells(v)).select("file_name", "page", "table_idx", "headers", "rows", "row_count", "col_count"))


def captions(v):
    """Words above each table: a numbered line, long on every third file, one before it, and one too far away."""
    t = dt.shape_tables(cells(v))
    third = F.regexp_extract("file_name", "([0-9]+)", 1).cast("long") % 3 == 0
    text = F.concat(F.when(third, F.lit("Table 7: lines of this order are ")).otherwise(F.lit("Table 7: lines ")), F.col("row_count").cast("string"))
    lines = F.array(F.struct(F.lit("see page 4").alias("l"), F.lit(45.0).alias("up")), F.struct(text.alias("l"), F.lit(20.0).alias("up")), F.struct(F.lit("far away").alias("l"), F.lit(130.0).alias("up")))
    w = t.select("file_name", "page", "table_idx", "y0", F.posexplode(lines).alias("n", "line"))
    w = w.select("file_name", "page", F.col("table_idx").alias("block_no"), F.col("n").alias("line_no"), (F.col("y0") - F.col("line.up")).alias("y0"), F.posexplode(F.split("line.l", " ")).alias("word_no", "text"))
    return w.withColumns({"x0": F.lit(72.0) + 25.0 * F.col("word_no"), "x1": F.lit(95.0) + 25.0 * F.col("word_no"), "y1": F.col("y0") + 10})


# Where the last line over the table is shorter than 20 characters, the one before stands in front of it; numbering goes only at the start.
query("a8_table_titles", "cells", """SELECT file_name, page, table_idx, CASE WHEN regexp_extract(file_name, '([0-9]+)', 1)::BIGINT % 3 = 0 THEN 'lines of this order are ' ELSE 'see page 4 Table 7: lines ' END || row_count AS title FROM tables""")(
    lambda v: dt.table_titles(dt.shape_tables(cells(v)), captions(v)).select("file_name", "page", "table_idx", "title"))


query("a9_format_table", "cells", """SELECT file_name, page, table_idx, '[TABLE START: 4 columns x ' || row_count || ' rows]' || chr(10) || '[HEADER] part | quantity | flag | -' || chr(10) || array_to_string(list_transform(rows, lambda r: '[ROW] ' || array_to_string(r, ' | ')), chr(10)) || chr(10) || '[TABLE END]' AS block FROM tables""")(
    lambda v: dt.format_table(dt.shape_tables(cells(v))).select("file_name", "page", "table_idx", "block"))
query("a9_page_with_tables", "cells pages", """
WITH f AS (SELECT file_name, page, table_idx, '[TABLE START: 4 columns x ' || row_count || ' rows]' || chr(10) || '[HEADER] part | quantity | flag | -' || chr(10) || array_to_string(list_transform(rows, lambda r: '[ROW] ' || array_to_string(r, ' | ')), chr(10)) || chr(10) || '[TABLE END]' AS block FROM tables),
b AS (SELECT file_name, page, string_agg(block, chr(10) || chr(10) ORDER BY table_idx) AS blocks FROM f GROUP BY ALL)
SELECT file_name, page, 'Orders of page ' || page || chr(10) || chr(10) || blocks AS text FROM b UNION ALL SELECT * FROM pages_t""")(
    lambda v: dt.page_with_tables(v.pages.unionByName(cells(v).select("file_name", "page").distinct().withColumn("text", F.concat(F.lit("Orders of page "), F.col("page").cast("string")))), dt.shape_tables(cells(v))))


def _chunks(v):
    return sec.chunk_pages(v.pages).withColumn("section_title", F.lit("Intro"))


def _contexts(v):
    return sec.document_context(v.pages, v.toc, v.files)


# A library of so many characters as a prompt takes; the sample's is longer on all but the smallest tables.
_MOST = 20_000
_LIBRARY = f"""
lib AS (SELECT DISTINCT match AS t, '- Text: "' || match || '"' || chr(10) || '  Context: "' || context || '"' || chr(10) || '  Category: "' || term || '"' || chr(10) || '  Justification: "' || selection_mode || '"' AS item FROM boxes),
ln AS (SELECT greatest(1, ceil(sum(length(item) + 2) / {_MOST}))::BIGINT AS n FROM lib),
lb AS (SELECT (('0x' || substr(md5(item), 1, 8))::BIGINT % n)::INT AS block, string_agg(item, chr(10) || chr(10) ORDER BY t, item) AS library FROM lib, ln GROUP BY 1)"""


def _library(v):
    return v.boxes.select(F.col("match").alias("redacted_text"), "context", F.col("term").alias("category"), F.col("selection_mode").alias("justification"))


query("a10_library", "boxes", f"WITH {_LIBRARY} SELECT block, library FROM lb")(lambda v: dt.library_blocks(_library(v), _MOST)[0])
query("a10_prompts", "pages boxes", f"""WITH {_LIBRARY}, c AS (SELECT file_name, (page - 1) // 5 * 5 + 1 AS s, max(page) AS e, string_agg(text || chr(10) || chr(10), '' ORDER BY page) AS t FROM pages_t GROUP BY ALL),
p AS (SELECT file_name, s AS start_page, block AS library_block, concat_ws(chr(10) || chr(10), 'You review clinical documents for confidential information.', 'Known items:' || chr(10) || library, 'Section: Intro', 'Pages ' || s || ' to ' || e, t,
  'Reply with a JSON array of {{"text", "page", "confidence", "category", "justification", "context"}}.') AS prompt FROM c, lb)
SELECT file_name, start_page, library_block, length(prompt) AS n, sha1(prompt) AS digest FROM p""")(
    lambda v: dt.prompt_digests(_chunks(v), _contexts(v).select("file_name", *[F.lit("").alias(c) for c in ("title_text", "toc_text", "outline")]), _library(v), most=_MOST))


def stub(prompt: str) -> str:
    """A model that reports each at-sign's word and fails on texts without a vowel."""
    if "ununun" in prompt:
        raise ValueError("refused")
    found = [w for w in prompt.split() if "@" in w]
    return "[" + ",".join('{"text": "%s"}' % w.replace("\\", "").replace('"', "") for w in found) + "]"


query("a11_score_chunks", "pages", """SELECT file_name, (page - 1) // 5 * 5 + 1 AS start_page, contains(string_agg(text, ' '), 'ununun') AS failed FROM pages_t GROUP BY file_name, (page - 1) // 5""")(
    lambda v: dt.score_chunks(_chunks(v).withColumn("prompt", F.col("text")), stub).select("file_name", "start_page", F.col("error").isNotNull().alias("failed")))
def _first_words(prompt: str) -> str:
    return f"{len(prompt)} {prompt[:40]}"


def _moody(prompt: str) -> str:
    """A model that is out of order for every other prompt."""
    if len(prompt) % 2:
        raise TimeoutError("try again")
    return "early " + _first_words(prompt)


@query("a11_resumed", "pages", """SELECT file_name, (page - 1) // 5 * 5 + 1 AS start_page, CASE WHEN n % 2 = 1 THEN 2 ELSE 1 END AS attempts, CASE WHEN n % 2 = 0 THEN 'early ' ELSE '' END || n || ' ' || substr(t, 1, 40) AS response, NULL::VARCHAR AS error
FROM (SELECT file_name, min(page) AS page, string_agg(text || chr(10) || chr(10), '' ORDER BY page) AS t, length(t) AS n FROM pages_t GROUP BY file_name, (page - 1) // 5)""")
def _(v):
    """A scan half of whose calls fail, and a second one, which asks only for these."""
    path = stream_dir(v.spark) + "/replies"
    prompts = _chunks(v).select("file_name", "start_page", F.col("text").alias("prompt"))
    dt.score_missing(prompts, _moody, path)
    dt.score_missing(prompts, _first_words, path)
    return dt.score_missing(prompts, _moody, path).drop("prompt_hash")


query("a12_parse_detections", "dets", """SELECT file_name, page AS start_page, text, page, CASE WHEN length(text) % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, 'unknown' AS category FROM dets WHERE page % 3 = 0 OR page % 5 <> 0""")(
    lambda v: dt.parse_detections(replies(v)).select("file_name", "start_page", "text", "page", "confidence", "category"))
query("a13_summaries", "files toc", "SELECT file_name FROM files WHERE total_pages <= 2")(lambda v: dt.summaries_to_fetch(v.files, v.files.filter("total_pages > 2").select("file_name")).select("file_name"))
query("a14_clean_detection", "pages", r"SELECT file_name, page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM pages_t")(
    lambda v: v.pages.select("file_name", "page", dt.clean_detection(F.concat(F.lit(" [ROW]  [HEADER] "), "text")).alias("c")))
query("a18_batch_id", "dets", "SELECT id, substr(sha1('/corpus/' || file_name || ':' || page || ':' || text), 1, 16) AS batch FROM dets")(
    lambda v: detections(v).select("id", dt.batch_id(F.concat(F.lit("/corpus/"), "file_name"), F.col("page"), F.col("text")).alias("batch")))
query("a19_dedupe", "results", "SELECT arg_min(id, id) AS id FROM results GROUP BY file_name, page, CASE WHEN length(match) % 2 = 0 THEN match END, CASE WHEN length(match) % 2 = 1 THEN id END")(
    lambda v: dt.dedupe_detections(_twice(v)).select("id"))


def _twice(v):
    r = v.results.select("id", "file_name", "page", F.col("match").alias("text"), F.when(F.length("match") % 2 == 1, F.col("rects")).alias("rects"), F.col("id").alias("seq"))
    return r.unionByName(r.withColumns({"id": F.concat("id", F.lit("~")), "seq": F.concat("seq", F.lit("~"))}))


query("a20_replace_slice", "results", "SELECT id, category FROM results WHERE NOT (category = 'ai' AND file_name = 'doc_10.pdf' AND page BETWEEN 1 AND 3) UNION ALL SELECT 'new', 'ai' FROM results WHERE category = 'ai' AND file_name = 'doc_10.pdf'")(
    lambda v: dt.replace_slice(v.results, v.results.filter("category = 'ai' AND file_name = 'doc_10.pdf'").withColumn("id", F.lit("new")), "doc_10.pdf", 1, 3).select("id", "category"))
query("a21_compounds", "boxes", "SELECT lower(match) AS key, arg_min(match, (seq, id)) AS name FROM boxes GROUP BY 1")(
    lambda v: dt.compound_names(v.boxes.select(F.col("match").alias("name"), F.struct("seq", "id").alias("ord"))))
# Every place of a detection's text in its page, ignoring case, that doesn't overlap the one before; o2 has them with their words.
VIEWS["places"] = (["dets", "offsets", "pages"], """
  o0 AS (SELECT d.id, d.file_name, d.page, length(d.text) AS n, string_split(lower(p.text), lower(d.text)) AS parts FROM dets d JOIN pages_t p USING (file_name, page) WHERE contains(lower(p.text), lower(d.text))),
  o1 AS (SELECT id, file_name, page, n, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * n + 1 AS p FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM o0)),
  o2 AS (SELECT o.id, o.p, w.y0, w.y1, w.x0 FROM o1 o JOIN offsets w ON w.file_name = o.file_name AND w.page = o.page AND w.start < o.p - 1 + o.n AND w.stop > o.p - 1),
  o3 AS (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY id ORDER BY y0, x0) <= 20 THEN 0 ELSE 1 END AS new FROM o2),
  o4 AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING) AS occurrence FROM o3)""")
query("a15_exact_counts", "places", "SELECT id, count(*) AS n FROM o2 GROUP BY id")(lambda v: dt.find_on_page(v.words, detections(v)).groupBy("id").agg(F.count("*").alias("n")))
query("a15_locate", "places", """SELECT id, CASE WHEN max(occurrence) = 1 THEN 'exact' ELSE 'first' END AS how, count(*) FILTER (occurrence = 1)::INT AS n_rects FROM o4 GROUP BY id""")(
    lambda v: dt.locate(detections(v).withColumn("context", F.col("text")), v.words).select("id", "how", F.size("rects").alias("n_rects")))
query("a16_fuzzy")(lambda v: dt.fuzzy_locate(detections(v).withColumn("text", F.concat(F.lit("q"), F.expr("substring(text, 2)"))), v.words).select("id", F.round("ratio", 4).alias("ratio")))
query("a17_locate_all", "places", "SELECT id, 'exact' AS how, count(*)::INT AS n_rects FROM o2 GROUP BY id")(lambda v: dt.locate_all(detections(v), v.words).select("id", "how", F.size("rects").alias("n_rects")))
