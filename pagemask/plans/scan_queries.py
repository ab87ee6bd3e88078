"""Queries of the dose scan and the consistency scan."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.functions.text import clean_token
from pagemask.operators import doses, gaps
from pagemask.plans.search_queries import _UNDER
from pagemask.plans.register import query
from pagemask.plans.views_sql import VIEWS
from pagemask.sources.layout import Views, stream_dir
from pagemask.streaming.jobs import GapState, stream_gap_scan
from pagemask.streaming.parts import of_files, store_by_file


VIEWS["notes"] = ([], """
  n0 AS (SELECT *, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
  n1 AS (SELECT 'order_' || l_orderkey || '.pdf' AS file_name, n::INT AS page, CASE n % 6 WHEN 0 THEN 'Subject ' || l_linenumber || ' received ' || q || 'mg/kg daily of compound .'
    WHEN 1 THEN 'Subject 12 received ' || q || ' mg/kg daily , see Table 3 .' WHEN 2 THEN 'Give ' || q || '-' || (q + 5) || ' mL once and ( 1,0' || (q + 10) || '.5 µg ) twice'
    WHEN 3 THEN 'see page 4 for ' || q || ' mg' WHEN 4 THEN 'no dose given here today' ELSE 'one two three four five six seven eight nine ten eleven ' || q || ' IU/kg weekly, then (' || q || 'g)' END AS note FROM n0),
  n2 AS (SELECT file_name, page, unnest(range(len(t))) AS k, unnest(t) AS text FROM (SELECT file_name, page, string_split(note, ' ') AS t FROM n1)),
  notes AS (SELECT file_name, page, 0 AS block_no, (k // 12)::INT AS line_no, (k % 12)::INT AS word_no, k::INT AS k, text, trim(trim(text), '()[]{}<>.,;:!?') AS clean,
    72.0::DOUBLE + 6.0 * coalesce(sum(length(text) + 1) OVER (PARTITION BY file_name, page, k // 12 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x0, 72.0::DOUBLE + 12.0 * (k // 12) AS y0 FROM n2)""")
VIEWS["doses"] = (["notes"], r"""
  dz AS (SELECT *, lead(clean) OVER p AS next, row_number() OVER p AS place FROM notes WINDOW p AS (PARTITION BY file_name, page ORDER BY k)),
  dm AS (SELECT *, CASE WHEN regexp_matches(clean, '^[0-9][0-9,.]*([-–][0-9][0-9,.]*)?(mg|g|kg|ng|mcg|ug|µg|mL|ml|L|l|IU|iu|mmol|mEq|meq)(/[A-Za-zµ^0-9]+)?$') THEN 1
    WHEN regexp_matches(clean, '^[0-9][0-9,.]*([-–][0-9][0-9,.]*)?$') AND regexp_matches(next, '^(mg|g|kg|ng|mcg|ug|µg|mL|ml|L|l|IU|iu|mmol|mEq|meq)(/[A-Za-zµ^0-9]+)?$') THEN 2 END AS span FROM dz),
  doses AS (SELECT m.file_name, m.page, m.place, m.span, CASE WHEN m.span = 1 THEN m.clean ELSE m.clean || ' ' || m.next END AS match,
    (SELECT string_agg(o.text, ' ' ORDER BY o.k) FROM notes o WHERE o.file_name = m.file_name AND o.page = m.page AND o.k + 1 BETWEEN m.place - 8 AND m.place + m.span - 1 + 8) AS context FROM dm m WHERE span IS NOT NULL)""")


def notes(v: Views):
    """Dose notes made from order lines, as page words."""
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    li = v.table("lineitem").withColumns({"n": n, "q": F.col("l_quantity").cast("int").cast("string")})
    q5, q10 = ((F.col("l_quantity").cast("int") + d).cast("string") for d in (5, 10))
    note = (
        F.when(F.col("n") % 6 == 0, F.concat(F.lit("Subject "), F.col("l_linenumber").cast("string"), F.lit(" received "), "q", F.lit("mg/kg daily of compound .")))
        .when(F.col("n") % 6 == 1, F.concat(F.lit("Subject 12 received "), "q", F.lit(" mg/kg daily , see Table 3 .")))
        .when(F.col("n") % 6 == 2, F.concat(F.lit("Give "), "q", F.lit("-"), q5, F.lit(" mL once and ( 1,0"), q10, F.lit(".5 µg ) twice")))
        .when(F.col("n") % 6 == 3, F.concat(F.lit("see page 4 for "), "q", F.lit(" mg")))
        .when(F.col("n") % 6 == 4, F.lit("no dose given here today"))
        .otherwise(F.concat(F.lit("one two three four five six seven eight nine ten eleven "), "q", F.lit(" IU/kg weekly, then ("), "q", F.lit("g)")))
    )
    file = F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit(".pdf"))
    w = li.select(file.alias("file_name"), F.col("n").alias("page"), F.posexplode(F.split(note, " ")).alias("k", "text"))
    line = F.floor(F.col("k") / 12).cast("int")
    before = W.partitionBy("file_name", "page", "line_no").orderBy("word_no").rowsBetween(W.unboundedPreceding, -1)
    w = w.select("file_name", "page", F.lit(0).alias("block_no"), line.alias("line_no"), (F.col("k") % 12).alias("word_no"), "text")
    w = w.withColumns({"x0": F.lit(72.0) + 6.0 * F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)), "y0": F.lit(72.0) + 12.0 * F.col("line_no")})
    return w.withColumns({"x1": F.col("x0") + 6.0 * F.length("text"), "y1": F.col("y0") + 10.0})


query("d1_clean_token", "words", "SELECT trim(trim(text), '()[]{}<>.,;:!?') AS clean, count(*) AS n FROM words GROUP BY 1")(
    lambda v: v.words.groupBy(clean_token(F.col("text")).alias("clean")).agg(F.count("*").alias("n")))
query("d2_combined", "doses", "SELECT file_name, page, count(*) AS n FROM doses WHERE span = 1 GROUP BY ALL")(
    lambda v: notes(v).filter(doses.is_combined_dose(clean_token(F.col("text")))).groupBy("file_name", "page").agg(F.count("*").alias("n")))
query("d3_pairs", "doses", "SELECT file_name, page, place, match FROM doses WHERE span = 2")(
    lambda v: doses.dose_matches(notes(v)).filter("span = 2").select("file_name", "page", "place", "match"))
query("d4_context", "doses", "SELECT file_name, page, place, context FROM doses")(lambda v: doses.dose_matches(notes(v)).select("file_name", "page", "place", "context"))
query("d5_not_structural", "doses", "SELECT file_name, page, place FROM doses WHERE NOT regexp_matches(context, '(?i)\\b(page|table)\\s+[0-9]')")(
    lambda v: doses.dose_matches(notes(v)).filter(doses.not_structural(F.col("context"))).select("file_name", "page", "place"))
query("d6_keyword", "doses", "SELECT file_name, page, place, (contains(lower(context), 'daily') OR contains(lower(context), 'weekly') OR contains(lower(context), 'give') OR contains(lower(context), 'iv')) AS clinical FROM doses")(
    lambda v: doses.dose_matches(notes(v)).select("file_name", "page", "place", doses.has_dose_keyword(F.col("context")).alias("clinical")))
_RECTS = """
lines AS (SELECT d.file_name, d.page, d.place, d.match, d.context, o.line_no, min(o.x0) AS x0, max(o.x0 + 6.0 * length(o.text)) AS x1, min(o.y0) AS y0 FROM doses d JOIN notes o ON o.file_name = d.file_name AND o.page = d.page AND o.k + 1 BETWEEN d.place AND d.place + d.span - 1 GROUP BY ALL),
rects AS (SELECT file_name, page, place, match, context, count(*) AS n_rects, sum(x1 - x0) AS width, min(x0) AS x, min(y0) AS y FROM lines GROUP BY ALL)"""


def _flat(r, *more):
    w = F.aggregate("rects", F.lit(0.0), lambda a, x: a + x["w"])
    return r.select("file_name", "page", "match", *more, F.size("rects").alias("n_rects"), F.round(w, 6).alias("width"), F.array_min(F.transform("rects", lambda x: x["x"])).alias("x"), F.array_min(F.transform("rects", lambda x: x["y"])).alias("y"))


query("d7_rects", "doses", f"WITH {_RECTS} SELECT file_name, page, match, place, n_rects, round(width, 6) AS width, x, y FROM rects")(
    lambda v: _flat(doses.dose_rects(doses.dose_matches(notes(v))), "place"))
query("d8_scan_doses", "doses", f"WITH {_RECTS} SELECT file_name, page, match, 'CCI:dosing' AS term, 'dosage' AS category, context, n_rects, round(width, 6) AS width, x, y FROM rects WHERE NOT regexp_matches(context, '(?i)\\b(page|table)\\s+[0-9]')")(
    lambda v: _flat(doses.scan_doses(notes(v)), "term", "category", "context"))

# Every place of a probe (without outer punctuation) in a page's text that doesn't begin or end inside a word.
_W = r"[\p{L}\p{M}\p{N}_]"
VIEWS["gaps"] = (["boxes", "offsets", "pages"], _UNDER.strip() + rf""",
  idx AS (SELECT DISTINCT trim(u.text) AS text, lower(trim(u.text)) AS probe, b.file_name, b.page FROM boxes b JOIN under u USING (id) WHERE trim(u.text) <> ''),
  probes AS (SELECT DISTINCT probe FROM idx WHERE length(probe) >= 2),
  pt AS (SELECT probe, CASE WHEN trim(probe, '()[]{{}}<>.,;:!? ') <> '' THEN trim(probe, '()[]{{}}<>.,;:!? ') ELSE probe END AS needle FROM probes),
  lp AS (SELECT file_name, page, lower(text) AS text FROM pages_t),
  runs AS (SELECT DISTINCT file_name, page, unnest(regexp_extract_all(text, '{_W}+')) AS run FROM lp),
  rp AS (SELECT probe, needle, regexp_extract(needle, '{_W}+') AS run FROM pt WHERE needle <> ''),
  cd AS (SELECT lp.file_name, lp.page, probe, needle, text FROM rp JOIN runs USING (run) JOIN lp USING (file_name, page) WHERE rp.run <> '' AND contains(text, needle)
    UNION ALL SELECT lp.file_name, lp.page, probe, needle, text FROM rp JOIN lp ON contains(text, needle) WHERE rp.run = ''),
  ps AS (SELECT *, length(needle) AS n, unnest(range(1, length(text) - length(needle) + 2)) AS p FROM cd),
  ph AS (SELECT file_name, page, probe, p - 1 AS b, p - 1 + n AS e FROM ps WHERE substr(text, p, n) = needle AND NOT (p > 1 AND regexp_matches(substr(text, p - 1, 2), '^{_W}{{2}}$')) AND NOT regexp_matches(substr(text, p + n - 1, 2), '^{_W}{{2}}$')),
  hw AS (SELECT h.file_name, h.page, h.probe, min(o.x0 + (o.x1 - o.x0) / length(o.text) * greatest(0, b - o.start)) AS x0, min(o.y0) AS y0, max(o.x1 - (o.x1 - o.x0) / length(o.text) * greatest(0, o.stop - e)) AS x1, max(o.y1) AS y1
    FROM ph h JOIN offsets o ON o.file_name = h.file_name AND o.page = h.page AND o.start < e AND o.stop > b GROUP BY h.file_name, h.page, h.probe, b, o.block_no, o.line_no),
  hm AS (SELECT *, lag(y0) OVER w AS py, lag(x1) OVER w AS px FROM hw WINDOW w AS (PARTITION BY file_name, page, probe ORDER BY y0, x0)),
  hr AS (SELECT *, sum(CASE WHEN py IS NULL OR abs(y0 - py) >= 5 OR x0 - px > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY file_name, page, probe ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING) AS run FROM hm),
  hits AS (SELECT file_name, page, probe, round(min(x0), 6) AS x0, min(y0) AS y0, round(max(x1), 6) AS x1, max(y1) AS y1 FROM hr GROUP BY file_name, page, probe, run),
  own AS (SELECT h.file_name, h.page, h.probe, h.x0, h.y0, max(greatest(0, least(h.x1, b.x + b.w) - greatest(h.x0, b.x)) * greatest(0, least(h.y1, b.y + b.h) - greatest(h.y0, b.y)) / ((h.x1 - h.x0) * (h.y1 - h.y0))) AS share FROM hits h JOIN boxes b ON b.file_name = h.file_name AND b.page = h.page GROUP BY ALL),
  cov AS (SELECT h.*, coalesce(share, 0) >= 0.5 AS covered FROM hits h LEFT JOIN own USING (file_name, page, probe, x0, y0)),
  gaps AS (SELECT file_name, page, probe AS match_text, x0, y0, x1, y1 FROM cov WHERE NOT covered)""")


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("x0", "x1")})


def _scan(v):
    return _rounded(gaps.gap_scan(v.words, v.boxes))


query("g2_redacted_index", "gaps", "SELECT * FROM idx")(lambda v: gaps.redacted_index(v.boxes, v.words))
query("g3_probes", "gaps", "SELECT probe FROM probes WHERE length(probe) >= 3")(lambda v: gaps.probe_texts(gaps.redacted_index(v.boxes, v.words)))
query("g4_gap_scan", "gaps", "SELECT * FROM gaps")(lambda v: _scan(v.stored()))
query("g4_locations", "gaps", "SELECT g.*, l.n_locations FROM gaps g JOIN (SELECT probe, count(DISTINCT (file_name, page)) AS n_locations FROM idx GROUP BY probe) l ON l.probe = g.match_text")(
    lambda v: gaps.with_locations(_rounded(gaps.gap_scan(v.words, v.boxes)), gaps.redacted_index(v.boxes, v.words)).withColumn("n_locations", F.size("redacted_locations")).drop("redacted_locations"))
query("g5_is_covered", "gaps", "SELECT * FROM cov")(lambda v: gaps.is_covered(_rounded(gaps.probe_hits(v.words, gaps.probe_texts(gaps.redacted_index(v.boxes, v.words), 2))), v.boxes))
query("g6_gap_context", "gaps", """SELECT g.*, substr(string_agg(w.text, ' ' ORDER BY w.block_no, w.line_no, w.word_no), 1, 300) AS context FROM gaps g JOIN words w ON w.file_name = g.file_name AND w.page = g.page
  AND w.x1 > g.x0 - 200 AND w.x0 < g.x1 + 200 AND w.y1 > g.y0 - 5 AND w.y0 < g.y1 + 5 GROUP BY g.file_name, g.page, g.match_text, g.x0, g.y0, g.x1, g.y1""")(
    lambda v: gaps.gap_context(_rounded(gaps.gap_scan(v.words, v.boxes)), v.words))


@query("g7_incremental", "gaps", "SELECT * FROM gaps")
def _(v):
    """Before: no third pages, other words on the second ones, and half of the boxes, with some that are gone now."""
    v, page = v.stored(), F.col("page")
    words = v.words.filter(page % 3 > 0).withColumn("text", F.when((page % 3 == 2) & (F.col("word_no") == 4), F.lit("other")).otherwise(F.col("text")))
    boxes = v.boxes.filter("seq % 2 = 0").unionByName(v.boxes.filter("seq % 5 = 0").withColumns({"id": F.concat("id", F.lit("~")), "x": F.col("x") + F.col("w")}))
    none = {"pages": "file_name string, page int, mark long", "probes": "probe string", "hits": "file_name string, page int, probe string, x0 double, y0 double, x1 double, y1 double"}
    before = gaps.gap_scan_incremental({t: v.spark.createDataFrame([], s) for t, s in none.items()}, words, boxes)
    return _rounded(gaps.gap_scan_incremental(before, v.words, v.boxes)["gaps"])


@query("g9_stream_gaps", "gaps", "SELECT * FROM gaps")
def _(v):
    """Three micro-batches: all files with their first two pages and half of their boxes; then half of the files, and then the others, as they are."""
    path = stream_dir(v.spark)
    store_by_file(v.words, path + "/words")
    store_by_file(v.boxes, path + "/boxes")
    even = F.pmod(F.xxhash64("file_name"), F.lit(2)) == 0
    files = v.spark.read.parquet(path + "/words").select("file_name").distinct()
    for some in (files, files.filter(even), files.filter(~even)):
        some.coalesce(1).write.mode("append").parquet(path + "/changes")

    def table(name, first):
        """Rows of files as they are in batch n: files of later batches still have their first state."""

        def of(some, n):
            new = [F.lit(False), even][n] if n < 2 else F.lit(True)
            return of_files(v.spark, f"{path}/{name}", some).filter(new | F.expr(first))

        return of

    changes = v.spark.readStream.schema("file_name string").option("maxFilesPerTrigger", 1).parquet(path + "/changes")
    stream_gap_scan(changes, table("words", "page <= 2"), table("boxes", "seq % 2 = 0"), path + "/state", path + "/checkpoint", once=True).awaitTermination()
    return _rounded(GapState(v.spark, path + "/state").gaps())


query("g8_gap_results", "gaps results", "SELECT id, file_name, page, match, term, category FROM results WHERE category <> 'gap' UNION ALL SELECT concat_ws('#', 'gap', file_name, page, match_text, trunc(x0)::INT, y0::INT), file_name, page, match_text, 'CCI:consistency', 'gap' FROM gaps")(
    lambda v: gaps.gaps_to_results(_rounded(gaps.gap_scan(v.words, v.boxes)), v.results))
