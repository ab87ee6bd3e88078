"""Carrying redactions from a document's version to its next one."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.functions.geometry import area, coverage, overlap, rect
from pagemask.functions.grids import anchors, best_cells, first_alike, holding, refs_by_page, table_scores
from pagemask.functions.similarity import best_windows, indel_ratio, token_set_ratio
from pagemask.operators.search import find_on_page, text_under_boxes, with_texts
from pagemask.sources.layout import PAGE, READING, page_text

TABLE = [*PAGE, "table_idx"]
SIDES = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}


def _box() -> list[Column]:
    return [F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")]


def _prefixed(df: DataFrame, columns: list[str], p: str = "_") -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in columns])


def _same_page(p: str = "_") -> Column:
    return (F.col("file_name") == F.col(f"{p}file_name")) & (F.col("page") == F.col(f"{p}page"))


# ---- extraction


def classify_annotations(annots: DataFrame) -> DataFrame:
    """Annotations that mark redactions, with the rule that chose them: type 25, subject Redact, subject containing redact, type 13."""
    subject = F.lower(F.coalesce("subject", F.lit("")))
    label = F.when(F.col("annot_type") == 25, "type25").when(subject == "redact", "subject").when(F.contains(subject, F.lit("redact")), "subject_part").when(F.col("annot_type") == 13, "stamp")
    return annots.withColumn("label", label).filter(F.col("label").isNotNull())


def annotation_boxes(annots: DataFrame) -> DataFrame:
    """A box for every four vertices (highlight), or the rectangle where there are none."""
    n = F.floor(F.coalesce(F.size("vertices"), F.lit(0)) / 4).cast("int")

    def quad(i):
        q = F.slice("vertices", i * 4 + 1, 4)
        xs, ys = F.transform(q, lambda v: v["x"]), F.transform(q, lambda v: v["y"])
        return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"), F.lit("highlight").alias("selection_mode"))

    r = F.col("rect")
    whole = F.array(F.struct(r["x0"].alias("x"), r["y0"].alias("y"), (r["x1"] - r["x0"]).alias("w"), (r["y1"] - r["y0"]).alias("h"), F.lit("rectangle").alias("selection_mode")))
    quads = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), quad)).otherwise(whole)
    return annots.select("annot_id", *PAGE, F.posexplode(quads).alias("n", "b")).select("annot_id", *PAGE, "n", "b.*")


def split_by_lines(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """id, n, x, y, w, h: one box for each text line in a box, or the box itself where it has no text."""
    w = _prefixed(words, [*PAGE, *READING, "x0", "y0", "x1", "y1"])
    share = coverage(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), *_box())
    b = boxes.select("id", *PAGE, "x", "y", "w", "h")
    lines = b.join(w, _same_page() & (share >= 0.5)).groupBy("id", "_block_no", "_line_no").agg(F.min("_x0").alias("x0"), F.min("_y0").alias("y0"), F.max("_x1").alias("x1"), F.max("_y1").alias("y1"))
    n = F.row_number().over(W.partitionBy("id").orderBy("_block_no", "_line_no"))
    found = lines.select("id", n.alias("n"), rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r")).select("id", "n", "r.*")
    return found.unionByName(b.join(found.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).alias("n"), "x", "y", "w", "h"))


def box_text_context(boxes: DataFrame, words: DataFrame, radius: int = 50) -> DataFrame:
    """id, text and context: radius characters around the first occurrence of the text (or of its first three words) on the page,
    cut at word borders."""
    t = text_under_boxes(boxes, words).select("id", *PAGE, F.trim("text").alias("text")).join(page_text(words).withColumnRenamed("text", "full"), PAGE)
    whole = F.expr("locate(lower(text), lower(full))")
    t = t.withColumn("head", F.array_join(F.slice(F.split("text", " "), 1, 3), " "))
    part = F.expr("locate(lower(head), lower(full))")
    t = t.withColumns({"at": F.when(whole > 0, whole).when(part > 0, part), "len": F.when(whole > 0, F.length("text")).otherwise(F.length("head"))})
    low = F.greatest(F.lit(1), F.col("at") - radius)
    high = F.least(F.length("full"), F.col("at") + F.col("len") - 1 + radius)
    raw = F.substring(F.col("full"), low, high - low + 1)
    left = F.when(low > 1, F.regexp_replace(raw, r"^\S*\s", "")).otherwise(raw)
    context = F.when(high < F.length("full"), F.regexp_replace(left, r"\s\S*$", "")).otherwise(left)
    return t.select("id", "text", F.coalesce(context, F.lit("")).alias("context"))


def text_coverage(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """id, coverage (share of the box that text blocks cover, at most 1) and has_text. A block is the union of its words."""
    blocks = words.groupBy(*PAGE, "block_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    k = _prefixed(blocks, [*PAGE, "x0", "y0", "x1", "y1"])
    cut = overlap(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), *_box())
    b = boxes.select("id", *PAGE, "x", "y", "w", "h").join(k, _same_page() & (cut > 0), "left")
    total = F.sum(F.when(F.col("_x0").isNotNull(), cut).otherwise(F.lit(0.0)))
    g = b.groupBy("id").agg(total.alias("s"), F.max(F.col("w") * F.col("h")).alias("a"))
    return g.select("id", F.least(F.lit(1.0), F.coalesce(F.try_divide("s", "a"), F.lit(0.0))).alias("coverage"), (F.col("s") > 0).alias("has_text"))


def table_bounds(cells: DataFrame) -> DataFrame:
    if "cells" in cells.columns:  # one row a table
        return cells.select(*TABLE, *[f(f"cells.{c}").alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))])
    return cells.groupBy(*TABLE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def table_overlap(boxes: DataFrame, cells: DataFrame, least: float = 0.8) -> DataFrame:
    """id, table_idx and share of the table that covers a box most, where it covers the box by `least`."""
    t = _prefixed(table_bounds(cells), [*TABLE, "x0", "y0", "x1", "y1"])
    share = coverage(*_box(), F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"))
    hit = boxes.select("id", *PAGE, "x", "y", "w", "h").join(t, _same_page() & (share >= least)).withColumn("share", share)
    return hit.groupBy("id").agg(F.max_by(F.struct(F.col("_table_idx").alias("table_idx"), "share"), F.struct("share", -F.col("_table_idx"))).alias("b")).select("id", "b.*")


def drawing_overlap(boxes: DataFrame, drawings: DataFrame, cells: DataFrame, reach: float = 30.0, least: int = 5) -> DataFrame:
    """id, count, cluster rectangle and the box's place in it, of boxes over drawings: no table covers 30 %, `least` drawings are hit,
    and the box covers 80 % of the union of the drawings within reach."""
    tabled = table_overlap(boxes, cells, 0.3).select("id")
    # equal rectangles of a page are one row on both sides: copies never make pairs
    d = _prefixed(drawings, [*PAGE, "x0", "y0", "x1", "y1"]).groupBy(*[f"_{c}" for c in (*PAGE, "x0", "y0", "x1", "y1")]).agg(F.count("*").alias("_copies"))
    placed = boxes.select("id", *PAGE, "x", "y", "w", "h").join(tabled, "id", "left_anti")
    place_key = [*PAGE, "x", "y", "w", "h"]
    b = placed.select(*place_key).distinct()
    bx = _box()
    near = (F.col("_x0") <= bx[2] + reach) & (F.col("_x1") >= bx[0] - reach) & (F.col("_y0") <= bx[3] + reach) & (F.col("_y1") >= bx[1] - reach)
    touch = (F.col("_x0") < bx[2]) & (F.col("_x1") > bx[0]) & (F.col("_y0") < bx[3]) & (F.col("_y1") > bx[1])
    g = b.join(d, _same_page() & near).groupBy(*place_key).agg(F.sum(F.when(touch, F.col("_copies")).otherwise(0)).alias("hit"), F.sum("_copies").alias("count"), F.min("_x0").alias("x0"), F.min("_y0").alias("y0"), F.max("_x1").alias("x1"), F.max("_y1").alias("y1"))
    c = [F.col(k) for k in ("x0", "y0", "x1", "y1")]
    g = placed.join(g.filter((F.col("hit") >= least) & (coverage(*c, *_box()) >= 0.8)), place_key)

    def place(v: Column, low: str, high: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(v - F.col(low), F.col(high) - F.col(low)), F.lit(0.0))))

    return g.select("id", "count", *c, place(bx[0], "x0", "x1").alias("rx0"), place(bx[1], "y0", "y1").alias("ry0"), place(bx[2], "x0", "x1").alias("rx1"), place(bx[3], "y0", "y1").alias("ry1"))


def classify_boxes(boxes: DataFrame, cells: DataFrame, drawings: DataFrame, words: DataFrame) -> DataFrame:
    """id and kind (TABLE, DRAWING, TEXT) of each box; a drawing box with text is a text box as well."""
    t = table_overlap(boxes, cells).select("id", F.lit(True).alias("table"))
    d = drawing_overlap(boxes, drawings, cells).select("id", F.lit(True).alias("drawing"))
    k = boxes.select("id").join(t, "id", "left").join(d, "id", "left").join(text_coverage(boxes, words).select("id", "has_text"), "id", "left")
    kinds = F.when(F.col("table"), F.array(F.lit("TABLE"))).when(F.col("drawing") & F.col("has_text"), F.array(F.lit("DRAWING"), F.lit("TEXT"))).when(F.col("drawing"), F.array(F.lit("DRAWING"))).otherwise(F.array(F.lit("TEXT")))
    return k.select("id", F.explode(kinds).alias("kind"))


def table_hits(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """id, table_idx and n_cells: cells of which a box covers over 20 % of what it shares with the table."""
    t = _prefixed(table_bounds(cells), [*TABLE, "x0", "y0", "x1", "y1"], "t_")
    b = boxes.select("id", *PAGE, "x", "y", "w", "h").join(t, _same_page("t_") & (overlap(*_box(), F.col("t_x0"), F.col("t_y0"), F.col("t_x1"), F.col("t_y1")) > 0))
    bx = _box()
    inner = [F.greatest(bx[0], F.col("t_x0")), F.greatest(bx[1], F.col("t_y0")), F.least(bx[2], F.col("t_x1")), F.least(bx[3], F.col("t_y1"))]
    c = _prefixed(cells, [*TABLE, "x0", "y0", "x1", "y1"])
    hit = b.join(c, _same_page() & (F.col("t_table_idx") == F.col("_table_idx")))
    cut = overlap(*inner, F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"))
    return hit.groupBy("id", F.col("t_table_idx").alias("table_idx")).agg(F.count_if(cut > 0.2 * area(*inner)).alias("n_cells"))


def subtract_rect(boxes: DataFrame) -> DataFrame:
    """Strips of a box (x, y, w, h) outside a rectangle (tx0, ty0, tx1, ty1), over 1 pt in both directions: id, side, x0, y0, x1, y1."""
    x0, y0, x1, y1 = _box()
    a, b, c, d = (F.col(k) for k in ("tx0", "ty0", "tx1", "ty1"))
    low, high = F.greatest(y0, b), F.least(y1, d)

    def strip(side, *r):
        return F.struct(F.lit(side).alias("side"), *[v.alias(k) for v, k in zip(r, ("x0", "y0", "x1", "y1"))])

    parts = F.array(strip("top", x0, y0, x1, F.least(y1, b)), strip("bottom", x0, F.greatest(y0, d), x1, y1), strip("left", x0, low, F.least(x1, a), high), strip("right", F.greatest(x0, c), low, x1, high))
    return boxes.select("id", F.inline(F.filter(parts, lambda p: (p["x1"] - p["x0"] > 1) & (p["y1"] - p["y0"] > 1))))


# ---- drawings


def drawing_clusters(drawings: DataFrame, reach: float = 30.0) -> DataFrame:
    """file_name, page, cluster, n, x0, y0, x1, y1: connected groups of drawings of a page, where one grown by reach meets another.

    Pages are independent. Within one, a sweep over x meets the rectangles that are still near in x, all at once; of their groups only the different ones are united, and
    a rectangle that ends before a later one and lies within its height is dropped, as whatever meets it meets that one.
    """

    def one_page(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf[["x0", "y0", "x1", "y1"]].to_numpy()
        up: dict[int, int] = {}
        label = np.arange(len(r))

        def find(i):
            while up.get(i, i) != i:
                up[i] = up.get(up[i], up[i])
                i = up[i]
            return i

        open_ = np.zeros(0, dtype=int)
        for i in np.argsort(r[:, 0], kind="stable").tolist():
            x0, y0, x1, y1 = r[i]
            open_ = open_[r[open_, 2] + reach >= x0]
            low, high = r[open_, 1], r[open_, 3]
            near = open_[(low - reach <= y1) & (high + reach >= y0)]
            if len(near):
                roots = {find(k) for k in np.unique(label[near]).tolist()}
                least = min(roots)
                up.update((k, least) for k in roots)
                label[near] = label[i] = least
            open_ = np.append(open_[(low < y0) | (high > y1) | (r[open_, 2] > x1)], i)
        g = pdf.assign(c=[find(k) for k in label.tolist()]).groupby("c", sort=True)
        out = g.agg(n=("x0", "size"), x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max")).sort_values(["x0", "y0", "x1", "y1"]).reset_index(drop=True)
        out.insert(0, "cluster", range(len(out)))
        out.insert(0, "page", key[1])
        out.insert(0, "file_name", key[0])
        return out

    return drawings.groupBy(*PAGE).applyInPandas(one_page, "file_name string, page int, cluster int, n long, x0 double, y0 double, x1 double, y1 double")


def cluster_signature(n: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """count, width, height, aspect and density as text."""
    w, h = x1 - x0, y1 - y0
    zero = F.lit(0.0)
    return F.format_string("count:%d|w:%.1f|h:%.1f|aspect:%.2f|density:%.4f", n, w, h, F.coalesce(F.try_divide(w, h), zero), F.coalesce(F.try_divide(n, w * h), zero))


def parse_signature(c: Column) -> Column:
    """The parts of a signature as map<string,double>."""
    return F.transform_values(F.str_to_map(c, F.lit(r"\|"), F.lit(":")), lambda k, v: v.cast("double"))


def _alike(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.try_divide(F.abs(a - b), F.greatest(a, b)), F.lit(0.0)))


def match_clusters(source: DataFrame, target: DataFrame, pages: int = 2, variant: str = "position", cells: DataFrame | None = None) -> DataFrame:
    """The best target cluster for each source cluster within `pages` pages: source cluster, page, cluster, score. With the target's table
    cells, clusters of which a table covers 30 % are passed over.

    position: dimension .3, aspect .2, position .3, count .2; 0.65 in all and 0.5 in each. density: count .2, dimension .3, aspect .2,
    density .3, without threshold. The page window is an equi-join on exploded pages.
    """
    s = source.select("file_name", F.col("page").alias("s_page"), F.col("cluster").alias("s_cluster"), *[F.col(c).alias("s_" + c) for c in ("n", "x0", "y0", "x1", "y1")])
    s = s.withColumn("page", F.explode(F.sequence(F.greatest(F.lit(1), F.col("s_page") - pages), F.col("s_page") + pages)))
    if cells is not None:
        t = _prefixed(table_bounds(cells), [*PAGE, "x0", "y0", "x1", "y1"])
        share = coverage(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "_x0", "_y0", "_x1", "_y1")])
        target = target.join(t, _same_page() & (share >= 0.3), "left_anti")
    j = s.join(target, PAGE)
    sw, sh, w, h = (F.col(b) - F.col(a) for a, b in (("s_x0", "s_x1"), ("s_y0", "s_y1"), ("x0", "x1"), ("y0", "y1")))
    count = _alike(F.col("s_n").cast("double"), F.col("n").cast("double"))
    dim = (_alike(sw, w) + _alike(sh, h)) / 2
    aspect = _alike(F.coalesce(F.try_divide(sw, sh), F.lit(0.0)), F.coalesce(F.try_divide(w, h), F.lit(0.0)))
    place = F.greatest(F.lit(0.0), 1.0 - (F.abs(F.col("s_x0") - F.col("x0")) / 595.0 + F.abs(F.col("s_y0") - F.col("y0")) / 842.0) / 2)
    density = _alike(F.coalesce(F.try_divide(F.col("s_n"), sw * sh), F.lit(0.0)), F.coalesce(F.try_divide(F.col("n"), w * h), F.lit(0.0)))
    if variant == "position":
        j = j.withColumn("score", 0.3 * dim + 0.2 * aspect + 0.3 * place + 0.2 * count).filter((F.col("score") >= 0.65) & (F.least(dim, aspect, place, count) >= 0.5))
    else:
        j = j.withColumn("score", 0.2 * count + 0.3 * dim + 0.2 * aspect + 0.3 * density)
    w_ = W.partitionBy("file_name", "s_page", "s_cluster").orderBy(F.col("score").desc(), "page", "cluster")
    return j.withColumn("_n", F.row_number().over(w_)).filter("_n = 1").select("file_name", "s_page", "s_cluster", "page", "cluster", "score")


# ---- tables


def _neighbours(cells: DataFrame) -> DataFrame:
    """cells with the texts and origins above, below, left and right of each, by a look along its column and along its row. Both looks go over the whole table, so that cells are
    dealt by it once, or not at all where they are by their page."""
    column, row = W.partitionBy(*TABLE).orderBy("col_idx", "row_idx"), W.partitionBy(*TABLE).orderBy("row_idx", "col_idx")
    looks = {"up": (F.lag, column, "row_idx", -1), "down": (F.lead, column, "row_idx", 1), "left": (F.lag, row, "col_idx", -1), "right": (F.lead, row, "col_idx", 1)}
    near = {side: look(F.struct("row_idx", "col_idx", "text", "x0", "y0")).over(over) for side, (look, over, _, _) in looks.items()}
    out = cells.withColumns({f"_{side}": c for side, c in near.items()})
    for side, (_, _, idx, step) in looks.items():
        own, other = F.col(f"_{side}"), "col_idx" if idx == "row_idx" else "row_idx"
        n = F.when((own[idx] == F.col(idx) + step) & (own[other] == F.col(other)), own)  # a gap in the grid has no neighbour
        out = out.withColumns({side: n["text"], f"{side}_x": n["x0"], f"{side}_y": n["y0"]})
    return out.drop(*[f"_{side}" for side in looks])


def _key_cells(cells: DataFrame) -> DataFrame:
    """cells with their neighbours, and rows and cols of their table, and key: whether a cell is one of the four corners or the centre."""
    table = W.partitionBy(*TABLE)
    c = _neighbours(cells).withColumns({"rows": F.max("row_idx").over(table) + 1, "cols": F.max("col_idx").over(table) + 1})
    r, k = F.col("row_idx"), F.col("col_idx")
    corner = ((r == 0) | (r == F.col("rows") - 1)) & ((k == 0) | (k == F.col("cols") - 1))
    return c.withColumn("key", corner | ((r == F.floor(F.col("rows") / 2)) & (k == F.floor(F.col("cols") / 2))))


def table_fingerprint(cells: DataFrame) -> DataFrame:
    """Key cells (four corners and centre, each once) with their neighbours: file_name, page, table_idx, row_idx, col_idx, text, up, down, left, right."""
    return _key_cells(cells).filter("key").select(*TABLE, "row_idx", "col_idx", "text", *SIDES)


def _window(df: DataFrame, pages: int, keep: list[str]) -> DataFrame:
    """df with a row for each page within the window; its own page is s_page."""
    return df.withColumn("s_page", F.col("page")).withColumn("page", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - pages), F.col("page") + pages))).select(*keep)


def match_tables(source: DataFrame, target: DataFrame, pages: int = 2, variant: str = "newer", source_titles: DataFrame | None = None, target_titles: DataFrame | None = None) -> DataFrame:
    """The best target table of each source table within `pages` pages: file_name, s_page, s_table, page, table_idx, score.

    Both sides are cells; titles (file_name, page, table_idx, title) are optional. Scores: adjacency of key cells, structure, headers (first
    rows) and titles (their ratio; 0.5 where one side has none, 1 where both have none); weights .30 .30 .25 .15 with 0.40 in all (newer),
    or .50 .25 .15 .10 with 0.65 (older).
    """
    weights, threshold = ((0.30, 0.30, 0.25, 0.15), 0.40) if variant == "newer" else ((0.50, 0.25, 0.15, 0.10), 0.65)

    out = table_scores(source, target, pages)
    for titles, own, name in ((source_titles, ["file_name", "s_page", "s_table"], "s_title"), (target_titles, TABLE, "t_title")):
        if titles is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
        else:
            out = out.join(titles.select(*[F.col(a).alias(b) for a, b in zip(TABLE, own)], F.nullif(F.trim("title"), F.lit("")).alias(name)), own, "left")
    both_titles = F.col("s_title").isNotNull() & F.col("t_title").isNotNull()
    ratio = indel_ratio("s_title", "t_title") / 100.0 if source_titles is not None and target_titles is not None else F.lit(0.0)
    title = F.when(both_titles, ratio).when(F.col("s_title").isNull() & F.col("t_title").isNull(), 1.0).otherwise(0.5)
    total = weights[0] * F.col("adjacency") + weights[1] * F.col("structure") + weights[2] * F.col("headers") + weights[3] * title
    out = out.withColumn("score", total).filter(F.col("score") >= threshold)
    w = W.partitionBy("file_name", "s_page", "s_table").orderBy(F.col("score").desc(), "page", "table_idx")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("file_name", "s_page", "s_table", "page", "table_idx", "score")


def _moved() -> list[Column]:
    """x, y, w, h at the same place in the target's bounds."""
    kx = F.try_divide(F.col("tx1") - F.col("tx0"), F.col("sx1") - F.col("sx0"))
    ky = F.try_divide(F.col("ty1") - F.col("ty0"), F.col("sy1") - F.col("sy0"))
    return [(F.col("tx0") + (F.col("x") - F.col("sx0")) * kx).alias("x"), (F.col("ty0") + (F.col("y") - F.col("sy0")) * ky).alias("y"), (F.col("w") * kx).alias("w"), (F.col("h") * ky).alias("h")]


def transfer_relative(boxes: DataFrame) -> DataFrame:
    """id, x, y, w, h: a box at the same place in the target's bounds. boxes: x, y, w, h, source bounds sx0.. and target bounds tx0..; a degenerate
    source gives none."""
    return boxes.filter("sx1 - sx0 > 0 AND sy1 - sy0 > 0").select("id", *_moved())


def anchor_cells(source: DataFrame, target: DataFrame, matches: DataFrame) -> DataFrame:
    """The best anchor of each matched table: the key cell with equal content (2) and equal neighbours (1 each), 2 at least, case ignored;
    the first of equals. file_name, s_page, s_table, dx, dy (the anchor's shift) and anchor (its score)."""
    best = F.max_by(F.struct("dx", "dy", "anchor"), F.struct("anchor", -F.col("row"), -F.col("col")))
    return anchors(source, target, matches).filter("anchor IS NOT NULL").groupBy("file_name", "s_page", "s_table").agg(best.alias("b")).select("file_name", "s_page", "s_table", "b.*")


def transfer_anchored(boxes: DataFrame, source: DataFrame, target: DataFrame, matches: DataFrame) -> DataFrame:
    """id, file_name, page, x, y, w, h, how: boxes (with table_idx) carried to the matched table by its anchor's shift, or else to the same
    place in its bounds; boxes of tables without a match, or without an anchor in a degenerate table, have no row."""
    # boxes meet what is known of a page's tables there, and stay where they are
    m = anchors(source, target, matches).withColumnRenamed("s_table", "_table").repartition("file_name", "s_page")
    best = F.max_by(F.struct("dx", "dy", "anchor"), F.when(F.col("anchor").isNotNull(), F.struct("anchor", -F.col("row"), -F.col("col")))).over(W.partitionBy("file_name", "s_page", "_table"))
    m = m.withColumn("_best", best).drop("dx", "dy", "anchor").select("*", "_best.*")
    b = boxes.select("id", "file_name", F.col("page").alias("s_page"), F.col("table_idx").alias("s_table"), "x", "y", "w", "h").join(m, ["file_name", "s_page"]).filter("s_table - _table = 0")
    anchored = F.col("anchor").isNotNull()
    place = F.when(anchored, F.struct((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "w", "h", F.lit("anchor").alias("how"))).when(
        (F.col("sx1") > F.col("sx0")) & (F.col("sy1") > F.col("sy0")) & F.col("tx0").isNotNull(), F.struct(*_moved(), F.lit("relative").alias("how")))
    return b.withColumn("p", place).filter("p IS NOT NULL").select("id", "file_name", "page", "p.*")


def containing_cell(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """id and the cell that shares the most area with a box, with its neighbours, the box's offset in it (dx, dy) and in the neighbours (up_dx and so on)."""
    return holding(boxes, cells)


def match_cells(refs: DataFrame, target: DataFrame, offset: int = 1) -> DataFrame:
    """The target cell of each reference (rows of containing_cell): centre times 5 and neighbours times 1; the first of 8 and more in
    reading order, else the best of 3.5 and more. Pages from p to p + offset (or p + offset to p)."""
    low, high = min(0, offset), max(0, offset)
    r = refs.select("id", "file_name", F.col("page").alias("s_page"), F.col("text").alias("r_text"), *[F.col(s).alias("r_" + s) for s in SIDES])
    r = r.withColumn("page", F.explode(F.sequence(F.greatest(F.lit(1), F.col("s_page") + low), F.col("s_page") + high)))
    parts = ["text", *SIDES]
    j = best_cells(refs_by_page(r), target, [f"r_{c}" for c in parts], (5.0, 1.0, 1.0, 1.0, 1.0), 3.5, 8.0)
    j = j.withColumnsRenamed({f"m_{i}": f"m_{c}" for i, c in enumerate(parts)})
    full = F.when(F.col("score") >= 8.0, F.lit(1)).otherwise(0)
    w = W.partitionBy("id").orderBy(full.desc(), F.when(full == 1, F.lit(0.0)).otherwise(-F.col("score")), F.struct("page", "table_idx", "row_idx", "col_idx"))
    return j.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def match_cell_content(boxes: DataFrame, target: DataFrame, pages: int = 2, threshold: float = 0.85) -> DataFrame:
    """The first target cell within `pages` pages whose text is alike to a box's text: id, page, table_idx, row_idx, col_idx."""
    b = boxes.select("id", "file_name", "text", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - pages), F.col("page") + pages)).alias("page"))
    b = b.withColumnRenamed("text", "b_text")
    j = first_alike(refs_by_page(b), target, "b_text", threshold)
    return j.groupBy("id").agg(F.min(F.struct("page", "table_idx", "row_idx", "col_idx")).alias("c")).select("id", "c.*")


def reconstruct(matches: DataFrame, refs: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """id, page, x, y, w, h of matched references: the mean of cell origins plus offsets, the centre weighing 5 and each neighbour
    1; the size stays. refs: rows of containing_cell, which hold their offsets, or None where matches hold them; source isn't read."""
    j = matches if refs is None else matches.join(refs.select("id", "w", "h", "dx", "dy", *[f"{k}_d{c}" for k in SIDES for c in "xy"]), "id")
    weight, x, y = F.lit(5.0), 5.0 * (F.col("x0") + F.col("dx")), 5.0 * (F.col("y0") + F.col("dy"))
    for k in SIDES:
        ok = F.col(f"{k}_x").isNotNull() & F.col(f"{k}_dx").isNotNull()
        weight = weight + F.when(ok, 1.0).otherwise(0.0)
        x = x + F.when(ok, F.col(f"{k}_x") + F.col(f"{k}_dx")).otherwise(0.0)
        y = y + F.when(ok, F.col(f"{k}_y") + F.col(f"{k}_dy")).otherwise(0.0)
    return j.select("id", "page", (x / weight).alias("x"), (y / weight).alias("y"), "w", "h")


# ---- text


def page_window(source_files: DataFrame, target_files: DataFrame, fallback: int = 2) -> DataFrame:
    """file_name, page offset (target minus source pages) and search radius (its size, or the fallback where it is 0)."""
    t = target_files.select("file_name", F.col("total_pages").alias("t"))
    offset = F.col("t") - F.col("total_pages")
    return source_files.join(t, "file_name").select("file_name", offset.alias("page_offset"), F.when(offset == 0, F.lit(fallback)).otherwise(F.abs(offset)).alias("radius"), F.col("t").alias("target_pages"))


def _spread(boxes: DataFrame, window: DataFrame) -> DataFrame:
    """Text boxes with a row for each target page of their window; b_id is the box's, id that of box and page."""
    b = boxes.filter(F.length(F.trim("text")) >= 3).join(window, "file_name")
    pages = F.sequence(F.greatest(F.lit(1), F.col("page") - F.col("radius")), F.greatest(F.greatest(F.lit(1), F.col("page") - F.col("radius")), F.least("target_pages", F.col("page") + F.col("radius"))))
    b = b.select(F.col("id").alias("b_id"), "file_name", F.trim("text").alias("text"), F.explode(pages).alias("page"))
    return b.withColumn("id", F.concat_ws("@", "b_id", F.col("page").cast("string")))


def transfer_text_exact(boxes: DataFrame, target_words: DataFrame, window: DataFrame) -> DataFrame:
    """b_id, page and line rectangles of every hit of the boxes' texts within their page windows."""
    q = _spread(boxes, window)
    return find_on_page(target_words, q).join(q.select("id", "b_id"), "id").select("b_id", *PAGE, "x0", "y0", "x1", "y1")


def transfer_text_fuzzy(boxes: DataFrame, exact: DataFrame, target_words: DataFrame, window: DataFrame, threshold: float = 0.85) -> DataFrame:
    """b_id, page, ratio and rectangle of the best window of n - 5 to n + 5 words on each page, for boxes without an exact hit.

    A page and its boxes meet once. Of all windows only those are made into texts that can reach the threshold by their length and letters, the best ones first.
    """
    rest = boxes.join(exact.select(F.col("b_id").alias("id")).distinct(), "id", "left_anti")
    n = F.size(F.split("text", r"\s+"))
    q = _spread(rest, window).select(F.col("b_id").alias("id"), *PAGE, F.lower("text").alias("target"), (n - 5).alias("least"), (n + 5).alias("most"))
    return best_windows(with_texts(target_words, q), threshold, 0.3).withColumnRenamed("id", "b_id")


def match_lines(boxes: DataFrame, target_words: DataFrame, window: DataFrame, threshold: float = 0.8) -> DataFrame:
    """b_id, page, block_no, line_no, score: lines of the window whose token-set ratio with the box's text reaches the threshold."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    lines = target_words.groupBy(*PAGE, "block_no", "line_no").agg(text.alias("line"))
    q = _spread(boxes, window).join(lines, PAGE)
    # a common token is needed to reach the threshold: other pairs never come to the ratio
    q = q.filter(F.arrays_overlap(F.split("text", r"\s+"), F.split("line", r"\s+")) | (2.0 * F.least(F.length("text"), F.length("line")) >= threshold * (F.length("text") + F.length("line"))))
    return q.withColumn("score", token_set_ratio("text", "line") / 100.0).filter(F.col("score") >= threshold).select("b_id", *PAGE, "block_no", "line_no", "score")


def amend_prompts(boxes: DataFrame, target_pages: DataFrame) -> DataFrame:
    """file_name and prompt: the target's text with page marks and the numbered source items with their context."""
    marked = F.concat(F.lit("[PAGE "), F.col("page").cast("string"), F.lit("]\n"), "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("t")))), lambda p: p["t"]), "\n\n")
    pages = target_pages.groupBy("file_name").agg(text.alias("pages"))
    n = F.row_number().over(W.partitionBy("file_name").orderBy("seq"))
    item = F.concat(F.col("n").cast("string"), F.lit(". "), "text", F.lit(" ["), F.coalesce("context", F.lit("")), F.lit("]"))
    items = boxes.withColumn("n", n).groupBy("file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("i")))), lambda x: x["i"]), "\n").alias("items"))
    return items.join(pages, "file_name").select("file_name", F.concat_ws("\n\n", F.lit("Find each item in the new version."), "items", "pages", F.lit('Reply with {"matches": [{"source", "text", "page"}]}.')).alias("prompt"))


def parse_amend_matches(replies: DataFrame, boxes: DataFrame) -> DataFrame:
    """file_name, id (the source box with the same text, else the file's first), text, page of the matches in the replies."""
    from pagemask.operators.detect import fenced_json

    m = F.from_json(fenced_json(F.col("response")), "matches array<struct<source:string,text:string,page:int>>")
    d = replies.select("file_name", F.posexplode(m["matches"]).alias("n", "m")).select("file_name", "n", "m.*").filter((F.coalesce("page", F.lit(0)) > 0) & (F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0))
    by_text = boxes.groupBy("file_name", F.col("text").alias("source")).agg(F.min_by("id", "seq").alias("own"))
    first = boxes.groupBy("file_name").agg(F.min_by("id", "seq").alias("any"))
    return d.join(by_text, ["file_name", "source"], "left").join(first, "file_name").select("file_name", "n", F.coalesce("own", "any").alias("id"), "text", "page")


#: Boxes of a page up to which each is held against all those taken before it.
FEW = 64


def suppress_overlaps(new: DataFrame, existing: DataFrame, threshold: float = 0.5) -> DataFrame:
    """New boxes (id, file_name, page, seq, x, y, w, h) that no existing one covers by the threshold; a box that is taken counts for those after it.

    Existing boxes are met by page; the order among new ones is followed page by page, where a box meets those taken before it, on a page of many boxes
    only those that touch one of its cells of a grid.
    """
    e = _prefixed(existing, [*PAGE, "x", "y", "w", "h"])
    share = coverage(*_box(), F.col("_x"), F.col("_y"), F.col("_x") + F.col("_w"), F.col("_y") + F.col("_h"))
    left = new.select("id", *PAGE, "seq", "x", "y", "w", "h").join(e, _same_page() & (share >= threshold), "left_anti")

    def few(r: list[list[float]]) -> list[int]:
        kept, at = [], []
        for i, (x, y, w, h) in enumerate(r):
            x1, y1, least = x + w, y + h, threshold * w * h
            covered = w * h > 0 and any(max(0.0, min(x1, c) - max(x, a)) * max(0.0, min(y1, d) - max(y, b)) >= least for a, b, c, d in kept)
            if not covered:
                kept.append((x, y, x1, y1))
                at.append(i)
        return at

    def many(r: np.ndarray) -> list[int]:
        ends = r[:, :2] + r[:, 2:]
        # cells of twice the usual size, and not so small that a large box has more than some thousands
        size = np.maximum(2 * np.median(np.abs(r[:, 2:]), axis=0), np.maximum((ends.max(axis=0) - r[:, :2].min(axis=0)) / 64, 1e-9))
        first, last = np.floor(r[:, :2] / size).astype(int).tolist(), np.floor(ends / size).astype(int).tolist()
        grid: dict[tuple[int, int], list[int]] = {}
        at = []
        for i, ((a, b), (c, d)) in enumerate(zip(first, last)):
            x, y, w, h = r[i]
            cells = [(k, l) for k in range(a, c + 1) for l in range(b, d + 1)]
            near = np.unique(np.array([j for cell in cells for j in grid.get(cell, ())], dtype=int))
            cut = np.maximum(0, np.minimum(x + w, ends[near, 0]) - np.maximum(x, r[near, 0])) * np.maximum(0, np.minimum(y + h, ends[near, 1]) - np.maximum(y, r[near, 1]))
            if not (w * h > 0 and (cut >= threshold * w * h).any()):
                at.append(i)
                for cell in cells:
                    grid.setdefault(cell, []).append(i)
        return at

    def scan(batches):
        for b in batches:
            boxes = b.column(2)
            ends, values = boxes.offsets.to_numpy(), boxes.values.flatten()
            r = np.stack([v.to_numpy(zero_copy_only=False) for v in values[4:]], axis=1)
            kept, page = [], []
            for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                at = many(r[lo:hi]) if hi - lo > FEW else few(r[lo:hi].tolist())
                kept += [lo + i for i in at]
                page += [k] * len(at)
            kept, page = pa.array(kept, pa.int64()), pa.array(page, pa.int64())
            own = {"file_name": b.column(0).take(page), "page": b.column(1).take(page), **{n: values[i].take(kept) for i, n in fields.items()}}
            yield pa.RecordBatch.from_arrays([own[c] for c in columns], names=columns)

    columns = left.columns
    # a page is one row: pages of a batch are gone through without a call for each
    order = [F.col("seq").isNull().alias("no_seq"), F.col("seq"), F.col("id").isNull().alias("no_id"), F.col("id")]
    fields = {1: "seq", 3: "id", 4: "x", 5: "y", 6: "w", 7: "h"}
    pages = left.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*order, "x", "y", "w", "h"))).alias("boxes"))
    return pages.mapInArrow(scan, left.schema)


def finalize_boxes(df: DataFrame) -> DataFrame:
    """Boxes with a text of three characters and more, with their mode: rectangle over 20 pt of height, else highlight."""
    return df.filter(F.length(F.trim("text")) >= 3).withColumn("selection_mode", F.when(F.col("h") > 20, "rectangle").otherwise("highlight"))


def transfer_stats(source: DataFrame, out: DataFrame) -> DataFrame:
    """matched, missed and total per file and source page, and over all (null file and page)."""
    got = out.select(F.col("b_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    j = source.select("id", *PAGE).join(got, "id", "left")
    g = j.groupingSets([["file_name", "page"], []], "file_name", "page").agg(F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("missed"), F.count("*").alias("total"))
    return g
