"""Batch detection over page chunks: tables as text, prompts, an injected model, parsing and locating of its replies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.functions.geometry import rect
from pagemask.functions.similarity import best_windows
from pagemask.operators.search import find_on_page, group_occurrences, with_texts
from pagemask.sources.layout import PAGE, READING

DETECTIONS = "array<struct<text:string,page:int,confidence:string,category:string,justification:string,context:string>>"
RECTS = "array<struct<x:double,y:double,w:double,h:double>>"


# ---- tables


def shape_tables(cells: DataFrame) -> DataFrame:
    """file_name, page, table_idx, headers, rows, row_count, col_count and bounds of tables given by their cells.

    Tables of one column and fewer than three rows are dropped. The first row is the header unless it is blank, or over half (integer)
    of its cells are longer than 50 characters or are numbers.
    """
    key = [*PAGE, "table_idx"]
    t = cells.withColumn("text", F.coalesce("text", F.lit("")))
    line = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda c: c["text"])
    rows = t.groupBy(*key, "row_idx").agg(line.alias("line"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda r: r["line"])
    g = rows.groupBy(*key).agg(lines.alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    g = g.withColumn("first", F.get("lines", F.lit(0))).withColumn("col_count", F.array_max(F.transform("lines", lambda r: F.size(r))))
    g = g.filter(~((F.col("col_count") <= 1) & (F.size("lines") < 3)))
    half = F.floor(F.size("first") / 2)
    header = (
        F.exists("first", lambda c: F.trim(c) != "")
        & (F.size(F.filter("first", lambda c: F.length(c) > 50)) <= half)
        & (F.size(F.filter("first", lambda c: F.regexp_like(F.trim(c), F.lit(r"^[-+]?[0-9][0-9.,]*%?$")))) <= half)
    )
    body = F.when(header, F.slice("lines", 2, F.greatest(F.lit(0), F.size("lines") - 1))).otherwise(F.col("lines"))
    return g.select(*key, F.when(header, F.col("first")).otherwise(F.array().cast("array<string>")).alias("headers"), body.alias("rows"), F.size(body).alias("row_count"), "col_count", "x0", "y0", "x1", "y1")


def table_titles(tables: DataFrame, words: DataFrame, above: float = 100.0) -> DataFrame:
    """tables with title: the last text line within `above` points over the table (with the one before if shorter than 20), without numbering."""
    key = [*PAGE, "table_idx"]
    w = words.select(*[F.col(c).alias("_" + c) for c in [*PAGE, *READING, "x0", "y0", "x1", "y1", "text"]])
    near = (F.col("_y1") <= F.col("y0")) & (F.col("_y0") >= F.greatest(F.lit(0.0), F.col("y0") - above)) & (F.col("_x1") > F.col("x0")) & (F.col("_x0") < F.col("x1"))
    hit = tables.select(*key, "x0", "y0", "x1").join(w, (F.col("file_name") == F.col("_file_name")) & (F.col("page") == F.col("_page")) & near)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_word_no", "_text"))), lambda x: x["_text"]), " ")
    lines = hit.groupBy(*key, "_block_no", "_line_no").agg(F.min("_y0").alias("y"), line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y", "_block_no", "_line_no", "line"))), lambda x: x["line"])
    g = lines.groupBy(*key).agg(ordered.alias("l"))
    last, prev = F.get("l", F.size("l") - 1), F.get("l", F.size("l") - 2)
    both = F.when((F.length(last) < 20) & (F.size("l") > 1), F.concat_ws(" ", prev, last)).otherwise(last)
    title = F.trim(F.regexp_replace(both, r"(?i)^\s*(table\s+[0-9.]+\s*[:.]?|[0-9]+(\.[0-9]+)*\.?)\s*", ""))
    return tables.join(g.select(*key, title.alias("title")), key, "left")


def table_inventory(tables: DataFrame, max_pages: int = 50) -> DataFrame:
    """file_name and a text that lists its tables on the first pages; untitled ones are numbered; with a total."""
    w = W.partitionBy("file_name").orderBy("page", "table_idx")
    t = tables.filter(F.col("page") <= max_pages).withColumn("n", F.row_number().over(w))
    name = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Table "), F.col("n").cast("string")))
    line = F.format_string("- %s (Page %d, %d columns x %d rows)", name, F.col("page"), F.col("col_count"), F.col("row_count"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return t.groupBy("file_name").agg(F.concat(F.array_join(lines, "\n"), F.lit("\nTotal: "), F.count("*").cast("string"), F.lit(" tables")).alias("inventory"))


def format_table(tables: DataFrame) -> DataFrame:
    """tables with block: the table as lines of text, blanks as -, short rows padded."""

    def line(mark: str, row: Column) -> Column:
        filled = F.transform(row, lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-")))
        padded = F.concat(filled, F.array_repeat(F.lit("-"), F.greatest(F.lit(0), F.col("col_count") - F.size(row))))
        return F.concat(F.lit(mark), F.array_join(padded, " | "))

    head = F.when(F.size("headers") > 0, F.array(line("[HEADER] ", F.col("headers")))).otherwise(F.array().cast("array<string>"))
    start = F.format_string("[TABLE START: %d columns x %d rows]", F.col("col_count"), F.col("row_count"))
    body = F.transform("rows", lambda r: line("[ROW] ", r))
    return tables.withColumn("block", F.array_join(F.concat(F.array(start), head, body, F.array(F.lit("[TABLE END]"))), "\n"))


def page_with_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """pages with the page's table blocks after the text."""
    blocks = format_table(tables).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "block"))), lambda x: x["block"]), "\n\n").alias("blocks"))
    return pages.join(blocks, PAGE, "left").select(*PAGE, F.concat_ws("\n\n", "text", "blocks").alias("text"))


# ---- prompts and model


#: Characters of known items in one prompt, about.
LIBRARY_CHARS = 1_000_000
#: Characters of known items that a task holds, about: blocks that meet the same copy of a chunk.
GROUP_CHARS = 16_000_000
#: Tasks that share the chunks of a group of blocks, where there are several blocks.
SALTS = 32


def _items(library: DataFrame) -> DataFrame:
    shown = [(label, F.coalesce(F.col(c), F.lit("")) if c in library.columns else F.lit("")) for label, c in (("Text", "redacted_text"), ("Context", "context"), ("Category", "category"), ("Justification", "justification"))]
    item = F.concat_ws("\n", *[F.concat(F.lit(("- " if i == 0 else "  ") + label + ': "'), c, F.lit('"')) for i, (label, c) in enumerate(shown)])
    return library.select("redacted_text", item.alias("item")).distinct()


def library_blocks(library: DataFrame, most: int = LIBRARY_CHARS) -> tuple[DataFrame, int]:
    """block and library: all items as lines of prompts (text, context, category and justification), each once, in order within a block; and the number of blocks.

    A library of up to `most` characters is one block. A longer one is dealt by the items' hashes to as many blocks as it takes, each put together in a task of its own.
    Only the library's length reaches the driver.
    """
    items = _items(library)
    total = items.agg(F.sum(F.length("item") + 2)).first()[0] or 0
    n = max(1, -(-total // most))
    block = (F.conv(F.substring(F.md5("item"), 1, 8), 16, 10).cast("long") % n).cast("int") if n > 1 else F.lit(0)
    ordered = F.array_sort(F.collect_list(F.struct("redacted_text", "item")))
    text = F.array_join(F.transform(ordered, lambda x: x["item"]), "\n\n")
    return items.groupBy(block.alias("block")).agg(text.alias("library")), n


def _with_library(chunks: DataFrame, library: DataFrame, most: int) -> DataFrame:
    """chunks with a row for each block of the library, and its text. One block, whose length is known to be within `most`, is broadcast; several are joined in groups of
    GROUP_CHARS characters, with the chunks dealt to SALTS tasks for each: a chunk is shuffled once a group, and meets the group's blocks after that."""
    blocks, n = library_blocks(library, most)
    if n == 1:
        return chunks.withColumn("library_block", F.lit(0)).join(F.broadcast(blocks.withColumnRenamed("block", "library_block")), "library_block", "left")
    each = max(1, GROUP_CHARS // most)
    groups = -(-n // each)
    salted = chunks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("_salt", F.pmod(F.xxhash64("file_name", "start_page"), F.lit(SALTS)).cast("int"))
    # every number has its row, also one that no item's hash has hit
    numbers = library.sparkSession.range(n).select(F.col("id").cast("int").alias("block"))
    spread = numbers.join(blocks, "block", "left").select(F.col("block").alias("library_block"), F.floor(F.col("block") / each).cast("int").alias("_group"), "library", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return salted.join(spread.hint("merge"), ["_group", "_salt"]).drop("_group", "_salt")


ROLE = "You review clinical documents for confidential information."


def _prompt_ends(role: str) -> tuple[Column, Column]:
    """What stands in a prompt before the known items, and after them."""

    def part(label: str, col: str) -> Column:
        return F.when(F.coalesce(F.length(col), F.lit(0)) > 0, F.concat(F.lit(label + "\n"), col))

    head = F.concat_ws("\n\n", F.lit(role), part("Title pages:", "title_text"), part("Contents:", "toc_text"), part("Outline:", "outline"))
    tail = F.concat_ws(
        "\n\n", F.when(F.coalesce(F.length("section_title"), F.lit(0)) > 0, F.concat(F.lit("Section: "), "section_title")), F.format_string("Pages %d to %d", F.col("start_page"), F.col("end_page")), F.col("text"),
        F.lit('Reply with a JSON array of {"text", "page", "confidence", "category", "justification", "context"}.'),
    )
    return head, tail


def _known(library: Column) -> Column:
    return F.when(F.coalesce(F.length(library), F.lit(0)) > 0, F.concat(F.lit("Known items:\n"), library))


def build_prompts(chunks: DataFrame, contexts: DataFrame, library: DataFrame, role: str = ROLE, most: int = LIBRARY_CHARS) -> DataFrame:
    """chunks with library_block and prompt: role, document context, known items, section, page range, text and the form of the reply.

    A library that doesn't fit a prompt (`most` characters) gives a chunk one prompt for each of its blocks; no item is left out, and the replies of all of them are the chunk's.
    """
    c = _with_library(chunks.join(contexts, "file_name", "left"), library, most)
    head, tail = _prompt_ends(role)
    return c.select(*chunks.columns, "library_block", F.concat_ws("\n\n", head, _known(F.col("library")), tail).alias("prompt"))


def prompt_digests(chunks: DataFrame, contexts: DataFrame, library: DataFrame, role: str = ROLE, most: int = LIBRARY_CHARS) -> DataFrame:
    """file_name, start_page, library_block, n and digest: length and SHA-1 of each prompt of `build_prompts`, one row a prompt, without its text.

    All chunks of a library block begin alike: the hash of this beginning is kept, and goes on with each chunk's own end. A chunk is shuffled once for a group of blocks
    (GROUP_CHARS characters), as there; a task holds the group's blocks and goes through its chunks.
    """
    blocks, n = library_blocks(library, most)
    each = max(1, GROUP_CHARS // most)
    head, tail = _prompt_ends(role)
    binary = lambda c: c.cast("binary")
    c = chunks.join(contexts, "file_name", "left").select("file_name", "start_page", head.alias("head"), tail.alias("tail"))
    group = F.explode(F.sequence(F.lit(0), F.lit(-(-n // each) - 1))).alias("_group")
    c = c.select(group, F.pmod(F.xxhash64("file_name", "start_page"), F.lit(SALTS)).cast("int").alias("_salt"), "file_name", "start_page", F.lit(None).cast("int").alias("block"), (F.length("head") + F.length("tail") + 2).alias("n"), binary(F.col("head")).alias("head"), binary(F.col("tail")).alias("tail"))
    # every number has its row, also one that no item's hash has hit
    numbers = library.sparkSession.range(n).select(F.col("id").cast("int").alias("block"))
    known = F.coalesce(F.concat(_known(F.col("library")), F.lit("\n\n")), F.lit(""))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    b = numbers.join(blocks, "block", "left").select("block", known.alias("known"), F.floor(F.col("block") / each).cast("int").alias("_group"), salt)
    b = b.select("_group", "_salt", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("int").alias("start_page"), "block", F.length("known").alias("n"), binary(F.col("known")).alias("head"), F.lit(None).cast("binary").alias("tail"))
    rows = b.unionByName(c.withColumn("start_page", F.col("start_page").cast("int"))).repartition("_group", "_salt").sortWithinPartitions("_group", "_salt", F.col("block").isNull())
    names = ["file_name", "start_page", "library_block", "n", "digest"]

    def scan(batches):
        at, held, first, states = None, [], None, []
        out: list[list] = [[], [], [], [], []]

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=names)
            for v in out:
                v.clear()
            return batch

        for batch in batches:
            for g, s, file, page, block, n, head, tail in zip(*[c.to_pylist() for c in batch.columns]):
                if (g, s) != at:
                    at, held, first = (g, s), [], None
                if block is not None:
                    held.append((block, n, head))
                    continue
                if head != first:
                    begun = hashlib.sha1(head + b"\n\n")
                    first, states = head, []
                    for number, length, text in held:
                        state = begun.copy()
                        state.update(text)
                        states.append((number, length, state.copy))
                digests = []
                for _, _, copy in states:
                    state = copy()
                    state.update(tail)
                    digests.append(state.hexdigest())
                out[0] += [file] * len(states)
                out[1] += [page] * len(states)
                out[2] += [number for number, _, _ in states]
                out[3] += [n + length for _, length, _ in states]
                out[4] += digests
                if len(out[0]) >= 50_000:
                    yield made()
        if out[0]:
            yield made()

    return rows.mapInArrow(scan, "file_name string, start_page int, library_block int, n int, digest string")


def score_chunks(prompts: DataFrame, scorer: Callable[[str], str], parallel: int | None = None) -> DataFrame:
    """prompts without their text, with response and error. A call that fails gives an error, never a failed job.

    parallel bounds the concurrent calls. `score_missing` keeps the replies and asks only for those that are missing.
    """
    keys = [c for c in prompts.columns if c not in ("prompt", "text")]

    def call(batches):
        for pdf in batches:
            rows = []
            for p in pdf["prompt"]:
                try:
                    rows.append((scorer(p), None))
                except Exception as e:  # noqa: BLE001  the model is foreign code
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "response": [r for r, _ in rows], "error": [e for _, e in rows]})

    df = prompts.repartition(parallel) if parallel else prompts
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema if f.name in keys)
    return df.mapInPandas(call, f"{fields}, response string, error string")


def latest_replies(replies: DataFrame) -> DataFrame:
    """The last reply of each prompt: of all attempts that succeeded the last one, else the last failure; attempts is their number."""
    keys = [c for c in replies.columns if c not in ("attempt", "response", "error")]
    best = F.max_by(F.struct("response", "error"), F.struct(F.col("error").isNull(), "attempt", "response"))
    return replies.groupBy(*keys).agg(F.max("attempt").alias("attempts"), best.alias("b")).select(*keys, "attempts", "b.*")


def score_missing(prompts: DataFrame, scorer: Callable[[str], str], path: str, attempts: int = 3, parallel: int | None = None) -> DataFrame:
    """Scores the prompts that have no reply yet and returns the latest reply of each prompt: the prompts' columns without their text, prompt_hash, attempts, response and error.

    Replies are appended to the table at `path`, keyed by the prompts' columns and a hash of the prompt, so a prompt that changes is asked again. A prompt that failed is asked again, up to
    `attempts` times over all calls. A job that is lost midway has appended nothing; calling again scores what is missing, and nothing twice that is there. Replies of prompts that
    aren't asked for any more stay in the table and aren't returned. Prompts that are given twice are asked once.
    """
    spark = prompts.sparkSession
    keys = [c for c in prompts.columns if c not in ("prompt", "text")]
    asked = prompts.select(*keys, F.xxhash64("prompt").alias("prompt_hash"), "prompt").dropDuplicates([*keys, "prompt_hash"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name != "prompt")
    schema = f"{fields}, attempt int, response string, error string"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # so that there is a table
    known = latest_replies(spark.read.schema(schema).parquet(path)).select(*[F.col(k).alias("_" + k) for k in (*keys, "prompt_hash")], "attempts", "error")
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in (*keys, "prompt_hash")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    todo = asked.join(known, on, "left").filter(F.col("attempts").isNull() | (F.col("error").isNotNull() & (F.col("attempts") < attempts)))
    scored = score_chunks(todo.select(*keys, "prompt_hash", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"), "prompt"), scorer, parallel)
    scored.select(*[c.strip().split(" ")[0].strip("`") for c in schema.split(", ")]).write.mode("append").parquet(path)
    replies = spark.read.schema(schema).parquet(path)
    wanted = asked.select(*[F.col(k).alias("_" + k) for k in (*keys, "prompt_hash")])
    return latest_replies(replies).join(wanted, on, "left_semi")


def fenced_json(response: Column) -> Column:
    """The body of a ```json fence if there is one, else the response."""
    body = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(F.regexp_like(response, F.lit(r"(?s)```(?:json)?\s*.*?```")), body).otherwise(response))


def parse_detections(replies: DataFrame) -> DataFrame:
    """A row per detection of the replies, missing fields filled. A reply that isn't a JSON array gives none."""
    items = F.from_json(fenced_json(F.col("response")), DETECTIONS)
    keys = [c for c in replies.columns if c not in ("response", "error")]
    d = replies.select(*keys, F.posexplode(items).alias("n", "d")).filter(F.col("d").isNotNull())

    def of(field: str, default) -> Column:
        return F.coalesce(F.col(f"d.{field}"), F.lit(default)).alias(field)

    return d.select(*keys, "n", of("text", ""), of("page", 0), of("confidence", "medium"), of("category", "unknown"), of("justification", ""), of("context", ""))


def parse_summary(response: Column) -> Column:
    """The fields of a document summary reply as struct<compound,sponsor,indication,summary>."""
    return F.from_json(fenced_json(response), "compound string, sponsor string, indication string, summary string")


def summaries_to_fetch(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files without a stored summary."""
    return files.join(cache, "file_name", "left_anti")


def clean_detection(c: Column) -> Column:
    """White space collapsed; table marks dropped."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"^(\[(ROW|HEADER)\]\s*)+", ""))


def batch_id(path: Column, page: Column, text: Column) -> Column:
    """The first 16 hex digits of SHA-1 over path:page:text."""
    return F.substring(F.sha1(F.concat_ws(":", path, page.cast("string"), text)), 1, 16)


def dedupe_detections(df: DataFrame) -> DataFrame:
    """One row for each file, page and first rectangle (to 0.1 pt); unlocated ones for each file, page and text; the first by seq stays."""
    r = F.get("rects", F.lit(0))
    place = F.when(r.isNotNull(), F.concat_ws(",", *[F.bround(r[k], 1).cast("string") for k in "xywh"])).otherwise(F.concat(F.lit("text:"), "text"))
    w = W.partitionBy("file_name", "page", "_place").orderBy("seq")
    return df.withColumn("_place", place).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_place")


def replace_slice(results: DataFrame, new: DataFrame, file_name: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """results with the AI rows of a file (and page range) replaced by new ones."""
    gone = (F.col("category") == "ai") & (F.col("file_name") == file_name)
    if first is not None:
        gone &= F.col("page").between(first, last)
    return results.filter(~gone).unionByName(new)


def compound_names(contexts: DataFrame) -> DataFrame:
    """Distinct studied compounds, ignoring case; the first spelling (ord) stays."""
    c = contexts.withColumn("name", F.trim("name")).filter(F.length("name") > 0)
    return c.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "ord").alias("name"))


# ---- locating


def fuzzy_locate(targets: DataFrame, words: DataFrame, threshold: float = 0.8, window: int = 6) -> DataFrame:
    """id, ratio and rects of the best run of one to `window` words on the target's page; the first of equals.

    Length and letters drop runs that can't reach the threshold before any ratio is computed.
    """
    t = targets.select(F.col("id").cast("string"), *PAGE, F.lower("text").alias("target"), F.lit(1).alias("least"), F.lit(window).alias("most"))
    best = best_windows(with_texts(words, t.filter("target IS NOT NULL")), threshold)
    return best.select("id", "ratio", F.array(rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("rects"))


def _rect_list():
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1")))
    return F.transform(ordered, lambda r: F.struct(r["x0"].alias("x"), r["y0"].alias("y"), (r["x1"] - r["x0"]).alias("w"), (r["y1"] - r["y0"]).alias("h")))


def _widened(detections: DataFrame) -> DataFrame:
    """id, file_name, page, radius and the target with 1 to 4 context words on each side, where the context holds the target."""
    d = detections.withColumns({"cw": F.split(F.trim("context"), r"\s+"), "tw": F.split(F.trim("text"), r"\s+")}).filter(F.size("cw") >= F.size("tw"))
    at = F.filter(F.sequence(F.lit(1), F.size("cw") - F.size("tw") + 1), lambda i: F.slice("cw", i, F.size("tw")) == F.col("tw"))
    d = d.withColumn("at", F.get(at, F.lit(0))).filter("at IS NOT NULL AND size(cw) > 1")
    d = d.withColumn("radius", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.size("cw") - 1))))
    low = F.greatest(F.lit(1), F.col("at") - F.col("radius"))
    high = F.least(F.size("cw"), F.col("at") + F.size("tw") - 1 + F.col("radius"))
    return d.select(F.col("id").alias("det"), "radius", F.concat_ws("@", "id", F.col("radius").cast("string")).alias("id"), *PAGE, "text", F.array_join(F.slice("cw", low, high - low + 1), " ").alias("wide"))


def locate(detections: DataFrame, words: DataFrame, threshold: float = 0.8) -> DataFrame:
    """id, how and rects of each detection (id, file_name, page, text, context) on its page.

    One occurrence: its rectangles. Several: the target's part of the least widened text that occurs once, else the first occurrence.
    None: the best fuzzy run. Detections that aren't found have no row.
    """
    hits = find_on_page(words, detections).withColumnRenamed("id", "key")
    groups = group_occurrences(hits)
    counts = groups.groupBy("key").agg(F.max("occurrence").alias("n"))
    first = groups.filter("occurrence = 1").groupBy("key").agg(_rect_list().alias("rects")).join(counts, "key")
    many = detections.join(first.filter("n > 1").select(F.col("key").alias("id")), "id", "left_semi")
    wide = _widened(many)
    found = find_on_page(words, wide, "wide").groupBy("id").agg(F.count("*").alias("n"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("x1").alias("x1"), F.first("y1").alias("y1")).filter("n = 1")
    part = wide.join(found, "id").withColumn("s", F.expr("locate(lower(text), lower(wide)) - 1")).filter("s >= 0")
    width = F.col("x1") - F.col("x0")
    x = F.col("x0") + width * F.col("s") / F.length("wide")
    one = F.array(F.struct(x.alias("x"), F.col("y0").alias("y"), (width * F.length("text") / F.length("wide")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")))
    sure = part.groupBy("det").agg(F.min_by(one, "radius").alias("sure"))
    exact = first.join(sure, F.col("key") == F.col("det"), "left").select(
        F.col("key").alias("id"), F.when(F.col("n") == 1, "exact").when(F.col("sure").isNotNull(), "context").otherwise("first").alias("how"),
        F.when(F.col("n") == 1, F.col("rects")).otherwise(F.coalesce("sure", "rects")).cast(RECTS).alias("rects"),
    )
    rest = detections.join(exact, "id", "left_anti")
    return exact.unionByName(fuzzy_locate(rest, words, threshold).select("id", F.lit("fuzzy").alias("how"), F.col("rects").cast(RECTS)))


def locate_all(targets: DataFrame, words: DataFrame, threshold: float = 0.8) -> DataFrame:
    """id, how and rects: every rectangle of the phrase on the page, else one fuzzy run."""
    exact = find_on_page(words, targets).groupBy("id").agg(_rect_list().cast(RECTS).alias("rects")).select("id", F.lit("exact").alias("how"), "rects")
    rest = targets.join(exact, "id", "left_anti")
    return exact.unionByName(fuzzy_locate(rest, words, threshold).select("id", F.lit("fuzzy").alias("how"), F.col("rects").cast(RECTS)))
