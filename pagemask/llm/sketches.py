"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below a fixed fraction of the hash range; a document without one holds its least hash alone. So the
sketch of two documents together is the hashes below the threshold of both, or else the least of all (`merged`): sketches of parts merge
into the sketch of the whole, in any order. As all sketches hold the same part of the hash range, the share of one's hashes in the other
estimates how much of a document another one contains, however unequal they are (`containment`), and their Jaccard similarity (`likeness`).

Where a document is compared with the next one in the order of ids, documents are dealt to ranges of ids; each range gets a copy of the first document
of the range after it, so that the next document of each is at hand. A range streams through its task in order, and texts are shuffled once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import id_and_text, portions
from pagemask.llm.near_copies import shingles

#: The part of all shingles whose hashes are kept, as one in so many.
ONE_IN = 8
#: Rows of a range of ids, and ranges at most: their bounds are in every task.
RANGE_ROWS = 1_000
RANGES = 4_096


def sketch(text: str, words: int = 5, one_in: int = ONE_IN) -> np.ndarray:
    """The sketch's hashes, ascending."""
    h = shingles(text, words)
    return h[: max(1, int(np.searchsorted(h, np.uint64((1 << 64) // one_in)))) if len(h) else 0]


def likeness_of(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sketches; of two empty ones 1."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, words: int = 5, one_in: int = ONE_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points) and sketch (array of signed longs, ascending as unsigned), one row per input row.

    Texts are split and lower-cased as SimHash does it; a text of fewer words is one shingle. Null and blank texts have an empty sketch, equal texts have
    equal ones. Null ids and repeated rows stay. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def scan(batches):
        for b in portions(batches):
            texts = b.column(1).to_pylist()
            found = [sketch(t, words, one_in).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_chars long, sketch array<long>")


def _unsigned(c: Column) -> Column:
    """A long whose order is that of the unsigned hash."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def containment(a: Column, b: Column) -> Column:
    """Of two sketches: the share of a's document that b's contains, from the hashes of a in b; null if a is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two sketches' documents; of two empty ones 1."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(1.0))


def merged(sketches: DataFrame, by: list[str], one_in: int = ONE_IN, column: str = "sketch") -> DataFrame:
    """by and the sketch of each group's documents taken together. Hashes are put together before the shuffle, each once a task and group."""
    each = sketches.select(*by, F.explode_outer(column).alias("_h")).distinct()
    low = F.lit((1 << 64) // one_in - (1 << 63))
    order = F.array_sort(F.collect_list(F.when(_unsigned(F.col("_h")) < low, _unsigned(F.col("_h")))))
    held = each.groupBy(*by).agg(order.alias("_low"), F.min(_unsigned(F.col("_h"))).alias("_least"))
    both = F.when(F.size("_low") > 0, F.col("_low")).when(F.col("_least").isNull(), F.array().cast("array<long>")).otherwise(F.array("_least"))
    return held.select(*by, F.transform(both, _unsigned).alias(column))


def _ranges(docs: DataFrame, id_col: str, rows: int, most: int) -> tuple[list[int], dict[int, int]]:
    """Bounds of ranges of ids (a range holds the ids up to its bound), and for the greatest id of each range the range that it follows.
    Only these bounds reach the driver: `most` at most."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL")
    n = ids.count()
    parts = max(1, min(most, -(-n // rows)))
    bounds = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0] if n else []
    bounds = sorted(set(bounds))
    place = F.lit(0)
    if bounds:
        place = _place(F.col("id"), bounds)
    tops = sorted(ids.groupBy(place.alias("range")).agg(F.max("id").alias("top")).collect())
    # ids fall, so a range is followed by the one below it, and the last one by the first
    return bounds, {r["top"]: tops[(k + 1) % len(tops)]["range"] for k, r in enumerate(tops)}


def _place(ids: Column, bounds: list[int]) -> Column:
    """The number of bounds below an id."""
    sorted_ = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def place(v: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sorted_, v.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int32))

    return place(ids)


def spliced(text: str, after: str) -> str:
    """The text with its last half replaced by as many first characters of `after`, or all."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame, words: int = 5, one_in: int = ONE_IN, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited and near_next: each document's likeness to its edited text, that is
    the text `spliced` with the next document's, and to the next document.

    Documents follow each other by falling ids, rows of one id by a hash of their text; the first one follows the last, so a single document follows itself.
    A null id has no place in this order: its row is followed by nothing, as by an empty text, and near_next is null. Null texts are empty.
    One row per input row, repeated ones too; other columns are not read.
    """
    bounds, follows = _ranges(docs, id_col, range_rows, ranges)
    rows = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    heads = rows.sparkSession.createDataFrame(list(follows.items()), "_top long, _to int")
    own = _place(F.col("doc_id"), bounds) if bounds else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNotNull(), own).otherwise(-1 - F.pmod("th", F.lit(len(bounds) + 1)).cast("int")))
    rows = rows.join(F.broadcast(heads), F.col("doc_id") == F.col("_top"), "left")
    places = F.array_compact(F.array(F.struct(F.lit(0).alias("copy"), "range"), F.when(F.col("_to").isNotNull(), F.struct(F.lit(1).alias("copy"), F.col("_to").alias("range")))))
    # a copy stands after all rows of the range that it is copied to
    dealt = rows.select("doc_id", "text", "th", F.inline(places)).repartition("range").sortWithinPartitions("range", "copy", F.desc("doc_id"), F.desc("th"), "text").select("doc_id", "text", "range", "copy")
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("sketch", longs), ("edited_sketch", longs), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def scan(batches):
        out: list[tuple] = []
        held = None  # the row whose next one hasn't come: id, text, sketch, range, whether it is a copy

        def row(now, after):
            doc, text, own, *_ = now
            edited = spliced(text, after[1] if after else "")
            its = sketch(edited, words, one_in)
            return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.view(np.int64), its.view(np.int64), likeness_of(own, its), likeness_of(own, after[2]) if after else None

        for b in portions(batches):
            for doc, text, part, copy in zip(*[c.to_pylist() for c in b.columns]):
                now = (doc, text, sketch(text, words, one_in), part, copy)
                if held and not held[4]:
                    out.append(row(held, now if part == held[3] and doc is not None else None))
                held = now
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if held and not held[4]:
            out.append(row(held, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return dealt.mapInArrow(scan, "doc_id long, n_chars long, edited_sha256 string, sketch array<long>, edited_sketch array<long>, near_edited double, near_next double")


def written(sketch_col: str) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch_col, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", "edited_sha256", written("sketch").alias("fingerprint"), written("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")
