"""What the training-data operators share: reading id and text, streaming Arrow batches, storage paths."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that join_hot deals with by a broadcast: no other key has more than one in so many rows.
HOT_KEYS = 2000
#: Bytes of text that are worked on at once; a longer text is a portion of its own.
PORTION = 4 << 20
_OPEN: ContextVar[tuple[Scope, ...]] = ContextVar("open scopes", default=())


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string, null as empty): other columns, whatever their names, never reach an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees. Only a local session, where one machine does it all, may leave
    the setting out. The folder stays, unless a Scope is open."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.gettempdir() + "/pagemask-checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scope in _OPEN.get()[-1:]:
        scope.made.append(path)
    return path


class Scope:
    """Removes at its end the folders that operators have named inside it (`with Scope(spark):`), and no others: what was made before it, beside it in
    another thread, or in a scope within it isn't touched. Results that are read from such folders must be written before it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __enter__(self) -> Scope:
        self.token = _OPEN.set((*_OPEN.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _OPEN.reset(self.token)
        for path in self.made:
            drop_dir(self.spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, one: DataFrame, on: Column, count: str) -> DataFrame:
    """Inner join of many rows with a small row for each key, where one key may have any share of the rows.

    one: narrow, at most one row matches each of rows; `count` is its column with the number of rows that match it. The HOT_KEYS rows of the
    largest counts are broadcast, which is a bounded number; the rest meet in a shuffle, where each key has under one in HOT_KEYS rows.
    rows are read twice. No column may be in both.
    """
    first = [c for c in one.columns if c != count]
    hot = one.orderBy(F.col(count).desc(), *first).limit(HOT_KEYS).withColumn("_is_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), on, "left")
    rest = met.filter("_is_hot IS NULL").select(*rows.columns).join(one, on)
    return met.filter("_is_hot").select(*rest.columns).unionByName(rest)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder that shared_dir named."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def batches_of(columns: dict[str, pa.DataType], rows, every: int = 2000):
    """Record batches of `every` rows from an iterator of tuples."""
    schema = pa.schema(list(columns.items()))
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= every:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], schema=schema)


def portions(batches, column: int = 1, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most `most` bytes in a string column, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, stop - at)
            at = stop


def texts(batches):
    """(doc_id, text) of Arrow batches whose first two columns they are."""
    for b in portions(batches):
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


def spans_text(spans: Column) -> Column:
    """'kind:start:end' of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(found: DataFrame, base: list[str], spans_col: str = "spans") -> DataFrame:
    """doc_id, n_<kind> for each base kind, base_sha256 and spans of an operator's span arrays (sorted by start, then kind)."""
    s = F.col(spans_col)

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of_kind(k) for k in base],
        F.sha2(spans_text(F.filter(s, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        spans_text(s).alias("spans"),
    )
