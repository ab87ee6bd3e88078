"""Whitening of embeddings, fitted on distinct vectors with weights.

Vectors are quantised to integers first; equal ones are one group, found by a shuffle with partial sums, so a common vector is one row a task. The fit weighs
each distinct vector by one or by its number of rows: sums are exact integers, the covariance is a sum of centred matrix
products, one for each task, added up by Spark. What reaches the driver depends on the number of dimensions alone. Each distinct vector is
whitened once and joined back to its rows by a 256-bit digest; the commonest ones by a bounded broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import join_hot, materialize

SCALE, SHIFT = 64, 1_000_000
#: An entry from here on isn't exact any more once it is scaled.
LARGEST = float(1 << 46)
#: Eigenvalues below this part of the greatest one are rounding, not variance.
RANK = 1e-12
#: Rows that are multiplied at once.
BLOCK = 4096


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, floor(64 c) + 1,000,000 of each entry c. Rows go whose vector is null or empty, has entries that are null, not finite, or 2^46
    and more in size (they can't be told from their neighbours), or isn't of the commonest number of entries (the greater one of equally common ones)."""
    c = F.col("v")
    good = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.size(c) > 0) & good)
    sizes = rows.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size(c) == (sizes["d"] if sizes else 0))
    return rows.select("vec_id", F.transform(c, lambda e: F.floor(e * SCALE) + F.lit(SHIFT)).alias("x"))


def _digest(x: Column) -> Column:
    return F.sha2(F.array_join(x.cast("array<string>"), ","), 256)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(parts: DataFrame, kind: str) -> dict[int, list]:
    """Lists `v` of equal length added up element by element for each `i`; the result has as many numbers as one task gives."""
    each = parts.select("i", F.posexplode("v").alias("j", "e")).groupBy("i", "j").agg(F.sum(F.col("e").cast(kind)).alias("e"))
    out: dict[int, dict] = {}
    for r in each.collect():
        out.setdefault(r["i"], {})[r["j"]] = r["e"]
    return {i: [row[j] for j in range(len(row))] for i, row in out.items()}


def _sums(distinct: DataFrame, weight: str) -> list[int]:
    """The sum of the weights, then the weighted sums of all dimensions, exact."""

    def scan(batches):
        total = None
        for b in batches:
            x, w = _matrix(b.column(0)), b.column(1).to_numpy()
            # parts of 2^20, so that no product sum leaves 64 bits within a batch; Python's integers hold the total
            low, high = (x & 0xFFFFF), x >> 20
            own = [int(w.sum()), *((int(h) << 20) + int(l) for h, l in zip(w @ high, w @ low))]
            total = own if total is None else [a + c for a, c in zip(total, own)]
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "v": pa.array([[str(t) for t in total]], pa.list_(pa.string()))})

    parts = distinct.select("x", F.col(weight).cast("long")).mapInArrow(scan, "i int, v array<string>")
    return [int(t) for t in _added(parts, "decimal(38,0)").get(0, [])]


class Centre:
    """Of sums S over a weight n: x - S/n to full double precision, by the whole part of S/n first."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exact; None where a sum leaves 64 bits."""
        rest = np.array([s % self.n for s in self.sums], dtype=object)
        near = self.n**2 * (self.of(x) ** 2).sum(axis=1)
        if len(near) and near.max() < 2.0**62 and self.n < 1 << 62:
            y = (x - self.whole) * self.n - rest.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, rest)) for row in (x - self.whole)]
        return [e if e < 1 << 63 else None for e in exact]


def _products(rows: DataFrame, values, width: int) -> np.ndarray:
    """The weighted sum of v^T v over all rows' values, which are centred. values(batch): the rows' values and weights."""

    def scan(batches):
        total = np.zeros((width, width))
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                v, w = values(b.slice(k, BLOCK))
                total += (v * w[:, None]).T @ v
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    got = _added(rows.mapInArrow(scan, "i int, v array<double>"), "double")
    return np.array([got[i] for i in range(width)]) if got else np.zeros((width, width))


def whitened(vectors: DataFrame, components: int = 16, weights: str = "one", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, explained, identity_error and whitened: each remaining row's vector on the first `components` unit eigenvectors of the
    covariance, over the root of the eigenvalue, as an array; explained: their parts of the trace.

    weights: "one" fits each distinct vector once, "counts" as often as it occurs; n is the sum of the weights, the divisor of every covariance.
    deviation: sum over the dimensions of (n x - S)^2 with the weighted sums S, exact; null where it leaves 64 bits. identity_error: the
    largest entry of the whitened vectors' covariance less the identity, one value for all. Components without variance are left out: at most
    n - 1 have any, so a single distinct vector has empty arrays and a null identity_error. `quantised` says which rows go. Null ids and repeated rows stay, an
    empty table gives no rows. The dimensions' square must fit the driver; nothing that grows with the rows reaches it.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights are one or counts")
    x = quantised(vectors, id_col, vector_col)
    distinct = materialize(x.groupBy("x").agg(F.count("*").alias("rows")).select(_digest(F.col("x")).alias("key"), "x", "rows", F.lit(1).cast("long").alias("one")), "vectors")
    weight = "one" if weights == "one" else "rows"
    schema = "vec_id {}, n long, deviation long, explained array<double>, identity_error double, whitened array<double>".format(dict(x.dtypes)["vec_id"])
    n, *sums = _sums(distinct, weight) or [0]
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    centre, d = Centre(n, sums), len(sums)

    def centred(b):
        return centre.of(_matrix(b.column(0))), b.column(1).to_numpy().astype(np.float64)

    v = _products(distinct.select("x", weight), centred, d) / n
    value, vector = np.linalg.eigh((v + v.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    kept = min(components, int((value > max(RANK * value[0], 0.0)).sum()))
    project = vector[:, :kept] / np.sqrt(value[:kept])
    explained = (value[:kept] / np.trace(v)).tolist() if kept else []

    def whiten(batches):
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                some = b.slice(k, BLOCK)
                rows = _matrix(some.column(1))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), some.column(3), pa.array(centre.deviations(rows), pa.int64()), pa.array(list(centre.of(rows) @ project), pa.list_(pa.float64()))],
                    names=["key", "rows", "w", "deviation", "whitened"],
                )

    white = distinct.select("key", "x", "rows", F.col(weight).alias("w")).mapInArrow(whiten, "key string, rows long, w long, deviation long, whitened array<double>")
    white = materialize(white, "whitened")

    def again(b):
        return _matrix(b.column(0)), b.column(1).to_numpy().astype(np.float64)

    error = float(np.abs(_products(white.select("whitened", "w"), again, kept) / n - np.eye(kept)).max()) if kept else None
    rows = x.select("vec_id", _digest(F.col("x")).alias("_key"))
    found = join_hot(rows, white.select("key", "rows", "deviation", "whitened"), F.col("_key") == F.col("key"), "rows")
    explained_col = F.array(*[F.lit(e) for e in explained]) if kept else F.array().cast("array<double>")
    return found.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", explained_col.alias("explained"), F.lit(error).cast("double").alias("identity_error"), "whitened")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = found.select("*", F.posexplode("whitened").alias("_k", "_w"))
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), "n", "deviation", F.col("_w").alias("whitened"), F.get("explained", F.col("_k")).alias("explained"), "identity_error")
