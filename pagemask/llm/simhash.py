"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are majority votes over the XXH64 hashes of word shingles. Equal fingerprints are one node. Two fingerprints with
at most `errors` differing bits agree in one of errors + 1 blocks of bits, so every fingerprint goes to one trie per block and
block value, and each trie is joined with itself: pairs of nodes are walked together from the root, differing bits add up,
and a pair is dropped once they exceed the budget, or when all below it is linked already. A trie gives the links of a
spanning forest, never all pairs of a dense group. Tries of more than HOT rows are split again by blocks of the other bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import id_and_text, join_hot, materialize, portions
from pagemask.llm.components import components

#: Rows of one trie above which it is split, and pairs of trie nodes held at once.
HOT = 200_000
PAIRS = 400_000


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 bits; each is 1 if it is set in over half of the shingles' hashes. No words: 0."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: only A-Z change, and only space and \t to \r split
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (Spark's hash of the text) and fp (the fingerprint's 64 bits as a signed long), one row per input row."""

    def scan(batches):
        for b in portions(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=["doc_id", "th", "fp"])

    return id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(scan, "doc_id long, th long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Least index of each index's component, under links a-b and those that `root` has."""
    root = np.arange(n) if root is None else root.copy()
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            return root
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class Trie:
    """Binary tries over the rows of several groups: a node is a range of sorted rows that share a group and leading bits."""

    def __init__(self, group: np.ndarray, keys: np.ndarray, errors: int):
        self.keys, self.errors, self.n = keys, errors, len(keys)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if self.n else np.zeros(0, np.int64)
        self.ranges = first, np.r_[first[1:], self.n].astype(np.int64)
        self.root = np.arange(self.n)

    def split(self, level: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the ones begin in each node, at the bit of a level."""
        ones = np.r_[0, np.cumsum((self.keys >> np.uint64(63 - level)) & np.uint64(1))].astype(np.int64)
        return hi - (ones[hi] - ones[lo])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.root = _roots(self.n, a, b, self.root)

    def join(self) -> np.ndarray:
        lo, hi = self.ranges
        many = hi - lo > 1
        lo, hi = lo[many], hi[many]
        self.walk(0, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))
        return self.root

    def walk(self, level: int, pairs: np.ndarray) -> None:
        """pairs: bounds of the one node, bounds of the other, bits that differ so far. Equal nodes stand for a self-join."""
        while pairs.shape[1]:
            a, b, c, d, diff = pairs
            single = (b - a == 1) & (d - c == 1)
            if single.any():  # two rows are compared at once
                x, y = a[single], c[single]
                near = np.bitwise_count(self.keys[x] ^ self.keys[y]) <= self.errors
                self.link(x[near], y[near])
                pairs = pairs[:, ~single]
                continue
            if level == 64:
                return
            if pairs.shape[1] > PAIRS:
                turns = np.r_[0, np.cumsum(self.root[1:] != self.root[:-1])]
                open_ = (turns[a] != turns[b - 1]) | (turns[c] != turns[d - 1]) | (self.root[a] != self.root[c])
                pairs = pairs[:, open_]
                if pairs.shape[1] > PAIRS:
                    half = PAIRS // 2
                    for k in range(0, pairs.shape[1], half):
                        self.walk(level, self.closed(pairs[:, k : k + half]))
                    return
                continue
            m, k = self.split(level, a, b), self.split(level, c, d)
            same = a == c
            level += 1
            pairs = np.concatenate(
                [
                    np.stack([a, m, c, k, diff]),
                    np.stack([m, b, k, d, diff]),
                    np.stack([a, m, k, d, diff + 1]),
                    np.stack([m, b, c, np.where(same, c, k), diff + 1]),  # a self-join meets its two halves once
                ],
                axis=1,
            )
            twice = (pairs[0] == pairs[2]) & (pairs[1] - pairs[0] <= 1)
            pairs = pairs[:, (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= self.errors) & ~twice]

    def closed(self, pairs: np.ndarray) -> np.ndarray:
        """Pairs without those whose rows are all linked already."""
        a, b, c, d, _ = pairs
        turns = np.r_[0, np.cumsum(self.root[1:] != self.root[:-1])]
        return pairs[:, (turns[a] != turns[b - 1]) | (turns[c] != turns[d - 1]) | (self.root[a] != self.root[c])]


def links(nodes: DataFrame, errors: int = 3) -> DataFrame:
    """u, v: links of a spanning forest of the fingerprints (column fp, distinct) with at most `errors` differing bits."""
    width = 64 // (errors + 1)
    mask = (1 << width) - 1
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask)).alias("value")) for k in range(errors + 1)])
    rows = nodes.select("fp", F.inline(blocks))
    # At most (errors + 1) * 2^width keys exist, so the table of hot ones is bounded.
    hot = rows.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(F.col("block").alias("_b"), F.col("value").alias("_v"))
    rows = rows.join(F.broadcast(hot), (F.col("block") == F.col("_b")) & (F.col("value") == F.col("_v")), "left")
    other = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.floor(i / width) != F.col("block"))
    part = (64 - width) // (errors + 1)

    def sub(j: int):
        # the j-th part of the other bits: a hot trie's pairs agree in one of these too
        return F.aggregate(F.slice(other, j * part + 1, part if j < errors else 64 - width - errors * part), F.lit(0).cast("long"), lambda x, i: x * 2 + F.getbit(F.col("fp"), i).cast("long"))

    subs = F.when(F.col("_b").isNull(), F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("rest")))).otherwise(
        F.array(*[F.struct(F.lit(j).alias("part"), sub(j).alias("rest")) for j in range(errors + 1)])
    )
    rows = rows.select("fp", "block", "value", F.inline(subs))
    keyed = rows.select(F.xxhash64("block", "value", "part", "rest").alias("trie"), F.col("fp").alias("key"))
    dealt = keyed.repartition(F.col("trie")).sortWithinPartitions("trie")

    def scan(batches):
        def joined(group: np.ndarray, keys: np.ndarray):
            order = np.lexsort((keys, group))
            group, keys = group[order], keys[order]
            root = Trie(group, keys, errors).join()
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                return pa.RecordBatch.from_pydict({"u": keys[at].view(np.int64), "v": keys[root[at]].view(np.int64)})

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
            if sum(len(g) for g, _ in held) < 100_000 and len(held) < 64:
                continue
            g, k = (np.concatenate(x) for x in zip(*held))
            stop = int(np.searchsorted(g, g[-1]))  # the last trie may go on in the next batch
            if stop and (out := joined(g[:stop], k[:stop])) is not None:
                yield out
            held = [(g[stop:], k[stop:])]
        if held:
            g, k = (np.concatenate(x) for x in zip(*held))
            if len(g) and (out := joined(g, k)) is not None:
                yield out

    return dealt.mapInArrow(scan, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, errors: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, fp, root (a fingerprint that names the component) and component_id: the smallest doc_id that is reachable over
    links of at most `errors` differing bits.

    One row per input row. Null and empty texts have the fingerprint 0. Rows with a null id take part; their component's id is the
    smallest id that isn't null, or null. Repeated rows and equal texts share a component. Other columns are not read.
    """
    prints = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), errors))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id", "n"), "classes")
    return join_hot(prints, classes, F.col("fp") == F.col("_fp"), "n").select("doc_id", "th", "fp", "root", "component_id")


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each root of found (doc_id, th, root): that of the smallest id (null last), of one id that of the
    smallest text hash; where rows of this id and text differ in other columns, that of the smallest JSON form."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("at")).select(F.col("at.doc_id").alias("_id"), F.col("at.th").alias("_th"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    others = F.struct(*[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    one = kept.groupBy("id", "th").agg(F.min_by("row", F.to_json(others)).alias("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def without_near_duplicates(docs: DataFrame, words: int = 3, errors: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates."""
    return first_of_each(docs, near_duplicates(docs, words, errors, id_col, text_col), id_col, text_col)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
