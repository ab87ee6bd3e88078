"""Near copies by the Jaccard similarity of word shingles.

A pair at similarity 0.8 differs in about 10 of SimHash's 64 bits, and often in more, so no budget of bits that a trie join can
afford finds all such pairs. Candidates come from MinHash instead: BANDS keys of ROWS minima each, which a pair at 0.8 misses
altogether with a probability of (1 - 0.8 ** ROWS) ** BANDS, about 1e-7. Every link is then verified on the exact shingle sets.

In a bucket of equal keys all members are first held against the least one. Texts of buckets that are then still in several components (texts
that share a long passage and little else, as a rule) meet anew by the rarest of their shingles: two sets with a similarity of `least` have one in common
among the first |set| - ceil(least |set|) + 1 of each, in any order of the shingles that is the same for all, so the rarest come first. A shared passage
is the commonest part of a text and never in this prefix; what only one text has leads to no other. Texts that such shingles connect, over any number
of them, form a cluster (of more than RIGHT texts: each shingle's texts by themselves). There, each member outside the largest component is
held against all of them, in blocks of bounded size. No link between members of one component is looked for, and a block returns a spanning
forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import id_and_text, join_hot, materialize, portions
from pagemask.llm.components import components
from pagemask.llm.simhash import fingerprints, first_of_each, links

BANDS = 40
ROWS = 5
#: Members of a bucket that one block holds, and those that are streamed past them.
LEFT = 500
RIGHT = 2000

_draw = np.random.default_rng(42)
_MUL = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, split as `fingerprint` does; a shorter text is one shingle, an empty one none."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64))


def name_of(sh: np.ndarray) -> int:
    """A signed hash that names a set of shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(sh.tobytes())).astype(np.int64)) if len(sh) else 0


def buckets(sh: np.ndarray) -> list[int]:
    """The keys of a set's bands."""
    import xxhash

    if not len(sh):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(sh), 256):
        np.minimum(least, (sh[k : k + 256, None] * _MUL + _ADD).min(axis=0), out=least)
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (Spark's hash of the text), node (the name of its shingle set) and the keys of its bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def scan(batches):
        for b in portions(batches):
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            columns = [b.column(0), b.column(2), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([buckets(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(scan, "doc_id long, th long, node long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """node and its set, of the texts whose hash is wanted (th, each once)."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.list_(pa.int64()))])

    def scan(batches):
        for b in portions(batches, 0):
            sets = [shingles(t, words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)

    # Copies of a text are one row a task before they meet; a semi-join would be moved below this step.
    texts = id_and_text(docs, id_col, text_col).groupBy(F.xxhash64("text").alias("th")).agg(F.first("text").alias("text")).join(wanted, "th")
    return texts.select("text").mapInArrow(scan, "node long, set array<long>").dropDuplicates(["node"])


def _verified(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """u, v: links of similarity `least` and more between the left and the right members of each block, a spanning forest over
    their components. rows: block, right (0 or 1), node, comp."""
    dealt = rows.join(sets, "node").select("block", "right", "node", "comp", "set").repartition("block").sortWithinPartitions("block", "right")

    def scan(batches):
        block, left, index, up = None, [], None, {}

        def find(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for b in batches:
            u, v = [], []
            ends = b.column(4).offsets.to_numpy()
            values = b.column(4).values.to_numpy().view(np.uint64)
            for k, (key, right, node, comp) in enumerate(zip(*[b.column(c).to_pylist() for c in range(4)])):
                if key != block:
                    block, left, index, up = key, [], None, {}
                mine = values[ends[k] : ends[k + 1]]
                if not right:
                    left.append((node, comp, mine.copy()))
                    continue
                if not left:
                    continue
                if index is None:
                    sizes = np.array([len(s) for *_, s in left])
                    every, owner = np.concatenate([s for *_, s in left]), np.repeat(np.arange(len(left)), sizes)
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order]
                lo, hi = np.searchsorted(index[0], mine, "left"), np.searchsorted(index[0], mine, "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(index[1][at], minlength=len(left))
                for x in np.flatnonzero(common >= least * (sizes + len(mine) - common) - 1e-9):
                    other, its, _ = left[x]
                    a, c = find(comp), find(its)
                    if a != c:
                        up[a] = c
                        u.append(other)
                        v.append(node)
            if u:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.mapInArrow(scan, "u long, v long")


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _stars(members: DataFrame) -> DataFrame:
    """Blocks that hold every member of a bucket against its least one."""
    pairs = members.filter("node <> head").select("head", "node").distinct()
    parts = pairs.groupBy("head").agg(F.ceil(F.count("*") / RIGHT).cast("int").alias("parts"))
    left = parts.select(F.col("head").alias("node"), _upto(F.col("parts")).alias("part"))
    left = left.select(F.xxhash64("node", "part").alias("block"), F.lit(0).alias("right"), "node", F.col("node").alias("comp"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    right = pairs.join(parts, "head").select(F.xxhash64("head", part).alias("block"), F.lit(1).alias("right"), "node", F.col("node").alias("comp"))
    return left.unionByName(right)


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """node, each once, of the members of buckets that hold several components."""
    m = members.filter("n > 2").select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    several = m.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("bucket")
    return m.join(several, "bucket", "left_semi").select("node").distinct()


def rare_shingles(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """node and bucket: the shingles of a node's prefix that another one of the nodes has too. nodes: node; sets: node, set."""
    own = sets.join(nodes, "node", "left_semi")
    every = own.select("node", F.explode("set").alias("shingle"))
    often = every.groupBy(F.col("shingle").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
    ordered = F.array_sort(F.collect_list(F.struct("n", "key")))
    shared = join_hot(every, often, F.col("shingle") == F.col("key"), "n").groupBy("node").agg(ordered.alias("own"))
    # shingles of this node alone are the rarest: they fill the prefix first
    size = F.col("size")
    room = size - F.ceil(F.lit(least) * size - 1e-6) + 1 - (size - F.size("own"))
    shared = shared.join(own.select("node", F.size("set").alias("size")), "node")
    return shared.select("node", F.explode(F.slice("own", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("s")).select("node", F.col("s.key").alias("bucket"))


def _clusters(rare: DataFrame) -> DataFrame:
    """node and bucket: the cluster of nodes that buckets connect; in one of more than RIGHT nodes, its buckets as they are."""
    head = rare.groupBy("bucket").agg(F.min("node").alias("head"))
    found = components(rare.join(head, "bucket").select(F.col("node").alias("u"), F.col("head").alias("v")))
    roots = found.groupBy("root").agg((F.count("*") >= RIGHT).alias("wide"))  # the root itself has no row
    named = found.join(roots, "root").select("node", "root", "wide").union(roots.select("root", "root", "wide"))
    return rare.join(named, "node").select("node", F.when(F.col("wide"), F.col("bucket")).otherwise(F.col("root")).alias("bucket")).distinct()


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows (with node and bucket) of buckets with several rows, and n, head and sign: number, least and a name of the bucket's nodes."""
    full = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head"), F.expr("bit_xor(xxhash64(node))").alias("sign")).filter("n > 1")
    return rows.join(full, "bucket")


def _rest(members: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks that hold the members outside a bucket's largest component against all its members, where a bucket has several."""
    m = members.join(found, "node", "left").select("bucket", "n", "sign", "node", F.coalesce("root", "node").alias("comp"))
    sizes = m.groupBy("bucket", "n", "sign", "comp").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("bucket", "n", "sign").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.max("size").alias("most"), F.count("*").alias("comps")).filter("comps > 1")
    # buckets of the same members are one: the least, as left and right members must take the same one
    open_ = open_.groupBy("n", "sign").agg(F.min(F.struct("bucket", "main", "most")).alias("b")).select("n", "b.*")
    open_ = open_.select("bucket", "main", F.ceil((F.col("n") - F.col("most")) / LEFT).cast("int").alias("lefts"), F.ceil(F.col("n") / RIGHT).cast("int").alias("rights"))
    m = m.select("bucket", "node", "comp").join(open_, "bucket")
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    left = m.filter("comp <> main").select("bucket", "node", "comp", own("lefts").alias("l"), _upto(F.col("rights")).alias("r")).withColumn("right", F.lit(0))
    right = m.select("bucket", "node", "comp", own("rights").alias("r"), _upto(F.col("lefts")).alias("l")).withColumn("right", F.lit(1))
    return left.unionByName(right).select(F.xxhash64("bucket", "l", "r").alias("block"), "right", "node", "comp")


def _sim_members(docs: DataFrame, sketches: DataFrame, errors: int, id_col: str, text_col: str) -> DataFrame:
    """node, th and bucket, each once: the shingle sets of texts whose SimHash fingerprints are linked by the trie join, over any number of links; bucket names
    the component of fingerprints. Components of one set are left out."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col).dropDuplicates(["th"]).select("th", "fp"), "prints")
    roots = components(links(prints.select("fp").distinct(), errors))
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("th").alias("_th"), F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("bucket"))
    # sketches has one row of each set here
    return sketches.join(rooted, F.col("th") == F.col("_th")).select("node", "th", "bucket")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", errors: int | None = None) -> DataFrame:
    """doc_id, th and root (the shingle set that names the component): rows whose shingle sets have a Jaccard similarity of `least`
    and more are linked, and links are followed. One row per input row; null and empty texts are equal. Other columns aren't read.

    errors: texts whose SimHash fingerprints the trie join links at so many differing bits (`simhash.links`) are candidates as well, besides those of the bands; None: only these.
    """
    sketches = materialize(_sketches(docs, words, id_col, text_col), "sketches")
    each = sketches.dropDuplicates(["node"])
    rows = each.select("node", "th", F.explode("keys").alias("bucket"))
    if errors is not None:
        rows = rows.unionByName(_sim_members(docs, each, errors, id_col, text_col))
    members = materialize(_bucketed(rows), "members")
    sets = materialize(_sets(docs, members.select("th").distinct(), words, id_col, text_col), "sets")
    star = materialize(_verified(_stars(members), sets, least), "star-links")
    linked = components(star)
    rare = materialize(rare_shingles(materialize(_open(members, linked), "open"), sets, least), "rare-shingles")
    rest = _verified(_rest(_bucketed(materialize(_clusters(rare), "clusters")), linked), sets, least)
    found = components(star.unionByName(rest)).withColumnRenamed("node", "_node")
    return sketches.join(found, F.col("node") == F.col("_node"), "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def without_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", errors: int | None = None) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last), of one id that of the smallest text hash."""
    return first_of_each(docs, near_copies(docs, words, least, id_col, text_col, errors), id_col, text_col)
