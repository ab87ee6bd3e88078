"""Repeated byte strings by a hash-compared suffix sort of sampled suffixes.

A byte goes if a string of `length` bytes that covers it also starts earlier (in a smaller doc_id, or before it in the same
document). Sampling: in every window of `length` bytes the gram of GRAM bytes with the least hash is the window's anchor, so equal
windows have equal anchors at equal offsets, and each window belongs to one anchor. A text has about one anchor in 35 bytes.

1. Each task finds the anchors of its documents by prefix polynomial hashes, with a cryptographic digest (BLAKE2b, 128 bits) of all bytes of
   the anchor's windows: what is settled by it in steps 1 and 2 needs no look at the bytes, as no two strings with one digest are known.
   An anchor whose windows all stood earlier in the same batch is settled there; so a string that fills a third of all rows
   leaves one row a batch.
2. Anchors are shuffled by hash and sorted. Of occurrences with the same windows only the first can keep bytes. Where an anchor has
   different surroundings, the first of each goes on. Rows stream through: no group is held, whatever its size.
3. These fetch their surroundings from the text. The suffixes right of the anchor, and the reversed ones left of it, are
   mergesorted; two suffixes are compared by a binary search for their longest common extension over prefix hashes, and
   neighbours in the result are compared byte by byte, which verifies order and extensions (a collision leads to another base).
   Windows are equal if both extensions reach; the first of equal windows stays.
   An anchor with more than `most` different surroundings isn't held in a task, which bounds its memory: its windows are grouped by their
   bytes by Spark instead, with the same result.
4. Runs are merged per document, and the text is cut.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import batches_of, materialize

GRAM = 32
#: Bytes that are hashed at once: position bits of a sampled key.
CHUNK_BITS = 18
#: A null id sorts as the last one, after a document of that very id, from which its th tells it apart.
NO_ID = (1 << 63) - 1
NULL_TH = 1 << 62
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    if base not in _TABLES:
        n = (1 << CHUNK_BITS) + 1
        _TABLES[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, dtype=np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return _TABLES[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


class PrefixHash:
    """Polynomial hashes of all substrings of a byte array, from one prefix sum."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = _powers(base)
        self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]

    def of(self, start, stop):
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def anchors(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start where `valid`: anchor place g, first and last window start a and b, anchor hash, and the two halves of the
    digest of the windows' bytes and of the anchor's place among them."""
    none = np.zeros(0, np.int64)
    windows = len(data) - length + 1
    if windows < 1 or not valid[:windows].any():
        return none, none, none, *[none.view(np.uint64)] * 3
    one = PrefixHash(data, _BASES[0])
    grams = np.arange(len(data) - GRAM + 1)
    h = _mix(one.of(grams, grams + GRAM))
    low = np.uint64((1 << CHUNK_BITS) - 1)
    key = (h & ~low) | grams.astype(np.uint64)  # the least hash, the leftmost of equals
    span, width = length - GRAM + 1, 1
    least = key
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:windows], least[span - width : span - width + windows])
    starts = np.flatnonzero(valid[:windows])
    g = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (starts[1:] != starts[:-1] + 1)])
    a, b = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
    g = g[new]
    raw = data.tobytes()
    digests = np.frombuffer(b"".join([blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), (b + length).tolist())]), np.uint64).reshape(-1, 2)
    place = (g - a).astype(np.uint64) << np.uint64(32) | (b - a).astype(np.uint64)
    return g, a, b, h[g], digests[:, 0] ^ _mix(place), digests[:, 1]


def _runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merges runs that touch; rows are sorted by document and start, and stops rise with starts."""
    if not len(doc):
        return doc, start, stop
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])])
    return doc[new], start[new], stop[np.r_[new[1:], len(doc)] - 1]


_ROW = "settled boolean, key long, around long, more long, doc long, th long, g int, a int, b int"


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Step 1. settled: bytes from a to b go. Else an anchor at g, whose windows start from a to b."""

    def scan(batches):
        size = 1 << CHUNK_BITS

        def chunks(texts):
            """(row index, offset of the first byte, bytes) of pieces whose windows make up all windows."""
            for i, t in enumerate(texts):
                data = t.encode()
                for k in range(0, max(1, len(data) - length + 1), size - length):
                    if len(data) - k >= length:
                        yield i, k, data[k : k + size - 1]

        def packed(texts):
            held, n = [], 0
            for c in chunks(texts):
                if held and n + len(c[2]) > size:
                    yield held
                    held, n = [], 0
                held.append(c)
                n += len(c[2])
            if held:
                yield held

        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for held in packed(batch.column(2).to_pylist()):
                data = np.frombuffer(b"".join(c[2] for c in held), dtype=np.uint8)
                sizes = np.array([len(c[2]) for c in held])
                ends = np.cumsum(sizes)
                which = np.repeat(np.arange(len(held)), sizes)
                # a piece's last windows belong to the next piece, if there is one
                valid = np.arange(len(data)) + length <= ends[which]
                g, a, b, key, around, more = anchors(data, valid, length)
                row, shift = np.array([c[0] for c in held])[which[a]], (np.array([c[1] for c in held]) - (ends - sizes))[which[a]]
                parts.append((row, g + shift, a + shift, b + shift, key, around, more))
            if not parts:
                continue
            row, g, a, b, key, around, more = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((a, th[row], doc[row], more, around, key))
            later = np.r_[False, np.all([x[order][1:] == x[order][:-1] for x in (key, around, more)], axis=0)]
            gone, left = order[later], order[~later]
            gone = gone[np.lexsort((a[gone], row[gone]))]
            r, s, e = _runs(row[gone], a[gone], b[gone] + length)
            none = np.zeros(len(r), np.uint64)
            yield _batch(True, _mix(doc[r].view(np.uint64)), none, none, doc[r], th[r], s, s, e)
            yield _batch(False, key[left], around[left], more[left], doc[row[left]], th[row[left]], g[left], a[left], b[left])

    return docs.mapInArrow(scan, _ROW)


def _batch(settled, key, around, more, doc, th, g, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(key), settled)), *(pa.array(x.view(np.int64)) for x in (key, around, more)), pa.array(doc), pa.array(th), *(pa.array(x.astype(np.int32)) for x in (g, a, b))],
        names=["settled", "key", "around", "more", "doc", "th", "g", "a", "b"],
    )


def _settle(rows: DataFrame, length: int) -> DataFrame:
    """Step 2, on rows of step 1: the same schema; rows that aren't settled must look at their surroundings."""

    def scan(batches):
        before = None  # the last row's key and digest
        held = None  # the first row of the current key, while no other surroundings of it have come
        for batch in batches:
            t = pa.Table.from_batches([batch])
            settled = t.column(0).to_numpy()
            if settled.any():
                yield from t.filter(pa.array(settled)).to_batches()
                t = t.filter(pa.array(~settled))
            if not t.num_rows:
                continue
            key, around, more, doc, th, g, a, b = (t.column(i).to_numpy() for i in range(1, 9))
            last = before or (~key[0], 0, 0)
            same_key = np.r_[last[0], key[:-1]] == key
            later = same_key & (np.r_[last[1], around[:-1]] == around) & (np.r_[last[2], more[:-1]] == more)
            before = key[-1], around[-1], more[-1]
            first = np.flatnonzero(~later)
            # of two firsts of one key that follow each other, both have different surroundings
            follows = same_key[first]
            ask = follows.copy()
            ask[:-1] |= follows[1:]
            if len(first):
                if held is not None and follows[0]:
                    yield held
                if not follows[-1]:
                    ask[-1] = False
                    held = t.slice(int(first[-1]), 1).to_batches()[0]
                else:
                    held = None
            yield _batch(True, key[later], around[later], more[later], doc[later], th[later], a[later], a[later], b[later] + length)
            at = first[ask]
            yield _batch(False, key[at], around[at], more[at], doc[at], th[at], g[at], a[at], b[at])

    order = ["key", "around", "more", "doc", "th", "a"]
    return rows.repartition("key").sortWithinPartitions(*order).mapInArrow(scan, _ROW)


class Suffixes:
    """Byte strings in rows of a matrix, sorted within groups by comparing prefix hashes."""

    def __init__(self, group: np.ndarray, data: np.ndarray, size: np.ndarray, base: int = _BASES[0]):
        self.group, self.data, self.size = group, data, size
        self.hash = np.zeros((len(data), data.shape[1] + 1), dtype=np.uint64)
        for i in range(data.shape[1]):
            self.hash[:, i + 1] = self.hash[:, i] * np.uint64(base) + data[:, i] + np.uint64(1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of rows x and y: a binary search over the prefixes' hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        while (low < high).any():
            mid = (low + high + 1) // 2
            equal = self.hash[x, mid] == self.hash[y, mid]
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        end_x, end_y = n == self.size[x], n == self.size[y]
        at = np.minimum(n, self.data.shape[1] - 1)
        smaller = self.data[x, at] < self.data[y, at]
        return np.where(end_x | end_y, np.where(end_x & end_y, or_equal, end_x), smaller)

    def sort(self) -> np.ndarray:
        """Row numbers in order; groups stand together as they came. Bottom-up mergesort of all groups at once."""
        n = len(self.group)
        first = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if n else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, n])
        start, total = np.repeat(first, count), np.repeat(count, count)
        order, width = np.arange(n), 1
        inside = np.arange(n) - start
        while width < count.max(initial=0):
            pair = inside // (2 * width) * (2 * width)
            right = inside - pair >= width
            mid, end = np.minimum(pair + width, total), np.minimum(pair + 2 * width, total)
            low, high = np.where(right, pair, mid), np.where(right, mid, end)  # the sibling run
            base = low.copy()
            todo = np.flatnonzero(low < high)
            while len(todo):  # how many of the sibling come before: a binary search of comparisons
                m = (low[todo] + high[todo]) // 2
                before = self.less(order[start[todo] + m], order[todo], right[todo])
                low[todo], high[todo] = np.where(before, m + 1, low[todo]), np.where(before, high[todo], m)
                todo = todo[low[todo] < high[todo]]
            place = start + pair + (inside - np.where(right, mid, pair)) + (low - base)
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, 2 * width
        return order

    def verified(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Order, and each row's common extension with the one before it (-1 at a group's first), checked byte by byte; None if hashes collided."""
        order = self.sort()
        x, y = order[:-1], order[1:]
        within = np.arange(self.data.shape[1])[None, :] < np.minimum(self.size[x], self.size[y])[:, None]
        differs = (self.data[x] != self.data[y]) | ~within
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), self.data.shape[1]) if len(x) else np.zeros(0, np.int64)
        at = np.minimum(common, self.data.shape[1] - 1)
        ended = common == self.size[x]
        ordered = ended | ((common < self.size[y]) & (self.data[x, at] < self.data[y, at]))
        same = self.group[x] == self.group[y]
        if not ordered[same].all():
            return None
        return order, np.r_[-1, np.where(same, common, -1)][: len(order)]


def _sorted(group: np.ndarray, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[0]
    while (found := Suffixes(group, data, size, base).verified()) is None:
        base = (base * 0x5851F42D4C957F2D + 0x14057B7EF767814F) % (1 << 64) | 1
    return found


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of windows that also stand in an earlier row of the group. Rows are in order of occurrence within groups.

    left: bytes before the anchor, right: those from it on; a window of offset o has o bytes before the anchor; low to high are the
    offsets of a row's windows.
    """

    def matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in parts])
        wide = max(1, int(size.max(initial=0)))
        return np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), wide), size

    n, offsets = len(group), np.arange(length - GRAM + 1)
    classes = []
    for parts, needed in ((right, length - offsets), ([p[::-1] for p in left], offsets)):
        order, common = _sorted(group, *matrix(parts))
        starts = common[:, None] < needed[None, :]
        ids = np.empty((n, len(offsets)), dtype=np.int64)
        ids[order] = np.cumsum(starts, axis=0)
        classes.append(ids)
    own = (offsets[None, :] >= low[:, None]) & (offsets[None, :] <= high[:, None])
    row, at = np.nonzero(own)
    key = (at * (n + 1) + classes[0][row, at]) * (n + 1) + classes[1][row, at]
    _, first = np.unique(key, return_index=True)  # rows come in order of occurrence, so this is the first
    later = np.ones(len(key), dtype=bool)
    later[first] = False
    return row[later], at[later]


_FOUND = "settled boolean, doc long, th long, a int, b int, bytes binary"


def _compare(asked: DataFrame, length: int, most: int) -> DataFrame:
    """Step 3, on key, doc, th, g, a, b and the bytes from a to b + length. settled: bytes from a to b go. Else a window at a, by its bytes."""

    def out(settled, doc, th, a, b, data=None):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), settled)), pa.array(doc), pa.array(th), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(data if data is not None else [None] * len(doc), pa.binary())], names=["settled", "doc", "th", "a", "b", "bytes"])

    def solve(t):
        key, doc, th, g, a, b = (t.column(i).to_numpy() for i in range(6))
        data = t.column(6).to_pylist()
        order = np.lexsort((g, th, doc, key))
        key, doc, th, g, a, b = (x[order] for x in (key, doc, th, g, a, b))
        data = [data[i] for i in order]
        cut = (g - a).tolist()
        row, at = repeated_windows(key, [d[:c] for d, c in zip(data, cut)], [d[c:] for d, c in zip(data, cut)], g - b, g - a, length)
        start = g[row] - at
        ranked = np.lexsort((start, row))
        r, s, e = _runs(row[ranked], start[ranked], start[ranked] + length)
        return out(True, doc[r], th[r], s, e)

    def windows(t):
        for batch in t.to_batches(max_chunksize=500):
            doc, th, a, b, data = (batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6))
            rows = [(i, j, k + w, d[w : w + length]) for i, j, k, m, d in zip(doc, th, a, b, data) for w in range(m - k + 1)]
            yield out(False, np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), np.array([x[2] for x in rows]), [x[3] for x in rows])

    def scan(batches):
        held, n, last = [], 0, None  # rows of open groups; `last` is a group too large to hold
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = t.column(0).to_numpy()
            if last is not None:
                stop = int(np.searchsorted(keys, last, side="right"))
                yield from windows(t.slice(0, stop))
                if stop == len(keys):
                    continue
                t, last = t.slice(stop), None
            held.append(t)
            n += t.num_rows
            if n < 8_000:
                continue
            t = pa.concat_tables(held).combine_chunks()
            keys = t.column(0).to_numpy()
            stop = int(np.searchsorted(keys, keys[-1]))
            if stop:
                yield from each(t.slice(0, stop))
            t = t.slice(stop)
            if t.num_rows > most:
                last = keys[-1]
                yield from windows(t)
                held, n = [], 0
            else:
                held, n = [t], t.num_rows
        if n:
            yield from each(pa.concat_tables(held).combine_chunks())

    def each(t):
        """Whole groups: those of at most `most` rows in portions, larger ones by their windows."""
        keys = t.column(0).to_numpy()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[first[1:], len(keys)]
        start = 0
        for s, e in zip(first.tolist(), ends.tolist()):
            if e - s > most:
                if s > start:
                    yield solve(t.slice(start, s - start))
                yield from windows(t.slice(s, e - s))
                start = e
            elif e - start >= 8_000:
                yield solve(t.slice(start, e - start))
                start = e
        if start < len(keys):
            yield solve(t.slice(start))

    return asked.select("key", "doc", "th", "g", "a", "b", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(scan, _FOUND)


def _packed(docs: DataFrame) -> DataFrame:
    """doc, th and the text as compressed UTF-8, which is what the joins move."""

    def scan(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([z.compress(t.encode()) for t in b.column(2).to_pylist()], pa.binary())], names=["doc", "th", "packed"])

    return docs.mapInArrow(scan, "doc long, th long, packed binary")


def _surroundings(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The rows of step 2 that aren't settled, with their bytes."""
    places = asked.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("key", "g", "a", "b")).alias("places"))
    both = _packed(docs).join(places, (F.col("doc") == F.col("_doc")) & (F.col("th") == F.col("_th"))).select("doc", "th", "packed", "places")
    types = {"key": pa.int64(), "doc": pa.int64(), "th": pa.int64(), "g": pa.int32(), "a": pa.int32(), "b": pa.int32(), "bytes": pa.binary()}

    def scan(batches):
        z = zstandard.ZstdDecompressor()

        def rows():
            for b in batches:
                for doc, th, packed, places in zip(*(b.column(i).to_pylist() for i in range(4))):
                    data = z.decompress(packed)
                    for p in places:
                        yield p["key"], doc, th, p["g"], p["a"], p["b"], data[p["a"] : p["b"] + length]

        yield from batches_of(types, rows(), 5000)

    return both.mapInArrow(scan, "key long, doc long, th long, g int, a int, b int, bytes binary")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc (the id, NO_ID for null), th (tells texts of one id apart; 0 where ids don't repeat) and text: all rows, and each document once."""
    own = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("doc"), own.isNull().alias("null"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    repeats = rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").take(1)
    h = F.xxhash64("text")
    th = F.when(F.col("null"), F.lit(NULL_TH) + F.shiftrightunsigned(h, 3)).otherwise(F.shiftright(h, 2) if repeats else F.lit(0).cast("long"))
    rows = rows.select("doc", th.alias("th"), "text")
    return rows, rows.dropDuplicates(["doc", "th"]) if repeats else rows


def repeated_spans(rows: DataFrame, length: int = 100, most: int = 40_000) -> DataFrame:
    """doc, th and spans array<struct<a,b>>: bytes to remove, not merged, of rows of `keyed` that don't repeat."""
    first = materialize(_settle(_anchor_rows(rows, length), length), "anchors")
    asked = first.filter("NOT settled").select("key", "doc", "th", "g", "a", "b")
    second = materialize(_compare(_surroundings(rows, asked, length), length, most), "windows")
    windows = second.filter("NOT settled").select("bytes", F.struct("doc", "th", "a").alias("at"))
    firsts = windows.groupBy(F.col("bytes").alias("_bytes")).agg(F.min("at").alias("first"))
    third = windows.join(firsts, (F.col("bytes") == F.col("_bytes")) & (F.col("at") > F.col("first"))).select("at.doc", "at.th", "at.a", (F.col("at.a") + length).alias("b"))
    settled = [x.filter("settled").select("doc", "th", "a", "b") for x in (first, second)]
    return settled[0].unionByName(settled[1]).unionByName(third).groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 100, most: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, array<struct<start,stop>> in bytes) and kept (binary), one row per input row.

    Null and empty texts have no bytes. Null ids come after all others. Texts of one id are ordered by a hash of the text; rows
    that repeat both id and text are one document and share its result. Other columns are not read.
    """
    rows, once = keyed(docs, id_col, text_col)
    spans = repeated_spans(once, length, most).select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), "spans")
    both = _packed(rows).join(spans, (F.col("doc") == F.col("_doc")) & (F.col("th") == F.col("_th")), "left").select("doc", "th", "packed", "spans")
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), "kept": pa.binary()}

    def scan(batches):
        z = zstandard.ZstdDecompressor()

        def cut():
            for b in batches:
                for doc, th, packed, spans in zip(*(b.column(i).to_pylist() for i in range(4))):
                    data, runs = z.decompress(packed), []
                    for a, e in sorted((s["a"], s["b"]) for s in spans or ()):
                        if runs and a <= runs[-1]["stop"]:
                            runs[-1]["stop"] = max(runs[-1]["stop"], e)
                        else:
                            runs.append({"start": a, "stop": e})
                    edges = [0, *(x for r in runs for x in (r["start"], r["stop"])), len(data)]
                    yield None if doc == NO_ID and th >= NULL_TH else doc, len(data), runs, b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))

        yield from batches_of(types, cut(), 1000)

    return both.mapInArrow(scan, "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    r = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
