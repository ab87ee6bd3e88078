"""Table grids on Arrow batches: a table's cells are one row, and neighbours, places and matches of a whole batch are found at once by sorting numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from pagemask.functions.similarity import Cells, cell, indel, lcs

SIDES = ("up", "down", "left", "right")
#: Stands for a missing place.
NONE = -(1 << 40)
#: Pairs of boxes and cells, or of texts, that are held at once.
AT_ONCE = 1_000_000


def whole(a: pa.Array) -> np.ndarray:
    return a.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


def opened(lists: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The row of each element of an array of lists of structs, and the elements' fields."""
    values = lists.flatten()
    n = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), n), dict(zip([f.name for f in values.type], values.flatten()))


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges lo to hi: the number of the range and the index, for each index in it."""
    n = hi - lo
    return np.repeat(np.arange(len(n)), n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def near(table: np.ndarray, row: np.ndarray, col: np.ndarray) -> dict[str, np.ndarray]:
    """The index of the cell above, below, left and right of each, by a look along its column and its row; -1 without one. A gap in the grid has no neighbour."""
    out = {side: np.full(len(table), -1) for side in SIDES}
    for first, second, before, after in ((col, row, "up", "down"), (row, col, "left", "right")):
        o = np.lexsort((second, first, table))
        a, b = o[:-1], o[1:]
        next_ = (table[a] == table[b]) & (first[a] == first[b]) & (second[a] + 1 == second[b]) & (first[a] != NONE) & (second[a] != NONE)
        a, b = a[next_], b[next_]
        out[after][a], out[before][b] = b, a
    return out


def take(a: pa.Array, at: np.ndarray) -> pa.Array:
    """Elements by index; null for -1."""
    return a.take(pa.array(at, pa.int64(), mask=at < 0))


def _limits(table: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The greatest place in each table, and 1; NONE without one."""
    most = np.full(n, NONE)
    np.maximum.at(most, table, at)
    return np.where(most == NONE, NONE, most + 1)


def is_key(row: np.ndarray, col: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Whether a cell is one of the four corners or the centre; rows and cols are those of its table."""
    corner = ((row == 0) | (row == rows - 1)) & ((col == 0) | (col == cols - 1))
    return (corner | ((row == rows // 2) & (col == cols // 2))) & (row != NONE) & (col != NONE)


def by_table(cells: DataFrame) -> DataFrame:
    """file_name, page, table_idx and cells (an array): one row a table. A frame that has an array of cells already is one."""
    if "cells" in cells.columns:
        return cells
    own = [c for c in ("row_idx", "col_idx", "x0", "y0", "x1", "y1", "text") if c in cells.columns]
    return cells.groupBy("file_name", "page", "table_idx").agg(F.collect_list(F.struct(*own)).alias("cells"))


def by_page(cells: DataFrame, *parts: str) -> DataFrame:
    """file_name, page and tables (an array of table_idx and cells): one row a page, dealt as the cells are. parts: the fields of a cell that are wanted, as arrays of their own
    instead of cells, which are much smaller."""
    inner = [F.col(f"cells.{p}").alias(p) for p in parts] or ["cells"]
    return by_table(cells).groupBy("file_name", "page").agg(F.collect_list(F.struct("table_idx", *inner)).alias("tables"))


def _codes(*parts: np.ndarray) -> list[np.ndarray]:
    """One number for each different row, in several arrays of the shape (columns, rows) alike."""
    every = np.concatenate(parts, axis=1)
    if not every.shape[1]:
        return [np.zeros(p.shape[1], np.int64) for p in parts]
    low = every.min(axis=1)
    size = [int(x) for x in every.max(axis=1) - low + 1]
    if math.prod(size) < 1 << 62:
        code = np.zeros(every.shape[1], np.int64)
        for column, least, n in zip(every, low, size):
            code = code * n + (column - least)
    else:
        o = np.lexsort(every[::-1])
        code = np.empty(len(o), np.int64)
        code[o] = np.cumsum(np.r_[True, (every[:, o[1:]] != every[:, o[:-1]]).any(axis=0)]) - 1
    return np.split(code, np.cumsum([p.shape[1] for p in parts])[:-1])


def met(there: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of equal rows (asked, there) of two arrays of the shape (columns, rows); rows with a missing number meet none."""
    have, want = (np.flatnonzero((a != NONE).all(axis=0)) for a in (there, asked))
    x, y = _codes(there[:, have], asked[:, want])
    o = np.argsort(x, kind="stable")
    who, at = spread(np.searchsorted(x[o], y, "left"), np.searchsorted(x[o], y, "right"))
    return want[who], have[o[at]]


def cells_of(tables: dict[str, pa.Array]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The table of each cell, and the cells' fields, of the elements of `by_page`."""
    if "cells" in tables:
        return opened(tables["cells"])
    parts = {c: v for c, v in tables.items() if c != "table_idx"}
    n = np.diff(parts["row_idx"].offsets.to_numpy())
    return np.repeat(np.arange(len(n)), n), {c: v.flatten() for c, v in parts.items()}


def in_order(page: np.ndarray, table: np.ndarray, f: dict[str, pa.Array]) -> np.ndarray:
    """The order of cells by page, table, row and column; of cells at one place by what else they hold."""
    row, col = whole(f["row_idx"]), whole(f["col_idx"])
    o = np.lexsort((col, row, table, page))
    a, b = o[:-1], o[1:]
    if ((page[a] == page[b]) & (table[a] == table[b]) & (row[a] == row[b]) & (col[a] == col[b])).any():
        words = f["text"].to_pylist()
        rank = {w: k for k, w in enumerate(sorted({w for w in words if w is not None}))}
        text = np.array([-1 if w is None else rank[w] for w in words])
        at = [f[c].cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False) for c in ("y1", "x1", "y0", "x0") if c in f]
        o = np.lexsort((text, *at, col, row, table, page))
    return o


def look_up(asked: DataFrame, cells: DataFrame, place: tuple[str, str, str]) -> DataFrame:
    """asked, each row with the cells at its place (columns of asked: table, row and column, on its file_name and page): table_idx, row_idx, col_idx, text, x0, y0 and the
    neighbours' texts and origins. Rows without a cell go."""
    own = [c for c in asked.columns if c not in ("file_name", "page")]
    types = {f.name: f for f in asked.schema}
    found = [("table_idx", IntegerType()), ("row_idx", IntegerType()), ("col_idx", IntegerType()), ("text", StringType()), ("x0", DoubleType()), ("y0", DoubleType())]
    found += [(f"{s}{p}", t) for s in SIDES for p, t in (("", StringType()), ("_x", DoubleType()), ("_y", DoubleType()))]
    schema = StructType([types["file_name"], types["page"], *[types[c] for c in own], *[StructField(*f) for f in found]])

    def scan(batches):
        for b in batches:
            who, a = opened(b.column(2))
            page, t = opened(b.column(3))
            inner, f = opened(t["cells"])
            row, col = whole(f["row_idx"]), whole(f["col_idx"])
            table = whole(t["table_idx"])[inner]
            want = np.stack([who, *[whole(a[c]) for c in place]])
            i, j = met(np.stack([page[inner], table, row, col]), want)
            sides = near(inner, row, col)
            out = [take(b.column(0), who[i]), take(b.column(1), who[i]), *[take(a[c], i) for c in own], take(t["table_idx"], inner[j])]
            out += [take(f[c], j) for c in ("row_idx", "col_idx", "text", "x0", "y0")]
            out += [take(f[c], sides[s][j]) for s in SIDES for c in ("text", "x0", "y0")]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    dealt = asked.repartition("file_name", "page").groupBy("file_name", "page").agg(F.collect_list(F.struct(*own)).alias("asked"))
    return dealt.join(by_page(cells), ["file_name", "page"]).select("file_name", "page", "asked", "tables").mapInArrow(scan, schema)


def holding(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """id, file_name, page, w, h of each box with the cell that shares the most area with it: the first of equals by row and column. table_idx, row_idx, col_idx, text, the neighbours'
    texts, dx, dy (the box's offset in the cell) and up_dx, up_dy and so on (in the neighbours)."""
    types = {f.name: f for f in boxes.schema}
    found = [("table_idx", IntegerType()), ("row_idx", IntegerType()), ("col_idx", IntegerType()), ("text", StringType()), *[(s, StringType()) for s in SIDES], ("dx", DoubleType()), ("dy", DoubleType())]
    found += [(f"{s}_dx", DoubleType()) for s in SIDES] + [(f"{s}_dy", DoubleType()) for s in SIDES]
    schema = StructType([*[types[c] for c in ("id", "file_name", "page", "w", "h")], *[StructField(*f) for f in found]])

    def scan(batches):
        for b in batches:
            page, box = opened(b.column(2))
            on, t = opened(b.column(3))
            inner, f = opened(t["cells"])
            row, col = whole(f["row_idx"]), whole(f["col_idx"])
            real = lambda a: a.cast(pa.float64()).to_numpy(zero_copy_only=False)
            x, y, w, h = (real(box[c]) for c in "xywh")
            x0, y0, x1, y1 = (real(f[c]) for c in ("x0", "y0", "x1", "y1"))
            # one box of equal ids and sizes
            name = box["id"].dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
            (same,) = _codes(np.stack([page, name, (w + 0.0).view(np.int64), (h + 0.0).view(np.int64)]))
            ends = np.searchsorted(on[inner], np.arange(b.num_rows + 1))  # cells of a page lie together
            n = np.diff(ends)[page]
            picked, k = [], 0
            while k < len(page):
                stop = max(k + 1, int(np.searchsorted(np.cumsum(n[k:]), AT_ONCE, "right")) + k)
                i, j = spread(ends[page[k:stop]], ends[page[k:stop] + 1])
                i += k
                wide, high = np.fmin(x[i] + w[i], x1[j]) - np.fmax(x[i], x0[j]), np.fmin(y[i] + h[i], y1[j]) - np.fmax(y[i], y0[j])  # a missing end doesn't count
                hit = (wide > 0) & (high > 0) & (wide * high > 0)
                picked.append((i[hit], j[hit], (wide * high)[hit]))
                k = stop
            i, j, cut = (np.concatenate(c) for c in zip(*picked)) if picked else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            o = np.lexsort((j, col[j], row[j], -cut, same[i]))
            i, j = i[o], j[o]
            first = np.r_[True, same[i[1:]] != same[i[:-1]]] if len(i) else np.zeros(0, bool)
            i, j = i[first], j[first]
            sides = near(inner, row, col)

            def off(own, at, s):
                k = sides[s][j]
                return _double(np.where(k < 0, np.nan, at[j] + (own[i] - at[j]) - at[k]))

            out = [take(box["id"], i), take(b.column(0), page[i]), take(b.column(1), page[i]), take(box["w"], i), take(box["h"], i), take(t["table_idx"], inner[j])]
            out += [take(f[c], j) for c in ("row_idx", "col_idx", "text")] + [take(f["text"], sides[s][j]) for s in SIDES]
            out += [_double(x[i] - x0[j]), _double(y[i] - y0[j]), *[off(x, x0, s) for s in SIDES], *[off(y, y0, s) for s in SIDES]]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    dealt = boxes.groupBy("file_name", "page").agg(F.collect_list(F.struct("id", "x", "y", "w", "h")).alias("boxes"))
    return dealt.join(by_page(cells), ["file_name", "page"]).select("file_name", "page", "boxes", "tables").mapInArrow(scan, schema)


_BOUNDS = ("x0", "y0", "x1", "y1")
_KEY = StructType([StructField(*f) for f in (("row", IntegerType()), ("col", IntegerType()), ("x0", DoubleType()), ("y0", DoubleType()), ("text", StringType()), *[(s, StringType()) for s in SIDES])])
_MATCH = [StructField(*f) for f in (("s_page", IntegerType()), ("s_table", IntegerType()), ("table_idx", IntegerType()), *[(f"s{c}", DoubleType()) for c in _BOUNDS])]


def _bounds(f: dict[str, pa.Array], table: np.ndarray, n: int) -> list[np.ndarray]:
    """The least x0 and y0 and the greatest x1 and y1 of each of n tables; NaN without one."""
    out = []
    for c, least in zip(_BOUNDS, (True, True, False, False)):
        v = np.full(n, np.inf if least else -np.inf)
        own = f[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
        (np.minimum if least else np.maximum).at(v, table[~np.isnan(own)], own[~np.isnan(own)])
        out.append(np.where(np.isinf(v), np.nan, v))
    return out


def _double(v: np.ndarray) -> pa.Array:
    return pa.array(v, pa.float64(), mask=np.isnan(v))


def anchors(source: DataFrame, target: DataFrame, matches: DataFrame) -> DataFrame:
    """file_name, s_page, s_table, page, table_idx of each match of two tables that are there, their bounds (sx0, tx0 and so on), and row, col, dx, dy and anchor of the key cell with the best anchor, the
    first of equals: 2 for equal content and 1 for each equal neighbour, 2 at least (without one: null); case and spaces around are ignored.

    Of the source only key cells and their neighbours' texts leave their page, for the page of their table's match; the target's cells stay where they are."""
    asked = StructType([StructField("file_name", StringType()), StructField("page", IntegerType()), *_MATCH, StructField("keys", ArrayType(_KEY))])

    def keys(batches):
        for b in batches:
            m_on, m = opened(b.column(2))
            t_on, t = opened(b.column(3))
            inner, f = opened(t["cells"])
            row, col = whole(f["row_idx"]), whole(f["col_idx"])
            at = np.flatnonzero(is_key(row, col, _limits(inner, row, len(t_on))[inner], _limits(inner, col, len(t_on))[inner]))
            who, table = met(np.stack([t_on, whole(t["table_idx"])]), np.stack([m_on, whole(m["s_table"])]))
            ends = np.searchsorted(inner[at], np.arange(len(t_on) + 1))
            n, j = spread(ends[table], ends[table + 1])
            j, sides = at[j], near(inner, row, col)
            own = [take(f[c], j) for c in ("row_idx", "col_idx", "x0", "y0", "text")] + [take(f["text"], sides[s][j]) for s in SIDES]
            own = pa.ListArray.from_arrays(pa.array(np.searchsorted(n, np.arange(len(who) + 1)), pa.int32()), pa.StructArray.from_arrays(own, names=_KEY.names))
            out = [take(b.column(0), m_on[who]), take(m["page"], who), take(b.column(1), m_on[who]), take(m["s_table"], who), take(m["table_idx"], who)]
            yield pa.RecordBatch.from_arrays([*out, *[_double(v[table]) for v in _bounds(f, inner, len(t_on))], own], names=asked.names)

    found = StructType([StructField("file_name", StringType()), StructField("page", IntegerType()), *_MATCH, *[StructField(f"t{c}", DoubleType()) for c in _BOUNDS]])
    found = StructType([*found, *[StructField(*f) for f in (("row", IntegerType()), ("col", IntegerType()), ("dx", DoubleType()), ("dy", DoubleType()), ("anchor", IntegerType()))]])

    def held(batches):
        for b in batches:
            who, m = opened(b.column(2))
            of, a = opened(m["keys"])
            t_on, t = opened(b.column(3))
            inner, f = opened(t["cells"])
            row, col = whole(f["row_idx"]), whole(f["col_idx"])
            match, table = met(np.stack([t_on, whole(t["table_idx"])]), np.stack([who, whole(m["table_idx"])]))
            to = np.full(len(who), NONE)
            to[match] = table  # a table is there once
            i, j = met(np.stack([inner, row, col]), np.stack([to[of], whole(a["row"]), whole(a["col"])]))
            sides = near(inner, row, col)
            coded = pa.concat_arrays([f["text"], *[a[c] for c in ("text", *SIDES)]]).dictionary_encode()
            words = coded.dictionary.to_pylist()
            number: dict[str, int] = {"": 0}
            plain = np.array([0, *[number.setdefault(w.strip(" ").lower(), len(number)) for w in words]])  # the first one is a missing text
            longer = np.array([False, *[len(w) > 0 for w in words]])
            there, own, *beside = np.split(coded.indices.fill_null(-1).to_numpy().astype(np.int64) + 1, np.cumsum([len(f["text"]), *[len(a["text"])] * 4]))
            total = 2 * (plain[there[j]] == plain[own[i]])
            for s, mine in zip(SIDES, beside):
                k = sides[s][j]
                other = np.where(k < 0, 0, there[k])
                total = total + (longer[other] & (mine[i] > 0) & (plain[other] == plain[mine[i]]))
            good = total >= 2
            i, j, total = i[good], j[good], total[good]
            o = np.lexsort((col[j], row[j], -total, of[i]))
            o = o[np.r_[True, of[i[o[1:]]] != of[i[o[:-1]]]]] if len(o) else o
            best = np.full(len(who), -1)
            best[of[i[o]]] = o
            # of each match: its key cell, the cell there, and their anchor
            i, j, total = (np.where(best < 0, -1, v[best]) if len(v) else best for v in (i, j, total))
            i, j, total = i[match], j[match], total[match]
            off = lambda c: pc.subtract(take(f[c], j), take(a[c], i))
            out = [take(b.column(0), who[match]), take(b.column(1), who[match]), *[take(m[x.name], match) for x in _MATCH], *[_double(v[table]) for v in _bounds(f, inner, len(t_on))]]
            out += [take(a["row"], i), take(a["col"], i), off("x0"), off("y0"), pa.array(total, pa.int32(), mask=total < 0)]
            yield pa.RecordBatch.from_arrays(out, names=found.names)

    own = matches.select("file_name", "s_page", "s_table", "page", "table_idx").groupBy("file_name", "s_page").agg(F.collect_list(F.struct("s_table", "page", "table_idx")).alias("matches"))
    s = own.join(by_page(source).withColumnRenamed("page", "s_page"), ["file_name", "s_page"]).select("file_name", "s_page", "matches", "tables").mapInArrow(keys, asked)
    s = s.repartition("file_name", "page").groupBy("file_name", "page").agg(F.collect_list(F.struct(*[f.name for f in _MATCH], "keys")).alias("matches"))
    return s.join(by_page(target), ["file_name", "page"]).select("file_name", "page", "matches", "tables").mapInArrow(held, found)


class Texts:
    """Texts by number, and whether two of them are alike (`cell` of `least` and more, or above it), which most pairs' lengths and letters rule out."""

    KEPT = 1_000_000

    def __init__(self, least: float = 0.85, above: bool = True):
        self.least, self.above = least, above
        self.known: dict[tuple[str, str], bool] = {}

    def numbered(self, *columns: pa.Array) -> list[np.ndarray]:
        """The columns' texts as numbers, -1 for null."""
        coded = pa.concat_arrays(columns).dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.plain = [" ".join(t.lower().split()) for t in self.words]
        self.size = np.array([len(p) for p in self.plain], np.int64)
        self.count = np.array([p.count(" ") + 1 for p in self.plain], np.int64)
        letters = np.frombuffer("".join(self.plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 63
        self.bags = np.bincount(np.repeat(np.arange(len(self.plain)), self.size) * 64 + letters, minlength=64 * len(self.plain)).astype(np.int32).reshape(-1, 64)
        self.bits = np.packbits(self.bags > 0, axis=1).view(np.uint64).ravel()
        return np.split(coded.indices.fill_null(-1).to_numpy().astype(np.int64), np.cumsum([len(c) for c in columns])[:-1])

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether letters that the other text has allow two texts to be alike."""
        x, y, n, m = self.bits[a], self.bits[b], self.size[a], self.size[b]
        k = np.minimum(n - np.bitwise_count(x & ~y), m - np.bitwise_count(y & ~x))
        return ((x & y) != 0) & ((2.0 * k >= (self.least - 1e-9) * (np.minimum(n, m) + k)) | (np.maximum(self.count[a], self.count[b]) >= 3))

    def each(self, a: np.ndarray, b: np.ndarray, of) -> np.ndarray:
        """A function's values of pairs of numbers; it is asked once for two texts, with the numbers of all different pairs."""
        pairs, at = np.unique(a * (len(self.words) + 1) + b, return_inverse=True)
        return of(pairs // (len(self.words) + 1), pairs % (len(self.words) + 1))[at]

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (self.size[a] > 0) & (self.size[b] > 0)
        for k in range(0, len(a), AT_ONCE // 8):
            x, y = a[k : k + AT_ONCE // 8], b[k : k + AT_ONCE // 8]
            common = np.minimum(self.bags[x], self.bags[y]).sum(axis=1)
            # both ratios are at most that of the common letters against as many of the longer cell's
            most = 2.0 * common / np.maximum(np.minimum(self.size[x], self.size[y]) + common, 1)
            out[k : k + AT_ONCE // 8] &= (most > self.least - 1e-9) | ((np.maximum(self.count[x], self.count[y]) >= 3) & (common > 0))
        for k in np.flatnonzero(out).tolist():
            pair = self.plain[a[k]], self.plain[b[k]]
            v = pair[0] == pair[1] and (self.least < 1.0 or not self.above) or self.known.get(pair)
            if v is None:
                if len(self.known) >= self.KEPT:
                    self.known.clear()
                v = self.known[pair] = self.reaches(*pair) and ((v := cell(*pair)) > self.least or (v == self.least and not self.above))
            out[k] = v
        return out

    def reaches(self, x: str, y: str) -> bool:
        """Whether the longest common subsequence allows it: of no window is it longer. Shared words of three and more aren't bounded so."""
        common = lcs(x, y)
        return 2.0 * common > self.least * (min(len(x), len(y)) + common) - 1e-9 or max(x.count(" "), y.count(" ")) >= 2

    def heads(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ratios of headers: 1 where both are blank, 0 where one is."""
        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = ("" if k < 0 else self.words[k].strip(" ") for k in (x, y))
            out.append(1.0 if x == y else 0.0 if not x or not y else indel(x, y) / 100.0)
        return np.array(out, np.float64)


_SCORED = StructType([StructField(*f) for f in (("file_name", StringType()), ("s_page", IntegerType()), ("s_table", IntegerType()), ("page", IntegerType()), ("table_idx", IntegerType()), ("structure", DoubleType()), ("headers", DoubleType()), ("adjacency", DoubleType()))])


def table_scores(source: DataFrame, target: DataFrame, pages: int) -> DataFrame:
    """Each table of the source with each table of the target within `pages` pages: file_name, s_page, s_table, page, table_idx and three scores from 0 to 1: structure, headers
    (first rows; 1 without any) and adjacency (key cells and their neighbours).

    Of a source table only its key cells, their neighbours and its first row leave their page; the target's cells stay where they are. A page's tables meet as one row."""
    s = by_table(source).select("file_name", "page", "table_idx", (F.array_max("cells.row_idx") + 1).alias("rows"), (F.array_max("cells.col_idx") + 1).alias("cols"), "cells")
    beside = lambda at, n: (at <= 1) | (at >= n - 2) | (F.abs(at - F.floor(n / 2)) <= 1)
    few = F.filter("cells", lambda e: (e["row_idx"] == 0) | (beside(e["row_idx"], F.col("rows")) & beside(e["col_idx"], F.col("cols"))))
    s = s.withColumn("cells", F.when((F.col("rows") <= 7) & (F.col("cols") <= 7), F.col("cells")).otherwise(few))
    s = s.groupBy("file_name", "page").agg(F.collect_list(F.struct("table_idx", "rows", "cols", *[F.col(f"cells.{p}").alias(p) for p in ("row_idx", "col_idx", "text")])).alias("own"))
    s = s.withColumn("s_page", F.col("page")).withColumn("page", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - pages), F.col("page") + pages)))
    both = s.repartition("file_name", "page").join(by_page(target, "row_idx", "col_idx", "text"), ["file_name", "page"])

    def flat(f: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        n = np.diff(f["row_idx"].offsets.to_numpy())
        return np.repeat(np.arange(len(n)), n), whole(f["row_idx"].flatten()), whole(f["col_idx"].flatten()), f["text"].flatten()

    def share(of: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(of, weights, n), np.bincount(of, minlength=n)

    def scan(batches):
        texts = Texts()
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 2000):
                yield scored(whole_batch.slice(k, 2000), texts)

    def scored(b: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        s_on, s = opened(b.column(3))
        t_on, t = opened(b.column(4))
        (st, sr, sc, s_text), (tt, tr, tc, t_text) = flat(s), flat(t)
        a, z = texts.numbered(s_text, t_text, pa.array([""]))[:2]
        blank = texts.words.index("")
        rows, cols = whole(s["rows"]), whole(s["cols"])
        limits = rows, cols, _limits(tt, tr, len(t_on)), _limits(tt, tc, len(t_on))
        key, head = is_key(sr, sc, rows[st], cols[st]), sr == 0
        entry = np.flatnonzero(key | head)
        # pairs of tables of one row, and their entries
        left, right = spread(np.searchsorted(t_on, s_on, "left"), np.searchsorted(t_on, s_on, "right"))
        n = len(left)
        ends = np.searchsorted(st[entry], np.arange(len(s_on) + 1))
        pair, e = spread(ends[left], ends[left + 1])
        e = entry[e]
        who, at = met(np.stack([tt, tr, tc]), np.stack([right[pair], sr[e], sc[e]]))
        pair, e = pair[who], e[who]
        is_head = head[e]
        ratio, heads = share(pair[is_head], texts.each(np.where(a < 0, blank, a)[e[is_head]], np.where(z < 0, blank, z)[at[is_head]], texts.heads), n)
        on = key[e]
        p, e, at = pair[on], e[on], at[on]
        own, other = near(st, sr, sc), near(tt, tr, tc)
        x, y = [np.where(a < 0, blank, a)[e]], [np.where(z < 0, blank, z)[at]]
        for side in SIDES:
            for out, code, sides, of in ((x, a, own, e), (y, z, other, at)):
                i = sides[side][of]
                out.append(np.where(i < 0, -1, code[i]))
        x, y = np.concatenate(x), np.concatenate(y)
        there = (x >= 0) & (y >= 0)
        good = np.zeros(len(x), bool)
        good[there] = texts.each(x[there], y[there], texts.alike)
        there, good = there.reshape(5, -1), good.reshape(5, -1)
        sides = there[1:].sum(axis=0)
        score = 0.5 * good[0] + 0.5 * np.where(sides > 0, good[1:].sum(axis=0) / np.maximum(sides, 1), 0.0)
        total, found = share(p, score, n)
        # a key cell without a cell at its place counts as unlike
        (different,) = _codes(np.stack([p, e])) if len(p) else (np.zeros(0, np.int64),)
        first = np.unique(different, return_index=True)[1]
        missing = np.bincount(st[key], minlength=len(s_on))[left] - np.bincount(p[first], minlength=n)
        adjacency = np.where(found > 0, total / np.maximum(found + missing, 1), 0.0)
        apart = lambda one, two: np.where((one == NONE) | (two == NONE), 0.0, np.maximum(0.0, 1.0 - np.abs(one - two) / 5.0))
        structure = (apart(cols[left], limits[3][right]) + apart(rows[left], limits[2][right])) / 2
        page = s_on[left]
        out = [take(b.column(0), page), take(b.column(2), page), take(s["table_idx"], left), take(b.column(1), page), take(t["table_idx"], right)]
        out += [pa.array(v) for v in (structure, np.where(heads > 0, ratio / np.maximum(heads, 1), 1.0), adjacency)]
        return pa.RecordBatch.from_arrays(out, names=_SCORED.names)

    return both.select("file_name", "page", "s_page", "own", "tables").mapInArrow(scan, _SCORED)


def refs_by_page(refs: DataFrame, at_once: int = 500) -> DataFrame:
    """file_name, page and refs (an array of the other columns, in order): one row a page; a page of more than `at_once` references has several."""
    own = [c for c in refs.columns if c not in ("file_name", "page")]
    r = refs.repartition("file_name", "page").groupBy("file_name", "page").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("refs"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("refs") - 1) / at_once)), lambda i: F.slice("refs", (i * at_once + 1).cast("int"), at_once))
    return r.select("file_name", "page", F.explode(parts).alias("refs"))


def best_cells(refs: DataFrame, cells: DataFrame, texts: list[str], weights: tuple[float, ...], least: float, full: float) -> DataFrame:
    """Each reference with its cell on each page (`Cells.best`): the columns of refs (file_name, page, refs: arrays of structs), the cell's place and text, with several texts also its origin and end
    and its neighbours' texts and origins, and m_0, m_1 and so on and score. texts: the fields of a reference that are held against a cell's text and its neighbours'; a missing text is empty."""
    sides = len(texts) > 1
    pages = refs.join(by_page(cells, *(() if sides else ("row_idx", "col_idx", "text"))), ["file_name", "page"])
    types = {f.name: f for f in refs.schema}
    own = list(types["refs"].dataType.elementType)
    more = [("x0", DoubleType()), ("y0", DoubleType()), ("x1", DoubleType()), ("y1", DoubleType())] if sides else []
    beside = [(f"{s}{p}", t) for s in SIDES for p, t in (("", StringType()), ("_x", DoubleType()), ("_y", DoubleType()))] if sides else []
    place = [("table_idx", IntegerType()), ("row_idx", IntegerType()), ("col_idx", IntegerType())]
    scores = [(c, DoubleType()) for c in [*[f"m_{i}" for i in range(len(weights))], "score"]]
    schema = StructType([types["file_name"], types["page"], *own, *[StructField(*f) for f in (*place, *more, ("text", StringType()), *beside, *scores)]])

    def scan(batches):
        held = Cells(weights, least, full)
        for b in batches:
            r_on, r = opened(b.column(2))
            t_on, t = opened(b.column(3))
            inner, f = cells_of(t)
            row, col = whole(f["row_idx"]), whole(f["col_idx"])
            order = in_order(t_on[inner], whole(t["table_idx"])[inner], f)
            blank = lambda a: ["" if x is None else x for x in a.to_pylist()]
            near_by = near(inner, row, col) if sides else {}
            there = list(zip(*[blank(f["text"].take(pa.array(order))), *[blank(take(f["text"], near_by[s][order])) for s in near_by]]))
            asked = list(zip(*[blank(r[c]) for c in texts]))
            ra, ca = (np.searchsorted(on, np.arange(b.num_rows + 1)).tolist() for on in (r_on, t_on[inner][order]))
            found = [(ra[k] + i, ca[k] + j, *sims, total) for k in range(b.num_rows) for i, j, sims, total in held.best(asked[ra[k] : ra[k + 1]], there[ca[k] : ca[k + 1]])]
            if not found:
                continue
            i, j, *values = zip(*found)
            i, j = np.array(i), order[np.array(j)]
            out = [take(b.column(0), r_on[i]), take(b.column(1), r_on[i]), *[take(r[x.name], i) for x in own], take(t["table_idx"], inner[j])]
            out += [take(f[c], j) for c in ("row_idx", "col_idx", *[c for c, _ in more], "text")] + [take(f[c], near_by[s][j]) for s in near_by for c in ("text", "x0", "y0")]
            yield pa.RecordBatch.from_arrays([*out, *[pa.array(v, pa.float64()) for v in values]], names=schema.names)

    return pages.select("file_name", "page", "refs", "tables").mapInArrow(scan, schema)


def first_alike(refs: DataFrame, cells: DataFrame, text: str, threshold: float) -> DataFrame:
    """Each reference (file_name, page, refs: arrays of structs) with the place of the first cell on each of its pages whose text is alike to its own by the threshold."""
    pages = refs.join(by_page(cells, "row_idx", "col_idx", "text"), ["file_name", "page"])
    types = {f.name: f for f in refs.schema}
    own = [f for f in types["refs"].dataType.elementType if f.name != text]
    schema = StructType([types["file_name"], types["page"], *own, *[StructField(c, IntegerType()) for c in ("table_idx", "row_idx", "col_idx")]])

    def scan(batches):
        texts = Texts(threshold, above=False)
        for b in batches:
            r_on, r = opened(b.column(2))
            t_on, t = opened(b.column(3))
            inner, f = cells_of(t)
            order = in_order(t_on[inner], whole(t["table_idx"])[inner], f)
            a, z = texts.numbered(r[text], f["text"])
            z = z[order]
            ends = np.searchsorted(t_on[inner][order], np.arange(b.num_rows + 1))
            low, high = ends[r_on], ends[r_on + 1]
            done, k, found = np.cumsum(high - low), 0, []
            while k < len(a):
                stop = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + AT_ONCE, "right")))
                i, j = spread(low[k:stop], high[k:stop])
                i += k
                some = np.flatnonzero((a[i] >= 0) & (z[j] >= 0))
                some = some[texts.may(a[i[some]], z[j[some]])]
                some = some[texts.each(a[i[some]], z[j[some]], texts.alike)]
                first = some[np.unique(i[some], return_index=True)[1]]
                found.append((i[first], order[j[first]]))
                k = stop
            if found:
                i, j = (np.concatenate(c) for c in zip(*found))
                out = [take(b.column(0), r_on[i]), take(b.column(1), r_on[i]), *[take(r[x.name], i) for x in own], take(t["table_idx"], inner[j])]
                yield pa.RecordBatch.from_arrays([*out, take(f["row_idx"], j), take(f["col_idx"], j)], names=schema.names)

    return pages.select("file_name", "page", "refs", "tables").mapInArrow(scan, schema)
