"""Text similarity on Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b); 100 for two empty texts."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer one, shorter windows at the ends included."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    n = len(s)
    ends = [t[:i] for i in range(1, n)] + [t[i : i + n] for i in range(len(t) - n + 1)] + [t[-i:] for i in range(1, n)]
    return max(indel(s, w) for w in ends)


def token_set(a: str, b: str) -> float:
    """Best ratio among the sorted common tokens and these with each side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [indel(one, two)]
    if both:
        scores += [indel(both, one), indel(both, two)]
    return max(scores)


def sequence(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio from 0 to 1."""
    return SequenceMatcher(None, a, b).ratio()


def sequence_from(a: str, b: str, threshold: float) -> float:
    """`sequence` where it can reach the threshold; 0 where one of its upper bounds is below it."""
    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold else 0.0


class Windows:
    """The runs of consecutive words of a page, joined by spaces, against which texts are held."""

    def __init__(self, words: list[str]):
        self.words = words
        sizes = np.array([len(w) for w in words], np.int64)
        self.ends = np.r_[0, np.cumsum(sizes + 1)]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters = np.unique(np.r_[codes, np.uint32(32)])
        counts = np.zeros((len(words), len(self.letters)), np.int32)
        np.add.at(counts, (np.repeat(np.arange(len(words)), sizes), np.searchsorted(self.letters, codes)), 1)
        counts[:, np.searchsorted(self.letters, 32)] += 1  # the space after each word
        self.sums = np.concatenate([np.zeros((1, counts.shape[1]), np.int32), np.cumsum(counts, axis=0, dtype=np.int32)])

    def best(self, target: str, least: int, most: int, threshold: float, off: float | None = None) -> tuple[float, int, int] | None:
        """(ratio, first word, words) of the run of least to most words with the best `sequence` ratio of `threshold` and more; the first of equals, then the shortest.

        Only runs whose length isn't off by more than `off` of the target's count, if it is given. A run's letters bound its ratio from above: all runs' bounds are
        computed at once, and ratios from the highest bound down, until none can be better.
        """
        a = len(target)
        codes = np.frombuffer(target.encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.searchsorted(self.letters, codes)
        place[place == len(self.letters)] = 0
        bag = np.bincount(place[self.letters[place] == codes], minlength=len(self.letters))
        space, found = np.searchsorted(self.letters, 32), []
        for k in range(max(1, least), min(most, len(self.words)) + 1):
            b = self.ends[k:] - self.ends[:-k] - 1
            fits = 2.0 * np.minimum(a, b) >= threshold * (a + b)
            if off is not None:
                fits &= np.abs(a - b) <= off * a
            i = np.flatnonzero(fits)
            if not len(i):
                continue
            counts = self.sums[i + k] - self.sums[i]
            counts[:, space] -= 1
            bound = 2.0 * np.minimum(counts, bag).sum(axis=1) / (a + b[i])
            good = bound >= threshold
            found += zip((-bound[good]).tolist(), i[good].tolist(), [k] * int(good.sum()))
        best = None
        for bound, i, k in sorted(found):
            if best and -bound < best[0]:
                break
            ratio = sequence(target, " ".join(self.words[i : i + k]))
            if ratio >= threshold and (best is None or (-ratio, i, k) < (-best[0], best[1], best[2])):
                best = ratio, i, k
        return best


BOXED = "struct<id:string,target:string,least:int,most:int>"


def best_windows(pages: DataFrame, threshold: float, off: float | None = None) -> DataFrame:
    """id, file_name, page, ratio, x0, y0, x1 and y1 of the best run of a page's words for each text (`Windows.best`); texts without one have no row.

    pages: file_name, page, shown (the words in order), x0, y0, x1, y1 (of each word) and boxes (array of BOXED)."""
    schema = pa.schema([("id", pa.string()), ("file_name", pa.string()), ("page", pa.int32()), ("ratio", pa.float64()), *[(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")]])

    def scan(batches):
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                file, page, shown, x0, y0, x1, y1, boxes = (c[r] for c in b.columns)
                words = Windows(shown.as_py())
                xs = [c.values.to_numpy() for c in (x0, y0, x1, y1)]
                for box in boxes.as_py():
                    best = words.best(box["target"], box["least"], box["most"], threshold, off)
                    if best:
                        run = slice(best[1], best[1] + best[2])
                        rows.append((box["id"], file.as_py(), page.as_py(), best[0], *[float(f(x[run])) for f, x in zip((np.min, np.min, np.max, np.max), xs)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    columns = ["file_name", "page", "shown", "x0", "y0", "x1", "y1", "boxes"]
    return pages.select(*columns).mapInArrow(scan, "id string, file_name string, page int, ratio double, x0 double, y0 double, x1 double, y1 double")


def cell(a: str, b: str) -> float:
    """Similarity of two cells from 0 to 1: equal, contained, half of the tokens shared (three tokens on a side), else the better ratio."""
    x, y = " ".join(a.lower().split()), " ".join(b.lower().split())
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.95
    tx, ty = set(x.split()), set(y.split())
    share = len(tx & ty) / max(len(tx), len(ty))
    if max(len(tx), len(ty)) >= 3 and share >= 0.5:
        return min(1.0, 0.5 + share / 2)
    near = partial(x, y) / 100.0
    return near if near >= 0.85 else max(near, indel(x, y) / 100.0)


def _udf(f):
    @F.pandas_udf(DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}  # of this batch: cells and words repeat
        out = []
        for pair in zip(a, b):
            v = known.get(pair)
            if v is None and None not in pair:
                v = known[pair] = float(f(*pair))
            out.append(v)
        return pd.Series(out, dtype="float64")

    return scored


seq_ratio, indel_ratio, partial_ratio, token_set_ratio, cell_similarity = (_udf(f) for f in (sequence, indel, partial, token_set, cell))


def seq_ratio_from(threshold: float):
    """seq_ratio, with 0 for pairs that can't reach the threshold by their length or letters."""
    return _udf(lambda a, b: sequence_from(a, b, threshold))


#: Stated as a type, not as text: workers import this module without a session.
SKETCH = StructType([StructField("plain", StringType()), StructField("letters", LongType()), StructField("words", IntegerType())])


@F.pandas_udf(SKETCH)
def cell_sketch(text: pd.Series) -> pd.DataFrame:
    """What `cell_bounds` needs of a cell, made once a cell and not once a pair: its plain form, its letters as bits, and its number of words. A null text is empty."""
    known: dict[str | None, tuple[str, int, int]] = {}  # of this batch: a cell is its neighbours' neighbour
    out = []
    for t in text:
        v = known.get(t)
        if v is None:
            words = (t or "").lower().split()
            plain, bits = " ".join(words), 0
            for ch in set(plain):
                bits |= 1 << (ord(ch) & 63)
            v = known[t] = plain, bits - (1 << 64) if bits >> 63 else bits, len(words)
        out.append(v)
    return pd.DataFrame(out, columns=["plain", "letters", "words"])


def cell_bounds(a: Column, b: Column) -> Column:
    """struct<lo, hi> around `cell` of two cells by their sketches, without a look at more than their letters; lo = hi where that settles it.

    Equal, contained, empty and missing (null sketch) cells are settled. Else a letter that the other cell lacks can't be matched: with k letters left of the shorter
    cell's m, both ratios are at most 2k / (m + k). Shared words aren't bounded so: cells of three words and more may reach 1."""
    x, y = a["plain"], b["plain"]
    lacks = lambda x, y: F.length(x["plain"]) - F.bit_count(x["letters"].bitwiseAND(F.bitwise_not(y["letters"])))
    m, k = F.least(F.length(x), F.length(y)), F.least(lacks(a, b), lacks(b, a))
    both = lambda v: F.struct(F.lit(v).alias("lo"), F.lit(v).alias("hi"))
    upto = lambda v: F.struct(F.lit(0.0).alias("lo"), v.alias("hi"))
    return (
        F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), both(0.0)).when(x == y, both(1.0)).when(F.contains(x, y) | F.contains(y, x), both(0.95))
        .when(a["letters"].bitwiseAND(b["letters"]) == 0, both(0.0)).when(F.greatest(a["words"], b["words"]) >= 3, upto(F.lit(1.0))).otherwise(upto(2.0 * k / (m + k)))
    )


class Cells:
    """Cells of a page, each of one text or more, in order, against which references of as many texts are held. A pair's score is the sum of its weighted similarities.

    Letters bound similarities from above (as in `cell_bounds`), for all pairs at once; `cell` is asked only where a pair can still win, and once for two texts."""

    #: Pairs of references and cells whose bounds are held at once, and similarities that are kept.
    AT_ONCE = 200_000
    KEPT = 1_000_000
    #: Slack of bounds against rounding.
    EPS = 1e-9

    def __init__(self, weights: tuple[float, ...], least: float, full: float):
        self.weights, self.least, self.full = weights, least, full
        self.sketches: dict[str, tuple[int, int, int]] = {}
        self.known: dict[tuple[str, str], float] = {}

    def sketch(self, text: str) -> tuple[int, int, int]:
        v = self.sketches.get(text)
        if v is None:
            words = text.lower().split()
            plain, bits = " ".join(words), 0
            for ch in set(plain):
                bits |= 1 << (ord(ch) & 63)
            if len(self.sketches) >= self.KEPT:
                self.sketches.clear()
            v = self.sketches[text] = len(plain), bits, len(words)
        return v

    def sim(self, a: str, b: str) -> float:
        v = self.known.get((a, b))
        if v is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            v = self.known[a, b] = cell(a, b)
        return v

    def coded(self, rows: list[tuple[str, ...]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rows' texts as numbers, and length, letters and words of each number's text."""
        number: dict[str, int] = {}
        at = np.array([[number.setdefault(t, len(number)) for t in r] for r in rows], dtype=np.int64)
        n, bits, words = zip(*[self.sketch(t) for t in number])
        return at, [np.array(n, np.int64), np.array(bits, np.uint64), np.array(words, np.int64)]

    @staticmethod
    def upper(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Upper bounds of `cell` for all pairs."""
        (n, x, w), (o, y, v) = ([c[:, None] for c in a], [c[None, :] for c in b])
        lacks = lambda size, own, other: size - np.bitwise_count(own & ~other).astype(np.int64)
        m, k = np.minimum(n, o), np.minimum(lacks(n, x, y), lacks(o, y, x))
        hi = np.where(np.maximum(w, v) >= 3, 1.0, 2.0 * k / np.maximum(m + k, 1))
        return np.where((x & y) == 0, 0.0, hi)

    def best(self, refs: list[tuple[str, ...]], cells: list[tuple[str, ...]]) -> list[tuple[int, int, list[float], float]]:
        """(reference, cell, similarities, score) of each reference's cell: the first that scores `full` and more, else the best of `least` and more, the first of equals."""
        out, step = [], max(1, self.AT_ONCE // max(1, len(cells)))
        if not cells:
            return out
        there, b = self.coded(cells)
        for k in range(0, len(refs), step):
            some = refs[k : k + step]
            here, a = self.coded(some)
            every = self.upper(a, b)
            his = [every[here[:, p][:, None], there[:, p][None, :]] for p in range(len(self.weights))]
            total = sum(w * h for w, h in zip(self.weights, his))
            rest = total - self.weights[0] * his[0]
            out += [(k + r, *w) for r, ref in enumerate(some) if (w := self.winner(ref, cells, total[r], rest[r]))]
        return out

    def winner(self, ref: tuple[str, ...], cells: list[tuple[str, ...]], hi: np.ndarray, rest: np.ndarray) -> tuple[int, list[float], float] | None:
        def score(c: int, least: float) -> tuple[list[float], float] | None:
            """Where the first texts allow `least`."""
            first = self.sim(ref[0], cells[c][0])
            if self.weights[0] * first + rest[c] < least - self.EPS:
                return None
            sims = [first, *[self.sim(x, y) for x, y in zip(ref[1:], cells[c][1:])]]
            total = self.weights[0] * first
            for w, v in zip(self.weights[1:], sims[1:]):
                total += w * v
            return sims, total

        for c in np.flatnonzero(hi >= self.full - self.EPS).tolist():
            found = score(c, self.full)
            if found and found[1] >= self.full:
                return c, *found
        if self.full <= self.least:
            return None
        best = None
        open_ = np.flatnonzero(hi >= self.least - self.EPS)
        for c in open_[np.argsort(-hi[open_], kind="stable")].tolist():
            if best and hi[c] < best[2] - self.EPS:
                break
            found = score(c, best[2] if best else self.least)
            if found and found[1] >= self.least and (best is None or (-found[1], c) < (-best[2], best[0])):
                best = c, *found
        return best
