"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words joined by single spaces. An item of m characters has an error budget of
k = max_error * m edits and is cut into k + 1 pieces; a passage within k edits holds one piece unchanged. An Aho-Corasick
automaton finds all piece hits of all items in one pass, and Myers' bit-parallel distance verifies the item in the stretch of
text around each hit.

The items are a query set. Spark deals them to blocks of about BLOCK_CHARS characters, each broadcast and held against all
documents. Where there are several, each block's matches are written to the shared folder and its broadcast is destroyed before the next,
so what the driver and a task hold has the bound of one block whatever the benchmark's size.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import batches_of, id_and_text, materialize, texts

BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")


def normalise(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def pieces(item: str, max_error: float, min_chars: int = 0) -> tuple[int, list[tuple[int, str]]]:
    """The error budget of a normalised item (0 below min_chars), and its pieces with their offsets: one more than the budget, of near equal length."""
    k = int(max_error * len(item)) if len(item) >= min_chars else 0
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """Bits of the places of each character."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of text with the least edit distance to the item; the first end of equals. Myers 1999."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        h_plus = minus | ~(d | plus) & full
        h_minus = plus & d
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = h_plus << 1 & full  # a match may start anywhere: no cost enters from above
        h_minus = h_minus << 1 & full
        plus = h_minus | ~(d | h_plus) & full
        minus = h_plus & d
        if score < best[0]:
            best = (score, j + 1)
    return best


class Matcher:
    """A block of normalised items."""

    def __init__(self, items: list[tuple[int, str]], max_error: float, min_chars: int = 0):
        self.items, self.automaton = [], ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (item_id, text) in enumerate(items):
            k, parts = pieces(text, max_error, min_chars)
            self.items.append((item_id, text, k, masks(text), masks(text[::-1]), len(text) < min_chars))
            for offset, part in parts:
                where.setdefault(part, []).append((n, offset))
        for part, uses in where.items():
            self.automaton.add_word(part, (len(part), uses))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item within its budget, in a normalised text."""
        if not self.items or not text:
            return []
        hits: dict[int, list[int]] = {}
        for last, (length, uses) in self.automaton.iter(text):
            whole = (last < length or text[last - length] == " ") and (last + 1 == len(text) or text[last + 1] == " ")
            for n, offset in uses:
                if whole or not self.items[n][5]:  # a short item is one piece, and matches as whole words
                    hits.setdefault(n, []).append(last + 1 - length - offset)
        found = []
        for n, starts in hits.items():
            item_id, item, k, peq, qep, _ = self.items[n]
            m, best, stretch = len(item), None, None
            starts.sort()
            ranges: list[list[int]] = []
            for s in starts:  # hits that lie close share one verification
                low, high = max(0, s - k), min(len(text), s + m + k)
                if ranges and low <= ranges[-1][1] and high - ranges[-1][0] <= 4 * (m + 2 * k):
                    ranges[-1][1] = max(high, ranges[-1][1])
                else:
                    ranges.append([low, high])
            for low, high in ranges:
                d, end = best_match(peq, m, text[low:high])
                if d <= k and (best is None or d < best):
                    best, stretch = d, (low, low + end)
            if best is not None:
                low, end = stretch
                start = end - best_match(qep, m, text[low:end][::-1][: m + k])[1]
                found.append((item_id, best, start, end))
        return found


def spans_in(text: str, norm_start: int, norm_end: int) -> tuple[int, int]:
    """Code points of the words of the raw text that a stretch of its normalised form touches."""
    at, norm, raw = 0, [], []
    for m in _WORD.finditer(text):
        norm.append(at)
        raw.append((m.start(), m.end()))
        at += len(m[0].lower()) + 1
    a, b = bisect_right(norm, norm_start) - 1, bisect_right(norm, max(norm_start, norm_end - 1)) - 1
    return raw[a][0], raw[b][1]


def _dealt(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """item_id, text and block of the items, each once, and the number of blocks: equal in expectation, by a hash."""
    chosen = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''").distinct()
    size = chosen.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    return chosen.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(max(1, n)))), n


def find_leaks(docs: DataFrame, items: DataFrame, max_error: float = 0.08, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, stop, text: the best match of each item in each document (least distance, then first).

    start and stop are code points of the raw text. Items of fewer than min_chars normalised characters match exactly and as whole words.
    Null and empty texts match nothing, nor do items without a word. Repeated rows of docs each give their rows; repeated items count once;
    rows with null ids take part. Other columns are not read. With no item the result is empty.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, start int, stop int, text string"
    types = {"doc_id": pa.int64(), "item_id": pa.int64(), "distance": pa.int32(), "start": pa.int32(), "stop": pa.int32(), "text": pa.string()}
    dealt, n = _dealt(items, item_id_col, item_text_col)
    if n > 1:
        dealt = materialize(dealt, "items")
    out = None
    for block in range(n):
        normal = [(r["item_id"], normalise(r["text"])) for r in dealt.filter(F.col("block") == block).select("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast([x for x in normal if x[1]])

        def scan(batches, shared=shared):
            matcher = Matcher(shared.value, max_error, min_chars)

            def rows():
                for i, t in texts(batches):
                    for item_id, d, s, e in matcher.find(normalise(t)):
                        a, b = spans_in(t, s, e)
                        yield i, item_id, d, a, b, t[a:b]

            yield from batches_of(types, rows())

        part = id_and_text(docs, id_col, text_col).mapInArrow(scan, schema)
        if n > 1:
            part = materialize(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item. Ids decide, so rows of one id go together; rows with null ids are judged together too."""
    bad = find_leaks(docs, items, **options).select(F.col("doc_id").alias("leak")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(options.get("id_col", "doc_id")).cast("long").alias("id"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("leak")), "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, items)
