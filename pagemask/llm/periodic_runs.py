"""Periodic runs of words, by uniting suffix classes in the order of falling longest common prefixes (LCP).

A run is a stretch of words with smallest period q, at least `repeats` (two or more) times q long, that no neighbouring word extends.
Per text the suffixes are sorted by prefix doubling; then neighbours in that order are united, longest LCP first. Each class keeps
its positions in order (union-find, the smaller class goes into the larger one). Where a position comes to stand beside one of the other
class, their LCP is that of the moment, l; if their distance d is within l, the words from the first of them on have period d for
l + d words. It is the smallest period, as a smaller one would have put a position of the same class between the two. A run's first
word and the one a period later always meet this way, so the pairs that a word before them doesn't extend are all runs, each once.

Only positions whose first words occur again in their text take part; the shortest LCP that any run needs bounds the classes.
A task works on a portion of texts at once; positions of different texts never share a class.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import id_and_text, portions

RUNS = "array<struct<start:long,length:long,period:long>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Bytes of text that are worked on at once.
AT_ONCE = 2 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each place's word, and where each text's words begin (one more: the end)."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    real = pc.greater(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    ends = np.r_[0, np.cumsum(real)][parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    return flat.dictionary, codes[real].astype(np.int64), ends.astype(np.int64)


def _ranks(words: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all are told apart. words: each text's codes (from 1), then a 0."""
    n = len(words)
    keys = doc * (int(words.max()) + 1) + words
    active, rank, levels, step = np.arange(n), np.zeros(n, np.int64), [], 0
    while len(active):
        order = np.argsort(keys, kind="stable")
        active, keys = active[order], keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(active)])
        if step:  # a group's rank is the number of suffixes before it; its parts keep their places within it
            parent = rank[active]
            begins = np.r_[True, parent[1:] != parent[:-1]]
            within = np.arange(len(active)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            value = (parent + within)[first]
        else:
            value = first
        rank = rank.copy()
        rank[active] = np.repeat(value, sizes)
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank)
        active = active[np.repeat(sizes > 1, sizes)]
        step = 1 << (len(levels) - 1)
        # a suffix that isn't alone yet has step words of its own text before it, so the sum is a place of that text
        keys = rank[active] * n + rank[active + step]
    return levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCP of the suffixes at a and b, pair by pair."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        found += (levels[k][a + found] == levels[k][b + found]) * (1 << k)
    return found


def _united(sa: list[int], lcp: np.ndarray, words: list[int], least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(first place, length, period) of all runs. sa: places in the order of their suffixes; lcp: of each with the next, 0 where there is none."""
    up, sets, runs = list(range(len(sa))), [[p] for p in sa], []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def seed(p: int, q: int, l: int) -> None:
        d = q - p
        if l + d >= max(least, repeats * d) and words[p - 1] != words[q - 1]:
            runs.append((p, l + d, d))

    order = np.argsort(-lcp, kind="stable")
    for s, l in zip(order.tolist(), lcp[order].tolist()):
        if not l:
            break
        a, b = find(s), find(s + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        many, few = sets[a], sets[b]
        for i, p in enumerate(few):
            k = bisect_left(many, p)
            if k and (not i or few[i - 1] < many[k - 1]):
                seed(many[k - 1], p, l)
            if k < len(many) and (i + 1 == len(few) or many[k] < few[i + 1]):
                seed(p, many[k], l)
        if len(few) == 1:
            many.insert(k, p)
        else:
            sets[a] = sorted(many + few)
        up[b], sets[b] = a, None
    return runs


def runs_of(codes: np.ndarray, ends: np.ndarray, least: int = 6, repeats: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) in this order of all runs of `least` words and `repeats` periods or more.

    codes: the words of all texts as numbers from 0; ends: where each text's begin, and the end."""
    if repeats < 2:
        raise ValueError("a run repeats twice or more")
    sizes = np.diff(ends)
    texts = len(sizes)
    doc = np.repeat(np.arange(texts), sizes + 1)
    starts = ends[:-1] + np.arange(texts)
    words = np.zeros(len(doc), np.int64)
    words[np.arange(len(codes)) + np.repeat(np.arange(texts), sizes)] = codes + 1
    # the LCP of a run's first two periods is its length less the period
    need = min(max(least - q, (repeats - 1) * q) for q in range(1, max(least, 1) + 1))
    if len(codes) <= need:
        return np.zeros((0, 4), np.int64)
    levels = _ranks(words, doc)
    at = min(max(need, 1).bit_length() - 1, len(levels) - 1)
    same = levels[at]
    again = np.bincount(same, minlength=len(same))[same] > 1
    sa = np.flatnonzero(again)
    sa = sa[np.argsort(levels[-1][sa], kind="stable")]
    if len(sa) < 2:
        return np.zeros((0, 4), np.int64)
    lcp = np.zeros(len(sa), np.int64)
    near = np.flatnonzero(same[sa[1:]] == same[sa[:-1]])
    lcp[near] = _common(levels, sa[near], sa[near + 1])
    lcp[lcp < need] = 0
    before = words.copy()
    before[starts + sizes] = -1 - np.arange(texts)  # what stands before a text is like no word
    found = _united(sa.tolist(), lcp, before.tolist(), least, repeats)
    if not found:
        return np.zeros((0, 4), np.int64)
    place, length, period = np.array(found, np.int64).T
    rows = np.stack([doc[place], place - starts[doc[place]], length, period], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the text's words that no run holds after its first period, by single spaces.

    Words are what the characters space and \\t to \\r divide. One row per input row, repeated ones and null ids included; null, empty and blank texts have
    no words, no runs and an empty collapsed text. A text of any length is worked on whole. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS_ARROW), ("collapsed", pa.string())])

    def scan(batches):
        for b in portions(batches, most=AT_ONCE):
            distinct, codes, ends = words_of(b.column(1))
            found = runs_of(codes, ends, least, repeats)
            kept = np.ones(len(codes), bool)
            if len(found):
                text, start, length, period = found.T
                steps = np.zeros(len(codes) + 1, np.int64)
                np.add.at(steps, ends[text] + start + period, 1)
                np.add.at(steps, ends[text] + start + length, -1)
                kept = np.cumsum(steps)[:-1] == 0
            left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][ends], pa.int32()), distinct.take(pa.array(codes[kept])))
            each = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(len(ends))), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), runs, pc.binary_join(left, " ")], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def repeating_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, of which those with h % 10 = 0 (h: CRC-32 of the decimal id) end in repetitions of a stretch of their own words.

    Of n words those from a = g % n on repeat the first p = 1 + floor((n - a) / (3 + g % 8)) of them, where g = floor(h / 10). A null id has no h."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t-\r]+", -1), lambda w: w != "")
    n, g = F.size("_w"), F.floor(h / 10)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_w", F.when(h % 10 == 0, words))
    rows = rows.withColumn("_a", F.when(n > 0, F.pmod(g, n))).withColumn("_p", F.lit(1) + F.floor((n - F.col("_a")) / (3 + g % 8)))
    edited = F.transform("_w", lambda w, i: F.when(i >= F.col("_a"), F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))).otherwise(w))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeating_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    first = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"], r["period"]))), 0)
    length, period = -first["k"], first["period"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), first["start"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
