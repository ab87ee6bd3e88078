"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a byte string ends, at each prefix, with one token: the one that ends there, encodes to itself, and is
compatible with the last token of the prefix before it (the two tokens' bytes encode to just these two). One pass over the
bytes stores that token for every prefix; the encoding is read backwards. An append only adds entries, and an edit re-computes entries
until they agree again with the old ones for as long as the longest token.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import id_and_text, portions
from pagemask.llm.pretokens import Cache, encoded, piece, single_spaced


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Pieces of up to SHARED bytes share a table of at most KNOWN prefixes; keeping each prefix of a longer one would cost the square of its
#: length. Both ways store the same last token of each prefix.
SHARED = 64
KNOWN = 300_000
#: Bytes of text that are encoded at once: ids and decoded bytes of a portion leave the worker together.
PORTION = 1 << 20


class Bpe:
    """A vocabulary of ranks; a token's rank is its id and the order of its merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reach: dict[bytes, int] = {}  # length of the longest token that ends with four bytes
        for t in ranks:
            if len(t) > 3 and self.reach.get(t[-4:], 0) < len(t):
                self.reach[t[-4:]] = len(t)
        self._pairs: dict[tuple[int, int], bool] = Cache(lambda p: self.merge(self.tokens[p[0]] + self.tokens[p[1]]) == list(p), 400_000)
        self._whole: dict[int, bool] = Cache(lambda t: self.merge(self.tokens[t]) == [t], 100_000)
        self.known: dict[bytes, int] = {}  # prefixes that texts share, and their last tokens; holds all prefixes of what it holds

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, the leftmost of equals, until none is left."""
        get, none = self.ranks.get, 1 << 62
        parts, ranks = [data[i : i + 1] for i in range(len(data))], [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The last token of data[:end], given those of all shorter prefixes (last[k] belongs to data[:k])."""
        get, pairs = self.ranks.get, self._pairs
        for start in range(max(0, end - self.reach.get(data[max(0, end - 4) : end], 3)), end):
            t = get(data[start:end])
            if t is not None and (pairs[last[start], t] if start else self._whole[t]):
                return t
        raise ValueError("bytes that no token covers")

    def prefixes(self, data: bytes) -> list[int]:
        """Last tokens of every prefix; entry 0 belongs to the empty one."""
        last = [-1]
        for end in range(1, len(data) + 1):
            last.append(self.last_token(data, end, last))
        return last

    def read_back(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of length `end` (all by default)."""
        at, ids = len(last) - 1 if end is None else end, []
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece: a piece that is a token is that token, as the library has it."""
        get = self.ranks.get
        if (t := get(piece)) is not None:
            return [t]
        if len(piece) > SHARED:
            return self.read_back(self.prefixes(piece))
        if len(self.known) > KNOWN:
            self.known.clear()
        known, pairs, reach, n = self.known, self._pairs, self.reach.get, len(piece)
        end = n
        while end and piece[:end] not in known:
            end -= 1
        while end < n:  # the table grows by the prefixes that no earlier piece had
            end += 1
            for start in range(max(0, end - (reach(piece[end - 4 : end], 3) if end > 3 else 3)), end):
                t = get(piece[start:end])
                if t is not None and (pairs[known[piece[:start]], t] if start else self._whole[t]):
                    known[piece[:end]] = t
                    break
            else:
                raise ValueError("bytes that no token covers")
        ids = []
        while n:
            ids.append(t := known[piece[:n]])
            n -= len(self.tokens[t])
        return ids[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> bytes:
        """data + more; `last` gets the new prefixes' entries."""
        data += more
        for end in range(len(last), len(data) + 1):
            last.append(self.last_token(data, end, last))
        return data

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """data with data[start:stop] replaced, its prefixes' tokens, and how many of these were computed anew."""
        changed = data[:start] + new + data[stop:]
        shift, out, same = len(new) - (stop - start), last[: start + 1], 0
        for end in range(start + 1, len(changed) + 1):
            out.append(self.last_token(changed, end, out))
            same = same + 1 if end - shift > stop and end - start > len(new) and out[end] == last[end - shift] else 0
            if same >= self.longest:
                return changed, out + last[end - shift + 1 :], end - start
        return changed, out, len(changed) - start


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str):
    """encode(texts) -> uint32 ids of all texts and their ends, by way of caches of words and pieces. One for each worker process, over all its tasks."""
    import regex

    bpe, pieces_of = Bpe(read_ranks(path)), regex.compile(pattern).findall
    held = Cache(lambda p: np.array(bpe.encode(p.encode()), dtype=np.uint32).tobytes(), 150_000)
    cache = Cache(most=600_000)

    def whole(text: str) -> bytes:
        return b"".join([held[p] for p in pieces_of(text)])

    def words(distinct: list[str]) -> list[bytes]:
        return cache.all_of(distinct, lambda missed: [whole(piece(w)) for w in missed])

    return lambda texts: encoded(texts, single_spaced, words, whole)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> pa.Array:
    """The bytes of each id, at its place."""
    by_id = {i: t for t, i in read_ranks(path).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.binary())


def joined(by_id: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes that each run of ids stands for; ends: where the runs end, each beginning where the one before ends."""
    taken = by_id.take(pa.array(ids))
    if taken.null_count:
        raise ValueError("an id that isn't in the vocabulary")
    _, at, data = taken.buffers()
    at = np.frombuffer(at, np.int32, len(taken) + 1, 4 * taken.offset)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at[np.r_[0, ends]].tobytes()), data or pa.py_buffer(b"")])


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.view(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int>, one row per input row. Each match of the pattern is encoded by itself; no special tokens.

    Null and empty texts give no ids; a null id stays null; repeated rows each give a row; other columns are not read.
    """

    def scan(batches):
        ids_of = encoder(path, pattern)
        for b in portions(batches, most=PORTION):
            ids, ends = ids_of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids, ends)], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for. A null array gives null bytes."""

    def scan(batches):
        by_id = vocabulary(path)
        for b in batches:
            lists = b.column(1)
            null, filled = lists.is_null(), pc.fill_null(lists, pa.scalar([], lists.type))
            ends = np.cumsum(pc.list_value_length(filled).to_numpy(), dtype=np.int64)
            decoded = joined(by_id, filled.flatten().to_numpy(zero_copy_only=False), ends)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pc.if_else(null, None, decoded)], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded: what decode(encode(docs)) gives, in one pass, so that a task has one Python worker and one set of caches.

    Rows are as encode has them; decoded is made from the ids alone.
    """

    def scan(batches):
        ids_of, by_id = encoder(path, pattern), vocabulary(path)
        for b in portions(batches, most=PORTION):
            ids, ends = ids_of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids, ends), joined(by_id, ids, ends)], names=["doc_id", "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, ids array<int>, decoded binary")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
