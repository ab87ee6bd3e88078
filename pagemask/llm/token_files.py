"""Token ids in bit-packed files.

File format (little-endian): 8 bytes magic 'PMTOK01\\n'; then blocks of BLOCK ids, each id in `bits` bits, lowest bits first,
the last block padded to 8 bytes; then the block offsets (uint64 each), the rows' doc ids (int64; 0 where null), null flags
(uint8 each) and token counts (int64 each); last a footer of 6 uint64: bits, ids, blocks, rows, offset of the block table,
checksum of the header words. Every block starts at a known offset and unpacks alone, so any range of ids can be read.

Documents are dealt by ranges of id, so file k holds smaller ids than file k + 1. The texts are shuffled, not their ids, which have about
as many bytes; each task encodes its range straight into its file. The number of files follows from the bytes of text.
Each attempt of a task writes under a name of its own, and only the names that the successful ones return count: a repeated
task, or one that ran twice, does no harm on any file system. What other attempts of the same call left is deleted at the end; all of a call's
names begin with an id of its own, and nothing else in the folder is touched.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import batches_of, id_and_text, portions, shared_dir
from pagemask.llm.pretokens import Cache, encoded, piece, single_spaced

MAGIC = b"PMTOK01\n"
BLOCK = 4096
#: Words in a worker's cache, some 200 bytes each.
WORDS = 700_000
#: Bytes of text for a file; small tables are dealt to three files for each core, of at least LEAST bytes.
FILE_BYTES = 256 << 20
LEAST = 4 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, lowest bits first, padded to a multiple of 8 bytes."""
    n = len(ids)
    size = (n * bits + 63) // 64 * 8
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes().ljust(size, b"\0")
    rows = np.zeros(((n + 63) // 64, 64), dtype=np.uint64)  # 64 ids fill `bits` words
    rows.reshape(-1)[:n] = ids
    words = np.zeros((len(rows), bits + 1), dtype=np.uint64)
    for k in range(64):
        at, shift = k * bits >> 6, k * bits & 63
        words[:, at] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return words[:, :bits].tobytes()[:size]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    words = np.concatenate([np.frombuffer(data, dtype=np.uint64), np.zeros(1, np.uint64)])
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return (((words[word] >> shift) | high) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Writes one file; ids stream through. A full block has BLOCK * bits / 8 bytes, so full blocks are packed together."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.n, self.rows = out, bits, 0, 0
        self.held: list[np.ndarray] = []
        self.pending = 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Rows and all their ids, one after the other."""
        self.docs.append((doc_ids.astype(np.int64), null.astype(np.uint8), counts.astype(np.int64)))
        self.held.append(ids)
        self.rows += len(doc_ids)
        self.pending += len(ids)
        self.n += len(ids)
        if self.pending >= 64 * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        self.out.write(pack(ids[:stop], self.bits))
        self.held, self.pending = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self.flush(True)
        blocks = (self.n + BLOCK - 1) // BLOCK
        self.out.write((len(MAGIC) + np.arange(blocks, dtype=np.uint64) * np.uint64(BLOCK * self.bits // 8)).tobytes())
        for column, kind in zip(zip(*self.docs), (np.int64, np.uint8, np.int64)):
            self.out.write(np.concatenate(column).astype(kind).tobytes())
        head = struct.pack("<5Q", self.bits, self.n, blocks, self.rows, len(MAGIC) + (self.n * self.bits + 63) // 64 * 8)
        self.out.write(head + struct.pack("<Q", zlib.crc32(head)))
        self.out.close()


class Reader:
    """Random access to one file: `read(start, stop)` touches only the blocks that hold the range."""

    def __init__(self, path: str):
        fs, p = file_system(path)
        self.f = fs.open_input_file(p)
        size = self.f.size()
        tail = self.f.read_at(48, size - 48)
        self.bits, self.n, blocks, rows, table, check = struct.unpack("<6Q", tail)
        if self.f.read_at(8, 0) != MAGIC or zlib.crc32(tail[:40]) != check:
            raise ValueError(f"{path} is no token file")
        raw = self.f.read_at(size - 48 - table, table)
        self.offsets = np.append(np.frombuffer(raw, np.uint64, blocks), np.uint64(table))
        self.doc_ids = np.frombuffer(raw, np.int64, rows, 8 * blocks)
        self.null = np.frombuffer(raw, np.uint8, rows, 8 * (blocks + rows))
        self.counts = np.frombuffer(raw, np.int64, rows, 8 * blocks + 9 * rows)

    def read(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (stop - 1) // BLOCK
        base = int(self.offsets[a])
        raw = self.f.read_at(int(self.offsets[b + 1]) - base, base)  # full blocks stand one after the other
        return unpack(raw, min((b + 1) * BLOCK, self.n) - a * BLOCK, self.bits)[start - a * BLOCK : stop - a * BLOCK]

    def documents(self, at_once: int = 256 * BLOCK):
        """(doc_id, first id's index in the file, ids) of each row in order; reads at_once ids at a time."""
        ends = np.cumsum(self.counts)
        low = high = 0
        held = np.zeros(0, np.uint32)
        for k, (n, end) in enumerate(zip(self.counts.tolist(), ends.tolist())):
            start = end - n
            if end > high:
                low, high = start, min(self.n, max(end, start + at_once))
                held = self.read(low, high)
            yield None if self.null[k] else int(self.doc_ids[k]), start, held[start - low : end - low]


def file_system(path: str):
    """Arrow's file system of a path as Spark names it, and the path in it."""
    return pafs.FileSystem.from_uri("s3:" + path.split(":", 1)[1] if path.startswith(("s3a:", "s3n:")) else path)


@lru_cache(maxsize=1)
def encoder(path: str):
    """encode(texts) -> uint32 ids of all texts and their ends, as the library gives them, by way of a cache of words; and the size of
    the vocabulary. One for each worker process, over all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = [x.content for x in t.get_added_tokens_decoder().values()]

    def whole(text: str) -> bytes:
        return np.array(t.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    cache, ends = Cache(most=WORDS), Cache(whole, 1000)

    def of_pieces(parts: list[str]) -> list[bytes]:
        """The ids of pieces that begin with a space or line break, by few calls of the library."""
        out: list[bytes] = []
        for k in range(0, len(parts), 20_000):
            some = parts[k : k + 20_000]
            e = t.encode(some, is_pretokenized=True, add_special_tokens=False)
            cut = np.searchsorted(np.array(e.word_ids), np.arange(len(some) + 1)).tolist()
            data = np.array(e.ids, dtype=np.uint32).tobytes()
            out += [data[4 * i : 4 * j] for i, j in zip(cut, cut[1:])]
        return out

    def missed(words: list[str]) -> list[bytes]:
        # letters and one mark after them are two pieces: of such words only the letters are encoded, each once
        heads = [w[:-1] if w[-1] in ".,;:!?" and w[:-1].isalpha() else w for w in words]
        at = {h: i for i, h in enumerate(dict.fromkeys(h for h in heads if h[0] != "\0"))}
        found = of_pieces([piece(h) for h in at]) if at else []
        return [(found[at[h]] if h[0] != "\0" else whole(h[1:])) + (ends[w[-1]] if len(h) < len(w) else b"") for h, w in zip(heads, words)]

    # The pattern must be the tokenizer's own; this file's description is checked, not assumed.
    kind = json.loads(t.to_str())
    cached = kind["normalizer"] is None and kind["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    def fits(text: str) -> bool:
        return cached and not any(s in text for s in special) and single_spaced(text)

    return lambda texts: encoded(texts, fits, lambda words: cache.all_of(words, missed), whole), t.get_vocab_size()


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, files: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> list[tuple[str, int, int]]:
    """Encodes docs, appends end_id to each, and writes files of about file_bytes bytes of text below `path` in ascending id order.

    Returns (file, rows, ids) of each file in order, which is all that reaches the driver. Null texts are empty, null ids
    come first, rows of one id are ordered by a hash of their text; each row is written, repeated ones too. Other files in the folder stay as they are,
    those of an earlier call too.
    """
    run = uuid.uuid4().hex[:12]
    rows = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    if files is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-total // file_bytes), min(3 * docs.sparkSession.sparkContext.defaultParallelism, total // LEAST))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        encode, size = encoder(tokenizer_path)
        k = TaskContext.get().partitionId()
        fs, p = file_system(path)
        fs.create_dir(p, recursive=True)
        name = f"{run}-{k:06d}-{uuid.uuid4().hex}.tok"
        w = Writer(fs.open_output_stream(f"{p}/{name}"), max(1, (size - 1).bit_length()))
        for b in portions(batches):
            doc = b.column(0)
            ids, ends = encode(b.column(1).to_pylist())
            w.add(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), np.diff(ends, prepend=0) + 1, np.insert(ids, ends, end_id))
        w.close()
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "file": [name], "rows": pa.array([w.rows], pa.int64()), "ids": pa.array([w.n], pa.int64())})

    written = sorted(dealt.mapInArrow(write, "k int, file string, rows long, ids long").collect(), key=lambda r: r["k"])
    names = {r["file"] for r in written}
    fs, p = file_system(path)
    for left in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
        if left.base_name.startswith(f"{run}-") and left.base_name not in names:
            fs.delete_file(left.path)
    return [(f"{path}/{r['file']}", r["rows"], r["ids"]) for r in written]


def checksums(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian uint32, from the files."""
    base, rows = 0, []
    for f, _, n in files:
        rows.append((f, base))
        base += n

    def read(batches):
        def each():
            for b in batches:
                for f, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for d, start, ids in Reader(f).documents():
                        yield d, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

        yield from batches_of({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}, each())

    frame = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return frame.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return checksums(spark, write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-files")))
