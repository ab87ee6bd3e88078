"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled to count a document. Only the words of the bounded sample, from which
the first tier is made, are grouped by Spark.

Tier one is a compact table of the frequent words' token counts, from a bounded sample of rows over all of the table, and broadcast.
Tier two is a bounded cache in each worker, filled by encoding what the table misses. Both are caches only: every count is what the
library gives.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import id_and_text, portions
from pagemask.llm.pretokens import Cache, plain

#: Bounds of the broadcast table: rows that are sampled (on average), and words that are kept.
SAMPLE_ROWS = 1000
FREQUENT = 50_000
#: The normalizer and the pre-tokenizer's pattern under which white space ends every merge and counts nothing.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def load(path: str):
    """count(text), and count_words(words) where the words are a list, by the library that the file's suffix names; and the tokenizer
    (None for sentencepiece)."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(sp.encode(text, num_threads=1)), None, None
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def count_words(words: list[str]) -> list[int]:
        found = np.zeros(0, dtype=np.int64)
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            e = t.encode(some, is_pretokenized=True, add_special_tokens=False)
            found = np.r_[found, np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(some))]
        return found.tolist()

    return lambda text: len(t.encode(text, add_special_tokens=False).ids), count_words, t


def words_split(tokenizer) -> bool:
    """Whether the tokenizer drops white space before its merges, by its own description, so that a text's count is the sum of its
    words' counts."""
    if tokenizer is None:
        return False
    kind = json.loads(tokenizer.to_str())
    parts = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
    cut = [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    return (kind["normalizer"] or {}).get("normalizers") == NORMALIZERS and parts == cut and kind["post_processor"] is None


@lru_cache(maxsize=1)
def rare_words(path: str) -> Cache:
    """The worker's cache, which all its tasks share."""
    return Cache()


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of plain texts, the number of the word at each place, and where each text's places end."""
    parts = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.string()), " ")
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), parts.offsets.to_numpy()[1:]


def frequent_words(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """Token counts of the FREQUENT most frequent words of about SAMPLE_ROWS rows, taken from all of the table by a hash, whole texts:
    bounded whatever the table's size. The words are counted by Spark."""
    _, count_words, tokenizer = load(path)
    if not words_split(tokenizer):
        return {}
    rows = id_and_text(docs, id_col, text_col)
    one_in = max(1, docs.count() // SAMPLE_ROWS)
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(one_in)) == 0).select("text")

    def scan(batches):
        for b in portions(batches, 0):
            some = [t for t in b.column(0).to_pylist() if plain(t)]
            if some:
                words, places, _ = split(some)
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(np.bincount(places, minlength=len(words)))})

    top = rows.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(FREQUENT)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    words = [r["word"] for r in top.collect() if not any(s in r["word"] for s in special)]
    return dict(zip(words, count_words(words)))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, frequent: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), one row per input row.

    Null and empty texts count zero bytes and tokens; a null id stays null; repeated rows each give a row; other columns are
    not read. Texts that aren't plain Latin, or hold a special token's string, are encoded whole by the library, and so are all texts
    where the tokenizer doesn't end its merges at white space (sentencepiece).
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path, id_col, text_col) if frequent is None else frequent)

    def scan(batches):
        count, count_words, tokenizer = load(path)
        by_word = words_split(tokenizer)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if by_word else []
        first, rare = table.value.get, rare_words(path)

        def of_words(words: list[str]) -> np.ndarray:
            found = list(map(first, words))
            missed = [i for i, n in enumerate(found) if n is None]
            for i, n in zip(missed, rare.all_of([words[i] for i in missed], count_words)):
                found[i] = n
            return np.array(found, dtype=np.int64)

        for b in portions(batches):
            texts = b.column(1).to_pylist()
            fit = [by_word and plain(t) and not any(s in t for s in special) for t in texts]
            total = np.zeros(len(texts), dtype=np.int64)
            if any(fit):
                words, places, ends = split([t for t, f in zip(texts, fit) if f])
                sums = np.r_[0, np.cumsum(of_words(words)[places])]
                total[np.flatnonzero(fit)] = np.diff(sums[np.r_[0, ends]])
            for i in np.flatnonzero(~np.array(fit, dtype=bool)):
                total[i] = count(texts[i])
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
