"""Secrets: fixed formats, and random-looking strings by character Markov models.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled samples:
values in a fixed secret format count as random, every other stretch of identifier characters as ordinary. The counts are
taken over the whole table by Spark; only two 68 x 68 count tables reach the driver. A token of 20 or more characters with
letters and digits is a finding if its log-likelihood ratio exceeds a total and a mean.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import SPANS, SPANS_ARROW, batches_of, id_and_text, span_digest, texts

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "random"]

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character classes of the models; the last class stands for every other byte and separates tokens.
CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(CHARS) + 1
_CLASS = np.full(256, N - 1, dtype=np.int64)
_CLASS[np.frombuffer(CHARS, dtype=np.uint8)] = np.arange(N - 1)

#: Labelled samples that are always added, so that a table without secrets trains a model too: seeded random strings, and
#: names as programs have them.
RANDOM_SAMPLES = 400
ORDINARY = """get_user_name setDefaultTimeout max_retries_per_request HttpServletRequest application_properties
    test_parse_config_file_2 org/apache/spark/sql/functions com-example-service-v2 README_2023_final background-color
    MAX_CONNECTIONS_PER_HOST user_profile_image_url_64 windows-server-2019-datacenter node_modules/package-lock
    build/output/release-1-2-3 AbstractSingletonProxyFactoryBean section-4-2-introduction img_20230401_120000
    customer_id_1234567890 page-header-navigation-item-12 INTERNAL_SERVER_ERROR_500 utf-8-encoded-string-value""".split()


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats; each kind leftmost and non-overlapping."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6] if any(w in low for w in _WORDS) else []
    for run in _LONG.finditer(text) if runs is None else runs:  # access and hex values lie within one long run
        s = run[0]
        if "AKIA" in s:
            found += [(run.start() + m.start(), 1, run.start() + m.end()) for m in _ACCESS.finditer(s) if len(m[0]) >= 20]
        if len(s) >= 24:
            found += [(run.start() + m.start(), 2, run.start() + m.end()) for m in _HEX.finditer(s)]
    return sorted(found)


def transitions(data: bytes) -> np.ndarray:
    """N x N counts of neighbouring character classes in data, with a boundary on both ends."""
    c = _CLASS[np.frombuffer(b"\n" + data + b"\n", dtype=np.uint8)]
    return np.bincount(c[:-1] * N + c[1:], minlength=N * N)


def _seeded() -> np.ndarray:
    rng = random.Random(7)
    kinds = [CHARS[:62].decode(), "0123456789abcdef", CHARS[:64].decode(), CHARS[:26].decode() + "0123456789"]
    noise = "\n".join("".join(rng.choices(rng.choice(kinds), k=rng.randint(20, 44))) for _ in range(RANDOM_SAMPLES))
    return np.stack([transitions("\n".join(ORDINARY).encode()), transitions(noise.encode())])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio, random against ordinary, of each transition: N x N, from all rows of docs.

    Each task adds up its own two tables; the shuffle holds at most 2 N^2 sums a task, the result 2 N^2.
    """

    def count(batches):
        total = np.zeros((2, N * N), dtype=np.int64)
        for _, t in texts(batches):
            spans, values, rest, at = base_spans(t), [], [], 0
            for s, k, e in spans:
                values.append(t[max(s, e - 40) : e] if k == 0 else t[s:e])
                rest.append(t[at:s])
                at = max(at, e)
            rest.append(t[at:])
            total[0] += transitions("\n".join(rest).encode())
            if values:
                total[1] += transitions("\n".join(re.split(r"[:=\x20\"']", v)[-1] for v in values).encode())
        label, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": label.astype(np.int32), "cell": cell.astype(np.int32), "n": total[label, cell]})

    counts = _seeded().astype(float)
    sums = id_and_text(docs, id_col, text_col).mapInArrow(count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # 2 N^2 rows at most
        counts[r["label"], r["cell"]] += r["n"]
    c = counts.reshape(2, N, N)
    c[:, N - 1, N - 1] = 0
    p = np.log((c + 0.5) / (c + 0.5).sum(axis=2, keepdims=True))
    return p[1] - p[0]


def ratio(token: str, model: np.ndarray) -> float:
    """Log-likelihood ratio of a token, its boundaries included."""
    c = _CLASS[np.frombuffer(b"\n" + token.encode() + b"\n", dtype=np.uint8)]
    return float(model[c[:-1], c[1:]].sum())


def find_spans(text: str, model: np.ndarray, least: float = 12.0, mean: float = 0.4) -> list[tuple[str, int, int]]:
    """(kind, start, end), sorted by start and then kind. Random strings never overlap a base span."""
    runs = list(_LONG.finditer(text))
    found = base_spans(text, runs)
    base = list(found)
    for m in runs:
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and not any(a < m.end() and m.start() < e for a, _, e in base):
            if (r := ratio(s, model)) >= least and r / len(s) >= mean:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, e) for a, k, e in sorted(found)]


def find_secrets(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind,start,end,text>>, one row per input row.

    Null and empty texts give an empty array; a null id stays null; repeated rows each give a row; other columns are not read.
    """

    def scan(batches):
        rows = ((i, [{"kind": k, "start": s, "end": e, "text": t[s:e]} for k, s, e in find_spans(t, model)]) for i, t in texts(batches))
        yield from batches_of({"doc_id": pa.int64(), "spans": SPANS_ARROW}, rows)

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def mask_secrets(docs: DataFrame, model: np.ndarray, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret in the text replaced by a mask (overlapping ones by one); nulls stay null, other columns as they are."""
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for _, s, e in find_spans(text, model):
            if s >= done:
                out += [text[done:s], mask]
            done = max(done, e)
        return "".join(out) + text[done:]

    def scan(batches):
        for b in batches:
            column = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield b.set_column(at, pa.field(text_col, pa.string()), column)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(scan, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return span_digest(find_secrets(docs, train(docs)), BASE)
