"""Quality rules, with cross-document line frequency. Only DataFrame functions: no Python runs on the executors.

Rules within a document (base): too few words, or too many words in repeated 8-word windows. Across documents: lines are
normalised (lower case, runs of white space as one space, trimmed) and hashed; a line that occurs in more than `line_limit`
distinct documents of one host, and in more than the share `line_share` of them, is boilerplate and removed; a document that keeps less
than `min_share` of its words is rejected. Documents with equal texts count as one document (`equal_once`), so that the lines of a
copied text aren't taken for boilerplate; with `merge_copies`, so do documents of a host that are near copies of each other line by line.

Texts are read once: features and line hashes are written to the shared folder, and all counting works on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import join_hot, materialize

SPACE = r"[ \t-\r]+"
#: A set of lines that more texts than this are held against is dealt to so many more tasks.
PER_SALT = 100_000
#: Near copies share lines with so much of the words of the longer one. Keys by which they are found.
COPY_SHARE = 0.6
KEYS = 16


def _windows(words: Column, n: int) -> Column:
    """Hashes of all n-word windows of an array of words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _features(rows: DataFrame, window: int) -> DataFrame:
    """rows (with text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = rows.withColumns({"_words": F.filter(F.split(text, SPACE, -1), lambda w: w != ""), "_lines": lines})
    d = d.withColumn("_h", _windows(F.col("_words"), window))
    # Only a text with a repeated window is looked at more closely: equal hashes become neighbours, their places are the windows'.
    pairs = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    s = F.col("_s")
    same = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
    starts = F.array_sort(F.transform(same, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    found = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # A generator, so that a filter on a feature isn't pushed below it and evaluated with all its inputs for each element.
    return d.select(*rows.columns, F.inline(F.array(found)))


def _lines(text: Column) -> Column:
    """array<struct<line_no,line,words>>: index, hash and number of words of each line with a word."""
    clean = F.lower(F.regexp_replace(text, r"[ \t\x0b-\r]+", " "))
    trimmed = F.transform(F.split(clean, "\n", -1), lambda x, i: F.struct(i.alias("line_no"), F.trim(x).alias("l")))
    return F.transform(F.filter(trimmed, lambda x: F.length(x["l"]) > 0), lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(x["l"]).alias("line"), F.size(F.split(x["l"], " ")).alias("words")))


def _same_host(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _often(once: DataFrame, hosts: DataFrame, line_limit: int, line_share: float) -> DataFrame:
    """_host, _line and n_docs of the lines above the limits. once: host, line and a name of the document, each once; hosts: _site, n_site."""
    counted = once.groupBy(F.col("host").alias("_host"), F.col("line").alias("_line")).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > line_limit)
    return join_hot(counted, hosts, _same_host("_host", "_site"), "n_site").filter(F.col("n_docs") > line_share * F.col("n_site")).select("_host", "_line", "n_docs")


def _at_line() -> Column:
    return _same_host("host", "_host") & (F.col("line") == F.col("_line"))


def frequent_lines(docs: DataFrame, line_limit: int, line_share: float, merge_copies: bool = False) -> DataFrame:
    """_host, _line (a hash) and n_docs, the number of distinct documents, of the lines above the limits. docs: did, host, lines.

    With merge_copies a document that is a near copy of another one of its host (of lesser did) doesn't count. Only documents with a
    frequent line are looked at. Each meets the least one of its host that has the same least line under each of KEYS hash orders, and is a
    copy if lines of COPY_SHARE of the longer one's words are common to both: each comparison is exact, and there are KEYS of them a document
    at most, however large a group is.
    """
    hosts = materialize(docs.select("did", F.col("host").alias("_site")).distinct().groupBy("_site").agg(F.count("*").alias("n_site")), "hosts")
    once = materialize(docs.select("host", "did", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct(), "lines")
    often = materialize(_often(once, hosts, line_limit, line_share), "often")
    if not merge_copies:
        return often
    hit = materialize(join_hot(once, often, _at_line(), "n_docs").select("host", "line", "did"), "frequent-lines")
    sets = docs.join(hit.select("did").distinct(), "did", "left_semi").groupBy("did", F.xxhash64("host").alias("site")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"))))))).alias("lines")
    )
    sets = materialize(sets, "line-sets")
    keys = F.array(*[F.xxhash64(F.lit(k), F.array_min(F.transform("lines", lambda x, k=k: F.xxhash64(x["line"], F.lit(k))))) for k in range(KEYS)])
    keyed = materialize(sets.select("did", "site", F.explode(keys).alias("key")), "line-keys")
    first = keyed.groupBy(F.col("site").alias("_s"), F.col("key").alias("_k")).agg(F.min("did").alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = join_hot(keyed, first, (F.col("site") == F.col("_s")) & (F.col("key") == F.col("_k")), "n").filter("did <> first").select("did", "first").distinct()
    pairs = materialize(pairs, "line-pairs")
    salts = pairs.groupBy(F.col("first").alias("_first")).agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / PER_SALT).cast("int"))
    salted = join_hot(pairs, salts, F.col("first") == F.col("_first"), "n").select("did", "first", F.pmod(F.xxhash64("did"), F.col("salts")).cast("int").alias("salt"))
    its = sets.join(salts, F.col("did") == F.col("_first")).select(F.col("did").alias("first"), F.col("lines").alias("its"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    words = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x["words"])
    same = words(F.array_intersect("lines", "its"))
    copies = salted.join(sets.select("did", "lines"), "did").join(its, ["first", "salt"]).filter(same >= F.lit(COPY_SHARE) * F.greatest(words("lines"), words("its"))).select("did").distinct()
    return materialize(_often(hit.join(copies, "did", "left_anti"), hosts, line_limit, line_share), "often")


_KEY = ["doc_id", "host", "th", "tn"]


def _same_document(a: str, b: str) -> Column:
    return F.col(a + "doc_id").eqNullSafe(F.col(b + "doc_id")) & _same_host(a + "host", b + "host") & (F.col(a + "th") == F.col(b + "th")) & (F.col(a + "tn") == F.col(b + "tn"))


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, text, host, the text's hash and length, and the input row as a struct."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(host_col).cast("string").alias("host"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
    )
    return rows.withColumns({"th": F.xxhash64("text"), "tn": F.octet_length("text")})


def verdicts(docs: DataFrame, line_limit: int = 20, line_share: float = 0.01, min_share: float = 0.2, window: int = 8, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", merge_copies: bool = False, equal_once: bool = True) -> DataFrame:
    """One row per input row: doc_id, host, th and tn (the text's hash and length), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, removed_lines (indexes of lines that are boilerplate in the document's host), removed_words, base_failed and kept.

    Null and empty texts have no words and fail. A null host is a host of its own; rows with null ids, and rows of one id, are told apart by
    host and text; repeated rows each give a row with the same verdict. Other columns are not read. Without `equal_once`, documents with
    equal texts count each. With `merge_copies`, near copies of a text don't make its lines boilerplate.
    """
    rows = _rows(docs, id_col, text_col, host_col).drop("row").withColumn("lines", _lines(F.col("text")))
    found = materialize(_features(rows, window).drop("text"), "quality")
    did = F.xxhash64("host", "th", "tn") if equal_once else F.xxhash64("host", "th", "tn", "doc_id")
    often = frequent_lines(found.select(did.alias("did"), "host", "lines"), line_limit, line_share, merge_copies)
    hit = join_hot(found.select(*_KEY, F.inline("lines")), often, _at_line(), "n_docs").select(*_KEY, "line_no", "words").distinct()
    removed = hit.groupBy(*[F.col(c).alias("_" + c) for c in _KEY]).agg(F.array_sort(F.collect_list("line_no")).alias("removed_lines"), F.sum("words").alias("removed_words"))
    gone = F.coalesce(F.col("removed_words"), F.lit(0))
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return found.join(removed, _same_document("", "_"), "left").select(
        *_KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), gone.cast("long").alias("removed_words"),
        failed.alias("base_failed"), (~failed & ((gone == 0) | (F.col("n_words") - gone >= F.lit(min_share) * F.col("n_words")))).alias("kept"),
    )


def quality_rules(docs: DataFrame, carry: bool = False, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """`verdicts` with the text in place of its hash, and with `carry` the whole input row as the struct `row`."""
    judged = verdicts(docs, id_col=id_col, text_col=text_col, host_col=host_col, **options).dropDuplicates(_KEY)
    both = _rows(docs, id_col, text_col, host_col).join(judged.withColumnsRenamed({c: "_" + c for c in _KEY}), _same_document("", "_"))
    return both.select("doc_id", "text", *[c for c in judged.columns if c not in _KEY], *(["row"] if carry else []))


def _left() -> Column:
    """The text without its removed lines; a text without such lines as it is."""
    gone = F.col("removed_lines")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return F.when(F.size(gone) > 0, left).otherwise(F.col("text"))


def without_lines(judged: DataFrame) -> DataFrame:
    """doc_id and text without the removed lines, of the documents kept."""
    return judged.filter("kept").select("doc_id", _left().alias("text"))


def without_boilerplate(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs (all columns) without the rejected documents, and without the boilerplate lines of those kept. Other columns stay as they are."""
    judged = quality_rules(docs, carry=True, text_col=text_col, **options).filter("kept")
    return judged.select(*[_left().alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    judged = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id AS own_id, coalesce(text, '') AS text, source AS host FROM documents),
w AS (SELECT rid, text, host, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - 6)) AS p, words FROM w WHERE len(words) >= 8),
keyed AS (SELECT rid, p, array_to_string(words[p:p + 7], ' ') AS k FROM win),
dup AS (SELECT rid, p FROM keyed QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, sum(least(8, p - before)) AS n FROM (SELECT rid, p, coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -8) AS before FROM dup) GROUP BY rid),
raw AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
norm AS (SELECT rid, host, text, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM raw),
site AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
many AS (SELECT host, line, count(DISTINCT text) AS n_docs FROM norm WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT text) > 20),
often AS (SELECT m.host, m.line FROM many m JOIN site s ON m.host IS NOT DISTINCT FROM s.host WHERE n_docs > 0.01 * s.n),
gone AS (SELECT n.rid, sum(len(string_split(n.line, ' '))) AS n FROM norm n JOIN often o ON n.host IS NOT DISTINCT FROM o.host AND n.line = o.line GROUP BY n.rid),
f AS (SELECT w.rid, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS wc,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS gone
      FROM w LEFT JOIN dl USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
j AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT own_id AS doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND (gone = 0 OR n_words - gone >= 0.2 * n_words)) AS kept FROM j JOIN d USING (rid)
"""
