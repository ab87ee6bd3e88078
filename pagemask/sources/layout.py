"""Page words, page texts and character offsets; and the views of the sample tables that the queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["file_name", "page"]
READING = ["block_no", "line_no", "word_no"]


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word table: file_name, page, block_no, line_no, word_no, x0, y0, x1, y1, text."""
    schema = "file_name string, page int, block_no int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
    return spark.read.schema(schema).parquet(path)


def store_by_page(rows: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Writes a table with file_name and page below `path`, bucketed by both, and reads it back. Joins, groups and windows by page then need no shuffle of it, and joins of two tables
    of as many buckets none at all; a file is spread over the buckets by its pages. buckets: as many as shuffles have partitions, unless said; more for larger tables,
    so that a bucket of the words stays at a few hundred megabytes. The table has a name of its own in the session's catalog."""
    import uuid

    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"by_page_{uuid.uuid4().hex}"
    # dealt as the buckets are, so that each bucket is one file
    rows.repartition(n, *PAGE).write.format("parquet").bucketBy(n, *PAGE).sortBy(*PAGE).option("path", path).saveAsTable(name)
    return spark.table(name)


def words_from_text(docs: DataFrame, per_page: int = 5, per_line: int = 12) -> DataFrame:
    """Words of plain texts, laid out with a fixed pitch: `per_page` lines of text a page, `per_line` words a visual line. Lines are dealt by their page, before they are cut
    into words: what is grouped, joined or ordered by page then needs no shuffle of words."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    tokens = F.filter(F.split("line", r"[ \t\r]+", -1), lambda t: t != "")
    placed = lines.select("file_name", (F.floor(F.col("i") / per_page) + 1).cast("int").alias("page"), (F.col("i") % per_page).alias("block_no"), "line").repartition(n, *PAGE)
    at = placed.select(*PAGE, "block_no", F.posexplode(tokens).alias("k", "text"))
    at = at.select(*PAGE, "block_no", F.floor(F.col("k") / per_line).cast("int").alias("line_no"), (F.col("k") % per_line).alias("word_no"), "text")
    page = W.partitionBy(*PAGE)
    line = W.partitionBy(*PAGE, "block_no", "line_no").orderBy("word_no").rowsBetween(W.unboundedPreceding, -1)
    x0 = F.lit(72.0) + 6.0 * F.coalesce(F.sum(F.length("text") + 1).over(line), F.lit(0))
    y0 = F.lit(72.0) + 12.0 * (F.dense_rank().over(page.orderBy("block_no", "line_no")) - 1)
    out = at.withColumns({"x0": x0, "y0": y0})
    return out.select(*PAGE, *READING, "x0", "y0", (F.col("x0") + 6.0 * F.length("text")).alias("x1"), (F.col("y0") + 10.0).alias("y1"), "text")


def word_offsets(words: DataFrame) -> DataFrame:
    """words with start and stop: character offsets in the page's text (0-based, end exclusive)."""
    before = W.partitionBy(*PAGE).orderBy(*READING).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return words.withColumn("start", start).withColumn("stop", F.col("start") + F.length("text"))


def page_text(words: DataFrame) -> DataFrame:
    """file_name, page and text: the words in reading order, joined by spaces."""
    ordered = F.array_sort(F.collect_list(F.struct(*READING, "text")))
    return words.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def corpus_files(docs: DataFrame, words: DataFrame) -> DataFrame:
    """file_name, file_path and total_pages of the sample documents."""
    paths = docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), "source")
    pages = words.groupBy("file_name").agg(F.max("page").alias("total_pages"))
    return paths.join(pages, "file_name").select("file_name", F.concat(F.lit("/corpus/"), "source", F.lit("/"), "file_name").alias("file_path"), "total_pages")


def sample_boxes(words: DataFrame) -> DataFrame:
    """Redaction boxes of all documents: long ASCII words, and tokens with an at-sign, an address or ten digits. Where the sum of a token's place
    numbers divides by three it was overlooked and has no box. Where the token's length is odd, the box also covers the next word of the line."""
    from pagemask.functions.text import clean_token

    w = words.withColumn("clean", clean_token(F.col("text")))
    line = W.partitionBy(*PAGE, "block_no", "line_no").orderBy("word_no")
    w = w.withColumns({"next_x1": F.lead("x1").over(line), "next_text": F.lead("text").over(line)})
    chosen = F.regexp_like("clean", F.lit("^[A-Za-z]{11,}$")) | F.contains("text", F.lit("@")) | F.regexp_like("text", F.lit(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")) | F.regexp_like("text", F.lit("[0-9]{10,}"))
    overlooked = (F.col("block_no") + F.col("line_no") + F.col("word_no")) % 3 == 0
    w = w.filter(chosen & ~overlooked).withColumn("n", F.row_number().over(W.partitionBy(*PAGE).orderBy(*READING)))
    two = (F.length("text") % 2 == 1) & F.col("next_x1").isNotNull()
    return w.select(
        *PAGE,
        F.concat_ws("#", "file_name", "page", *READING).alias("id"),
        (F.col("page") * 100000 + F.col("n")).cast("long").alias("seq"),
        F.col("x0").alias("x"), F.col("y0").alias("y"), (F.when(two, F.col("next_x1")).otherwise(F.col("x1")) - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"),
        F.when(F.col("n") % 3 == 0, "rectangle").otherwise("highlight").alias("selection_mode"),
        F.col("clean").alias("match"),
        F.lower(F.substring("clean", 1, 3)).alias("term"),
        F.concat_ws("#", "file_name", "page", F.floor((F.col("n") + 1) / 2).cast("string")).alias("batch_id"),
        F.when(two, F.concat_ws(" ", "text", "next_text")).otherwise(F.col("text")).alias("context"),
    )


def sample_results(words: DataFrame) -> DataFrame:
    """Search results: words of nine letters and more, over all categories."""
    from pagemask.functions.geometry import rect
    from pagemask.functions.text import clean_token

    w = words.withColumn("clean", clean_token(F.col("text"))).filter(F.length("clean") >= 9)
    n = F.length("clean")
    category = F.when(n % 4 == 0, "dosage").when(n % 4 == 1, "matches").when(n % 4 == 2, "gap").otherwise("ai")
    return w.select(
        F.concat_ws("#", "file_name", "page", *READING).alias("id"),
        "file_name",
        F.concat(F.lit("/corpus/"), "file_name").alias("file_path"),
        "page",
        F.col("text").alias("match"),
        F.lower(F.substring("clean", 1, 3)).alias("term"),
        category.alias("category"),
        F.concat_ws(" ", F.lit("block"), F.col("block_no").cast("string"), "text").alias("context"),
        F.when(n % 6 == 0, F.concat_ws("#", "file_name", "page", F.lit("1"))).alias("batch_id"),
        F.lit(False).alias("redacted"),
        (F.col("page") % 7 == 0).alias("dismissed"),
        F.array(rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("rects"),
    )


def sample_toc(words: DataFrame) -> DataFrame:
    """A bookmark for each page: the page's first three words; level 1 on every third page."""
    first = F.slice(F.array_sort(F.collect_list(F.struct(*READING, "text"))), 1, 3)
    pages = words.groupBy(*PAGE).agg(F.array_join(F.transform(first, lambda w: w["text"]), " ").alias("title"))
    return pages.select("file_name", (F.col("page") - 1).alias("toc_index"), F.when(F.col("page") % 3 == 1, 1).otherwise(2).alias("level"), "title", "page")


def stream_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session, where one machine does it all, may leave the setting out."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir() + '/pagemask-checkpoints').rstrip('/')}/stream-{uuid.uuid4().hex}"


class Views:
    """The sample views of one folder, each made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def stored(self) -> Views:
        """The same views, with words and boxes written once below the shared folder, bucketed by page, and read from there, as an application keeps them:
        for queries that read them many times."""
        path, v = stream_dir(self.spark), Views(self.spark, self.dir)
        v.kept["words"] = store_by_page(self.words, path + "/words")
        v.kept["boxes"] = store_by_page(v.boxes, path + "/boxes")
        return v

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def words(self) -> DataFrame:
        return self.kept["words"] if "words" in self.kept else words_from_text(self.table("documents"))

    @property
    def pages(self) -> DataFrame:
        return page_text(self.words)

    @property
    def files(self) -> DataFrame:
        return corpus_files(self.table("documents"), self.words)

    @property
    def boxes(self) -> DataFrame:
        return self.kept["boxes"] if "boxes" in self.kept else sample_boxes(self.words)

    @property
    def results(self) -> DataFrame:
        return sample_results(self.words)

    @property
    def toc(self) -> DataFrame:
        return sample_toc(self.words)

    @property
    def dismissed(self) -> DataFrame:
        r = self.results.filter(F.length("match") % 5 == 0)
        return r.select("file_name", "page", F.lower(F.trim("match")).alias("match_text"), "term").distinct()

    @property
    def terms(self) -> DataFrame:
        """The first letters of frequent words: the query set of the searches, with one blank and one inactive term."""
        rows = [("than*", True, 1), ("erin", True, 2), ("of the", True, 3), ("", True, 4), ("the", False, 5), ("*tion", True, 6)]
        return self.spark.createDataFrame(rows, "term string, active boolean, ord int")
