"""Equal rectangles of a page make no pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemask.operators import transfer as tr


def test_drawing_overlap_of_many_copies(spark):
    """20,000 drawings of five places under 20,000 equal boxes: 400 million pairs, if copies met."""
    k = F.col("id") % 5
    drawings = spark.range(20_000).select(F.lit("f").alias("file_name"), F.lit(1).alias("page"), (10.0 * k).alias("x0"), F.lit(0.0).alias("y0"), (10.0 * k + 8).alias("x1"), F.lit(5.0).alias("y1"))
    box = lambda v: F.lit(float(v))
    boxes = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("f").alias("file_name"), F.lit(1).alias("page"), box(0).alias("x"), box(0).alias("y"), box(60).alias("w"), box(20).alias("h"))
    cells = spark.createDataFrame([], "file_name string, page int, table_idx int, x0 double, y0 double, x1 double, y1 double")
    got = tr.drawing_overlap(boxes, drawings, cells).groupBy("count", "x0", "y0", "x1", "y1", "rx1").count().collect()
    assert [tuple(r) for r in got] == [(20_000, 0.0, 0.0, 48.0, 5.0, 1.0, 20_000)]
