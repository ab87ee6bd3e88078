"""t4_term_boxes and b5_redact_bookmark_pages follow their SQL where a word with the term ends in a hyphen at a line's end."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import plain


@pytest.mark.parametrize("name", ["t4_term_boxes", "b5_redact_bookmark_pages"])
def test_hyphen_at_the_end_of_a_line(spark, tmp_path, name):
    rows = [(0, "a xntst-\nward b"), (1, "a xnt-\nst b"), (2, "NTST c")]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    names = sorted(got.columns)
    want = c.sql(f"SELECT {','.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(plain(tuple(r)) for r in got.select(*names).collect()) == sorted(plain(r) for r in want)
