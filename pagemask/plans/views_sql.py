"""The sample views in DuckDB SQL, as common table expressions."""

from __future__ import annotations

import re

VIEWS: dict[str, tuple[list[str], str]] = {
    "words": ([], r"""
  w_lines AS (SELECT 'doc_' || doc_id || '.pdf' AS file_name, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  w_tokens AS (SELECT file_name, i // 5 + 1 AS page, i % 5 AS block_no, unnest(range(len(t))) AS k, unnest(t) AS text
    FROM (SELECT file_name, i, list_filter(regexp_split_to_array(line, '[ \t\r]+'), lambda x: x <> '') AS t FROM w_lines)),
  w_at AS (SELECT file_name, page, block_no, k // 12 AS line_no, k % 12 AS word_no, text FROM w_tokens),
  w_xy AS (SELECT *, 72.0::DOUBLE + 6.0 * coalesce(sum(length(text) + 1) OVER (PARTITION BY file_name, page, block_no, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x0,
    72.0::DOUBLE + 12.0 * (dense_rank() OVER (PARTITION BY file_name, page ORDER BY block_no, line_no) - 1)::DOUBLE AS y0 FROM w_at),
  words AS (SELECT file_name, page::INT AS page, block_no::INT AS block_no, line_no::INT AS line_no, word_no::INT AS word_no, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + 6.0 * length(text))::DOUBLE AS x1, (y0 + 10.0)::DOUBLE AS y1, text FROM w_xy)"""),
    "offsets": (["words"], """
  offsets0 AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY file_name, page ORDER BY block_no, line_no, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM words),
  offsets AS (SELECT *, (start + length(text))::INT AS stop FROM offsets0)"""),
    "pages": (["words"], """
  pages0 AS (SELECT file_name, page, string_agg(text, ' ' ORDER BY block_no, line_no, word_no) AS text FROM words GROUP BY file_name, page),
  pages_t AS (SELECT * FROM pages0)"""),
    "files": (["words"], """
  files AS (SELECT f.file_name, '/corpus/' || source || '/' || f.file_name AS file_path, total_pages
    FROM (SELECT 'doc_' || doc_id || '.pdf' AS file_name, source FROM documents) f JOIN (SELECT file_name, max(page) AS total_pages FROM words GROUP BY file_name) p USING (file_name))"""),
    "boxes": (["words"], r"""
  b0 AS (SELECT *, trim(trim(text), '()[]{}<>.,;:!?') AS clean, lead(x1) OVER l AS next_x1, lead(text) OVER l AS next_text FROM words WINDOW l AS (PARTITION BY file_name, page, block_no, line_no ORDER BY word_no)),
  b1 AS (SELECT *, row_number() OVER (PARTITION BY file_name, page ORDER BY block_no, line_no, word_no) AS n FROM b0
    WHERE (block_no + line_no + word_no) % 3 <> 0 AND (regexp_matches(clean, '^[A-Za-z]{11,}$') OR contains(text, '@') OR regexp_matches(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') OR regexp_matches(text, '[0-9]{10,}'))),
  boxes AS (SELECT file_name, page, concat_ws('#', file_name, page, block_no, line_no, word_no) AS id, page * 100000 + n AS seq, x0 AS x, y0 AS y,
    (CASE WHEN length(text) % 2 = 1 AND next_x1 IS NOT NULL THEN next_x1 ELSE x1 END) - x0 AS w, y1 - y0 AS h,
    CASE WHEN n % 3 = 0 THEN 'rectangle' ELSE 'highlight' END AS selection_mode, clean AS match, lower(substr(clean, 1, 3)) AS term,
    concat_ws('#', file_name, page, (n + 1) // 2) AS batch_id, CASE WHEN length(text) % 2 = 1 AND next_x1 IS NOT NULL THEN text || ' ' || next_text ELSE text END AS context FROM b1)"""),
    "results": (["words"], r"""
  r0 AS (SELECT *, trim(trim(text), '()[]{}<>.,;:!?') AS clean FROM words),
  results AS (SELECT concat_ws('#', file_name, page, block_no, line_no, word_no) AS id, file_name, '/corpus/' || file_name AS file_path, page, text AS match, lower(substr(clean, 1, 3)) AS term,
    CASE length(clean) % 4 WHEN 0 THEN 'dosage' WHEN 1 THEN 'matches' WHEN 2 THEN 'gap' ELSE 'ai' END AS category, 'block ' || block_no || ' ' || text AS context,
    CASE WHEN length(clean) % 6 = 0 THEN concat_ws('#', file_name, page, '1') END AS batch_id, false AS redacted, page % 7 = 0 AS dismissed,
    [{'x': x0, 'y': y0, 'w': x1 - x0, 'h': y1 - y0}] AS rects FROM r0 WHERE length(clean) >= 9)"""),
    "toc": (["words"], """
  toc AS (SELECT file_name, page - 1 AS toc_index, CASE WHEN page % 3 = 1 THEN 1 ELSE 2 END AS level, array_to_string(list(text ORDER BY block_no, line_no, word_no)[1:3], ' ') AS title, page FROM words GROUP BY file_name, page)"""),
    "dismissed": (["results"], """
  dismissed AS (SELECT DISTINCT file_name, page, lower(trim(match)) AS match_text, term FROM results WHERE length(match) % 5 = 0)"""),
    "terms": ([], """
  terms AS (SELECT * FROM (VALUES ('than*', true, 1), ('erin', true, 2), ('of the', true, 3), ('', true, 4), ('the', false, 5), ('*tion', true, 6)) t(term, active, ord))"""),
}


def with_views(names: str, query: str) -> str:
    """`query` under the views it names (and the ones these need)."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in done:
            done.append(name)

    for n in names.split():
        add(n)
    body = query.strip()
    # each view once, however often it is read
    ctes = re.sub(r"(?m)^(\s*\w+) AS \(", r"\1 AS MATERIALIZED (", ",".join(VIEWS[n][1] for n in done))
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
