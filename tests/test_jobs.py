from __future__ import annotations

import json
import os
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemask.operators import detect, gaps, sections, state, transfer
from pagemask.sources import io, project
from pagemask.streaming.jobs import STATE, GapState, box_state, fold_actions, stream_gap_scan
from pagemask.streaming.parts import Parts, folders, parts_of
from tests.conftest import line_words


def find(spark, text, target, how="locate", context=None, page=1):
    words = line_words(spark, [text])
    d = spark.createDataFrame([("d", "doc_0.pdf", page, target, context or text)], "id string, file_name string, page int, text string, context string")
    return detect.locate(d, words).collect() if how == "locate" else detect.find_on_page(words, d).collect()


def test_exact_search(spark):
    assert len(find(spark, "This is a test document with unique text.", "unique text", "all")) == 1
    assert len(find(spark, "test word appears twice: test", "test", "all")) == 2
    assert find(spark, "This is a test document.", "nonexistent", "all") == []


def test_locate(spark):
    text = "Patient received ABC-123 protocol."
    (r,) = find(spark, text, "ABC-123")
    assert r.how == "exact" and r.rects[0].w == 42.0
    (r,) = find(spark, text, "ABC-l23")
    assert r.how == "fuzzy"
    assert find(spark, text, "completely different") == []


def test_locate_by_context(spark):
    lines = "\n".join(["patient got test protocol", "a b", "a b", "a b", "other received test again"])
    (r,) = find(spark, lines, "test", context="other received test again")
    assert r.how == "context" and r.rects[0].y > 72


def test_gap_needs_one_box_of_half(spark):
    words = line_words(spark, ["secretword here secretword"])
    box = lambda i, x, w: (f"b{i}", "doc_0.pdf", 1, x, 72.0, w, 10.0)
    schema = "id string, file_name string, page int, x double, y double, w double, h double"
    first = [box(0, 72.0, 60.0)]
    assert gaps.gap_scan(words, spark.createDataFrame(first, schema)).count() == 1
    x = 72.0 + 6 * 16
    thirds = first + [box(1, x, 18.0), box(2, x + 40, 18.0)]
    assert gaps.gap_scan(words, spark.createDataFrame(thirds, schema)).count() == 1
    assert gaps.gap_scan(words, spark.createDataFrame(first + [box(3, x, 30.0)], schema)).count() == 0


def test_section_title_of_unsorted_list(spark):
    toc = spark.createDataFrame([("f", 0, 1, "A", 1), ("f", 1, 1, "B", 5), ("f", 2, 1, "C", 2)], "file_name string, toc_index int, level int, title string, page int")
    pages = spark.createDataFrame([("f", p) for p in (1, 2, 5)], "file_name string, page int")
    assert {r.page: r.section_title for r in sections.section_title(pages, toc).collect()} == {1: "A", 2: "A", 5: "C"}


def test_prompt_failure_is_a_row(spark):
    def model(p):
        if "bad" in p:
            raise ValueError("no")
        return '[{"text": "x"}]'

    p = spark.createDataFrame([("f", 1, "good"), ("f", 2, "bad")], "file_name string, start_page int, prompt string")
    scored = detect.score_chunks(p, model)
    assert {r.start_page: r.error for r in scored.collect()} == {1: None, 2: "ValueError: no"}
    d = detect.parse_detections(scored).collect()
    assert [(r.text, r.page, r.confidence, r.category) for r in d] == [("x", 0, "medium", "unknown")]
    broken = spark.createDataFrame([("f", "{"), ("f", "[]"), ("f", "```json\n[{}]\n```")], "file_name string, response string")
    assert detect.parse_detections(broken).count() == 1


def test_drawing_clusters(spark):
    rng = random.Random(3)
    rects = [(x, y, x + rng.randint(0, 40), y + rng.randint(0, 40)) for x, y in ((rng.randint(0, 900), rng.randint(0, 900)) for _ in range(120))]
    rects = [tuple(map(float, r)) for r in rects]
    root = list(range(len(rects)))
    for _ in rects:
        for i, a in enumerate(rects):
            for j, b in enumerate(rects):
                if a[0] - 30 <= b[2] and a[2] + 30 >= b[0] and a[1] - 30 <= b[3] and a[3] + 30 >= b[1]:
                    root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame([("f", 1, *r) for r in rects], "file_name string, page int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(r.n for r in transfer.drawing_clusters(df).collect())
    assert got == sorted(root.count(k) for k in set(root))


def test_suppression_follows_the_order(spark):
    rng = random.Random(4)
    schema = "id string, file_name string, page int, seq long, x double, y double, w double, h double"
    make = lambda n, p: [(f"{p}{i}", "f", i % 2, i, float(rng.randint(0, 60)), float(rng.randint(0, 60)), float(rng.randint(0, 30)), float(rng.randint(1, 30))) for i in range(n)]
    new, old = make(60, "n"), make(5, "o")

    def share(a, b):
        cut = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4])) * max(0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
        return cut / (a[6] * a[7]) if a[6] * a[7] else 0

    taken, want = list(old), []
    for n in new:
        if all(t[2] != n[2] or share(n, t) < 0.5 for t in taken):
            taken.append(n)
            want.append(n[0])
    got = transfer.suppress_overlaps(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema))
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_dense_pages(spark):
    """A hundred thousand rectangles on one page: groups by a grid of their own, and boxes that cover each other."""
    rng = random.Random(14)
    n, began = 100_000, time.time()
    rects = [("f", 1, x := 300.0 * (k % 20) + rng.uniform(0, 200), y := 300.0 * (k // 20 % 20) + rng.uniform(0, 200), x + rng.uniform(0, 60), y + rng.uniform(0, 60)) for k in range(n)]
    frame = spark.createDataFrame(pd.DataFrame(rects, columns=["file_name", "page", "x0", "y0", "x1", "y1"]).astype({"page": "int32"}))
    got = transfer.drawing_clusters(frame).collect()
    assert len(got) == 400 and all(r.n == n // 400 for r in got)
    boxes = frame.selectExpr("concat_ws('#', x0, y0) AS id", "file_name", "page", "monotonically_increasing_id() AS seq", "x0 AS x", "y0 AS y", "x1 - x0 AS w", "y1 - y0 AS h")
    kept = transfer.suppress_overlaps(boxes, boxes.limit(0)).count()
    assert 10_000 < kept < n and time.time() - began < 120


def test_action_log_in_any_split(spark):
    rng = random.Random(5)
    rows = [("f", f"b{rng.randint(0, 5)}", i, rng.choice(["add", "edit", "remove"]), 1, float(i), 0.0, 1.0, 1.0) for i in range(80)]
    schema = "file_name string, box_id string, seq long, action string, page int, x double, y double, w double, h double"
    boxes = {}
    for f, b, i, a, p, x, *_ in rows:
        if a == "add" or (a == "edit" and b in boxes):
            boxes[b] = x
        elif a == "remove":
            boxes.pop(b, None)
    log = spark.createDataFrame(rows, schema)
    assert {r.box_id: r.x for r in state.replay_actions(log).collect()} == boxes
    rng.shuffle(rows)
    kept = None
    for part in (rows[:30], rows[20:70], rows[60:]):
        kept = fold_actions(kept, spark.createDataFrame(part, schema))
    assert {r.box_id: r.x for r in state.replay_actions(kept).collect()} == boxes and kept.columns == STATE


def test_gap_stream_equals_a_full_scan_after_each_batch(spark, tmp_path):
    """Files change, come and go, boxes come and go; each batch is told the names alone, and asks for the words of the files it needs."""
    rng = random.Random(9)
    names = ["Alderton", "Birkhoff", "Castellan", "and", "of", "met", "C++"]
    text = lambda: " ".join(rng.choice(names) for _ in range(8))
    pages = {f"doc_{i}.pdf": text() for i in range(7)}
    boxes: list[tuple] = []
    schema = "id string, file_name string, page int, x double, y double, w double, h double"
    turns, asked = [], []
    for turn in range(4):
        changed = set(pages) if not turn else set(rng.sample(sorted(pages), 2))
        if turn:
            for f in changed:
                pages[f] = text()
            pages.pop(sorted(changed)[0]) if turn == 2 else None
        words = [(f, *r[1:]) for f, r in ((f, r) for f, t in pages.items() for r in line_words(spark, [t]).collect())]
        boxes = [x for x in boxes if x[1] not in changed]
        own = [r for r in words if r[0] in changed and r[-1] not in ("and", "of")]
        boxes += [(f"{turn}#{k}", r[0], r[1], r[5], r[6], r[7] - r[5], r[8] - r[6]) for k, r in enumerate(rng.sample(own, min(3, len(own))))]
        turns.append((words, list(boxes)))
        spark.createDataFrame([(f,) for f in changed], "file_name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    word_schema = line_words(spark, ["a"]).schema

    def of(k):
        def table(files, n):
            some = {r.file_name for r in files.collect()}
            asked.append((n, k, some))
            return spark.createDataFrame([r for r in turns[n][k] if (r[0] if k == 0 else r[1]) in some], word_schema if k == 0 else schema)

        return table

    changes = spark.readStream.schema("file_name string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    state = f"file://{tmp_path}/state"
    stream_gap_scan(changes, of(0), of(1), state, f"file://{tmp_path}/checkpoint", once=True, parts=4).awaitTermination()
    kept = GapState(spark, state, 4)
    for n in (2, 3):  # the last two batches are kept
        words, b = (spark.createDataFrame(t, s) for t, s in zip(turns[n], (word_schema, schema)))
        full = gaps.gap_scan(words, b).collect()
        got = kept.gaps(n).collect()
        assert sorted(map(tuple, got)) == sorted((r.file_name, r.page, r.match_text, r.x0, r.y0, r.x1, r.y1) for r in full) and full
    assert kept.hits.last() == 3 and all(len(some) <= 2 for n, k, some in asked if n and (n, k) not in {x[:2] for x in asked[: asked.index((n, k, some))]})


def test_a_batch_writes_the_parts_of_its_files(spark, tmp_path):
    """Bytes and rows that a batch writes follow the batch, not the state; a repeated batch gives the same state."""
    state = Parts(spark, f"file://{tmp_path}/s", "file_name string, v int", 16)
    rows = lambda names, v: spark.createDataFrame([(n, v) for n in names], "file_name string, v int")
    every = [f"f{i}" for i in range(200)]
    state.replace(rows(every, 0), 0, list(range(16)))
    for n, name in enumerate(("f3", "f5", "f3"), 1):
        for _ in range(2):  # the second time as after a failure
            touched = parts_of(rows([name], n), 16)
            assert len(touched) == 1
            old = state.read(n - 1, touched).filter(F.col("file_name") != name)
            state.replace(old.unionByName(rows([name], n)), n, touched)
        assert spark.read.parquet(f"file://{tmp_path}/s/data/{n}").count() < 40
        now = {r.file_name: r.v for r in state.read(n).collect()}
        assert len(now) == 200 and now[name] == n
    assert state.last() == 3 and set(folders(spark, f"file://{tmp_path}/s/live")) == {"2", "3"} and len(state.read(2).collect()) == 200
    state.replace(rows([], 0), 4, parts_of(rows(["f3"], 0), 16))
    assert state.read(4).count() < 200 and state.read(-1).count() == 0


def test_a_document_with_all_keys_is_read(spark, tmp_path):
    """Records of former versions, records without fields and things that aren't records."""
    box = {"id": "1", "x": 1.0, "y": 2, "w": 3.0, "h": 4.0, "page": 0, "selection_mode": "redact", "match": "é \"q\"", "pd_check_result": {"verdict": "public", "claim": "c"}, "repeat_pages": [1, 2], "section_title": "S"}
    doc = {
        "project_redactions": {"a.pdf": {"0": [box, {"selection_mode": "rectangle"}, "no box", 5], "11": [{"id": "2"}]}, "empty.pdf": {}},
        "project_toc_redactions": {"a.pdf": {"2": "CCI"}},
        "dismissed_matches": [["a.pdf", 1, "x, [y]", "t"], ["short"], "text", 7, None],
        "terms_list": [{"term": "one*", "active": True}, {"term": "two", "active": False}, "no term"],
        "selected_files": ["/c/a.pdf", "/c/b.pdf"],
        "folder": "/c",
        "search_results": [{"id": "r", "file_name": "a.pdf", "page": 3, "match": "m", "category": "ai"}, {"file_name": "b.pdf"}, []],
        "ai_detections": [{"text": "d", "page": 2, "file_name": "a.pdf", "rects": [{"x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0}], "redacted": True}, {}, 3],
        "ai_library_path": None,
        "ai_document_summaries": {"a.pdf": {"doc_type": "csr", "summary": "s"}},
        "cci_auto_batch_ids": ["b1"],
    }
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
    t = project.read_project(spark, str(tmp_path / "p.json"))
    b = {(r.page, r.n): r for r in t["boxes"].collect()}
    assert set(b) == {(1, 0), (1, 1), (12, 0)}
    assert (b[1, 0].selection_mode, b[1, 0].match, b[1, 0].y, b[1, 0].repeat_pages, b[1, 0].section_title) == ("highlight", 'é "q"', 2.0, [1, 2], "S")
    assert b[1, 0].pd_check_result[:5] == ("public", "c", 0.0, "", "") and b[1, 1].pd_check_result is None
    assert (b[1, 1].selection_mode, b[1, 1].id, b[1, 1].x, b[1, 1].match, b[12, 0].selection_mode) == ("rectangle", "", 0.0, None, "highlight")
    assert [tuple(r) for r in t["dismissed"].collect()] == [("a.pdf", 1, "x, [y]", "t")] and [tuple(r) for r in t["toc_edits"].collect()] == [("a.pdf", 2, "CCI")]
    assert [tuple(r) for r in t["terms"].orderBy("ord").collect()] == [("one*", True, 0), ("two", False, 1)] and [r.file_path for r in t["files"].orderBy("ord").collect()] == ["/c/a.pdf", "/c/b.pdf"]
    r = {x.file_name: x for x in t["results"].collect()}
    assert len(r) == 2 and (r["a.pdf"].id, r["a.pdf"].page, r["a.pdf"].category, r["a.pdf"].term, r["a.pdf"].redacted) == ("r", 3, "ai", "", False) and (r["b.pdf"].category, len(r["b.pdf"].id)) == ("matches", 40)
    d = sorted(t["detections"].collect(), key=lambda x: x.text)
    assert [(x.text, x.page, x.confidence, x.redacted, len(x.rects)) for x in d] == [("", 0, "low", False, 0), ("d", 2, "low", True, 1)]
    assert t["summaries"].first().summary == {"doc_type": "csr", "summary": "s"} and t["auto_batches"].first().batch_id == "b1" and tuple(t["settings"].first()) == ("/c", None)
    (tmp_path / "few.json").write_text("{}")
    assert all(f.count() == (k == "settings") for k, f in project.read_project(spark, str(tmp_path / "few.json")).items())
    (tmp_path / "bad.json").write_text("{,")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        project.read_project(spark, str(tmp_path / "bad.json"))["boxes"].collect()


@pytest.mark.parametrize("parts", [None, 1, 4])
def test_project_round_trip(spark, tmp_path, parts):
    """What is written is read again, from one document or several, each of which has all keys and is plain JSON."""
    odd = 'a "quoted"\\ name\n[{ü.pdf'
    box = "file_name string, page int, id string, seq long, x double, y double, w double, h double, selection_mode string, match string, term string, batch_id string, context string, section_title string, repeat_pages array<int>, rects string"
    boxes = [(f, p, f"{f}{p}{k}", 9 - k, 1.5 * k, 0.1, 3.0, 4e-5, "rectangle", None if k else 'm "', "t", "b", None, "s", [2] if k else [], "x") for f in (odd, "b.pdf", "c.pdf") for p in (1, 12) for k in range(3)]
    frames = {
        "boxes": spark.createDataFrame(boxes, box),
        "toc_edits": spark.createDataFrame([(odd, 0, "C\tCI"), (odd, 10, ""), ("b.pdf", 2, "x")], "file_name string, toc_index int, new_title string"),
        "dismissed": spark.createDataFrame([(odd, 1, "m,]\"", "t"), ("b.pdf", 2, "", "")], "file_name string, page int, match_text string, term string"),
        "terms": spark.createDataFrame([("z", True, 0), ('a"*', False, 1)], "term string, active boolean, ord int"),
        "files": spark.createDataFrame([(f"/x/{f}",) for f in (odd, "b.pdf")], "file_path string"),
        "results": spark.createDataFrame([("1", "b.pdf", "/x/b.pdf", 3, "m", "t", "gap", "c", "b", True, False)], "id string, file_name string, file_path string, page int, match string, term string, category string, context string, batch_id string, redacted boolean, dismissed boolean"),
        "detections": spark.createDataFrame([("d", odd, "/p", 2, "high", "c", "j", "x", False, True, "")], "text string, file_name string, file_path string, page int, confidence string, category string, justification string, context string, redacted boolean, dismissed boolean, batch_id string"),
        "summaries": spark.createDataFrame([(odd, {"a": 'b"'}), ("b.pdf", {})], "file_name string, summary map<string,string>"),
        "auto_batches": spark.createDataFrame([("b1",), ("b2",)], "batch_id string"),
        "settings": spark.createDataFrame([('/f "older', "/lib.csv")], "folder string, ai_library_path string"),
    }
    path = str(tmp_path / "project")
    n = project.write_project(frames, path, parts)
    texts = [x.read_text(encoding="utf-8") for x in sorted((tmp_path / "project").rglob("part-*.txt"))]
    assert len(texts) == n == (parts or 1) and all(list(json.loads(x)) == project.KEYS for x in texts) and not any('"rects"' in x or "null" in x.replace('"ai_library_path": null', "") for x in texts)
    if n == 1:
        d = json.loads(texts[0])
        assert [b["id"] for b in d["project_redactions"][odd]["11"]] == [f"{odd}12{k}" for k in (2, 1, 0)] and {b["page"] for b in d["project_redactions"][odd]["11"]} == {11}
        assert d["terms_list"] == [{"term": "z", "active": True}, {"term": 'a"*', "active": False}] and [odd, 1, 'm,]"', "t"] in d["dismissed_matches"]
    back = project.read_project(spark, path)
    key = lambda rows: sorted(map(str, rows))
    for name, frame in frames.items():
        columns = [c for c in frame.columns if c in back[name].columns and c not in project.UNSAVED]
        assert len(columns) >= len(frame.columns) - 2 and key(tuple(r) for r in back[name].select(*columns).collect()) == key(tuple(r) for r in frame.select(*columns).collect()), name
    path = str(tmp_path / "empty")
    project.write_project({k: f.limit(0) for k, f in frames.items()}, path)
    assert all(f.count() == (k == "settings") for k, f in project.read_project(spark, path).items())


def test_files(spark, tmp_path):
    for n in ("a.pdf", "B.PDF", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert {r.file_name for r in io.list_files(spark, str(tmp_path)).collect()} == {"a.pdf", "B.PDF"}
    one = spark.createDataFrame([("a.pdf",)], "file_name string")
    assert io.list_files(spark, str(tmp_path), one).count() == 1
    assert not io.export_results(spark.createDataFrame([], "file_name string, page int"), str(tmp_path / "out")) and not (tmp_path / "out").exists()


def test_plans_have_no_cartesian_product(spark):
    words = line_words(spark, ["a b c"])
    boxes = spark.createDataFrame([("b", "doc_0.pdf", 1, 72.0, 72.0, 60.0, 10.0)], "id string, file_name string, page int, x double, y double, w double, h double")
    plan = gaps.gap_scan(words, boxes)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_library_row_by_row(spark):
    df = spark.createDataFrame([("x1", "", "c"), ("", "second", "d"), ("", "", "")], ["Redacted", "CCI text", "Type"])
    assert [(r.redacted_text, r.category) for r in state.load_library(df).orderBy(F.col("redacted_text")).collect()] == [("second", "d"), ("x1", "c")]


def test_dismissing_twice_keeps_both(spark):
    rows = [("a", "f", 1, "x", "t", "b1", True, False), ("b", "f", 1, "y", "t", "b2", True, False)]
    r = spark.createDataFrame(rows, "id string, file_name string, page int, match string, term string, batch_id string, redacted boolean, dismissed boolean")
    boxes = spark.createDataFrame([("f", "b1"), ("f", "b2"), ("f", "b3")], "file_name string, batch_id string")
    key = lambda m: spark.createDataFrame([("f", 1, m, "t")], "file_name string, page int, match_text string, term string")
    one, left = state.dismiss(r, boxes, key("x"))
    two, left = state.dismiss(one, left, key("y"))
    assert {(x.id, x.dismissed, x.redacted, x.batch_id) for x in two.collect()} == {("a", True, False, None), ("b", True, False, None)}
    assert [x.batch_id for x in left.collect()] == ["b3"]


def test_library_has_every_item(spark):
    df = spark.createDataFrame([(f"text {i:04d}", "c", "k", f"j{i}") for i in range(450)], "redacted_text string, context string, category string, justification string")
    blocks, n = detect.library_blocks(df)
    (r,) = blocks.collect()
    assert n == 1 and r.library.count("- Text:") == 450 and '  Justification: "j449"' in r.library
    chunks = spark.createDataFrame([(f"{i}.pdf", 1, 5, "Intro", f"body {i}") for i in range(6)], "file_name string, start_page int, end_page int, section_title string, text string")
    none = spark.createDataFrame([], "file_name string, title_text string, toc_text string, outline string")
    for most in (10**6, 5_000):
        prompts = detect.build_prompts(chunks, none, df, most=most).collect()
        _, n = detect.library_blocks(df, most)
        assert len(prompts) == 6 * n and (n > 5) == (most == 5_000)
        for i in range(6):
            own = [p.prompt for p in prompts if p.file_name == f"{i}.pdf"]
            assert all(f"body {i}" in p for p in own) and sorted(x for p in own for x in re.findall(r"text \d{4}", p)) == [f"text {k:04d}" for k in range(450)]
    empty = detect.build_prompts(chunks, none, df.limit(0)).collect()
    assert len(empty) == 6 and not any("Known items" in p.prompt for p in empty)


def test_only_missing_replies_are_asked_for(spark, tmp_path):
    """Attempts that failed are repeated up to a bound, those that succeeded never; a changed prompt is another one."""
    log = tmp_path / "calls"
    log.mkdir()
    frame = lambda rows: spark.createDataFrame(rows, "file_name string, start_page int, prompt string")

    def model(name, fails):
        def call(prompt):
            with open(log / f"{name}-{abs(hash(prompt))}-{os.getpid()}", "a") as f:
                f.write(prompt + "\n")
            if prompt in fails:
                raise ValueError("no")
            return f"{name}: {prompt}"

        return call

    def asked(name):
        return sorted(x for p in log.glob(f"{name}-*") for x in p.read_text().split("\n")[:-1])

    path, rows = f"file://{tmp_path}/replies", [("a", 1, "one"), ("a", 2, "two"), (None, 1, "three"), ("a", 1, "one")]
    get = lambda r: {(x.file_name, x.start_page): (x.response, x.error, x.attempts) for x in r.collect()}
    first = get(detect.score_missing(frame(rows), model("m1", {"two", "three"}), path, parallel=3))
    assert first == {("a", 1): ("m1: one", None, 1), ("a", 2): (None, "ValueError: no", 1), (None, 1): (None, "ValueError: no", 1)} and asked("m1") == ["one", "three", "two"]
    second = get(detect.score_missing(frame(rows), model("m2", {"two"}), path))
    assert second == {("a", 1): ("m1: one", None, 1), ("a", 2): (None, "ValueError: no", 2), (None, 1): ("m2: three", None, 2)} and asked("m2") == ["three", "two"]
    third = get(detect.score_missing(frame(rows[1:2] + [("a", 1, "one more")]), model("m3", {"two"}), path))
    assert third == {("a", 2): (None, "ValueError: no", 3), ("a", 1): ("m3: one more", None, 1)} and asked("m3") == ["one more", "two"]
    fourth = get(detect.score_missing(frame(rows), model("m4", set()), path))
    assert fourth[("a", 2)] == (None, "ValueError: no", 3) and asked("m4") == []
    assert get(detect.score_missing(frame(rows), model("m5", set()), path, attempts=4))[("a", 2)] == ("m5: two", None, 4) and asked("m5") == ["two"]
    assert detect.score_missing(frame([]), model("m6", set()), f"{path}-none").collect() == []


def test_clusters_over_tables_are_passed_over(spark):
    box = "file_name string, page int, cluster int, n long, x0 double, y0 double, x1 double, y1 double"
    src = spark.createDataFrame([("f", 1, 0, 5, 0.0, 0.0, 100.0, 100.0)], box)
    dst = spark.createDataFrame([("f", 1, 0, 5, 0.0, 0.0, 100.0, 100.0), ("f", 2, 1, 5, 10.0, 10.0, 110.0, 110.0)], box)
    cells = spark.createDataFrame([("f", 1, 0, 0, 0, 0.0, 0.0, 100.0, 31.0, "a")], "file_name string, page int, table_idx int, row_idx int, col_idx int, x0 double, y0 double, x1 double, y1 double, text string")
    assert transfer.match_clusters(src, dst).first().page == 1 and transfer.match_clusters(src, dst, cells=cells).first().page == 2


def grid(spark, texts, page=1, idx=0):
    rows = [("f", page, idx, r, c, 60.0 * c, 14.0 * r, 60.0 * c + 60, 14.0 * r + 14, t) for r, line in enumerate(texts) for c, t in enumerate(line)]
    return spark.createDataFrame(rows, "file_name string, page int, table_idx int, row_idx int, col_idx int, x0 double, y0 double, x1 double, y1 double, text string")


def test_titles_decide_between_equal_tables(spark):
    t = [["a", "b"], ["1", "2"]]
    both = grid(spark, t, 1, 0).unionByName(grid(spark, t, 1, 1))
    titles = lambda a, b: spark.createDataFrame([("f", 1, 0, a), ("f", 1, 1, b)], "file_name string, page int, table_idx int, title string")
    m = transfer.match_tables(grid(spark, t), both, source_titles=titles("Plasma levels", None), target_titles=titles("Sites", "Plasma levels")).first()
    assert m.table_idx == 1 and round(m.score, 6) == 1.0
    assert round(transfer.match_tables(grid(spark, t), both, source_titles=titles(None, None)).first().score, 6) == 1.0
    assert round(transfer.match_tables(grid(spark, t), both, target_titles=titles("x", "y")).first().score, 6) == 1.0 - 0.15 / 2


def test_cell_matching_equals_brute_force(spark):
    from pagemask.functions.similarity import cell

    rng = random.Random(8)
    make = lambda: [[rng.choice(["alpha one", "alpha two", "beta", "12", "13", "", "gamma delta"]) for _ in range(3)] for _ in range(4)]
    a, b = make(), make()
    b[2] = list(a[2])
    src, dst = grid(spark, a), grid(spark, b, 2)
    boxes = spark.createDataFrame([(f"{r}{c}", "f", 1, 60.0 * c + 5, 14.0 * r + 2, 40.0, 9.0) for r in range(4) for c in range(3)], "id string, file_name string, page int, x double, y double, w double, h double")
    at = lambda t, r, c: t[r][c] if 0 <= r < 4 and 0 <= c < 3 else ""
    want, content = {}, {}
    for r in range(4):
        for c in range(3):
            scores = []
            for i in range(4):
                for j in range(3):
                    near = [cell(at(a, r + y, c + x), at(b, i + y, j + x)) for y, x in ((-1, 0), (1, 0), (0, -1), (0, 1))]
                    scores.append((5 * cell(a[r][c], b[i][j]) + sum(near), (i, j)))
                    if cell(a[r][c], b[i][j]) >= 0.85:
                        content.setdefault(f"{r}{c}", (i, j))
            full = [p for s, p in scores if s >= 8]
            best = max(scores, key=lambda x: (x[0], -x[1][0], -x[1][1]))
            if full or best[0] >= 3.5:
                want[f"{r}{c}"] = full[0] if full else best[1]
    got = transfer.match_cells(transfer.containing_cell(boxes, src), dst).collect()
    assert {x.id: (x.row_idx, x.col_idx) for x in got} == want
    texts = boxes.join(src.selectExpr("concat(row_idx, col_idx) AS id", "text"), "id")
    got = transfer.match_cell_content(texts, dst).collect()
    assert {x.id: (x.row_idx, x.col_idx) for x in got} == content


def test_line_and_run_matching_equals_brute_force(spark):
    from difflib import SequenceMatcher

    from pagemask.functions.similarity import token_set

    rng = random.Random(9)
    vocabulary = ["alpha", "alphq", "beta", "gamma", "delta", "x"]
    pages = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(5)) for _ in range(5)) for _ in range(6)]
    words = line_words(spark, pages)
    targets = [(f"doc_{i}.pdf", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4)))) for i in range(6)]
    boxes = spark.createDataFrame([(f, f, 1, t) for f, t in targets], "id string, file_name string, page int, text string")
    window = spark.createDataFrame([(f, 0, 0, 1) for f, _ in targets], "file_name string, page_offset int, radius int, target_pages int")
    got = {(r.b_id, r.block_no): round(r.score, 6) for r in transfer.match_lines(boxes, words, window).collect()}
    want = {(f, k): round(token_set(t, line) / 100, 6) for (f, t), p in zip(targets, pages) for k, line in enumerate(p.split("\n")) if len(t) >= 3 and token_set(t, line) >= 80}
    assert got == want and got
    found = {r.id: round(r.ratio, 6) for r in detect.fuzzy_locate(boxes, words).collect()}
    best = {}
    for (f, t), p in zip(targets, pages):
        w = p.split()
        r = max(SequenceMatcher(None, t, " ".join(w[i : i + k])).ratio() for k in range(1, 7) for i in range(len(w) - k + 1))
        if r >= 0.8:
            best[f] = round(r, 6)
    assert found == best and found


def test_log_entries_count_however_late(spark, tmp_path):
    from pagemask.streaming.jobs import stream_boxes

    schema = "file_name string, box_id string, seq long, action string, page int, x double, y double, w double, h double, ts timestamp"
    rows = [("f", "a", 1, "add", 1, 1.0, 1.0, 1.0, 1.0, "2026-01-09 00:00:00"), ("f", "b", 2, "add", 1, 2.0, 1.0, 1.0, 1.0, "2026-01-01 00:00:00"), ("f", "b", 2, "add", 1, 2.0, 1.0, 1.0, 1.0, "2026-01-01 00:00:00"), ("f", "a", 3, "edit", 1, 9.0, 1.0, 1.0, 1.0, "2025-12-01 00:00:00")]
    log = str(tmp_path / "log")
    for r in rows:  # a file and so a batch each
        spark.createDataFrame([r[:-1]], schema.rsplit(",", 1)[0]).selectExpr("*", f"timestamp'{r[-1]}' AS ts").coalesce(1).write.mode("append").parquet(log)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
    last: list[int] = []
    stream_boxes(live, f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint", on_boxes=lambda df, n: last.append(n), once=True).awaitTermination()
    got = state.replay_actions(box_state(spark, f"file://{tmp_path}/state").read(last[-1])).collect()
    assert {(r.box_id, r.x) for r in got} == {("a", 9.0), ("b", 2.0)} and last[-1] >= 3
    assert not (tmp_path / "state" / "0").exists()


def test_cell_bounds_hold_the_similarity(spark):
    from pagemask.functions.similarity import cell, cell_bounds, cell_sketch

    rng = random.Random(3)
    marks = ["a", "b", "c", "A", "1", "2", " ", "  ", ".", "é", "x y", "\n", "\t", "İ", "ß", " ", "Ж", "5 mg", "?", "\u007f"]
    some = lambda: "".join(rng.choice(marks) for _ in range(rng.randint(0, 7)))
    rows = []
    for _ in range(20_000):
        a = some()
        b = some() if rng.random() < 0.7 else a[: rng.randint(0, 7)] + rng.choice(marks) + a[rng.randint(0, 7) :]
        rows.append((a, b, cell(a, b)))
    rows += [(None, "a", 0.0), ("a", None, 0.0), (None, None, 0.0)]
    d = spark.createDataFrame(rows, "a string, b string, c double")
    d = d.withColumns({"k": cell_sketch("a"), "l": cell_sketch("b")}).select("c", cell_bounds(F.col("k"), F.col("l")).alias("b")).select("c", "b.*")
    assert d.filter("lo IS NULL OR hi IS NULL OR c < lo - 1e-9 OR c > hi + 1e-9 OR (lo = hi AND c <> lo)").count() == 0
    assert d.filter("lo = hi").count() > 2_000 and d.filter("lo = 0 AND hi BETWEEN 0.01 AND 0.84").count() > 1_000
