"""Problems 3 and 5 against brute force."""

import random
import re

from lumenframe.llm.boilerplate import boilerplate_blocks, repeated_lines, without_repeated_lines
from lumenframe.llm.runs import collapse_runs
from lumenframe.llm import boilerplate_queries, runs_queries
from tests.oracle import compare


def test_queries_equal_sql(spark):
    for module in (runs_queries, boilerplate_queries):
        for name, sql in module.SQL.items():
            compare(spark, module.QUERIES[name], sql)


def test_decoration(make_frames):
    titles = ["Report 7 - Ink", "(3) Report 7 - Ink", "● REPORT 7  -  ink", "Report 7 - Ink [00:12]", "Report 7 - Ink - 40%", "Report 7 - Ink (12 unread)", "*Report 7 - Ink — Edited", "Report 8 - Ink"]
    out = collapse_runs(make_frames([{"id": i, "timestamp": float(i), "app_name": "Ink", "window_title": t} for i, t in enumerate(titles)]))
    assert sorted((r.first_id, r.last_id, r.frame_count) for r in out.collect()) == [(0, 6, 7), (7, 7, 1)]


def brute_runs(rows):
    users: dict = {}
    for r in rows:
        if r["id"] is not None and r["timestamp"] is not None:
            users.setdefault(r["user_id"], []).append(r)
    out = []
    for user, events in users.items():
        events.sort(key=lambda r: (r["timestamp"], r["id"]))
        run = []
        for r in [*events, None]:
            key = r and (r["app_name"] or "", r["window_title"] or "")
            if run and key != run[0]:
                out.append((user, run[1], run[2], run[3]))
                run = []
            if r:
                run = [key, run[1] if run else r["id"], r["id"], run[3] + 1 if run else 1]
    return sorted(out, key=repr)


def test_runs_against_brute_force(spark, make_frames):
    rng = random.Random(11)
    rows = [
        {"id": rng.choice([i, i, i, None]), "timestamp": rng.choice([None] + [float(rng.randrange(500))] * 9), "user_id": rng.choice([1, 1, 2, None]), "app_name": rng.choice(["a", "", None]), "window_title": rng.choice(["x", "y", None])}
        for i in range(600)
    ]
    frames = make_frames(rows, "u long, c string, t string, border string")
    for size, batch in ((40.0, 10_000), (1e6, 7)):  # also batches that end within a chunk
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = sorted(((r.user_id, r.first_id, r.last_id, r.frame_count) for r in collapse_runs(frames, chunk_seconds=size).collect()), key=repr)
        assert got == brute_runs(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert collapse_runs(make_frames([])).count() == 0


def test_lines(make_frames):
    legal = "© {} Some Works.  All rights\tkept"
    rows = [{"id": i, "app_name": "A", "text": f"own line of text number {chr(97 + i % 26)}{i}x\n  {legal.format(i)} \nSee the other side please"} for i in range(12)]
    rows += [{"id": 100 + i, "app_name": a, "text": legal.format(i)} for i, a in enumerate([None, "", "B"])]
    rows += [{"id": 200, "app_name": "A", "text": None}, {"id": 201, "app_name": "A", "text": ""}, {"id": 202, "app_name": "A", "text": "ok go\n" * 3}]
    frames = make_frames(rows, "k string, line string, s string, h long")
    got = sorted((r.id, r.line_no) for r in repeated_lines(frames).collect())
    assert got == [(i, n) for i in range(12) for n in (2, 3)]
    blocks, _ = boilerplate_blocks(frames)
    assert {r.block for r in blocks.collect()} == {"see the other side please"}
    clean = {r.id: (r.text, r.removed) for r in without_repeated_lines(frames).collect()}
    assert clean[3] == ("own line of text number d3x", 2) and clean[200] == (None, 0) and clean[201] == ("", 0) and len(clean) == len(rows)
    assert repeated_lines(make_frames([])).count() == 0


def test_letter_runs_and_share(make_frames):
    rows = [{"id": i, "app_name": "A", "text": "two words 99\nnow three words 12"} for i in range(10)]
    rows += [{"id": 100 + i, "app_name": "B", "text": "now three words" if i < 10 else re.sub(r"\d", "", f"x{i}")} for i in range(501)]
    got = {(r.id, r.line_no) for r in repeated_lines(make_frames(rows)).collect()}
    assert got == {(i, 2) for i in range(10)}  # 10 of 501 is under 2 %
