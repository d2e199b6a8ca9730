import json
import threading
import urllib.error
import urllib.request
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe import api
from lumenframe.cache import Answers
from lumenframe.functions import crypto
from lumenframe.functions.timeparse import parse_natural_time
from lumenframe.operators import dedup
from lumenframe.operators.dedup import duplicate_ids, has_changed
from lumenframe.sources.store import MemoryStore, load_config
from lumenframe.streaming import pipeline

NOW = datetime(2024, 5, 15, 14, 30, tzinfo=timezone.utc).timestamp()  # a Wednesday
DAY = datetime(2024, 5, 15, tzinfo=timezone.utc).timestamp()


@pytest.mark.parametrize(
    ("expression", "start", "end"),
    [
        ("today", 0, 14.5), ("this morning", 6, 12), ("afternoon", 12, 17), ("tonight", 17, 23 + 59 / 60), ("yesterday", -24, 0),
        ("yesterday evening", -7, -1 / 60), ("yesterday at 4pm", -8, -7), ("last night", -4, 0), ("last night at midnight", 0, 1),
        ("last night at 11pm", -1, 0), ("last 2 hours", 12.5, 14.5), ("last few days", -9.5, 14.5), ("this week", -48, 14.5),
        ("last week", -216, -48), ("at 3:30pm", 15.5, 16.5), ("around noon", 12, 13), ("whatever", 13.5, 14.5), ("Last  10 Minutes", 14.5 - 1 / 6, 14.5),
    ],
)
def test_times(expression, start, end):
    got = parse_natural_time(expression, NOW)
    assert got == pytest.approx((DAY + 3600 * start, DAY + 3600 * end))


def test_strict_last_week():
    assert parse_natural_time("last week", NOW, strict=True) == (NOW - 3600, NOW)


def test_answers():
    now, version, calls = [0.0], ["v1"], []
    answers = Answers(lambda: version[0], lambda: now[0], capacity=2)

    def double(x):
        calls.append(x)
        return None if x == 0 else x * 2

    ask = lambda x: answers.ask("double", double, 10, x=x)
    assert (ask(1), ask(1), ask(0), ask(0)) == (2, 2, None, None) and calls == [1, 0, 0]
    now[0] = 10.0
    assert ask(1) == 2 and calls == [1, 0, 0, 1]
    version[0] = "v2"
    assert ask(1) == 2 and len(calls) == 5
    assert answers.usage() == {"asked": 6, "found": 1, "hit_rate": 0.17, "kept": 1}
    ask(2), ask(3)
    assert answers.usage()["kept"] == 2
    answers.forget("other")
    assert answers.usage()["kept"] == 2
    answers.forget()
    assert answers.usage()["kept"] == 0


def test_encryption(spark):
    df = spark.createDataFrame([(1, "secret"), (2, ""), (3, None), (4, "ENC:broken"), (5, "ünï")], "i int, v string")
    sealed = df.withColumn("e", crypto.encrypt(F.col("v"), "k")).cache()
    rows = sealed.withColumn("d", crypto.decrypt(F.col("e"), "k")).withColumn("w", crypto.decrypt(F.col("e"), "other")).orderBy("i").collect()
    assert [r.d for r in rows] == [r.v for r in rows]
    assert rows[0].e.startswith("ENC:") and rows[0].w == rows[0].e and rows[1].e == "" and rows[2].e is None and rows[3].e == "ENC:broken"


def test_dedup_anchor(make_frames):
    times = [0.0, 30.0, 59.0, 60.0, 100.0, 121.0]
    rows = [{"id": i, "timestamp": t, "app_name": "a", "phash": "f" * 16} for i, t in enumerate(times)]
    rows += [{"id": 10 + i, "timestamp": t, "app_name": "a", "phash": p, "user_id": 2} for i, (t, p) in enumerate([(0.0, ""), (1.0, None), (2.0, "a" * 16), (3.0, "b" * 16), (4.0, "a" * 16)])]
    assert sorted(r.id for r in duplicate_ids(make_frames(rows)).collect()) == [1, 2, 4]
    assert duplicate_ids(make_frames([])).count() == 0


def test_a_stretch_of_a_million_rows_is_folded_row_by_row():
    """An unchanging screen, every ten seconds: each minute's first row stays, and no batch grows."""
    n = 1_000_000
    ids = np.arange(n, dtype=np.int64)
    size = 10_000
    batches = (
        pa.record_batch([pa.array(np.ones(size, np.int64)), pa.array(np.ones(size, np.int64)), pa.array(ids[a : a + size] * 10.0), pa.array(ids[a : a + size])], names=["u", "s", "t", "i"])
        for a in range(0, n, size)
    )
    dropped = np.concatenate([np.asarray(b.column(0)) for b in dedup._after_anchors(batches, 60.0)])
    assert np.array_equal(dropped, ids[ids % 6 != 0])


def test_changed_against_the_last_changed_frame(make_frames):
    hashes = ["0" * 16, "0" * 15 + "7", "0" * 14 + "3f", "0" * 14 + "3F", None, "0" * 14 + "3e", "bad", "0" * 16, "0" * 16, ""]
    want = [True, False, True, False, True, False, True, True, False, True]
    frames = make_frames([{"id": i, "timestamp": float(i // 2), "phash": h} for i, h in enumerate(hashes)])
    got = {r.id: r.changed for r in dedup.changed_frames(frames).collect()}
    assert [got[i] for i in range(len(hashes))] == want and dedup.changed_frames(make_frames([])).count() == 0


def test_a_batch_tried_again_is_stored_once(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(NOW - 86400.0 * d, f"budget {d}") for d in range(10)], "timestamp double, text string")
    assert [store.append(rows, "a", 0), store.append(rows, "a", 0), store.append(rows, "b", 0), store.append(rows, "a", 1)] == [10, 0, 10, 10]
    assert sorted(r.id for r in store.frames().collect()) == list(range(1, 31))
    assert store.search_index().matching("budget").count() == 30
    store.append(rows.limit(1))
    assert store.search_index().matching("budget").count() == 31  # the index is kept in step
    assert store.prune(NOW, 2.5) == 21 and store.frames().count() == 10 and store.search_index().matching("budget").count() == 10
    assert store.vacuum() > 0 and store.frames().count() == 10 and store.prune(NOW, 2.5) == 0
    store._put("LOCK", "x", False)
    with pytest.raises(TimeoutError), store._turn(wait=0.5):
        pass


def test_keys_and_home(tmp_path, monkeypatch):
    monkeypatch.setenv("LUMENFRAME_HOME", str(tmp_path / "home"))
    monkeypatch.setenv(crypto.KEY_VARIABLE, "")
    assert load_config()["capture_interval"] == 10 and (tmp_path / "home" / "settings.json").exists()
    (tmp_path / "home" / "settings.json").write_text('{"capture_interval": 20, "x": 1}')
    assert load_config()["capture_interval"] == 20
    with pytest.raises(ValueError):
        crypto.export_key(None, str(tmp_path / "k"))
    crypto.export_key("secret", str(tmp_path / "k"))
    assert crypto.import_key(str(tmp_path / "k")) == "secret" == crypto.key_from_environment() and (tmp_path / "k").stat().st_mode & 0o77 == 0
    with pytest.raises(FileExistsError):
        crypto.export_key("other", str(tmp_path / "k"))


def test_exact_rounding():
    assert api.Service._share(1, 16, 15)["percent"] == 6.2 and api.Service._share(247, 2000, 10)["percent"] == 12.3


def test_changed(spark):
    rows = [("0" * 16, "0" * 15 + "7", False), ("0" * 16, "0" * 14 + "3f", True), ("0" * 16, "0" * 14 + "1F", False), ("", "0" * 16, True), (None, "x", True), ("zz", "0" * 16, True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", has_changed(F.col("a"), F.col("b"))).collect())


def test_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"), key="k")
    assert store.frames().count() == 0
    rows = [(NOW - 86400 * d - 10, "Notes", f"title {d}", "budget review " + "x" * 600, "", "f" * 16) for d in range(10)]
    assert store.insert_batch(rows) == 10
    assert store.insert(timestamp=NOW - 5, app_name="Mail", window_title="inbox", text="hello budget") == 11
    assert sorted(r.id for r in store.frames().collect()) == list(range(1, 12))
    assert all(r.text.startswith("ENC:") for r in store.frames().collect())
    assert store.frames(NOW - 3600, NOW).count() == 2
    report = store.compress_old(NOW)
    assert report["compressed"] == 7 and store.compress_old(NOW)["compressed"] == 0
    plain = crypto.decrypt_fields(store.frames(), "k")
    assert plain.where(F.length("text") == 500).count() == 7
    assert store.prune(NOW) == 3 and store.deduplicate(NOW, 2400) == 0
    store.auto_maintain(NOW)
    assert store.vacuum() > 0 and store.frames().count() == 8 and store.stats()["frames"] == 8
    assert store.decrypt_existing() == {"total": 8, "encrypted": 0}

    service = api.Service(MemoryStore(spark, str(tmp_path / "s")), lambda: NOW)
    assert [r["id"] for r in service.search("hello")] == [11] and service.latest()["id"] == 11
    assert service.during("today")[0]["id"] == 11 and service.smart_search("budget")
    assert service.focus(60)["total_frames"] == 2 and service.focus(60)["switches"] == 1
    assert [(r["top_app"], r["frame_count"]) for r in service.sessions(1)] == [("Notes", 2)]
    assert "Mail" in service.activity(60) and service.activity(0) == "No activity in the last 0 minutes."
    server = api.serve(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{base}/recent?minutes=60&limit=x"))[0]["id"] == 11
    for path, code in (("/nothing", 404), ("/search?q=a-b", 500)):
        with pytest.raises(urllib.error.HTTPError) as error:
            urllib.request.urlopen(base + path)
        assert error.value.code == code
    server.shutdown()
    assert [t["name"] for t in json.loads(api.answer(service, '{"id": 1, "method": "tools/list"}'))["result"]["tools"]] == list(api.TOOLS)
    assert "error" in json.loads(api.answer(service, '{"id": 2, "method": "x"}'))


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"session_gap_minutes": 5}')
    assert load_config(str(path))["session_gap_minutes"] == 5 and load_config(str(path))["capture_interval"] == 10
    path.write_text("{broken")
    assert load_config(str(path))["session_gap_minutes"] == 15 and load_config(None)["ignore_apps"] == []


def test_ingest_stream(spark, tmp_path):
    rows = [{"user_id": 1, "timestamp": NOW + i, "capture_id": i, "app_name": a, "window_title": "t", "text": t, "extra_context": "ssn 123-45-6789", "phash": "0" * 16} for i, (a, t) in enumerate([("Notes", "Nhat 7s th7s"), ("notes lock", "x"), ("Notes", "  "), ("Notes", "Password: abc")])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    store = MemoryStore(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema(pipeline.KEPT).json(str(tmp_path / "in"))
    pipeline.ingest(stream, store, lambda: {"ignore_apps": ["Notes Lock"]}, str(tmp_path / "c")).awaitTermination()
    got = store.frames().orderBy("id").collect()
    assert [r.text for r in got] == ["What is this", "[REDACTED:password_field]"] and got[0].extra_context == "ssn [REDACTED:ssn]"
