"""Maintenance, encryption, times in words, profile tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.functions import crypto
from lumenframe.functions.runtime import ensure_checkpoint_dir, read_table
from lumenframe.functions.timeparse import parse_natural_time
from lumenframe.functions.redact import PATTERNS
from lumenframe.operators import frames as R
from lumenframe.operators import maintain as M
from lumenframe.plans.frame_queries import CHANGES, DEDUP
from lumenframe.plans.text_queries import fts_sql, hits, repaired_sql
from lumenframe.sources.store import MemoryStore
from lumenframe.sources.tables import session_gap_seconds
from lumenframe.streaming import pipeline

KEY = "a key for tests only"


def _frames(spark, sf_dir):
    return read_table(spark, sf_dir, "frames")


def _now(spark, sf_dir):
    return (_frames(spark, sf_dir).agg(F.max("timestamp")).head()[0] or 0.0) + 1.0


def compress_old(spark, sf_dir):
    return M.compress_old(_frames(spark, sf_dir), _now(spark, sf_dir)).select("id", "text")


def compress_report(spark, sf_dir):
    return M.compress_report(_frames(spark, sf_dir), _now(spark, sf_dir))


def prune(spark, sf_dir):
    return M.prune(_frames(spark, sf_dir), _now(spark, sf_dir)).select("id")


def auto_maintain(spark, sf_dir):
    out = M.auto_maintain(_frames(spark, sf_dir), _now(spark, sf_dir), too_large=True)
    return out.select("id", F.char_length("text").alias("characters"))


def encrypt_roundtrip(spark, sf_dir):
    sealed = crypto.encrypt_fields(_frames(spark, sf_dir).where(~F.col("text").startswith(crypto.PREFIX)), KEY)
    return crypto.decrypt_fields(sealed, KEY).select("id", "text", "window_title", "extra_context")


def encrypted_rows(spark, sf_dir):
    return _frames(spark, sf_dir).where(crypto.is_encrypted(F.col("text"))).select("id")


def natural_time_range(spark, sf_dir):
    start, end = parse_natural_time("last 2 days", _now(spark, sf_dir))
    return R.time_range(_frames(spark, sf_dir), start, end, 200).select("id", "timestamp")


def _stream(spark, sf_dir):
    """The captures as a stream of files."""
    batch = read_table(spark, sf_dir, "captured")
    path = f"{sf_dir}/captured.parquet"
    reader = spark.readStream.schema(batch.schema)
    if path.startswith("/") or "://" in path:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
        if not folder:
            return reader.option("pathGlobFilter", "captured.parquet").parquet(sf_dir)
    return reader.parquet(path)


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _run(spark, stream):
    """Runs a stream to the end of what is there now, into the shared folder, and reads the result."""
    root = _folder(spark)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _run_complete(spark, stream):
    """As _run for aggregates that keep their whole result as state: the last micro-batch's result."""
    root, last = _folder(spark), []

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/{batch_id}")
        last.append(batch_id)

    writer = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def stream_prepared(spark, sf_dir):
    """Ignore list, blank texts, repair and redaction on the stream."""
    row = read_table(spark, sf_dir, "config").head()
    config = row.asDict(recursive=True) if row else {}
    return _run(spark, pipeline.prepare(_stream(spark, sf_dir), config).select("capture_id", "text", "window_title"))


def stream_focus(spark, sf_dir):
    found = _run_complete(spark, pipeline.focus_by_window(pipeline.with_event_time(_stream(spark, sf_dir))))
    return found.withColumn("window_start", F.unix_seconds("window_start"))


def session_window_native(spark, sf_dir):
    """Sessions of stored frames by the engine's own session window, as the streams use it."""
    stamped = F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long"))
    return pipeline.sessions(_frames(spark, sf_dir).withColumn("ts", stamped), session_gap_seconds(spark, sf_dir))


def stream_sessions(spark, sf_dir):
    gap = session_gap_seconds(spark, sf_dir)
    return _run_complete(spark, pipeline.sessions(pipeline.with_event_time(_stream(spark, sf_dir)), gap))


def stream_once(spark, sf_dir):
    """Captures delivered twice come out once."""
    return _run(spark, pipeline.once(_stream(spark, sf_dir), "3650 days").select("capture_id", "user_id"))


def stream_changed(spark, sf_dir):
    return _run(spark, pipeline.changed_only(_stream(spark, sf_dir)).select("capture_id", "user_id", "phash"))


def stream_unrepeated(spark, sf_dir):
    return _run(spark, pipeline.unrepeated(_stream(spark, sf_dir)).select("capture_id", "user_id", "timestamp"))


def _store(spark) -> MemoryStore:
    return MemoryStore(spark, f"{_folder(spark)}/store")


def store_roundtrip(spark, sf_dir):
    """Frames added to a store in two batches, one of them tried twice, and read again for one day."""
    store, frames = _store(spark), _frames(spark, sf_dir).withColumn("extra_context", F.col("id").cast("string"))
    for batch in (0, 1, 1):
        store.append(frames.where(F.col("id") % 2 == batch), "batches", batch)
    now = _now(spark, sf_dir)
    return store.frames(now - M.DAY, now).select(F.col("extra_context").cast("long").alias("frame"), "timestamp", "app_name")


def store_maintained(spark, sf_dir):
    """A store after cutting, dropping repeats and pruning; the days that are gone are deleted."""
    store, now = _store(spark), _now(spark, sf_dir)
    store.append(_frames(spark, sf_dir).withColumn("extra_context", F.col("id").cast("string")))
    store.auto_maintain(now, max_mb=0)
    store.vacuum()
    return store.frames().select(F.col("extra_context").cast("long").alias("frame"), F.char_length("text").cast("long").alias("characters"))


def store_search(spark, sf_dir):
    """Ranks by the store's index of postings."""
    store = _store(spark)
    store.append(_frames(spark, sf_dir).withColumn("project", F.col("id").cast("string")))
    found = store.search_index().matching("lighthouse OR telescopes")
    return found.join(store.frames(), "id").select(F.col("project").cast("long").alias("frame"), F.round("rank", 6).alias("rank"))


QUERIES = {
    "store_roundtrip": store_roundtrip,
    "store_maintained": store_maintained,
    "store_search": store_search,
    "stream_unrepeated": stream_unrepeated,
    "compress_old": compress_old,
    "compress_report": compress_report,
    "prune": prune,
    "auto_maintain": auto_maintain,
    "encrypt_roundtrip": encrypt_roundtrip,
    "encrypted_rows": encrypted_rows,
    "natural_time_range": natural_time_range,
    "latest_insights": lambda spark, d: M.latest_insights(read_table(spark, d, "user_insights")),
    "mood_by_state": lambda spark, d: M.mood_by_state(read_table(spark, d, "mood_energy_log")),
    "session_window_native": session_window_native,
    "stream_prepared": stream_prepared,
    "stream_focus": stream_focus,
    "stream_sessions": stream_sessions,
    "stream_once": stream_once,
    "stream_changed": stream_changed,
}

_N = '(SELECT max("timestamp") + 1 FROM frames)'

_BY_GAP = """WITH r AS (SELECT user_id, "timestamp" AS t, "timestamp" - lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp") AS d FROM {table}),
    s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > (SELECT max(session_gap_minutes) * 60 FROM config) THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM r)
    SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS frame_count FROM s GROUP BY user_id, n"""

_CUT = """CASE WHEN "timestamp" < {n} - 3 * 86400 AND len(text) > 500 AND NOT starts_with(text, 'ENC:') THEN substring(text, 1, 500) ELSE text END""".replace("{n}", _N)
#: Repeats of the last day by recursion, then cut texts without them and without what is older than 7 days.
_MAINTAINED = DEDUP.replace("WHERE phash <> ''", f"""WHERE phash <> '' AND "timestamp" > {_N} - 86400""") + f""", kept AS (
    SELECT id, len({_CUT})::{{kind}} AS characters FROM frames WHERE id NOT IN (SELECT id FROM f WHERE dropped) AND coalesce("timestamp" >= {_N} - 7 * 86400, true))"""
_UNREPEATED = DEDUP.replace(", id,", ", capture_id AS id,", 1).replace('"timestamp", id)', '"timestamp", capture_id)').replace("FROM frames", "FROM captured")


def _prepared_sql() -> str:
    """The stream's steps over plain text: ignore list, blanks, words, contextual repairs, secrets, the settings' own patterns."""
    own = "(SELECT '(?i)' || privacy_patterns['desk_code'][1] FROM config)"

    def redacted(column: str) -> str:
        for name, pattern in PATTERNS:
            column = f"""regexp_replace({column}, '{pattern.replace("'", "''")}', '[REDACTED:{name}]', 'g')"""
        return f"regexp_replace({column}, {own}, '[REDACTED:desk_code]', 'g')"

    kept = """c AS (SELECT row_number() OVER () AS n, capture_id, text, window_title FROM captured
        WHERE lower(coalesce(app_name, '')) NOT IN (SELECT lower(unnest(ignore_apps)) FROM config)
        AND regexp_replace(text, '\\s+', '', 'g') <> '' AND NOT starts_with(text, '[OCR unavailable'))"""
    return f"WITH {kept}" + repaired_sql("c", "text", "n", True) + f" SELECT c.capture_id, {redacted('done.x')} AS text, {redacted('c.window_title')} AS window_title FROM done JOIN c USING (n)"


SQL = {
    "store_roundtrip": f"""SELECT id AS frame, "timestamp", coalesce(app_name, '') AS app_name FROM frames WHERE "timestamp" BETWEEN {_N} - 86400 AND {_N}""",
    "store_maintained": _MAINTAINED.replace("{kind}", "BIGINT") + " SELECT id AS frame, characters FROM kept",
    "store_search": f"SELECT id AS frame, rank FROM ({fts_sql([hits("x = 'lighthouse'"), hits("regexp_matches(x, '^telescop(?:e|es|ed|ing)$')")], 'h0 > 0 OR h1 > 0')})",
    "auto_maintain": _MAINTAINED.replace("{kind}", "INT") + " SELECT id, characters FROM kept",
    "stream_prepared": _prepared_sql(),
    "stream_changed": CHANGES.replace("{rows}", 'SELECT user_id, capture_id AS id, "timestamp" AS t, phash FROM captured')
    + "SELECT o.id AS capture_id, o.user_id, o.phash FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n WHERE f.changed",
    "stream_unrepeated": _UNREPEATED
    + """ SELECT id AS capture_id, f.user_id, o.t AS "timestamp" FROM f JOIN o USING (user_id, n, id) WHERE NOT dropped
    UNION ALL SELECT capture_id, user_id, "timestamp" FROM captured WHERE coalesce(phash, '') = ''""",
    "compress_old": f"""SELECT id, CASE WHEN "timestamp" < {_N} - 3 * 86400 AND len(text) > 500 AND NOT starts_with(text, 'ENC:') THEN substring(text, 1, 500) ELSE text END AS text FROM frames""",
    "compress_report": f"""SELECT count(*) AS compressed, coalesce(sum(len(text) - 500), 0)::BIGINT AS characters_saved FROM frames
        WHERE "timestamp" < {_N} - 3 * 86400 AND len(text) > 500 AND NOT starts_with(text, 'ENC:')""",
    "prune": f'SELECT id FROM frames WHERE "timestamp" >= {_N} - 7 * 86400',
    "encrypt_roundtrip": "SELECT id, text, window_title, extra_context FROM frames WHERE NOT starts_with(text, 'ENC:')",
    "encrypted_rows": "SELECT id FROM frames WHERE starts_with(text, 'ENC:')",
    "natural_time_range": f'SELECT id, "timestamp" FROM frames WHERE "timestamp" BETWEEN {_N} - 2 * 86400 AND {_N} ORDER BY "timestamp" DESC, id DESC LIMIT 200',
    "latest_insights": """SELECT lower(trim(category)) AS category, key, r.id AS id, r.value AS value, r.confidence AS confidence, r.sample_count AS sample_count,
        r.first_seen AS first_seen, r.last_updated AS last_updated FROM (SELECT category, key, user_insights AS r,
        row_number() OVER (PARTITION BY lower(trim(category)), key ORDER BY coalesce(last_updated, '-inf'::DOUBLE) DESC, id DESC) AS n FROM user_insights) WHERE n = 1""",
    "mood_by_state": """SELECT mood_state, count(*) AS entries, round(avg(level), 6) AS mean_level FROM (SELECT DISTINCT "timestamp",
        CASE WHEN energy_level BETWEEN 0 AND 1 THEN energy_level END AS level, lower(trim(coalesce(mood_state, ''))) AS mood_state, source, context_json FROM mood_energy_log) GROUP BY 1""",
    "stream_focus": """SELECT user_id, app_name, (floor("timestamp" / 600) * 600)::BIGINT AS window_start,
        count(*) AS frames FROM captured GROUP BY ALL""",
    "session_window_native": _BY_GAP.replace("{table}", "frames"),
    "stream_sessions": _BY_GAP.replace("{table}", "captured"),
    "stream_once": "SELECT DISTINCT capture_id, user_id FROM captured",
}
