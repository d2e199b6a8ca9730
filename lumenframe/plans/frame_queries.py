"""Filters, statistics and activity over stored frames."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from lumenframe.functions.runtime import read_table
from lumenframe.operators import activity as A
from lumenframe.operators import dedup as D
from lumenframe.operators import frames as R
from lumenframe.sources.tables import session_gap_seconds


def _frames(spark, sf_dir):
    return read_table(spark, sf_dir, "frames")


def _now(spark, sf_dir) -> float:
    """The clock of the tests: one second after the newest frame. One row."""
    return (_frames(spark, sf_dir).agg(F.max("timestamp")).head()[0] or 0.0) + 1.0


def _at_now(operator, spark, sf_dir, **options):
    return operator(_frames(spark, sf_dir), now=_now(spark, sf_dir), **options)


def time_range(spark, sf_dir):
    now = _now(spark, sf_dir)
    return R.time_range(_frames(spark, sf_dir), now - 86400.0, now - 3600.0)


def ignore_apps(spark, sf_dir):
    row = read_table(spark, sf_dir, "config").select("ignore_apps").head()
    return R.without_ignored(_frames(spark, sf_dir), [*(row[0] or []), "Gridwell"]).select("id", "app_name")


QUERIES = {
    "recent": partial(_at_now, R.recent, minutes=720),
    "latest": lambda spark, d: R.latest(_frames(spark, d)),
    "time_range": time_range,
    "search_by_app": partial(_at_now, R.search_by_app, app="kestrel", minutes=1440),
    "ignore_apps": ignore_apps,
    "text_frames": lambda spark, d: R.with_text(_frames(spark, d)).select("id"),
    "project_frames": lambda spark, d: R.of_project(_frames(spark, d), "AN").select("id", "project"),
    "entry_lines": lambda spark, d: R.entry_lines(R.entries(_frames(spark, d))),
    "store_stats": lambda spark, d: R.store_stats(_frames(spark, d)),
    "focus_stats": partial(_at_now, R.focus_stats, minutes=1440),
    "project_stats": partial(_at_now, R.project_stats, minutes=1440),
    "context_switches": lambda spark, d: A.context_switches(_frames(spark, d)),
    "sessions": lambda spark, d: A.session_report(_frames(spark, d), session_gap_seconds(spark, d)),
    "session_top_app": lambda spark, d: A.session_report(_frames(spark, d), session_gap_seconds(spark, d)).select("user_id", "start", "top_app"),
    "app_segments": lambda spark, d: A.app_segments(_frames(spark, d)),
    "segment_samples": lambda spark, d: A.segment_samples(_frames(spark, d)),
    "activity_lines": partial(_at_now, A.activity_lines, minutes=1440),
    "focus_lines": partial(_at_now, A.focus_lines, minutes=1440),
    "dedup_removed": lambda spark, d: D.duplicate_ids(_frames(spark, d)),
    "dedup_kept": lambda spark, d: D.deduplicate(_frames(spark, d)).select("id"),
    "phash_hamming": lambda spark, d: D.hash_steps(_frames(spark, d)),
    "phash_changed": lambda spark, d: D.changed_frames(_frames(spark, d)),
}

_N = '(SELECT max("timestamp") + 1 FROM frames)'
_E = """id, "timestamp", coalesce(app_name, '') AS app_name, coalesce(window_title, '') AS window_title, coalesce(text, '') AS text,
coalesce(extra_context, '') AS extra_context, coalesce(project, '') AS project"""
_ROUND = "round(frames * 10.0 / 60, 1) AS estimated_minutes, round(frames * 100.0 / sum(frames) OVER (), 1) AS percent"
_SESSIONS = """
WITH r AS (SELECT user_id, id, "timestamp" AS t, coalesce(app_name, '') AS app, "timestamp" - lag("timestamp") OVER w AS d
      FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", id)),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS session FROM r),
a AS (SELECT user_id, session, app, count(*) AS n, min({'t': t, 'i': id}) AS f, max(t) AS l FROM s GROUP BY ALL),
g AS (SELECT user_id, session, min(f).t AS start, max(l) AS "end", sum(n)::BIGINT AS frame_count,
      list(app ORDER BY f) AS apps, list({'app': app, 'n': n} ORDER BY n DESC, f) AS top FROM a GROUP BY ALL),
m AS (SELECT *, greatest(("end" - start) / 60, 0.5) AS minutes FROM g)
"""
_SEGMENTS = """
WITH r AS (SELECT user_id, id, "timestamp" AS t, app_name, window_title,
      CASE WHEN row_number() OVER w = 1 OR app_name IS DISTINCT FROM lag(app_name) OVER w THEN 1 ELSE 0 END AS b
      FROM {frames} WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM r),
k AS (SELECT user_id, segment, window_title, min({'t': t, 'i': id}) AS f FROM s WHERE window_title <> '' GROUP BY ALL),
l AS (SELECT user_id, segment, list(window_title ORDER BY f) AS titles FROM k GROUP BY ALL),
g AS (SELECT user_id, segment, app_name, min(t) AS start, max(t) AS last, count(*) AS frame_count FROM s GROUP BY ALL),
o AS (SELECT g.user_id, g.segment, app_name, start, coalesce(lead(start) OVER (PARTITION BY g.user_id ORDER BY g.segment), last) AS "end",
      frame_count, coalesce(titles, []) AS titles FROM g LEFT JOIN l USING (user_id, segment))
"""
_DAY = f'(SELECT * FROM frames WHERE "timestamp" > {_N} - 86400)'
DEDUP = """
WITH RECURSIVE o AS (SELECT user_id, id, "timestamp" AS t, app_name, phash, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", id) AS n
                     FROM frames WHERE phash <> ''),
f AS (SELECT user_id, n, id, t AS anchor, app_name, phash, false AS dropped FROM o WHERE n = 1
      UNION ALL
      SELECT o.user_id, o.n, o.id,
             CASE WHEN o.app_name IS NOT DISTINCT FROM f.app_name AND o.phash = f.phash AND o.t - f.anchor < 60 THEN f.anchor ELSE o.t END,
             o.app_name, o.phash, o.app_name IS NOT DISTINCT FROM f.app_name AND o.phash = f.phash AND o.t - f.anchor < 60
      FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
"""
_HEX = "regexp_full_match({0}, '[0-9a-fA-F]{{16}}')"
_STEPS = f"""
WITH r AS (SELECT id, phash, lag(id) OVER w AS previous_id, lag(phash) OVER w AS p
           FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", id)),
h AS (SELECT id, previous_id, CASE WHEN {_HEX.format("phash")} AND {_HEX.format("p")}
      THEN bit_count(xor(('0x' || phash)::UBIGINT::BIT, ('0x' || p)::UBIGINT::BIT))::INT END AS bits FROM r)
"""

#: Each row of {rows} (user_id, id, t, phash) against the last changed one's hash, step by step.
CHANGES = """
WITH RECURSIVE o AS (SELECT user_id, id, phash, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS n FROM ({rows})),
f AS (SELECT user_id, n, id, true AS changed, nullif(phash, '') AS known FROM o WHERE n = 1
      UNION ALL
      SELECT user_id, n, id, d, CASE WHEN d AND coalesce(phash, '') <> '' THEN phash ELSE known END
      FROM (SELECT o.user_id, o.n, o.id, o.phash, f.known,
                   CASE WHEN regexp_full_match(coalesce(o.phash, ''), '[0-9a-fA-F]{16}') AND regexp_full_match(coalesce(f.known, ''), '[0-9a-fA-F]{16}')
                        THEN bit_count(xor(('0x' || o.phash)::UBIGINT::BIT, ('0x' || f.known)::UBIGINT::BIT)) >= 6 ELSE true END AS d
            FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
"""

SQL = {
    "recent": f'SELECT {_E} FROM frames WHERE "timestamp" > {_N} - 43200 ORDER BY "timestamp" DESC, id DESC LIMIT 50',
    "latest": f'SELECT {_E} FROM frames ORDER BY "timestamp" DESC, id DESC LIMIT 1',
    "time_range": f'SELECT {_E} FROM frames WHERE "timestamp" BETWEEN {_N} - 86400 AND {_N} - 3600 ORDER BY "timestamp" DESC, id DESC LIMIT 100',
    "search_by_app": f"""SELECT {_E} FROM frames WHERE "timestamp" > {_N} - 86400 AND app_name ILIKE '%kestrel%' ORDER BY "timestamp" DESC, id DESC LIMIT 20""",
    "ignore_apps": """SELECT id, app_name FROM frames WHERE lower(coalesce(app_name, '')) <> 'gridwell'
        AND lower(coalesce(app_name, '')) NOT IN (SELECT lower(unnest(ignore_apps)) FROM config)""",
    "text_frames": "SELECT id FROM frames WHERE regexp_replace(text, '\\s+', '', 'g') <> '' AND NOT starts_with(text, '[OCR unavailable')",
    "project_frames": "SELECT id, project FROM frames WHERE lower(project) LIKE '%an%'",
    "entry_lines": """SELECT id, strftime(make_timestamp(("timestamp" * 1000000)::BIGINT), '[%Y-%m-%d %H:%M]') || '  '
        || CASE WHEN coalesce(app_name, '') = '' THEN '?' ELSE app_name END
        || CASE WHEN coalesce(window_title, '') <> '' THEN ' — ' || window_title ELSE '' END || chr(10) || '    '
        || substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS line FROM frames""",
    "store_stats": 'SELECT count(*) AS frames, min("timestamp") AS oldest, max("timestamp") AS newest FROM frames',
    "focus_stats": f"SELECT app_name, frames, {_ROUND} FROM (SELECT app_name, count(*) AS frames FROM {_DAY} GROUP BY 1)",
    "project_stats": f"""SELECT project, frames, {_ROUND} FROM (SELECT CASE WHEN coalesce(project, '') = '' THEN '(untagged)' ELSE project END AS project,
        count(*) AS frames FROM {_DAY} GROUP BY 1)""",
    "context_switches": """SELECT user_id, sum(CASE WHEN coalesce(p, '') <> '' AND p IS DISTINCT FROM app_name THEN 1 ELSE 0 END)::BIGINT AS switches
        FROM (SELECT user_id, app_name, lag(app_name) OVER (PARTITION BY user_id ORDER BY "timestamp", id) AS p FROM frames) GROUP BY 1""",
    "sessions": _SESSIONS
    + """SELECT user_id, start, "end", round(minutes, 1) AS duration_minutes, apps, top[1].app AS top_app, frame_count,
        round(minutes, 0)::INT || 'min — ' || array_to_string([x.app || ' (' || round(x.n / frame_count * 100, 0)::INT || '%)' FOR x IN top[1:3]], ', ') AS summary FROM m""",
    "session_top_app": _SESSIONS + "SELECT user_id, start, top[1].app AS top_app FROM m",
    "app_segments": _SEGMENTS.replace("{frames}", "frames") + "SELECT * FROM o",
    "segment_samples": """WITH r AS (SELECT user_id, id, "timestamp" AS t, substring(regexp_replace(substring(text, 1, 200), '^\\s+|\\s+$', '', 'g'), 1, 150) AS x,
          CASE WHEN row_number() OVER w = 1 OR app_name IS DISTINCT FROM lag(app_name) OVER w THEN 1 ELSE 0 END AS b
          FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", id)),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM r)
        SELECT user_id, segment, arg_max(x, {'t': t, 'i': id}) FILTER (WHERE x <> '') AS sample FROM s GROUP BY ALL""",
    "activity_lines": _SEGMENTS.replace("{frames}", _DAY)
    + """SELECT user_id, segment, '  ' || strftime(make_timestamp((start * 1000000)::BIGINT), '%H:%M') || ' | ' || coalesce(app_name, '') || ' ('
        || round(greatest(("end" - start) / 60, 0.15), 0)::INT || 'min)'
        || CASE WHEN len(titles) > 0 THEN ' — ' || array_to_string(titles[1:2], ', ') ELSE '' END AS line FROM o""",
    "focus_lines": f"""WITH c AS (SELECT user_id, app_name, count(*) AS n, min({{'t': "timestamp", 'i': id}}) AS f FROM {_DAY} GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f)::INT AS rank, sum(n) OVER (PARTITION BY user_id) AS all_n FROM c)
        SELECT user_id, rank, '  ' || coalesce(app_name, '') || ': ~' || round(n * 10.0 / 60, 1) || 'min (' || round(n / all_n * 100, 0)::INT || '%)' AS line
        FROM r WHERE rank <= 5""",
    "dedup_removed": DEDUP + "SELECT id FROM f WHERE dropped",
    "dedup_kept": DEDUP + "SELECT id FROM frames WHERE id NOT IN (SELECT id FROM f WHERE dropped)",
    "phash_hamming": _STEPS + "SELECT id, previous_id, bits FROM h",
    "phash_changed": CHANGES.replace("{rows}", 'SELECT user_id, id, "timestamp" AS t, phash FROM frames') + "SELECT id, changed FROM f",
}
