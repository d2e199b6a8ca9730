"""Queries of problem 1."""

from lumenframe.operators.sessions import build_sessions
from lumenframe.sources.tables import frames, session_gap_seconds


def p1_found(spark, sf_dir):
    out = build_sessions(frames(spark, sf_dir), session_gap_seconds(spark, sf_dir), with_apps=False)
    return out.select("user_id", "first_id", "last_id")


def p1_sessions(spark, sf_dir):
    return build_sessions(frames(spark, sf_dir), session_gap_seconds(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_sessions": p1_sessions}

_ISLANDS = """
WITH g AS (SELECT max(session_gap_minutes) * 60.0 AS gap FROM config),
r AS (SELECT user_id, id, "timestamp" AS t, app_name, "timestamp" - lag("timestamp") OVER w AS d
      FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", id)),
s AS (SELECT user_id, id, t, app_name,
             sum(CASE WHEN d IS NULL OR d > gap THEN 1 ELSE 0 END) OVER
               (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS n
      FROM r, g)
"""

SQL = {
    "p1_found": _ISLANDS
    + """SELECT user_id, arg_min(id, {'t': t, 'i': id}) AS first_id, arg_max(id, {'t': t, 'i': id}) AS last_id
         FROM s GROUP BY user_id, n""",
    "p1_sessions": _ISLANDS
    + """SELECT user_id, arg_min(id, {'t': t, 'i': id}) AS first_id, arg_max(id, {'t': t, 'i': id}) AS last_id,
                min(t) AS start, max(t) AS "end", max(t) - min(t) AS duration_seconds,
                count(*) AS frame_count,
                list_sort(coalesce(list(DISTINCT app_name) FILTER (WHERE app_name <> ''), [])) AS apps
         FROM s GROUP BY user_id, n""",
}
