"""Queries of problem 3."""

from lumenframe.functions.runtime import read_table
from lumenframe.llm.runs import collapse_runs


def p3_found(spark, sf_dir):
    return collapse_runs(read_table(spark, sf_dir, "frames"), min_count=2).select("user_id", "first_id", "last_id")


def p3_events(spark, sf_dir):
    return collapse_runs(read_table(spark, sf_dir, "frames"))


QUERIES = {"p3_found": p3_found, "p3_events": p3_events}

_SQL = r"""
WITH a AS (SELECT user_id, id, "timestamp" AS t, coalesce(app_name, '') AS app,
                  trim(regexp_replace(lower(coalesce(window_title, '')), '\s+', ' ', 'g')) AS w FROM frames),
b AS (SELECT user_id, id, t, app,
             trim(regexp_replace(regexp_replace(w, '^(?:(?:\(\d+\+?\)|\[\d+\]|[●•∙*])\s*)+', ''),
               '(?:\s*(?:\(\d+\+? (?:unread|new)(?: messages?)?\)|\[\d{1,2}:\d{2}(?::\d{2})?\]|[-–—] ?\d{1,3} ?%|\(\d{1,3} ?%\)|[-–—] (?:edited|modified|unsaved)|\((?:edited|modified|unsaved)\)|[●•∙*]))+$',
               '')) AS title FROM a),
c AS (SELECT *, CASE WHEN lag(app) OVER o = app AND lag(title) OVER o = title THEN 0 ELSE 1 END AS s
      FROM b WINDOW o AS (PARTITION BY user_id ORDER BY t, id)),
d AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS n FROM c)
"""

SQL = {
    "p3_found": _SQL
    + """SELECT user_id, arg_min(id, {'t': t, 'i': id}) AS first_id, arg_max(id, {'t': t, 'i': id}) AS last_id
         FROM d GROUP BY user_id, n HAVING count(*) >= 2""",
    "p3_events": _SQL
    + """SELECT user_id, app AS app_name, title, arg_min(id, {'t': t, 'i': id}) AS first_id,
                arg_max(id, {'t': t, 'i': id}) AS last_id, min(t) AS start, max(t) AS "end",
                max(t) - min(t) AS duration_seconds, count(*) AS frame_count
         FROM d GROUP BY user_id, n, app, title""",
}
