"""Queries of problem 5."""

from pyspark.sql import functions as F

from lumenframe.functions.runtime import read_table
from lumenframe.llm.boilerplate import boilerplate_blocks, repeated_lines, without_repeated_lines


def p5_found(spark, sf_dir):
    return repeated_lines(read_table(spark, sf_dir, "frames"))


def p5_blocks(spark, sf_dir):
    blocks, _ = boilerplate_blocks(read_table(spark, sf_dir, "frames"))
    return blocks.select(F.col("s").alias("app_name"), "line", "texts", "block")


def p5_clean(spark, sf_dir):
    return without_repeated_lines(read_table(spark, sf_dir, "frames"))


QUERIES = {"p5_found": p5_found, "p5_blocks": p5_blocks, "p5_clean": p5_clean}

_SQL = r"""
WITH x AS (SELECT id, app_name, text, unnest(string_split(text, chr(10))) AS raw,
                  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
           FROM frames WHERE app_name <> ''),
y AS (SELECT id, app_name, line_no, raw,
             trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+', '', 'g'), '\s+', ' ', 'g')) AS line FROM x),
z AS (SELECT * FROM y WHERE regexp_matches(line, '^\P{L}*\p{L}+\P{L}+\p{L}+\P{L}+\p{L}')),
t AS (SELECT app_name, count(*) AS total FROM frames WHERE app_name <> '' GROUP BY 1),
n AS (SELECT app_name, line, count(DISTINCT id) AS texts FROM z GROUP BY 1, 2),
f AS (SELECT n.app_name, n.line, n.texts FROM n JOIN t USING (app_name) WHERE texts >= 10 AND texts >= 0.02 * total),
o AS (SELECT z.id, z.line_no FROM z JOIN f USING (app_name, line))
"""

SQL = {
    "p5_found": _SQL + "SELECT id, line_no FROM o",
    "p5_clean": _SQL
    + """, d AS (SELECT id, list(line_no) AS gone FROM o GROUP BY id)
    SELECT id, array_to_string([s[i] FOR i IN range(1, len(s) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], chr(10)) AS text,
           coalesce(len(gone), 0) AS removed
    FROM (SELECT frames.id, string_split(text, chr(10)) AS s, gone FROM frames LEFT JOIN d USING (id))""",
}
