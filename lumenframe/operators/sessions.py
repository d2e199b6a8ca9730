"""Activity sessions: a user's frames split wherever nothing was captured for longer than a gap.

Built in two steps so that no user, however busy, is handled by one task:

1. frames are placed in (user, time chunk) cells and local sessions are built within each cell;
2. only the first and the last local session of a cell can touch a neighbouring cell, so at most two rows for
   each user and chunk go into the merge of adjacent partial sessions. All others are final.

The size of step 2 depends on the time span covered, not on the number of frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 4 * 3600


def build_sessions(
    frames: DataFrame,
    gap_seconds: float,
    user: str = "user_id",
    chunk_seconds: float = CHUNK_SECONDS,
    with_apps: bool = True,
) -> DataFrame:
    """One row per session: ``user, first_id, last_id, start, end, duration_seconds, frame_count, apps``.

    A gap of exactly ``gap_seconds`` doesn't split. Order within a user is (timestamp, id). Null users form a
    user of their own. Frames whose ``timestamp`` or ``id`` is null (or a NaN time) have no place in time and are
    left out. Repeated rows count as often as they stand. ``apps`` holds the distinct non-empty names in
    alphabetical order. An empty table gives no rows. Only ``user, timestamp, id, app_name`` are read; other
    columns, whatever their names, play no part.
    """
    columns = [F.col(user).alias("u"), F.col("timestamp").cast("double").alias("t"), F.col("id").cast("long").alias("i")]
    if with_apps:
        columns.append(F.col("app_name").alias("a"))
    rows = (
        frames.select(*columns)
        .where(F.col("t").isNotNull() & ~F.isnan("t") & F.col("i").isNotNull())
        .withColumn("c", F.floor(F.col("t") / F.lit(float(chunk_seconds))))
    )
    cell = Window.partitionBy("u", "c")
    ordered = cell.orderBy("t", "i")
    previous = F.lag("t").over(ordered)
    marked = rows.withColumn("n", (previous.isNull() | (F.col("t") - previous > F.lit(float(gap_seconds)))).cast("int"))
    marked = marked.withColumn("n", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    aggregates = [
        F.min(F.struct("t", "i")).alias("f"),
        F.max(F.struct("t", "i")).alias("l"),
        F.count(F.lit(1)).alias("k"),
    ]
    if with_apps:
        aggregates.append(F.collect_set(F.when(F.col("a") != "", F.col("a"))).alias("apps"))
    local = marked.groupBy("u", "c", "n").agg(*aggregates)
    local = local.withColumn("last", F.col("n") == F.max("n").over(cell)).withColumn("border", (F.col("n") == 1) | F.col("last"))

    inner = local.where(~F.col("border"))
    per_user = Window.partitionBy("u").orderBy("f")
    before = F.lag(F.col("l.t")).over(per_user)
    border = local.where("border").withColumn("s", (before.isNull() | (F.col("f.t") - before > F.lit(float(gap_seconds)))).cast("int"))
    border = border.withColumn("s", F.sum("s").over(per_user.rowsBetween(Window.unboundedPreceding, 0)))
    merged = [F.min("f").alias("f"), F.max("l").alias("l"), F.sum("k").alias("k")]
    if with_apps:
        merged.append(F.flatten(F.collect_list("apps")).alias("apps"))
    border = border.groupBy("u", "s").agg(*merged)
    kept = ["u", "f", "l", "k"] + (["apps"] if with_apps else [])
    sessions = inner.select(*kept).unionByName(border.select(*kept))
    out = [
        F.col("u").alias(user),
        F.col("f.i").alias("first_id"),
        F.col("l.i").alias("last_id"),
        F.col("f.t").alias("start"),
        F.col("l.t").alias("end"),
        (F.col("l.t") - F.col("f.t")).alias("duration_seconds"),
        F.col("k").alias("frame_count"),
    ]
    if with_apps:
        out.append(F.array_sort(F.array_distinct("apps")).alias("apps"))
    return sessions.select(*out)
