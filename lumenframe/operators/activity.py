"""Activity of each user: context switches, application segments, session reports and narrative lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.ordered import in_cells, with_previous, with_running_sum

_NARROW = ["user_id", "timestamp", "id", "app_name"]


def context_switches(frames: DataFrame) -> DataFrame:
    """``user_id, switches``: changes of application; leaving an empty or null one isn't a switch, entering one is."""
    rows = with_previous(in_cells(frames.select(*_NARROW)), ["app_name"])
    before = F.col("previous.app_name")
    switch = (F.coalesce(before, F.lit("")) != "") & ~before.eqNullSafe(F.col("app_name"))
    return rows.groupBy("user_id").agg(F.sum(switch.cast("long")).alias("switches"))


def session_report(frames: DataFrame, gap_seconds: float = 900.0) -> DataFrame:
    """Sessions with minutes (0.5 at least), applications in order of appearance, the top one and a summary line.

    Ties for the top application go to the one seen first. Null and '' count as an application of that value.
    """
    rows = with_previous(in_cells(frames.select(*_NARROW)), ["timestamp"])
    before = F.col("previous.timestamp")
    rows = with_running_sum(rows, before.isNull() | (F.col("timestamp") - before > F.lit(float(gap_seconds))), "session")
    apps = rows.groupBy("user_id", "session", F.coalesce("app_name", F.lit("")).alias("app")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("timestamp", "id")).alias("first"),
        F.max("timestamp").alias("last"),
    )
    sessions = apps.groupBy("user_id", "session").agg(
        F.min("first").alias("first"),
        F.max("last").alias("end"),
        F.sum("n").alias("frame_count"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "app"))).alias("by_count"),
        F.sort_array(F.collect_list(F.struct("first", "app"))).alias("by_time"),
    )
    minutes = F.greatest((F.col("end") - F.col("first.timestamp")) / 60, F.lit(0.5))
    share = F.transform(
        F.slice("by_count", 1, 3),
        lambda x: F.concat(x["app"], F.lit(" ("), F.round(-x["n"] / F.col("frame_count") * 100, 0).cast("int").cast("string"), F.lit("%)")),
    )
    summary = F.concat(F.round(minutes, 0).cast("int").cast("string"), F.lit("min — "), F.array_join(share, ", "))
    return sessions.select(
        "user_id",
        F.col("first.timestamp").alias("start"),
        "end",
        F.round(minutes, 1).alias("duration_minutes"),
        F.transform("by_time", lambda x: x["app"]).alias("apps"),
        F.element_at("by_count", 1)["app"].alias("top_app"),
        "frame_count",
        summary.alias("summary"),
    )


def _in_segments(frames: DataFrame) -> DataFrame:
    rows = with_previous(in_cells(frames), ["app_name", "timestamp"])
    begins = F.col("previous").isNull() | ~F.col("previous.app_name").eqNullSafe(F.col("app_name"))
    return with_running_sum(rows, begins, "segment")


def segment_samples(frames: DataFrame) -> DataFrame:
    """``user_id, segment, sample``: the start of the last text of each segment that isn't blank; null where all are.

    Of a text the first 200 characters are looked at, and at most 150 of these stay after outer blanks are gone.
    """
    start = F.substring(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 200), r"(?U)^\s+|\s+$", ""), 1, 150)
    rows = _in_segments(frames.select(*_NARROW, start.alias("start")))
    kept = F.when(F.col("start") != "", F.struct("timestamp", "id", "start"))
    return rows.groupBy("user_id", "segment").agg(F.max(kept)["start"].alias("sample"))


def app_segments(frames: DataFrame) -> DataFrame:
    """``user_id, segment, app_name, start, end, frame_count, titles``: stretches of one application.

    A segment ends where the next begins, the last at its last frame. ``titles`` are the distinct non-empty window
    titles in order of first appearance.
    """
    rows = _in_segments(frames.select(*_NARROW, "window_title"))
    titles = rows.groupBy("user_id", "segment", "app_name", F.coalesce("window_title", F.lit("")).alias("title")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("timestamp", "id")).alias("first"), F.max("timestamp").alias("last")
    )
    segments = titles.groupBy("user_id", "segment", "app_name").agg(
        F.min("first.timestamp").alias("start"),
        F.max("last").alias("last"),
        F.sum("n").alias("frame_count"),
        F.sort_array(F.collect_list(F.when(F.col("title") != "", F.struct("first", "title")))).alias("t"),
    )
    # Segments are numbered without gaps, so the next one is found by its number instead of a window per user.
    follow = segments.select(F.col("user_id").alias("u"), (F.col("segment") - 1).alias("s"), F.col("start").alias("next"))
    on = segments["user_id"].eqNullSafe(follow["u"]) & (segments["segment"] == follow["s"])
    return segments.join(follow, on, "left").select(
        "user_id", "segment", "app_name", "start", F.coalesce("next", "last").alias("end"), "frame_count", F.transform("t", lambda x: x["title"]).alias("titles")
    )


def activity_lines(frames: DataFrame, now: float, minutes: float = 60) -> DataFrame:
    """``user_id, segment, line``: one line of narrative for each segment of the last ``minutes``, two titles at most."""
    window = app_segments(frames.where(F.col("timestamp") > F.lit(now - 60.0 * minutes)))
    at = F.date_format(F.timestamp_micros((F.col("start") * 1_000_000).cast("long")), "HH:mm")
    long = F.round(F.greatest((F.col("end") - F.col("start")) / 60, F.lit(0.15)), 0).cast("int").cast("string")
    titles = F.when(F.size("titles") > 0, F.concat(F.lit(" — "), F.array_join(F.slice("titles", 1, 2), ", "))).otherwise("")
    line = F.concat(F.lit("  "), at, F.lit(" | "), F.coalesce("app_name", F.lit("")), F.lit(" ("), long, F.lit("min)"), titles)
    return window.select("user_id", "segment", line.alias("line"))


def focus_lines(frames: DataFrame, now: float, minutes: float = 60, interval: float = 10, top: int = 5) -> DataFrame:
    """``user_id, rank, line``: the most used applications of each user in the last ``minutes``."""
    window = frames.where(F.col("timestamp") > F.lit(now - 60.0 * minutes))
    counts = window.groupBy("user_id", "app_name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("timestamp", "id")).alias("first"))
    user = Window.partitionBy("user_id")  # one row for each application of a user
    ranked = counts.withColumn("rank", F.row_number().over(user.orderBy(F.desc("n"), "first"))).withColumn("all", F.sum("n").over(user))
    estimate = F.round(F.col("n") * F.lit(float(interval)) / 60, 1).cast("string")
    percent = F.round(F.col("n") / F.col("all") * 100, 0).cast("int").cast("string")
    line = F.concat(F.lit("  "), F.coalesce("app_name", F.lit("")), F.lit(": ~"), estimate, F.lit("min ("), percent, F.lit("%)"))
    return ranked.where(F.col("rank") <= top).select("user_id", "rank", line.alias("line"))
