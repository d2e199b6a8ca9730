"""Filters, top-k reports and statistics over stored frames. ``now`` is always explicit (epoch seconds).

Order is newest first with the larger id first among equal times. Null times never pass a time filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = ["id", "timestamp", "app_name", "window_title", "text", "extra_context", "project"]
UNTAGGED = "(untagged)"
UNAVAILABLE = "[OCR unavailable"


def entries(frames: DataFrame) -> DataFrame:
    """The seven columns of a result row, nulls of the optional ones as ''."""
    optional = [F.coalesce(c, F.lit("")).alias(c) for c in ENTRY[2:]]
    return frames.select("id", "timestamp", *optional)


def newest(frames: DataFrame, limit: int) -> DataFrame:
    return frames.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def recent(frames: DataFrame, now: float, minutes: float = 30, limit: int = 50) -> DataFrame:
    """Frames strictly later than ``now - minutes``."""
    return entries(newest(frames.where(F.col("timestamp") > F.lit(now - 60.0 * minutes)), limit))


def latest(frames: DataFrame) -> DataFrame:
    return entries(newest(frames, 1))


def time_range(frames: DataFrame, start: float, end: float, limit: int = 100) -> DataFrame:
    """Frames from ``start`` to ``end``, both included."""
    return entries(newest(frames.where(F.col("timestamp").between(F.lit(start), F.lit(end))), limit))


def search_by_app(frames: DataFrame, app: str, now: float, minutes: float = 60, limit: int = 20) -> DataFrame:
    """Frames whose application contains ``app`` in any case; % and _ in ``app`` are wildcards."""
    return entries(newest(frames.where((F.col("timestamp") > F.lit(now - 60.0 * minutes)) & F.col("app_name").ilike(f"%{app}%")), limit))


def without_ignored(frames: DataFrame, ignored: list[str]) -> DataFrame:
    """Frames of applications that aren't ignored (exact names in any case); null and '' are never ignored."""
    names = [name.lower() for name in ignored if name]
    return frames.where(~F.lower(F.coalesce("app_name", F.lit(""))).isin(names)) if names else frames


def with_text(frames: DataFrame) -> DataFrame:
    """Frames with something other than blanks, without the notice that no recogniser was installed."""
    return frames.where((F.regexp_replace("text", r"(?U)\s+", "") != "") & ~F.col("text").startswith(UNAVAILABLE))


def of_project(frames: DataFrame, project: str) -> DataFrame:
    return frames.where(F.lower(F.coalesce("project", F.lit(""))).contains(project.lower()))


def store_stats(frames: DataFrame) -> DataFrame:
    """One row: number of frames, first and last time (null for an empty table)."""
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def _shares(counts: DataFrame, interval: float) -> list[Column]:
    """Estimated minutes and percent; the total is one aggregate over the small table of counts."""
    return [
        F.round(F.col("frames") * F.lit(float(interval)) / 60, 1).alias("estimated_minutes"),
        F.round(F.col("frames") / F.col("total") * 100, 1).alias("percent"),
    ]


def _with_total(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("frames").alias("total"))
    return counts.join(F.broadcast(total))  # one row


def focus_stats(frames: DataFrame, now: float, minutes: float = 60, interval: float = 10) -> DataFrame:
    """``app_name, frames, estimated_minutes, percent, rank``: most frames first, ties by first appearance."""
    window = frames.where(F.col("timestamp") > F.lit(now - 60.0 * minutes))
    counts = window.groupBy("app_name").agg(F.count(F.lit(1)).alias("frames"), F.min(F.struct("timestamp", "id")).alias("first"))
    counts = _with_total(counts)
    shares = counts.select("app_name", "frames", *_shares(counts, interval), "first")
    return shares.orderBy(F.desc("frames"), "first").drop("first")


def project_stats(frames: DataFrame, now: float, minutes: float = 60, interval: float = 10) -> DataFrame:
    """``project, frames, estimated_minutes, percent``; null and '' are one group, (untagged)."""
    window = frames.where(F.col("timestamp") > F.lit(now - 60.0 * minutes))
    name = F.when(F.coalesce("project", F.lit("")) == "", UNTAGGED).otherwise(F.col("project"))
    counts = _with_total(window.groupBy(name.alias("project")).agg(F.count(F.lit(1)).alias("frames")))
    return counts.select("project", "frames", *_shares(counts, interval)).orderBy(F.desc("frames"), "project")


def entry_lines(found: DataFrame) -> DataFrame:
    """``id, line``: one printed line for each result row."""
    app = F.when(F.coalesce("app_name", F.lit("")) == "", "?").otherwise(F.col("app_name"))
    head = F.date_format(F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long")), "'['yyyy-MM-dd HH:mm']'")
    title = F.when(F.coalesce("window_title", F.lit("")) != "", F.concat(F.lit(" — "), "window_title")).otherwise("")
    body = F.substring(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 1, 240)
    return found.select("id", F.concat(head, F.lit("  "), app, title, F.lit("\n    "), body).alias("line"))
