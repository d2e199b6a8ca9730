"""Structured Streaming over captures: the same transformations as in batch, windows with watermarks, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.functions.ocr import clean
from lumenframe.functions.redact import redact_columns, redact_text
from lumenframe.operators.dedup import bits_between
from lumenframe.operators.frames import with_text, without_ignored

KEPT = "user_id long, timestamp double, capture_id long, app_name string, window_title string, text string, extra_context string, phash string"


def prepare(captures: DataFrame, config: dict, redact_all: bool = True, redact_first: bool = False) -> DataFrame:
    """Ignore list, blank texts, recognition repair and redaction; works on batches and streams alike.

    Secrets are redacted in titles and contexts too unless ``redact_all`` is off. ``redact_first`` redacts before the
    repair, which could change a secret so that it is no longer recognised.
    """
    extra, disabled = config.get("privacy_patterns"), config.get("privacy_disabled_types")
    out = with_text(without_ignored(captures, config.get("ignore_apps") or []))
    text = clean(redact_text(F.col("text"), extra, disabled)) if redact_first else redact_text(clean(F.col("text")), extra, disabled)
    out = out.withColumn("text", text)
    return redact_columns(out, ("window_title", "extra_context"), extra, disabled) if redact_all else out


def with_event_time(captures: DataFrame, delay: str = "1 hour") -> DataFrame:
    stamped = captures.withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long")))
    return stamped.withWatermark("ts", delay)


def once(captures: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops captures delivered again within the watermark; state ends with it."""
    return with_event_time(captures, delay).dropDuplicatesWithinWatermark(["capture_id"])


def focus_by_window(captures: DataFrame, window: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Captures per user, application and tumbling (or sliding) window of event time."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = captures.groupBy(span.alias("w"), "user_id", "app_name").agg(F.count(F.lit(1)).alias("frames"))
    return counts.select("user_id", "app_name", F.col("w.start").alias("window_start"), "frames")


def sessions(captures: DataFrame, gap_seconds: float) -> DataFrame:
    """Sessions by gap in event time; a gap of exactly the length doesn't split. The end is the last capture's time."""
    micros = int(gap_seconds * 1_000_000) + 1
    grouped = captures.groupBy("user_id", F.session_window("ts", f"{micros} microseconds").alias("w"))
    out = grouped.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("frame_count"))
    return out.select("user_id", "start", "end", "frame_count")


def _keyed(captures: DataFrame, decide, memory: str, idle: str, delay: str = "1 hour") -> DataFrame:
    """Captures of each user that ``decide`` keeps, in order of time across micro-batches.

    ``decide(memory, times, apps, hashes)`` gives the flags of one micro-batch's captures in order and the new memory, whose
    first value is the newest time seen. Captures older than that come too late and are dropped. A task holds one user's
    captures of one micro-batch (bounded by the source's options) and the memory, which ends when event time has gone on
    for ``idle`` without captures of the user.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = [c.split()[0] for c in KEPT.split(", ")]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["timestamp", "capture_id"], kind="stable")
        if before is not None and before[0] is not None:
            rows = rows[~(rows["timestamp"] < before[0])]
        values = (rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in ("timestamp", "app_name", "phash"))
        keep, after = decide(before, *values)
        state.update(after)
        newest = 0 if after[0] is None else int(after[0] * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + pause)
        yield rows.loc[keep, columns]

    stamped = captures if "ts" in captures.columns else with_event_time(captures, delay)
    grouped = stamped.select(*columns, "ts").groupBy("user_id")
    return grouped.applyInPandasWithState(run, KEPT, memory, "append", GroupStateTimeout.EventTimeTimeout)


def _newest(before, times) -> float | None:
    seen = [t for t in times if t is not None] + ([before[0]] if before and before[0] is not None else [])
    return float(max(seen)) if seen else None


def changed_only(captures: DataFrame, threshold: int = 6, idle: str = "7 days") -> DataFrame:
    """Captures whose hash differs from the user's last emitted one; unknown hashes always pass and keep the old one."""

    def decide(before, times, apps, hashes):
        known, keep = before[1] if before else None, []
        for phash in hashes:
            bits = bits_between(phash, known)
            keep.append(bits is None or bits >= threshold)
            known = phash if keep[-1] and phash else known
        return keep, (_newest(before, times), known)

    return _keyed(captures, decide, "newest double, known string", idle)


def unrepeated(captures: DataFrame, window_seconds: float = 60.0, idle: str = "7 days") -> DataFrame:
    """Captures without those that show the application and hash of the user's last kept one less than a window later.

    A dropped capture doesn't move the comparison. Unknown hashes pass and don't end it, as in the batch form.
    """

    def decide(before, times, apps, hashes):
        app, known, anchor = before[1:] if before else (None, None, None)
        keep = []
        for t, a, h in zip(times, apps, hashes):
            drop = bool(h) and t is not None and anchor is not None and (a, h) == (app, known) and t - anchor < window_seconds
            if not drop and h and t is not None:
                app, known, anchor = a, h, t
            keep.append(not drop)
        return keep, (_newest(before, times), app, known, anchor)

    return _keyed(captures, decide, "newest double, app string, known string, anchor double", idle)


def ingest(captures: DataFrame, store, config_loader, checkpoint: str, available_now: bool = True, interval: str = "10 seconds", name: str = "captures", changes_only: bool = False):
    """Appends a stream of captures to a store; the settings are loaded anew for every micro-batch.

    With ``changes_only`` a user's captures of an unchanged screen are left out first. ``name`` tells streams apart:
    the store keeps the last micro-batch of each and adds one that is tried again only once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(prepare(batch, config_loader()), name, batch_id)

    captures = changed_only(captures) if changes_only else captures
    writer = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
