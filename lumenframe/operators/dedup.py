"""Repeated captures of an unchanged screen, and change detection by perceptual hashes."""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.ordered import in_cells, with_previous, with_running_sum
from lumenframe.functions.runtime import shuffle_partitions

WINDOW_SECONDS = 60.0
CHANGE_BITS = 6
_HEX = re.compile("[0-9a-fA-F]{16}")


def duplicate_ids(frames: DataFrame, after: float | None = None, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """``id`` of frames to drop: same user, application and hash as the last kept row, less than a window later.

    A dropped row doesn't move the comparison. Null and '' hashes are unknown and take no part; a row of another
    application or hash between two rows ends the comparison. A gap of a whole window always starts anew, so the
    ordered fold runs only over unbroken stretches of one unchanged screen, row by row: a stretch of any length takes no
    more memory than one row.
    """
    rows = frames.where((F.col("phash") != "") & (F.col("timestamp") > F.lit(after) if after is not None else F.lit(True)))
    rows = with_previous(in_cells(rows.select("user_id", "timestamp", "id", "app_name", "phash")), ["app_name", "phash", "timestamp"])
    before = F.col("previous")
    begins = (
        before.isNull()
        | ~before["app_name"].eqNullSafe(F.col("app_name"))
        | (before["phash"] != F.col("phash"))
        | (F.col("timestamp") - before["timestamp"] >= F.lit(window_seconds))
    )
    rows = with_running_sum(rows, begins, "stretch").select("user_id", "stretch", F.col("timestamp").alias("t"), F.col("id").alias("i"))
    ordered = rows.repartition(shuffle_partitions(frames.sparkSession), "user_id", "stretch").sortWithinPartitions("user_id", "stretch", "t", "i")
    return ordered.mapInArrow(partial(_after_anchors, window=float(window_seconds)), "id long")


def _after_anchors(batches, window: float):
    """Rows of a stretch that come less than ``window`` after its last kept row. Only that row's time is held."""
    anchor, last = None, None
    for batch in batches:
        users, stretches, times, ids = (c.to_pylist() for c in batch.columns)
        dropped = []
        for user, stretch, t, i in zip(users, stretches, times, ids):
            if (user, stretch) == last and t - anchor < window:
                dropped.append(i)
            else:
                anchor, last = t, (user, stretch)
        yield pa.RecordBatch.from_arrays([pa.array(dropped, pa.int64())], names=["id"])


def deduplicate(frames: DataFrame, **options) -> DataFrame:
    return frames.join(duplicate_ids(frames, **options), "id", "left_anti")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; null if either is null, empty or malformed."""

    def half(x: Column, start: int) -> Column:
        return F.conv(F.substring(x, start, 8), 16, 10).cast("long")

    valid = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = sum((F.bit_count(half(a, s).bitwiseXOR(half(b, s))) for s in (1, 9)), F.lit(0))
    return F.when(valid, bits.cast("int"))


def has_changed(current: Column, previous: Column, threshold: int = CHANGE_BITS) -> Column:
    """True if either hash is unknown or malformed or at least ``threshold`` bits differ."""
    return F.coalesce(hamming(current, previous) >= threshold, F.lit(True))


def hash_steps(frames: DataFrame) -> DataFrame:
    """``id, previous_id, bits``: each frame against the user's frame before it."""
    rows = with_previous(in_cells(frames.select("user_id", "timestamp", "id", "phash")), ["id", "phash"])
    return rows.select("id", F.col("previous.id").alias("previous_id"), hamming(F.col("phash"), F.col("previous.phash")).alias("bits"))


def changed_frames(frames: DataFrame, threshold: int = CHANGE_BITS) -> DataFrame:
    """``id, changed``: each frame against the hash of the user's last changed one, in the order (timestamp, id).

    A user's first frame is changed, and so is one whose hash or whose predecessor's is malformed. A null or '' hash is
    unknown: it is always a change and leaves the hash that is compared with. A frame with the well-formed hash of the
    frame right before it can't be a change, so an unchanging screen is settled where it lies; what is left is folded per
    user in order, holding one hash.
    """
    rows = with_previous(in_cells(frames.select("user_id", "timestamp", "id", "phash")), ["phash"])
    low = F.lower("phash")
    same = F.coalesce(low.rlike("^[0-9a-f]{16}$") & (low == F.lower("previous.phash")), F.lit(False)) & F.lit(threshold > 0)
    rows = rows.select("user_id", "timestamp", "id", "phash", same.alias("same"))
    left = rows.where(~F.col("same")).drop("same").repartition(shuffle_partitions(frames.sparkSession), "user_id")
    folded = left.sortWithinPartitions("user_id", "timestamp", "id").mapInArrow(partial(_fold_changes, threshold=threshold), "id long, changed boolean")
    return folded.unionByName(rows.where("same").select("id", F.lit(False).alias("changed")))


def bits_between(a: str | None, b: str | None) -> int | None:
    """Differing bits of two hashes of 16 hex digits; None if one isn't such a hash."""
    if not a or not b or not (_HEX.fullmatch(a) and _HEX.fullmatch(b)):
        return None
    return (int(a, 16) ^ int(b, 16)).bit_count()


def _fold_changes(batches, threshold: int):
    known, last = None, object()
    for batch in batches:
        users, _, ids, hashes = (c.to_pylist() for c in batch.columns)
        flags = []
        for user, phash in zip(users, hashes):
            if user != last:
                known, last = None, user
            bits = bits_between(phash, known)
            flags.append(bits is None or bits >= threshold)
            if flags[-1] and phash:
                known = phash
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flags, pa.bool_())], names=["id", "changed"])
