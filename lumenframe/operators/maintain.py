"""Ageing, pruning and migrations of stored frames, each one pass from a table to its next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.crypto import FIELDS, decrypt, encrypt, is_encrypted
from lumenframe.operators.dedup import deduplicate

KEPT_CHARACTERS = 500
DAY = 86400.0


def _old_and_long(now: float, days: float, key: str | None):
    text = decrypt(F.col("text"), key) if key else F.col("text")
    sealed = is_encrypted(F.col("text")) if not key else F.lit(False)
    return text, (F.col("timestamp") < F.lit(now - days * DAY)) & (F.char_length(text) > KEPT_CHARACTERS) & ~sealed


def compress_report(frames: DataFrame, now: float, days: float = 3, key: str | None = None) -> DataFrame:
    """One row: frames to cut and characters saved."""
    text, old = _old_and_long(now, days, key)
    saved = F.coalesce(F.sum(F.char_length(text) - KEPT_CHARACTERS), F.lit(0)).cast("long")
    return frames.where(old).agg(F.count(F.lit(1)).alias("compressed"), saved.alias("characters_saved"))


def compress_old(frames: DataFrame, now: float, days: float = 3, key: str | None = None) -> DataFrame:
    """Texts older than ``days`` cut to 500 characters. Ciphertext is cut only with its key, and sealed again."""
    text, old = _old_and_long(now, days, key)
    cut = F.substring(text, 1, KEPT_CHARACTERS)
    sealed = F.when(is_encrypted(F.col("text")), encrypt(cut, key)).otherwise(cut) if key else cut
    return frames.withColumn("text", F.when(old, sealed).otherwise(F.col("text")))


def prune(frames: DataFrame, now: float, days: float = 7) -> DataFrame:
    """Frames not older than ``days``; one exactly that old stays. Frames without a time stay."""
    return frames.where(F.coalesce(F.col("timestamp") >= F.lit(now - days * DAY), F.lit(True)))


def auto_maintain(frames: DataFrame, now: float, too_large: bool = False, compress_days: float = 3, dedup_hours: float = 24, keep_days: float = 7) -> DataFrame:
    """Cut old texts, drop repeated captures of the last hours and, if the store is too large, old frames: one plan."""
    out = deduplicate(compress_old(frames, now, compress_days), after=now - 3600.0 * dedup_hours)
    return prune(out, now, keep_days) if too_large else out


def encrypt_existing(frames: DataFrame, key: str) -> DataFrame:
    """All fields sealed in one pass; sealed, empty and null values stay."""
    return frames.withColumns({c: encrypt(F.col(c), key) for c in FIELDS})


def decrypt_existing(frames: DataFrame, key: str) -> DataFrame:
    return frames.withColumns({c: decrypt(F.col(c), key) for c in FIELDS})


def migration_report(frames: DataFrame) -> DataFrame:
    """One row: frames, and frames with at least one sealed field."""
    sealed = F.lit(False)
    for c in FIELDS:
        sealed = sealed | F.coalesce(is_encrypted(F.col(c)), F.lit(False))
    return frames.agg(F.count(F.lit(1)).alias("total"), F.count_if(sealed).alias("encrypted"))


def latest_insights(insights: DataFrame) -> DataFrame:
    """One row per (category, key): the latest update wins, then the larger id. Category in any case is one category."""
    key = [F.lower(F.trim("category")).alias("category"), "key"]
    rest = [c for c in insights.columns if c not in ("category", "key")]
    newest = F.max_by(F.struct(*rest), F.struct(F.coalesce("last_updated", F.lit(float("-inf"))), "id")).alias("row")
    return insights.groupBy(*key).agg(newest).select("category", "key", "row.*")


def mood_by_state(log: DataFrame) -> DataFrame:
    """Per state of mood (any case): distinct entries and their mean level between 0 and 1; levels outside are no levels."""
    state = F.lower(F.trim(F.coalesce("mood_state", F.lit(""))))
    level = F.when(F.col("energy_level").between(0, 1), F.col("energy_level"))
    once = log.select("timestamp", level.alias("level"), state.alias("mood_state"), "source", "context_json").distinct()
    return once.groupBy("mood_state").agg(F.count(F.lit(1)).alias("entries"), F.round(F.avg("level"), 6).alias("mean_level"))
