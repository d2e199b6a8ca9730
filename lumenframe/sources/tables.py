"""Readers of the stored tables and of the one-row configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.functions.runtime import read_table

DEFAULT_GAP_MINUTES = 15


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "frames")


def session_gap_seconds(spark: SparkSession, sf_dir: str) -> float:
    """The gap of the one-row ``config`` table in seconds; 15 minutes where the table is empty or the value null."""
    row = read_table(spark, sf_dir, "config").select("session_gap_minutes").head()
    minutes = DEFAULT_GAP_MINUTES if row is None or row[0] is None else row[0]
    return 60.0 * minutes
