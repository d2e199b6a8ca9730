"""Ordered computations over a user's rows without ever ordering a whole user in one task.

Rows are placed in (user, time chunk) cells and ordered there. What must pass from one cell to the next (the last row,
a running total) is one row for each cell; only those are ordered per user, and joined back to the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 6 * 3600
USER, TIME, ID, CELL = "user_id", "timestamp", "id", "_cell"


def in_cells(frames: DataFrame, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Adds the time chunk; rows without a time or an id have no place in the order and are left out."""
    placed = frames.where(F.col(TIME).isNotNull() & ~F.isnan(TIME) & F.col(ID).isNotNull())
    return placed.withColumn(CELL, F.floor(F.col(TIME) / F.lit(float(chunk_seconds))))


def _ordered():
    return Window.partitionBy(USER, CELL).orderBy(TIME, ID)


def _joined(rows: DataFrame, cells: DataFrame) -> DataFrame:
    on = rows[USER].eqNullSafe(cells["_u"]) & (rows[CELL] == cells["_c"])
    return rows.join(cells, on, "left").drop("_u", "_c")


def with_previous(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``previous``: a struct of ``columns`` of the user's row before, null for the first."""
    value = F.struct(*columns)
    last = rows.groupBy(F.col(USER).alias("_u"), F.col(CELL).alias("_c")).agg(F.max_by(value, F.struct(TIME, ID)).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy("_u").orderBy("_c"))
    joined = _joined(rows.withColumn("previous", F.lag(value).over(_ordered())), last.select("_u", "_c", before.alias("_before")))
    return joined.withColumn("previous", F.coalesce("previous", "_before")).drop("_before")


def with_running_sum(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the user's rows up to this one."""
    rows = rows.withColumn("_value", value.cast("long"))
    totals = rows.groupBy(F.col(USER).alias("_u"), F.col(CELL).alias("_c")).agg(F.sum("_value").alias("_total"))
    offset = F.sum("_total").over(Window.partitionBy("_u").orderBy("_c")) - F.col("_total")
    local = rows.withColumn(name, F.sum("_value").over(_ordered().rowsBetween(Window.unboundedPreceding, 0)))
    joined = _joined(local, totals.select("_u", "_c", offset.alias("_offset")))
    return joined.withColumn(name, F.col(name) + F.col("_offset")).drop("_offset", "_value")
