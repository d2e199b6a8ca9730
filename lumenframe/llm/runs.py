"""Runs of the same event in ordered sequences, found by a regular expression over symbol strings.

Every frame becomes one symbol: a Unicode code point that stands for its canonical event (application and window
title without passing decoration). Frames of one user and time chunk are concatenated to a string in which the
back-reference ``(.)\\1*`` matches each longest repetition; spans of the match are positions of frames. Symbols are
given out per Arrow batch, so there are never more of them than rows in a batch and no dictionary of all titles
exists anywhere. Runs at the two ends of a chunk are joined with those of the neighbouring chunk afterwards; only
these border runs are ordered per user, so a busy user is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.runtime import shuffle_partitions

CHUNK_SECONDS = 6 * 3600
MOST_SYMBOLS = 1_000_000

#: What programs add to a title in passing, before and after the document's own title.
PREFIX = r"^(?:(?:\(\d+\+?\)|\[\d+\]|[●•∙*])\s*)+"
SUFFIX = (
    r"(?:\s*(?:\(\d+\+? (?:unread|new)(?: messages?)?\)|\[\d{1,2}:\d{2}(?::\d{2})?\]|[-–—] ?\d{1,3} ?%"
    r"|\(\d{1,3} ?%\)|[-–—] (?:edited|modified|unsaved)|\((?:edited|modified|unsaved)\)|[●•∙*]))+$"
)
REPEAT = re.compile(r"(.)\1*", re.DOTALL)


def canonical_title(title: Column) -> Column:
    """Title without passing counts, progress, marks and times, in lower case with single blanks; null is ''."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, PREFIX, ""), SUFFIX, ""))


def _code_points(codes: np.ndarray) -> str:
    """One character per code; the surrogate range, which no string may hold, is left out."""
    points = codes.astype(np.uint32) + 0x100
    points[points >= 0xD800] += 0x800
    return points.astype("<u4").tobytes().decode("utf-32-le")


def _match_runs(batches, singles: bool):
    # A batch is cut where it would need more symbols than there are code points; runs at the cut are joined like borders.
    for batch in (b.slice(start, MOST_SYMBOLS) for b in batches for start in range(0, b.num_rows, MOST_SYMBOLS)):
        n = batch.num_rows
        t = pa.Table.from_batches([batch])
        code = np.zeros(n, dtype=np.int64)
        for name in ("u", "c", "app", "title"):
            values = t.column(name).combine_chunks().dictionary_encode()
            part = np.asarray(pc.fill_null(values.indices, -1)).astype(np.int64) + 1
            code = np.unique(code * (part.max() + 1) + part, return_inverse=True)[1].astype(np.int64)
        spans = np.array([m.span() for m in REPEAT.finditer(_code_points(code))], dtype=np.int64)
        start, stop = spans[:, 0], spans[:, 1] - 1
        u = np.asarray(pc.fill_null(t.column("u"), -1))
        known = np.asarray(pc.is_valid(t.column("u")))
        c = np.asarray(t.column("c"))
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = (u[1:] != u[:-1]) | (known[1:] != known[:-1]) | (c[1:] != c[:-1])
        border = edge[start] | edge[stop + 1]
        keep = border | (stop > start) | singles
        start, stop, border = start[keep], stop[keep], border[keep]
        a, b = pa.array(start), pa.array(stop)
        yield pa.RecordBatch.from_arrays(
            [
                t.column("u").take(a).combine_chunks(),
                t.column("c").take(a).combine_chunks(),
                pa.array(edge[start]),
                pa.array(border),
                t.column("app").take(a).combine_chunks(),
                t.column("title").take(a).combine_chunks(),
                t.column("i").take(a).combine_chunks(),
                t.column("i").take(b).combine_chunks(),
                t.column("t").take(a).combine_chunks(),
                t.column("t").take(b).combine_chunks(),
                pa.array((stop - start + 1).astype(np.int64)),
            ],
            names=["u", "c", "opens", "border", "app", "title", "i0", "i1", "t0", "t1", "k"],
        )


_RUN = "u long, c long, opens boolean, border boolean, app string, title string, i0 long, i1 long, t0 double, t1 double, k long"


def collapse_runs(frames: DataFrame, min_count: int = 1, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Each longest stretch of one user's consecutive frames with one application and one window, as one event.

    Columns: ``user_id, app_name, title, first_id, last_id, start, end, duration_seconds, frame_count``; ``title`` is
    the canonical one. Order is (timestamp, id); inactivity doesn't end a run. Null and '' are the same value in both
    names; the null user is a user of its own. Frames without ``timestamp`` or ``id`` (or with a NaN time) have no
    place in the order and are left out. Repeated rows stand next to each other and count. Runs of fewer than
    ``min_count`` frames are left out at the end, after runs have been joined across chunks. Other columns of the
    input are not read.
    """
    spark = frames.sparkSession
    rows = (
        frames.select(
            F.col("user_id").cast("long").alias("u"),
            F.col("timestamp").cast("double").alias("t"),
            F.col("id").cast("long").alias("i"),
            F.coalesce("app_name", F.lit("")).alias("app"),
            canonical_title(F.col("window_title")).alias("title"),
        )
        .where(F.col("t").isNotNull() & ~F.isnan("t") & F.col("i").isNotNull())
        .withColumn("c", F.floor(F.col("t") / F.lit(float(chunk_seconds))))
    )
    ordered = rows.repartition(shuffle_partitions(spark), "u", "c").sortWithinPartitions("u", "c", "t", "i")
    runs = ordered.mapInArrow(partial(_match_runs, singles=min_count <= 1), _RUN)
    # A piece is a chunk or, where an Arrow batch ends within one, a part of it; pieces are in order of (t0, i0).
    inner = runs.where(~F.col("border"))
    w = Window.partitionBy("u").orderBy("t0", "i0", "t1", "i1")
    joined = F.col("opens") & (F.lag("app").over(w) == F.col("app")) & (F.lag("title").over(w) == F.col("title"))
    border = runs.where("border").withColumn("n", F.when(joined, 0).otherwise(1))
    border = border.withColumn("n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    border = border.groupBy("u", "n").agg(
        F.first("app").alias("app"),
        F.first("title").alias("title"),
        F.min(F.struct("t0", "i0")).alias("f"),
        F.max(F.struct("t1", "i1")).alias("l"),
        F.sum("k").alias("k"),
    )
    kept = ["u", "app", "title", "f", "l", "k"]
    inner = inner.withColumn("f", F.struct("t0", "i0")).withColumn("l", F.struct("t1", "i1"))
    return (
        inner.select(*kept)
        .unionByName(border.select(*kept))
        .where(F.col("k") >= min_count)
        .select(
            F.col("u").alias("user_id"),
            F.col("app").alias("app_name"),
            "title",
            F.col("f.i0").alias("first_id"),
            F.col("l.i1").alias("last_id"),
            F.col("f.t0").alias("start"),
            F.col("l.t1").alias("end"),
            (F.col("l.t1") - F.col("f.t0")).alias("duration_seconds"),
            F.col("k").alias("frame_count"),
        )
    )
