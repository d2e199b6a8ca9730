"""Lines that return far too often within one source, found as blocks of a line graph.

Nodes are (source, normalised line) weighted with the number of texts that hold the line, edges join lines that
follow each other among the frequent ones, weighted with the number of texts in which they do. Nodes and edges of
high support stay; connected components of what stays are the boilerplate blocks, and every occurrence of a line of
a block is an occurrence to delete.

Scale. Lines are first counted by a 64-bit hash (16 bytes a distinct line, combined before the shuffle). Only lines
whose hash is frequent are counted again as strings, so a collision of hashes can't make a line frequent. Frequent
lines are few by definition: a line must stand in a ``min_share`` of its source's texts, so a source has at most
1 / min_share times its mean number of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.runtime import broadcast_if_small, materialize

MIN_TEXTS = 10
MIN_SHARE = 0.02
#: Lines of fewer runs of letters are never boilerplate.
MIN_LETTER_RUNS = 3
#: Largest number of frequent lines that is sent to every executor; more are joined by shuffle.
BROADCAST_LINES = 200_000
_LETTERS = r"^\P{L}*\p{L}+\P{L}+\p{L}+\P{L}+\p{L}"


def _lines(texts: DataFrame, source: str, text: str, key: str) -> DataFrame:
    """key, source, lines: the text's lines in lower case, without digits, with single blanks and none outside."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "")
    plain = F.regexp_replace(plain, r"(?U)[\s&&[^\n]]+", " ")
    lines = F.split(F.trim(plain), " ?\n ?")
    return texts.select(F.col(key).alias("k"), F.col(source).alias("s"), lines.alias("lines")).where(
        F.col("s").isNotNull() & (F.col("s") != "")
    )


def frequent_occurrences(
    texts: DataFrame,
    key: str = "id",
    source: str = "app_name",
    text: str = "text",
    min_texts: int = MIN_TEXTS,
    min_share: float = MIN_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, occurrences): ``s, line, texts`` of each frequent line; ``k, s, line, line_no`` of each place of one."""
    lines = _lines(texts, source, text, key)
    # A null beside each text's distinct lines counts the texts of the source in the same pass.
    single = lines.select("s", F.explode(F.concat(F.array_distinct("lines"), F.array(F.lit(None).cast("string")))).alias("line"))
    single = single.where(F.col("line").isNull() | (F.length("line") >= 5)).select("s", F.when(F.col("line").isNotNull(), F.xxhash64("line")).alias("h"))
    hashed = single.groupBy("s", "h").agg(F.count(F.lit(1)).alias("n"))
    hashed = materialize(hashed.where(F.col("h").isNull() | (F.col("n") >= min_texts)))
    totals = hashed.where(F.col("h").isNull()).select("s", F.col("n").alias("total"))
    totals = broadcast_if_small(totals, totals.count(), BROADCAST_LINES)
    enough = F.greatest(F.lit(float(min_texts)), F.col("total") * F.lit(min_share))
    frequent = materialize(hashed.where(F.col("h").isNotNull()).join(totals, "s").where(F.col("n") >= enough).select("s", "h"))
    hint = broadcast_if_small(frequent, frequent.count(), BROADCAST_LINES)
    placed = lines.select("k", "s", F.posexplode("lines").alias("pos", "line")).where(F.length("line") >= 5)
    places = placed.withColumn("h", F.xxhash64("line")).join(hint, ["s", "h"])
    places = materialize(
        places.select("k", "s", "line", (F.col("pos") + 1).cast("long").alias("line_no")).where(
            F.col("line").rlike(_LETTERS)
        )
    )
    nodes = (
        places.select("s", "line", "k", "line_no")
        .groupBy("s", "line")
        .agg(F.countDistinct("k").alias("texts"))
        .join(totals, "s")
        .where(F.col("texts") >= enough)
        .select("s", "line", "texts")
    )
    return nodes, places


def boilerplate_blocks(
    texts: DataFrame,
    key: str = "id",
    source: str = "app_name",
    text: str = "text",
    min_texts: int = MIN_TEXTS,
    min_share: float = MIN_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """(blocks, occurrences). blocks: ``s, line, texts, block``, the block named by its smallest line.

    Edges join frequent lines on directly following lines of a text and stay if they stand in ``min_texts`` texts.
    Components are found by repeatedly taking the smallest name among a line and its neighbours, then the name's own
    name (pointer jumping), until nothing changes; nodes are frequent lines only, never texts.
    """
    nodes, places = frequent_occurrences(texts, key, source, text, min_texts, min_share)
    nodes = materialize(nodes)
    small = broadcast_if_small(nodes.select("s", "line"), nodes.count(), BROADCAST_LINES)
    places = places.join(small, ["s", "line"], "left_semi")
    w = Window.partitionBy("k", "s").orderBy("line_no")
    follow = places.select(
        "k", "s", "line", F.lead("line").over(w).alias("next"), (F.lead("line_no").over(w) - F.col("line_no")).alias("step")
    ).where((F.col("step") == 1) & (F.col("next") != F.col("line")))
    edges = follow.groupBy("s", "line", "next").agg(F.countDistinct("k").alias("n")).where(F.col("n") >= min_texts)
    edges = materialize(
        edges.select("s", F.col("line").alias("a"), F.col("next").alias("b")).unionByName(
            edges.select("s", F.col("next").alias("a"), F.col("line").alias("b"))
        )
    )
    names = nodes.select("s", "line", "texts", F.col("line").alias("block"))
    while True:
        near = edges.join(names.select("s", F.col("line").alias("b"), F.col("block").alias("m")), ["s", "b"])
        near = near.groupBy("s", F.col("a").alias("line")).agg(F.min("m").alias("m"))
        step = names.join(near, ["s", "line"], "left").withColumn("to", F.least("block", F.coalesce("m", "block")))
        jump = step.select("s", F.col("line").alias("to"), F.col("to").alias("far"))
        after = step.join(jump, ["s", "to"], "left").select(
            "s", "line", "texts", F.least("to", F.coalesce("far", "to")).alias("next_block"), "block"
        )
        after = materialize(after)
        changed = after.where(F.col("next_block") != F.col("block")).limit(1).count()
        names = after.select("s", "line", "texts", F.col("next_block").alias("block"))
        if not changed:
            return names, places


def repeated_lines(texts: DataFrame, **options) -> DataFrame:
    """``id, line_no`` of every occurrence of a line that belongs to a boilerplate block of its application.

    Lines are divided by ``\\n`` and counted from 1. Texts whose source is null or '' take no part. A null text has no
    lines; an empty text has one empty line, which is never boilerplate. Rows that repeat another row count as texts
    of their own if their key differs; rows of one key count once. Extra columns are not read.
    """
    blocks, places = boilerplate_blocks(texts, **options)
    hint = broadcast_if_small(blocks.select("s", "line"), blocks.count(), BROADCAST_LINES)
    return places.join(hint, ["s", "line"], "left_semi").select(F.col("k").alias("id"), "line_no")


def without_repeated_lines(texts: DataFrame, key: str = "id", text: str = "text", **options) -> DataFrame:
    """``id, text, removed``: each text without its boilerplate lines; every row of the input comes out."""
    found = repeated_lines(texts, key=key, text=text, **options)
    drop = found.groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).join(drop, "id", "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("drop", (i + 1).cast("long")), F.lit(False)))
    return rows.select("id", F.array_join(kept, "\n").alias("text"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("removed"))
