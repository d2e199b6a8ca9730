"""Mixing sources to target shares of tokens by fitting subset sums over counts of exact token lengths.

The largest total that all sources can serve within their caps fixes each source's budget. Whole rounds of a source
(every document once more) fill most of it; what remains is a subset sum over documents of known length. Only the
number of documents of each length matters for it, so the fit works on a histogram: a proportional share of each
length first, then bounded-knapsack dynamic programming over what to add to it and what to give back, which is exact.
Documents of a length are then taken in the order of a seeded hash. The histogram has at most
sqrt(2 * tokens of a source) rows, as lengths differ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.runtime import materialize
from lumenframe.llm.tokens import token_counts

SEED = 20240
#: First range of the exact fit, in multiples of the source's longest document; it grows until the fit is settled.
EXACT_SPAN = 4


def _reachable(lengths: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, list]:
    """(first, steps): sums up to ``span`` of at most ``counts`` documents of each length.

    ``first[s]`` is the step (length, documents) by which the sum s was first reached, -1 where it isn't; what is left
    of s without that step was reached by an earlier one, so one number a sum gives back its documents.
    """
    reach = np.zeros(span + 1, dtype=bool)
    first = np.full(span + 1, -1, dtype=np.int32)
    reach[0], reached, steps = True, 1, []
    for i, size in enumerate(lengths.tolist()):
        left, part = int(counts[i]), 1
        while left > 0 and min(part, left) * size <= span and reached <= span:
            use = min(part, left)
            new = np.flatnonzero(reach[: span + 1 - use * size] & ~reach[use * size :]) + use * size
            first[new] = len(steps)
            reach[new] = True
            steps.append((i, use))
            reached += len(new)
            left, part = left - use, part * 2
    return first, steps


def _documents(first: np.ndarray, steps: list, lengths: np.ndarray, total: int) -> np.ndarray:
    used = np.zeros(len(lengths), dtype=np.int64)
    while total:
        i, use = steps[first[total]]
        used[i] += use
        total -= use * int(lengths[i])
    return used


def _bits(first: np.ndarray) -> int:
    reach = first >= 0
    reach[0] = True
    return int.from_bytes(np.packbits(reach, bitorder="little").tobytes(), "little")


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their sizes sum to the largest possible total up to ``budget``.

    A proportional part keeps the source's own distribution of lengths and leaves less than the longest document, W.
    Dynamic programming then looks for documents to add and to give back. A total that can be reached at all is reached
    from there by at most 2 W changes: in an order in which the sums stay between -W and W, more changes would meet a sum
    twice, and those between could be left out. So a range of sums of 2 W * W settles the fit, whatever the source's
    size; mostly the first range, EXACT_SPAN * W, does.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    usable = np.flatnonzero((lengths > 0) & (counts > 0))
    if budget <= 0 or not len(usable):
        return taken
    usable = usable[np.argsort(lengths[usable], kind="stable")]
    size, count = lengths[usable].astype(np.int64), counts[usable].astype(np.int64)
    step = int(np.gcd.reduce(size))
    size, budget = size // step, budget // step
    available = int((size * count).sum())
    if budget >= available:
        taken[usable] = count
        return taken
    base = np.array([int(c) * budget // available for c in count], dtype=np.int64)
    rest = budget - int((size * base).sum())
    for i in range(len(size) - 1, -1, -1):
        more = min(int(count[i] - base[i]), rest // int(size[i]))
        base[i] += more
        rest -= more * int(size[i])
    longest = int(size[-1])
    limit = min(2 * longest * longest, max(int((size * base).sum()), int((size * (count - base)).sum())))
    span = min(limit, EXACT_SPAN * longest)
    while rest:
        more, more_steps = _reachable(size, count - base, span + rest)
        less, less_steps = _reachable(size, base, span)
        a, b = _bits(more), _bits(less)
        gain = next((t for t in range(rest, 0, -1) if a >> t & b), 0) if span >= limit else rest if a >> rest & b else None
        if gain is not None:
            if gain:
                back = a >> gain & b
                back = (back & -back).bit_length() - 1
                base = base + _documents(more, more_steps, size, back + gain) - _documents(less, less_steps, size, back)
            break
        span = min(limit, 4 * span)
    taken[usable] = base
    return taken


def mix_to_shares(documents: DataFrame, targets: DataFrame, seed: int = SEED, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: ``doc_id, source, n_tokens, copies``; report: one row for each source of ``targets``.

    Sources without tokens, with a null or non-positive share or with ``max_repeats`` below 1 can't contribute: they
    are reported with an actual share of 0 and the other shares are scaled to sum to 1 (``fitted_share``). A null
    ``max_repeats`` means 1. The total is the largest at which every source meets its fitted share within its cap.
    Documents of 0 tokens take part in whole rounds only, since they don't change a size. A row counts as a document of
    its own, also where its ``doc_id`` is null, repeats another row or stands in several sources. ``report`` has ``source, target_share, fitted_share, max_repeats, documents,
    available_tokens, budget_tokens, mixed_tokens, actual_share, most_copies``.
    """
    spark = documents.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum("target_share").cast("double").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats")
    )
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").join(wanted.select("source"), "source", "left_semi")
    sizes = token_counts(chosen, ["doc_id", "source"], "text", vocabulary)
    sizes = materialize(sizes.select("doc_id", "source", F.col("n_tokens").alias("n"), F.monotonically_increasing_id().alias("row")))
    histogram = materialize(sizes.groupBy("source", "n").agg(F.count(F.lit(1)).alias("c")))
    # One row for each row of the targets' table: as small as the request itself.
    totals = wanted.join(
        histogram.groupBy("source").agg(F.sum("c").alias("documents"), F.sum(F.col("n") * F.col("c")).alias("tokens")), "source", "left"
    ).toPandas()
    totals = totals.fillna({"documents": 0, "tokens": 0}).sort_values("source").reset_index(drop=True)
    able = (totals.tokens > 0) & (totals.target_share > 0) & (totals.max_repeats >= 1)
    share = totals.target_share.where(able, 0.0)
    share = share / share.sum() if able.any() else share
    total = min(([int(m) * int(t) / s for m, t, s in zip(totals.max_repeats[able], totals.tokens[able], share[able])]), default=0)
    budget = [int(np.floor(s * total + 0.5)) for s in share]
    rounds = [min(int(m), b // int(t)) if ok else 0 for m, b, t, ok in zip(totals.max_repeats, budget, totals.tokens, able)]
    rest = [0 if not ok or r == int(m) else b - r * int(t) for m, b, t, r, ok in zip(totals.max_repeats, budget, totals.tokens, rounds, able)]
    plan_rows = [(s, int(r), int(x), float(f), int(b)) for s, r, x, f, b in zip(totals.source, rounds, rest, share, budget)]
    plan = spark.createDataFrame(plan_rows, "source string, rounds long, rest long, fitted_share double, budget long")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        taken = fit_lengths(group.n.to_numpy(), group.c.to_numpy(), int(group.rest.iloc[0]))
        return pd.DataFrame({"source": group.source, "n": group.n, "extra": taken})

    extra = histogram.join(plan, "source").groupBy("source").applyInPandas(fit, "source string, n long, extra long")
    extra = materialize(extra.where(F.col("extra") > 0))
    # Rank by hash within (source, length) without ever ordering a whole length: hash ranges first, then one range.
    hashed = sizes.withColumn("x", F.xxhash64(F.lit(seed), F.coalesce("doc_id", -1 - F.col("row")), "n", "source")).withColumn("b", F.shiftright("x", 52))
    ranges = hashed.groupBy("source", "n", "b").agg(F.count(F.lit(1)).alias("in_range"))
    w = Window.partitionBy("source", "n").orderBy("b")
    ranges = ranges.join(extra, ["source", "n"]).withColumn("room", F.col("extra") - F.sum("in_range").over(w) + F.col("in_range"))
    ranges = ranges.where(F.col("room") > 0).select("source", "n", "b", "room", "in_range")
    picked = hashed.join(ranges, ["source", "n", "b"])
    inside = picked.where(F.col("room") >= F.col("in_range"))
    edge = picked.where(F.col("room") < F.col("in_range"))
    edge = edge.withColumn("rank", F.row_number().over(Window.partitionBy("source", "n", "b").orderBy("x", "doc_id", "row")))
    edge = edge.where(F.col("rank") <= F.col("room"))
    more = inside.select("row").unionByName(edge.select("row")).withColumn("more", F.lit(1))
    mix = sizes.join(plan, "source").join(more, "row", "left")
    mix = mix.select("doc_id", "source", F.col("n").alias("n_tokens"), (F.col("rounds") + F.coalesce("more", F.lit(0))).alias("copies"))
    mix = materialize(mix.where(F.col("copies") > 0))
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    known = spark.createDataFrame(
        [(s, float(t), int(m), int(d), int(k)) for s, t, m, d, k in zip(totals.source, totals.target_share.fillna(0), totals.max_repeats, totals.documents, totals.tokens)],
        "source string, target_share double, max_repeats long, documents long, available_tokens long",
    )
    report = known.join(plan, "source").join(got, "source", "left")
    mixed = F.coalesce("mixed_tokens", F.lit(0)).cast("long")
    whole = F.sum(mixed).over(Window.partitionBy())
    report = report.select(
        "source",
        "target_share",
        "fitted_share",
        "max_repeats",
        "documents",
        "available_tokens",
        F.col("budget").alias("budget_tokens"),
        mixed.alias("mixed_tokens"),
        F.coalesce(mixed / F.when(whole > 0, whole), F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_copies", F.lit(0)).cast("long").alias("most_copies"),
    )
    return mix, report
