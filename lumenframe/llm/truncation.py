"""Texts that were cut at a field's limit or in mid-transfer.

Two kinds of evidence are combined as log-odds for each text, and the weight of one is learned with the other:

* Length. A source that cuts at a limit shows a point mass there. For each source a log-normal distribution of
  lengths is fitted by maximum likelihood with values at or beyond a candidate limit right-censored (EM); the
  posterior that a value at the limit was censored follows from the density that the fit leaves there. Elsewhere a
  value may have been cut in mid-transfer, with a small rate that is the same for all sources.
* Ending. Whether the text stops inside a word or a sentence of running text. What is complete without a full stop is
  learned from the corpus: shapes of unpunctuated lines that stand, finished, in front of an empty line (headings and
  the like), and closing lines that texts of different lengths share and that end texts more often than they begin
  longer lines: a cut tail is the beginning of other lines, a closing phrase isn't. List entries, code, table rows,
  links and sign-offs are told by their form.

How much an ending says isn't set but estimated: EM over the corpus's counts of (posterior of the limit, ending) gives
how often cut and whole texts end in each way, and how often texts are cut off the limits. What the task defines are
its labelled cases: running text that stops is cut, a full stop isn't. All other endings start at their limit's posterior
and are learned: a list entry, a row of code or a heading counts as cut at one source's limit and as whole at the same
length elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.runtime import broadcast_if_small, materialize, stored

#: A closing line is looked at as a stock phrase if it ends texts of so many different lengths.
STOCK_LENGTHS = 4
#: Tables up to this many rows are joined without a shuffle; the result is the same.
BROADCAST_LINES = 100_000
#: Lengths with at least so many texts, and so many times the fit's expectation, are candidate limits.
LIMIT_COUNT, LIMIT_EXCESS = 5, 4.0
#: Where EM starts: the chance of a cut off the limits, and the endings with the label of those that the task defines.
START_RATE = 0.01
ENDINGS = {"open": 1.0, "marked": 1.0, "closed": 0.0, "stock": None, "form": None, "link": None}
#: Texts that every ending is taken to have been seen on beforehand, cut and whole.
SMOOTH = 0.01
#: A limit speaks against a form only if more than this share of its texts stop open, or less than that of the source's go beyond.
OPEN_SHARE, BEYOND_SHARE = 0.5, 0.02
#: A heading has at most so many words and signs.
HEADING_TOKENS = 8

#: What may stand behind a cut.
MARKER = re.compile(
    r"\s*(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|�+"
    r"|[\[(<](?:truncated|cut|more|continued|abridged|gekürzt|tronqué|truncado)[\])>]|(?:>>|»)\s*more)\s*$",
    re.I,
)
CLOSED = re.compile(r"[.?!。！？।؟։።︒｡‼⁇⁈⁉]['\"”’»)\]*_]*$")
LIST = re.compile(r"^\s*(?:[-*•·–+]|\d{1,3}[.)]|[a-z][.)])\s+\S")
CODE = re.compile(r"^(?:\t| {2,})\S|^(?:def|class|import|from|return|for|if|while|SELECT|INSERT|#include)\b.*[:;(){}\]]\s*$|[{};]\s*$")
#: A row of short cells; a long one is running text that follows a table.
TABLE = re.compile(r"^\s*\|?\s*[^|\n]{1,40}(?:\s*\|\s*[^|\n]{1,40})+\s*\|?\s*$")
SENTENCES = re.compile(r"[.?!] [^\W\d_]")
LINK = re.compile(r"^[a-z][a-z0-9+.-]*://[^\s/]+\.[^\s/.]{2,}(?:/\S*)?$", re.I)
SIGN_OFF = re.compile(r"^(?:--|—|–)\s*\S|^\((?:[^()]*)\)$")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def line_shape(line: str) -> str:
    """Form of a line: A a capitalised word, a another, 9 a number, other signs as they are; '' if too long for a heading."""
    tokens = TOKEN.findall(line)
    if len(tokens) > HEADING_TOKENS:
        return ""
    return " ".join("9" if t.isdigit() else ("A" if t[0].isupper() else "a") if t.isalpha() else t for t in tokens)


def _features(batches):
    for batch in batches:
        out: dict = {"d": [], "s": [], "n": [], "last": [], "shape": [], "kind": [], "stock": [], "whole": [], "h": [], "bare": [], "unmarked": []}
        for d, s, text, h in zip(*(column.to_pylist() for column in batch.columns)):
            core = (text or "").rstrip()
            if not core:
                continue
            lines = core.split("\n")
            stock = []
            end = len(lines)
            while end and (not lines[end - 1].strip() or SIGN_OFF.match(lines[end - 1].strip())):
                if lines[end - 1].strip():
                    stock.append(lines[end - 1].strip())
                end -= 1
            body = lines[:end]
            last = body[-1].rstrip() if body else ""
            alone = len(body) == 1 or not body[-2].strip() if body else False
            bare = MARKER.sub("", last)
            if not last:
                kind = "closed"
            elif (LIST.match(last) or CODE.search(last)) and not CLOSED.search(last) and last[-1] not in ";}":
                kind = "form"
            elif LIST.match(last) or CODE.search(last):
                kind = "closed"
            elif TABLE.match(last) and not SENTENCES.search(last):
                kind = "row"
            elif LINK.match(last.strip()):
                kind = "link"
            elif bare != last:
                kind = "marked"
            elif CLOSED.search(last):
                kind = "closed"
            else:
                kind = "open" if alone else "inside"
            finished = set()
            for i in range(end - 1):
                line = body[i].strip()
                if line and not CLOSED.search(line) and (LINK.match(line) or i + 2 < end and not body[i + 1].strip()):
                    finished.add(("L " if LINK.match(line) else "") + line_shape(line))
            finished.discard("")
            out["d"].append(d)
            out["s"].append(s)
            out["n"].append(len(text))
            out["last"].append(last.strip() if kind in ("marked", "open", "inside") else None)
            out["shape"].append(("L " if kind == "link" else "") + line_shape(last.strip()))
            out["kind"].append(kind)
            out["stock"].append(len(stock))
            out["whole"].append(sorted(finished))
            out["h"].append(h)
            out["bare"].append(bare.strip() if kind in ("marked", "open", "inside") else None)
            out["unmarked"].append(bare == last)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["d"], pa.int64()),
                pa.array(out["s"], pa.string()),
                pa.array(out["n"], pa.int64()),
                pa.array(out["last"], pa.string()),
                pa.array(out["shape"], pa.string()),
                pa.array(out["kind"], pa.string()),
                pa.array(out["stock"], pa.int32()),
                pa.array(out["whole"], pa.list_(pa.string())),
                pa.array(out["h"], pa.int64()),
                pa.array(out["bare"], pa.string()),
                pa.array(out["unmarked"], pa.bool_()),
            ],
            names=list(out),
        )


_FEATURES = "d long, s string, n long, last string, shape string, kind string, stock int, whole array<string>, h long, bare string, unmarked boolean"


def _starts(batches):
    """(line, c): lines without cut marks, with their counts in the batch."""
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for line in text.split("\n"):
                line = MARKER.sub("", line).strip()
                if line:
                    counts[line] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["line", "c"])


#: Lines are looked up by their first 1, 2, 4 ... signs, the most of these that a closing line has, and then compared whole.
_WIDTHS = [1, 2, 4, 8, 16, 32, 64]


def _keys(column: str):
    return [F.when(F.length(column) >= w, F.substring(column, 1, w)) for w in _WIDTHS]


def stock_lines(features: DataFrame, texts: DataFrame) -> DataFrame:
    """``last, kind, is_stock`` of the closing lines that are stock phrases, whatever the corpus's size.

    Different texts must end with the line more often than lines of the corpus go on from it.
    """
    closing = features.where(F.col("kind").isin("marked", "open", "inside"))
    closing = closing.groupBy("last", "kind").agg(F.first("bare").alias("bare"), F.countDistinct("n").alias("lengths"), F.countDistinct("h").alias("ends"))
    closing = materialize(closing.where(F.col("lengths") >= STOCK_LENGTHS))
    asked = closing.where("bare <> ''").select("bare", F.coalesce(*reversed(_keys("bare"))).alias("key")).distinct()
    starts = texts.mapInArrow(_starts, "line string, c long").select("line", "c", F.explode(F.array_compact(F.array(*_keys("line")))).alias("key"))
    met = starts.join(broadcast_if_small(asked, closing.count(), BROADCAST_LINES), "key")
    met = met.where(F.col("line").startswith(F.col("bare")) & (F.length("line") > F.length("bare")))
    begins = met.groupBy("bare").agg(F.sum("c").alias("begins"))
    known = closing.join(begins, "bare", "left").where(F.col("ends") > F.coalesce("begins", F.lit(0)))
    return known.select("last", "kind", F.lit(True).alias("is_stock"))


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def fit_censored(logs: np.ndarray, weights: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of a normal distribution by maximum likelihood (EM) where ``censored`` values are lower bounds."""
    mean = float(np.average(logs, weights=weights))
    dev = max(0.05, float(np.sqrt(np.average((logs - mean) ** 2, weights=weights))))
    for _ in range(60):
        z = (logs[censored] - mean) / dev
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.maximum(_normal_tail(z), 1e-300)
        first, second = logs.copy(), logs**2
        first[censored] = mean + dev * hazard
        second[censored] = mean**2 + dev**2 + dev * hazard * (logs[censored] + mean)
        new = float(np.average(first, weights=weights))
        new_dev = max(0.05, math.sqrt(max(1e-6, float(np.average(second, weights=weights)) - new**2)))
        done = abs(new - mean) + abs(new_dev - dev) < 1e-6
        mean, dev = new, new_dev
        if done:
            break
    return mean, dev


def censoring(group: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source from its histogram (n, c): posterior that a value of that length was censored.

    ``opens`` and ``marks`` of the ``c`` texts stop open or with a cut mark. ``hard``: the length is a limit by its texts'
    endings or because hardly any go beyond, not a length that complete texts of one form share; ``marking``: it leaves marks.
    """
    group = group.sort_values("n")
    n, c = group.n.to_numpy(dtype=float), group.c.to_numpy(dtype=float)
    positive = n > 0
    n, c, opens, marks = n[positive], c[positive], group.opens.to_numpy()[positive], group.marks.to_numpy()[positive]
    out = []
    if len(n):
        logs = np.log(n)
        mean, dev = fit_censored(logs, c, np.zeros(len(n), dtype=bool))
        for _ in range(2):  # the limits found change the fit once
            density = np.exp(-0.5 * ((logs - mean) / dev) ** 2) / (dev * math.sqrt(2 * math.pi) * n)
            expected = c.sum() * density
            at = (c >= LIMIT_COUNT) & (c > LIMIT_EXCESS * np.maximum(expected, 0.5))
            mean, dev = fit_censored(logs, c, at)
        hard = ((opens + marks) / c > OPEN_SHARE) | (c.sum() - np.cumsum(c) < BEYOND_SHARE * c.sum())
        marking = marks / c > OPEN_SHARE
        out = [(group.s.iloc[0], int(x), float((k - min(e, k)) / (k + 0.5)), bool(f), bool(m)) for x, k, e, f, m in zip(n[at], c[at], expected[at], hard[at], marking[at])]
    return pd.DataFrame(out, columns=["s", "n", "posterior", "hard", "marking"]).astype({"n": "int64", "posterior": "float64", "hard": "bool", "marking": "bool"})


def ending_weights(table: list) -> tuple[dict, float]:
    """(log-odds of a cut by ending, rate of cuts off the limits) by EM over ``(posterior or 0, ending, texts)``.

    A posterior of 0 stands for a text off the limits. Cut and whole texts have one distribution of endings each. Labelled
    endings keep their label while the others are learned, and these are learned as endings of cut texts only at limits,
    as nothing tells the two apart elsewhere. What labelled endings weigh in the end follows from the counts too.
    """
    prior = np.array([p for p, _, _ in table], dtype=float)
    count = np.array([c for _, _, c in table], dtype=float)
    ending = np.array([list(ENDINGS).index(e) for _, e, _ in table], dtype=int)
    off, rate = prior == 0, START_RATE
    label = np.array([-1.0 if v is None else v for v in ENDINGS.values()])[ending]
    cut = np.where(label < 0, np.where(off, rate, prior), label)
    weights = np.zeros(len(ENDINGS))
    for _ in range(200):
        ends = [np.bincount(ending, w * count, minlength=len(ENDINGS)) + SMOOTH for w in (np.where(off & (label < 0), 0.0, cut), 1 - cut)]
        new = np.log(ends[0] / ends[0].sum()) - np.log(ends[1] / ends[1].sum())
        rate = min(0.5, max(1e-6, float((cut * count)[off & (label >= 0)].sum() / max(count[off].sum(), 1.0)))) if off.any() else rate
        done = np.abs(new - weights).max() < 1e-6
        weights, p = new, np.where(off, rate, prior)
        cut = np.where(label < 0, 1 / (1 + np.exp(-(np.log(p / (1 - p)) + weights[ending]))), label)
        if done:
            break
    return {e: float(w) for e, w in zip(ENDINGS, weights)}, rate


def score_truncation(documents: DataFrame) -> DataFrame:
    """``doc_id, source, n_chars, ending, limit_posterior, log_odds, truncated`` of each document with some text.

    Null, empty and blank texts are complete and don't come out here. ``n_chars`` is counted from the text, never
    taken from a column. A null source is a source of its own. Repeated rows come out repeatedly. Extra columns are
    not read. Texts are judged whole.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("d"), F.col("source").alias("s"), F.col("text").alias("t"), F.xxhash64("text").alias("h"))
    rows = rows.where(F.col("t").isNotNull())
    features = materialize(rows.mapInArrow(_features, _FEATURES))
    source = F.coalesce("s", F.lit("\u0000"))
    surely_open = (F.col("kind") == "inside") | (F.col("kind") == "open") & (F.col("shape") == "")  # no heading
    once = features.select(source.alias("s"), "n", "h", "kind", surely_open.alias("surely_open")).distinct()  # copies of a text are no point mass
    histogram = once.groupBy("s", "n").agg(
        F.count(F.lit(1)).alias("c"), F.count_if("surely_open").alias("opens"), F.count_if(F.col("kind") == "marked").alias("marks")
    )
    limits = histogram.groupBy("s").applyInPandas(censoring, "s string, n long, posterior double, hard boolean, marking boolean")
    stock = stock_lines(features, rows.select("t"))
    finished = features.select(F.explode("whole").alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("finished"))
    final = features.where(F.col("kind").isin("open", "link")).groupBy("shape").agg(F.count(F.lit(1)).alias("final"))
    shapes = final.join(finished, "shape").where(F.col("finished") >= F.greatest(F.lit(3), F.col("final"))).select("shape", F.lit(True).alias("is_whole"))
    limits, stock, shapes = (materialize(t) for t in (limits, stock, shapes))
    asked = F.col("kind").isin("marked", "open", "inside")  # only these endings are looked up, so no key is null
    stock_hint, shape_hint, limit_hint = (broadcast_if_small(t, t.count(), BROADCAST_LINES) for t in (stock, shapes, limits.withColumnRenamed("s", "src")))
    looked = features.where(asked).join(stock_hint, ["last", "kind"], "left")
    looked = looked.unionByName(features.where(~asked).withColumn("is_stock", F.lit(None).cast("boolean")))
    joined = looked.withColumn("src", source).join(limit_hint, ["src", "n"], "left").join(shape_hint, "shape", "left")
    is_stock = F.coalesce("is_stock", F.lit(False))
    whole = F.col("kind").isin("open", "link") & (F.col("shape") != "") & F.coalesce("is_whole", F.lit(False))
    evidence = (
        F.when(F.col("kind") == "closed", "closed")
        .when(is_stock, "stock")
        .when(whole | F.col("kind").isin("form", "row"), "form")
        .when(F.col("kind") == "inside", "open")
        .otherwise(F.col("kind"))
    )
    # A limit that leaves marks cut no text without one.
    heard = ~F.col("evidence").isin("stock", "form") | (F.col("hard") & (~F.col("marking") | ~F.col("unmarked")))
    joined = joined.withColumn("evidence", evidence).withColumn("p", F.when(heard, F.coalesce("posterior", F.lit(0.0))).otherwise(0.0))
    joined = stored(joined.select("d", "s", "n", "evidence", "p", F.coalesce("posterior", F.lit(0.0)).alias("posterior"), F.col("h")))
    once = joined.select("s", "h", "evidence", "p").distinct()
    table = once.groupBy(F.round("p", 3).alias("p"), "evidence").agg(F.count(F.lit(1)).alias("c"))  # at most 1,001 x 6 rows
    weights, rate = ending_weights([(min(r.p, 0.9995), r.evidence, r.c) for r in table.collect()])
    prior = F.when(F.col("p") > 0, F.col("p")).otherwise(F.lit(rate))
    lo = F.log(prior / (1 - prior)) + F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("evidence")]
    ending = F.when(F.col("evidence").isin("closed", "stock", "form"), "complete").when(F.col("evidence") == "marked", "marker").otherwise(F.col("evidence"))
    scored = joined.withColumn("ending", ending).withColumn("lo", lo)
    return scored.select(
        F.col("d").alias("doc_id"),
        F.col("s").alias("source"),
        F.col("n").alias("n_chars"),
        "ending",
        F.col("posterior").alias("limit_posterior"),
        F.col("lo").alias("log_odds"),
        (F.col("lo") > 0).alias("truncated"),
    )


def truncation_rates(documents: DataFrame) -> DataFrame:
    """``source, documents, truncated, rate, limit_chars``: all documents of a source count, also those without text.

    ``limit_chars`` is the length at which most of the source's cut texts stop, null if fewer than LIMIT_COUNT do.
    """
    scored = materialize(score_truncation(documents))
    key = F.coalesce("source", F.lit("\u0000")).alias("k")
    cut = scored.where("truncated")
    counts = cut.groupBy(key).agg(F.count(F.lit(1)).alias("truncated"))
    at = cut.groupBy(key, "n_chars").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LIMIT_COUNT)
    limit = at.groupBy("k").agg(F.max_by("n_chars", F.struct("c", "n_chars")).alias("limit_chars"))
    total = documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents")).withColumn("k", F.coalesce("source", F.lit("\u0000")))
    out = total.join(counts, "k", "left").join(limit, "k", "left")
    truncated = F.coalesce("truncated", F.lit(0)).cast("long")
    return out.select("source", "documents", truncated.alias("truncated"), (truncated / F.col("documents")).alias("rate"), "limit_chars")
