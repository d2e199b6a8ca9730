"""Ranked full-text search over four columns with a query language of terms, phrases and boolean operators.

A query is parsed to a tree whose leaves are phrases. There are two ways to evaluate it, with the same result:

* Over frames. Their columns become strings of terms (in the JVM; stems are added by one pass with a table of the
  words met), and each leaf becomes a number for each frame, its hits, by one pattern over the terms.
* Over an index (:class:`SearchIndex`): postings of each stem with its positions, sorted by term so that only the query's
  terms are read, and the size of each frame. It grows by a segment with every batch that is added.

One aggregate gives the collection's size and the leaves' document frequencies, after which each frame is scored on its
own and only the top of the ranking moves.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.porter import stem
from lumenframe.functions.terms import ACCENTED, PLAIN
from lumenframe.operators.frames import ENTRY, entries

COLUMNS = ["text", "extra_context", "app_name", "window_title"]
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
OVERFETCH, SNIPPET_TOKENS = 3, 40


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = tuple(COLUMNS)


@dataclass(frozen=True)
class Near:
    parts: tuple[Phrase, ...]
    distance: int
    columns: tuple[str, ...] = tuple(COLUMNS)


@dataclass(frozen=True)
class Op:
    name: str
    left: object
    right: object


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([^\W]+)|([():^*+{}\-,]))', re.UNICODE)


def _fold(word: str) -> list[str]:
    low = word.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return re.findall(r"[^\W_]+", low)


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {query[at:].strip()[:1]!r}")
        out.append(("string", m[1][1:-1].replace('""', '"')) if m[1] else ("word", m[2]) if m[2] else ("sign", m[3]))
        at = m.end()
    return out


class _Parser:
    """OR binds least, then AND (also where nothing stands between two phrases), then NOT."""

    def __init__(self, query: str):
        self.tokens, self.at = _lex(query), 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, None)

    def take(self, value: str | None = None):
        token = self.peek()
        if token[0] is None or (value is not None and token[1] != value):
            raise QuerySyntaxError(f"expected {value or 'a term'}")
        self.at += 1
        return token

    def parse(self):
        tree = self.either()
        if self.peek()[0]:
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        left = self.both()
        while self.peek() == ("word", "OR"):
            self.take()
            left = Op("OR", left, self.both())
        return left

    def both(self):
        left = self.without()
        while True:
            if self.peek() == ("word", "AND"):
                self.take()
            elif self.peek()[0] is None or self.peek() in (("sign", ")"), ("word", "OR"), ("word", "NOT")):
                return left
            left = Op("AND", left, self.without())

    def without(self):
        left = self.unit()
        while self.peek() == ("word", "NOT"):
            self.take()
            left = Op("NOT", left, self.unit())
        return left

    def unit(self):
        columns = self.columns()
        if self.peek() == ("sign", "("):
            self.take()
            tree = self.either()
            self.take(")")
            return _within(tree, columns) if columns else tree
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            return self.near(columns or tuple(COLUMNS))
        return self.phrase(columns or tuple(COLUMNS))

    def columns(self):
        minus = self.peek() == ("sign", "-")
        start = self.at + minus
        names, end = [], start
        if end < len(self.tokens) and self.tokens[end] == ("sign", "{"):
            end += 1
            while end < len(self.tokens) and self.tokens[end][0] == "word":
                names.append(self.tokens[end][1])
                end += 1
            end += 1
        elif end < len(self.tokens) and self.tokens[end][0] == "word":
            names, end = [self.tokens[end][1]], end + 1
        if end < len(self.tokens) and self.tokens[end] == ("sign", ":") and names:
            unknown = [n for n in names if n.lower() not in COLUMNS]
            if unknown:
                raise QuerySyntaxError(f"no such column: {unknown[0]}")
            self.at = end + 1
            chosen = {n.lower() for n in names}
            return tuple(c for c in COLUMNS if (c in chosen) != minus)
        if minus:
            raise QuerySyntaxError("unexpected '-'")
        return None

    def near(self, columns):
        self.take()
        self.take("(")
        parts = []
        while self.peek() not in (("sign", ")"), ("sign", ",")):
            parts.append(self.phrase(columns))
        distance = 10
        if self.peek() == ("sign", ","):
            self.take()
            distance = int(self.take()[1])
        self.take(")")
        return Near(tuple(parts), distance, columns)

    def phrase(self, columns):
        first = self.peek() == ("sign", "^")
        if first:
            self.take()
        words: list[str] = []
        prefix = False
        while True:
            kind, value = self.peek()
            if kind not in ("word", "string") or (kind == "word" and value in ("AND", "OR", "NOT")):
                raise QuerySyntaxError(f"unexpected {value!r}")
            self.take()
            words += _fold(value)
            if self.peek() == ("sign", "*"):
                self.take()
                prefix = True
            if self.peek() != ("sign", "+"):
                break
            self.take()
        return Phrase(tuple(words), prefix, first, columns)


def _within(tree, columns):
    if isinstance(tree, Op):
        return Op(tree.name, _within(tree.left, columns), _within(tree.right, columns))
    kept = tuple(c for c in tree.columns if c in columns)
    if isinstance(tree, Near):
        return Near(tuple(_within(p, columns) for p in tree.parts), tree.distance, kept)
    return Phrase(tree.words, tree.prefix, tree.first, kept)


def parse_query(query: str, plain: bool = False):
    """The query's tree. ``plain`` takes every run of letters or digits as a term, whatever signs stand between."""
    if plain:
        words = _fold(query)
        if not words:
            raise QuerySyntaxError("empty query")
        return reduce(lambda a, b: Op("AND", a, b), [Phrase((w,)) for w in words])
    if not query.strip():
        raise QuerySyntaxError("empty query")
    return _Parser(query).parse()


def _leaves(tree) -> list:
    return _leaves(tree.left) + _leaves(tree.right) if isinstance(tree, Op) else [tree]


def _phrases(tree) -> list[Phrase]:
    return [p for leaf in _leaves(tree) for p in (leaf.parts if isinstance(leaf, Near) else (leaf,))]


def _stemmed(batches):
    """Strings of terms to strings of stems; columns that aren't strings pass."""
    known: dict = {}

    def stem_of(word):
        found = known.get(word)
        if found is None:
            if len(known) > 500_000:
                known.clear()
            found = known[word] = stem(word)
        return found

    for batch in batches:
        columns = [
            pa.array([" ".join(map(stem_of, v.split(" "))) for v in column.to_pylist()], pa.string()) if pa.types.is_string(column.type) else column
            for column in batch.columns
        ]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def term_strings(frames: DataFrame, stemmed: bool = True) -> DataFrame:
    """``id, timestamp`` and a string of terms for each column: t_text and so on, with one blank at each end and between."""
    rows = frames.select(F.col("id").cast("long"), F.col("timestamp").cast("double"), *[_spaced(c).alias(f"t_{c}") for c in COLUMNS])
    types = "id long, timestamp double, " + ", ".join(f"t_{c} string" for c in COLUMNS)
    return rows.mapInArrow(_stemmed, types) if stemmed else rows


def _stem_query(tree):
    """The tree with stems for words, for terms that are stems."""
    if isinstance(tree, Op):
        return Op(tree.name, _stem_query(tree.left), _stem_query(tree.right))
    if isinstance(tree, Near):
        return Near(tuple(map(_stem_query, tree.parts)), tree.distance, tree.columns)
    return Phrase(tuple(map(stem, tree.words)), tree.prefix, tree.first, tree.columns)


def _spaced(column: str) -> Column:
    """The column's tokens in order with one blank before, between and after them."""
    folded = F.translate(F.lower(F.coalesce(column, F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_replace(F.concat(F.lit(" "), folded, F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def _phrase_pattern(phrase: Phrase) -> str:
    """Pattern of the phrase's words, each with the blank behind it."""
    last = len(phrase.words) - 1
    return "".join(re.escape(w) + (r"\S* " if phrase.prefix and i == last else " ") for i, w in enumerate(phrase.words)) or "(?!)"


def _phrase_hits(phrase: Phrase) -> Column:
    """Hits of a phrase in one frame: matches of a look-ahead, so that overlapping ones all count."""
    pattern = F.lit(f"(?={'^ ' if phrase.first else ' '}{_phrase_pattern(phrase)})")
    return sum((F.regexp_count(F.col(f"t_{c}"), pattern) for c in phrase.columns), F.lit(0))


def _starts(phrase: Phrase, terms: list[str]) -> list[int]:
    """Positions at which the phrase begins."""
    words, last = phrase.words, len(phrase.words) - 1
    if not words or phrase.first and len(terms) < len(words):
        return []
    ends = (lambda t: t.startswith(words[last])) if phrase.prefix else (lambda t: t == words[last])
    places = range(1 if phrase.first else max(0, len(terms) - last))
    return [i for i in places if terms[i : i + last] == list(words[:last]) and ends(terms[i + last])]


def clump_hits(starts: list, lengths: list[int], distance: int) -> list[int]:
    """For each phrase the number of its starts (sorted) that stand in a clump of all phrases.

    A clump has one start of each phrase, and at most ``distance`` terms between the end of any of them and the last
    start; a phrase may overlap another.
    """
    kept: list[set] = [set() for _ in starts]
    for last in sorted({x for each in starts for x in each}) if all(len(each) for each in starts) else ():
        spans = [(bisect_left(each, last - n - distance), bisect_right(each, last)) for each, n in zip(starts, lengths)]
        if all(low < high for low, high in spans):
            for one, each, (low, high) in zip(kept, starts, spans):
                one.update(each[low:high])
    return [len(one) for one in kept]


def _near_hits(leaf: Near) -> Column:
    """Array of the hits of each phrase of a NEAR group in one frame.

    Positions are looked at in Python, only of columns in which all phrases occur.
    """
    parts, lengths, distance = leaf.parts, [len(p.words) for p in leaf.parts], leaf.distance
    columns = [c for c in leaf.columns if all(c in p.columns for p in parts)]

    @F.pandas_udf("array<int>")
    def count(*series: pd.Series) -> pd.Series:
        out = []
        for values in zip(*series):
            total = [0] * len(parts)
            for value in values:
                if value is not None:
                    terms = value.split()
                    total = [a + b for a, b in zip(total, clump_hits([_starts(p, terms) for p in parts], lengths, distance))]
            out.append(total)
        return pd.Series(out)

    def likely(c):
        return reduce(lambda a, b: a & b, [F.col(f"t_{c}").rlike(" " + _phrase_pattern(p)) for p in parts])

    if not columns:
        return F.array(*[F.lit(0)] * len(parts))
    return count(*[F.when(likely(c), F.col(f"t_{c}")) for c in columns])


def _near_places(lengths: list[int], distance: int):
    """The same for arrays of positions."""

    @F.pandas_udf("array<int>")
    def count(*series: pd.Series) -> pd.Series:
        return pd.Series([clump_hits([x.tolist() for x in values], lengths, distance) for values in zip(*series)])

    return count


def _holds(tree, at: dict) -> Column:
    if isinstance(tree, Op):
        left, right = _holds(tree.left, at), _holds(tree.right, at)
        return {"AND": left & right, "OR": left | right, "NOT": left & ~right}[tree.name]
    return at[tree] > 0


def _scored(rows: DataFrame, tree, whole: DataFrame) -> DataFrame:
    """``id, timestamp, rank`` of rows (id, timestamp, size, hits h0 .. of leaves, f0 .. that score, g0 .. that are counted)."""
    leaves, phrases = list(dict.fromkeys(_leaves(tree))), _phrases(tree)
    counts = rows.agg(*[F.count_if(F.col(f"g{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    stats = counts.join(whole)  # one row each
    scored = rows.where(_holds(tree, {leaf: F.col(f"h{i}") for i, leaf in enumerate(leaves)})).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        n, f = F.col(f"n{i}"), F.col(f"f{i}")
        idf = F.greatest(F.log((F.col("total") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))).otherwise(0.0)
    return scored.select("id", "timestamp", (-score).alias("rank"))


def matching(frames: DataFrame, query: str, stemmed: bool = True, plain: bool = False) -> DataFrame:
    """``id, timestamp, rank`` of frames that match, rank being the (negative) bm25 score: smaller is better.

    Rows of one id are frames of their own. Null columns have no terms. A prefix may stand for any number of words.
    """
    tree = parse_query(query, plain)
    tree = _stem_query(tree) if stemmed else tree
    terms = term_strings(frames, stemmed)
    size = sum((F.length(f"t_{c}") - F.length(F.replace(F.col(f"t_{c}"), F.lit(" "))) - 1 for c in COLUMNS), F.lit(0))
    groups = [leaf for leaf in dict.fromkeys(_leaves(tree)) if isinstance(leaf, Near) and len(leaf.parts) > 1]
    terms = terms.withColumns({f"n{n}": _near_hits(group) for n, group in enumerate(groups)})
    hits, scores, counted = [], [], []
    for leaf in dict.fromkeys(_leaves(tree)):
        near = leaf in groups and [F.col(f"n{groups.index(leaf)}")[k] for k in range(len(leaf.parts))]
        hits.append(F.least(*near) if near else _phrase_hits(_only(leaf)))
    for leaf in _leaves(tree):
        near = leaf in groups and [F.col(f"n{groups.index(leaf)}")[k] for k in range(len(leaf.parts))]
        counted += [_phrase_hits(p) for p in (leaf.parts if near else [_only(leaf)])]
        scores += near or [_phrase_hits(_only(leaf))]
    columns = [c.alias(f"{name}{i}") for name, every in (("h", hits), ("f", scores), ("g", counted)) for i, c in enumerate(every)]
    rows = terms.select("id", "timestamp", size.alias("size"), *columns)
    return _scored(rows, tree, rows.agg(F.count(F.lit(1)).alias("total"), F.avg("size").alias("mean_size")))


def _only(leaf) -> Phrase:
    """The phrase of a leaf that is one, also of a NEAR group of one."""
    return _within(leaf.parts[0], leaf.columns) if isinstance(leaf, Near) else leaf


class SearchIndex:
    """Postings of stems at ``path`` (any Hadoop file system), kept in step with a history by :meth:`add`.

    ``postings``: ``term, id, column, positions`` sorted by term; a frequent term is spread over files by its ids.
    ``sizes``: ``id, timestamp, size`` of each frame. Ids must be unique, as a store's are.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, frames: DataFrame, segment: str | None = None) -> None:
        """Indexes more frames as a segment of its own; only a segment of the same name is written again."""
        segment = segment or uuid.uuid4().hex
        terms = term_strings(frames)
        size = sum((F.size(F.split(F.trim(f"t_{c}"), " ")) - (F.trim(f"t_{c}") == "").cast("int") for c in COLUMNS), F.lit(0))
        terms.select("id", "timestamp", size.alias("size")).write.mode("overwrite").parquet(f"{self.path}/sizes/segment={segment}")
        texts = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("column"), F.col(f"t_{c}").alias("t")) for i, c in enumerate(COLUMNS)]))
        single = terms.select("id", texts.alias("x")).where(F.trim("x.t") != "")
        single = single.select("id", "x.column", F.posexplode(F.split(F.trim("x.t"), " ")).alias("position", "term"))
        postings = single.groupBy("id", "column", "term").agg(F.array_sort(F.collect_list("position")).alias("positions"))
        postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{self.path}/postings/segment={segment}")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("term string, id long, column tinyint, positions array<int>").parquet(f"{self.path}/postings/*")

    def sizes(self) -> DataFrame:
        return self.spark.read.schema("id long, timestamp double, size int").parquet(f"{self.path}/sizes/*")

    def matching(self, query: str, plain: bool = False) -> DataFrame:
        """As :func:`matching`, reading the postings of the query's terms alone."""
        tree = _stem_query(parse_query(query, plain))
        leaves, phrases = list(dict.fromkeys(_leaves(tree))), _phrases(tree)
        asked = list(dict.fromkeys((w, p.prefix and j == len(p.words) - 1) for p in phrases for j, w in enumerate(p.words)))
        tests = [F.col("term").startswith(w) if prefix else F.col("term") == w for w, prefix in asked] or [F.lit(False)]
        found = self.postings().where(reduce(lambda a, b: a | b, tests))
        places = [F.array_sort(F.flatten(F.collect_list(F.when(t, F.col("positions"))))).alias(f"p{i}") for i, t in enumerate(tests)]
        cells = found.groupBy("id", "column").agg(*places)

        def starts(phrase: Phrase) -> Column:
            words = [F.col(f"p{asked.index((w, phrase.prefix and j == len(phrase.words) - 1))}") for j, w in enumerate(phrase.words)]
            if not words:
                return F.array().cast("array<int>")
            at = F.filter(words[0], lambda x: reduce(lambda a, b: a & b, [F.array_contains(w, x + j) for j, w in enumerate(words)]))
            at = F.filter(at, lambda x: x == 0) if phrase.first else at
            return F.when(F.col("column").isin([COLUMNS.index(c) for c in phrase.columns]), at).otherwise(F.array().cast("array<int>"))

        groups = [leaf for leaf in leaves if isinstance(leaf, Near) and len(leaf.parts) > 1]
        for n, leaf in enumerate(groups):
            places = [starts(_within(p, leaf.columns)) for p in leaf.parts]
            cells = cells.withColumn(f"n{n}", _near_places([len(p.words) for p in leaf.parts], leaf.distance)(*places))
        hits, scores, counted = [], [], []
        for leaf in leaves:
            near = leaf in groups and [F.col(f"n{groups.index(leaf)}")[k] for k in range(len(leaf.parts))]
            hits.append(F.least(*near) if near else F.size(starts(_only(leaf))))
        for leaf in _leaves(tree):
            near = leaf in groups and [F.col(f"n{groups.index(leaf)}")[k] for k in range(len(leaf.parts))]
            counted += [F.size(starts(p)) for p in (leaf.parts if near else [_only(leaf)])]
            scores += near or [F.size(starts(_only(leaf)))]
        names = [(f"{name}{i}", c) for name, every in (("h", hits), ("f", scores), ("g", counted)) for i, c in enumerate(every)]
        rows = cells.select("id", *[c.alias(n) for n, c in names]).groupBy("id").agg(*[F.sum(n).alias(n) for n, _ in names])
        sizes = self.sizes()
        whole = sizes.agg(F.count(F.lit(1)).alias("total"), F.avg("size").alias("mean_size"))
        return _scored(rows.join(sizes, "id"), tree, whole)


def _snippet(value: str | None, tests: list) -> str:
    """At most SNIPPET_TOKENS tokens of the text around its hits, which are marked; the head if there are none."""
    if not value:
        return ""
    spans = [(m.start(), m.end(), "".join(_fold(m.group()))) for m in re.finditer(r"[^\W_]+", value)]
    marks = [any(test(s[2]) for test in tests) for s in spans]
    start = 0
    if len(spans) > SNIPPET_TOKENS and any(marks):
        best = max(range(len(spans) - SNIPPET_TOKENS + 1), key=lambda i: (sum(marks[i : i + SNIPPET_TOKENS]), -i))
        start = best
    end = min(len(spans), start + SNIPPET_TOKENS)
    if not spans:
        return value
    out, at = ("..." if start else ""), spans[start][0] if start else 0
    for (a, b, _), mark in zip(spans[start:end], marks[start:end]):
        out += value[at:a] + (">>>" + value[a:b] + "<<<" if mark else value[a:b])
        at = b
    return out + ("..." if end < len(spans) else value[at:])


def with_snippets(found: DataFrame, query: str, stemmed: bool = True, plain: bool = False) -> DataFrame:
    """Replaces ``text`` by its snippet; meant for the few rows of a result."""
    words = [(w, p.prefix and i == len(p.words) - 1) for p in _phrases(parse_query(query, plain)) for i, w in enumerate(p.words)]

    norm = stem if stemmed else (lambda w: w)
    tests = [(lambda t, w=w, pre=pre: norm(t).startswith(norm(w)) if pre else norm(t) == norm(w)) for w, pre in words]

    @F.pandas_udf(T.StringType())
    def snippet(values: pd.Series) -> pd.Series:
        return values.map(lambda value: _snippet(value, tests))

    # Not deterministic as far as Catalyst knows: filters on snippets must not be pushed below the join to all frames.
    return found.withColumn("text", snippet.asNondeterministic()("text"))


def search(frames: DataFrame, query: str, limit: int = 20, stemmed: bool = True, plain: bool = False, index: SearchIndex | None = None) -> DataFrame:
    """Result rows with ``rank``, best first, ties by id; ``text`` is a snippet. With an ``index`` no frame is searched."""
    found = index.matching(query, plain) if index is not None else matching(frames, query, stemmed, plain)
    top = found.orderBy("rank", "id").limit(limit)
    joined = entries(frames).join(F.broadcast(top.select("id", "rank")), "id")  # at most ``limit`` rows
    return with_snippets(joined, query, stemmed, plain).orderBy("rank", "id")


def smart_search(frames: DataFrame, query: str, limit: int = 20, project: str | None = None, exclude_heartbeats: bool = True, stemmed: bool = True, index: SearchIndex | None = None) -> DataFrame:
    """Re-ranked search: 3 for the query in the title, 2 in the application, 1 in the snippet's first 200 characters."""
    found = search(frames, query, limit * OVERFETCH, stemmed, index=index)
    if exclude_heartbeats:
        found = found.where(~F.col("text").contains("[heartbeat"))
    if project:
        found = found.where(F.lower("project").contains(project.lower()))
    asked = query.lower()
    score = (
        F.when(F.lower("window_title").contains(asked), 3).otherwise(0)
        + F.when(F.lower("app_name").contains(asked), 2).otherwise(0)
        + F.when(F.lower(F.substring("text", 1, 200)).contains(asked), 1).otherwise(0)
    )
    return found.withColumn("score", score).orderBy(F.desc("score"), "rank", "id").limit(limit)


def substring_search(frames: DataFrame, query: str, now: float, limit: int = 20) -> DataFrame:
    """Search of decrypted rows by substring, in two stages; ``stage`` tells which.

    First the newest ``5 * limit`` frames whose application or project holds the query, of which those whose text,
    title or context holds it are hits; then, among the newest 500 of the last two hours, hits not seen yet.
    """
    asked = query.lower()
    inside = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(asked) for c in ("text", "window_title", "extra_context")])
    named = frames.where(F.col("app_name").ilike(f"%{query}%") | F.col("project").ilike(f"%{query}%"))
    first = named.orderBy(F.desc("timestamp"), F.desc("id")).limit(5 * limit).where(inside).withColumn("stage", F.lit(1))
    second = frames.where(F.col("timestamp") > F.lit(now - 7200.0)).orderBy(F.desc("timestamp"), F.desc("id")).limit(500)
    second = second.where(inside).join(first.select("id"), "id", "left_anti").withColumn("stage", F.lit(2))
    both = first.select(*ENTRY, "stage").unionByName(second.select(*ENTRY, "stage"))
    return both.orderBy("stage", F.desc("timestamp"), F.desc("id")).limit(limit)
