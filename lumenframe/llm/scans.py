"""Repair of text read off scanned pages: page headers and numbers, divided words, misrecognised characters.

A first pass over the texts finds the layout of each (lines repeated, up to misreadings, at page edges; sequences of
page numbers) and counts the corpus's words, combined per batch before they are shuffled. Against this vocabulary

* a division at a line end is undone where the joined word is known, or where its parts aren't words by themselves;
* a rare word is a misreading where undoing a known confusion of characters gives a far more frequent word.

Both decisions are made once for each distinct word. A second pass applies the table of misreadings, which holds
distinct words only; it is sent to the workers if it is within a checked size and joined by shuffle otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.runtime import materialize

FIELDS = ("text", "window_title")
#: A misreading's true word is at least so many times as frequent; less is asked of words with a digit inside.
RATIO, RATIO_DIGIT = 12, 3
BROADCAST_WORDS = 300_000
SIMILAR = 0.84
#: Longer runs of letters and digits are encoded data, no words; lines of other lengths are headers only where they repeat exactly.
LONGEST_WORD, FUZZY_LINE = 256, (8, 200)

TOKEN = re.compile(r"[^\W_]+")
#: Addresses are identifiers: their parts are no words.
ADDRESS = re.compile(r"[\w.+-]+ ?(?:@|\(at\)|\[at\]) ?\S+", re.I)
NUMBERS = [
    re.compile(p, re.I)
    for p in (
        r"^\[\s*(?P<n>\d{1,4})\s*\]$",
        r"^(?:p|pp|s)\.\s*(?P<n>\d{1,4})$",
        r"^(?:page|seite|página|pagina)\s+(?P<n>\d{1,4})(?:\s+(?:of|von|sur|de)\s+\d{1,4})?$",
        r"^(?P<n>\d{1,4})\s*/\s*\d{1,4}$",
        r"^[-–—]\s*(?P<n>\d{1,4})\s*[-–—]$",
        r"^(?P<n>\d{1,4})$",
        r"^(?P<r>[ivxlc]{1,8})$",
        r"^(?P<n>\d{1,4})\s{2,}(?P<h>\D.*)$",
        r"^(?P<h>.*\D)\s+\|\s+(?P<n>\d{1,4})$",
    )
]
BESIDE_HEADER = {7, 8}
#: What every number line begins or ends with; texts without it have none.
MAY_NUMBER = re.compile(
    r"^[ \t]*(?:\[\s*\d{1,4}\s*\]|(?:pp?|s|page|seite|página|pagina)[. ]\s*\d|[-–—]?\s*\d{1,4}\s*(?:[-–—]|/\s*\d{1,4})?[ \t\r]*$|\d{1,4}\s\s|[ivxlc]{1,8}[ \t\r]*$)"
    r"|\|\s+\d{1,4}[ \t\r]*$",
    re.I | re.M,
)
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
MAY_DIVIDE = re.compile(r"[-\u00ad‐‑¬]\s*\n")
HYPHEN = re.compile(r"([^\W_]+)[-­‐‑¬]$")
#: Confusions of characters: as read, as written.
CONFUSIONS = [("rn", "m"), ("m", "rn"), ("c", "e"), ("e", "c"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("ff", "fi"), ("ff", "fl"), ("fl", "fi"), ("ii", "u"), ("li", "h"), ("l", "i"), ("i", "l"), ("h", "b"), ("b", "h"), ("u", "v"), ("v", "u"), ("ri", "n"), ("q", "g"), ("g", "q")]
DIGITS = {"0": "o", "1": "li", "2": "z", "3": "e", "4": "a", "5": "s", "6": "b", "7": "i", "8": "b", "9": "g"}


def _roman(s: str) -> int:
    values = [ROMAN[c] for c in s.lower()]
    return sum(-v if i + 1 < len(values) and values[i + 1] > v else v for i, v in enumerate(values))


def _plain(line: str) -> str:
    return " ".join(line.lower().rstrip(".").split())


def page_furniture(lines: list) -> tuple[dict, set]:
    """(numbers, headers): line index -> kind of number line, and the indices of header lines of one text.

    A page number is a member of a sequence: two or more number lines of one form, each one or two more than the one before,
    never on neighbouring lines as figures in a column are. Headers are short lines that repeat, up to misreadings,
    at the top of pages: as the first line, beside a page number or with one on the same line.
    """
    found: dict = {}
    for i, line in enumerate(lines if MAY_NUMBER.search("\n".join(lines)) else ()):
        bare = line.strip()
        if not bare:
            continue
        for k, pattern in enumerate(NUMBERS):
            m = pattern.match(bare)
            if m:
                groups = m.groupdict()
                value = int(groups["n"]) if groups.get("n") else _roman(groups["r"])
                found.setdefault(7 if k in BESIDE_HEADER else k, []).append((i, value, groups.get("h")))
                break
    numbers: dict = {}
    beside: dict = {}
    for kind, items in found.items():
        run = [items[0]]
        for item in [*items[1:], None]:
            if item and 1 <= item[1] - run[-1][1] <= 2 and item[0] > run[-1][0] + 1:
                run.append(item)
                continue
            if len(run) > 1 and (kind != 7 or SequenceMatcher(None, _plain(run[0][2]), _plain(run[1][2])).ratio() >= SIMILAR):
                for i, _, header in run:
                    numbers[i] = kind
                    if header:
                        beside[i] = _plain(header)
            run = [item]
    content = [i for i, line in enumerate(lines) if line.strip() and i not in numbers]
    plain = {i: _plain(lines[i]) for i in content if len(lines[i]) > 2}
    plain = {i: p for i, p in plain.items() if len(p) > 2 and not any(pattern.match(lines[i].strip()) for pattern in NUMBERS[:7])}
    edges = set(content[:1])
    for i in numbers:
        if i in beside:
            continue
        j = i + 1
        while j < len(lines) and not lines[j].strip():
            j += 1
        edges.add(j)
        edges.add(i - 1)
    headers = set(beside)
    for i in sorted(edges & plain.keys()) if not beside else ():
        same = [j for j, p in plain.items() if j != i and abs(len(p) - len(plain[i])) <= 4 and _similar(plain[i], p)]
        if same and max(abs(j - i) for j in same) > 1:
            headers.update([i, *same])
            break  # a document has one name; lines below it may well repeat
    if beside:
        name = next(iter(beside.values()))
        headers.update(j for j, p in plain.items() if _similar(name, p))
    return numbers, headers


def _similar(a: str, b: str) -> bool:
    """Whether two lines are the same up to misreadings: at least SIMILAR by matching blocks of characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 4 or not FUZZY_LINE[0] <= min(len(a), len(b)) <= max(len(a), len(b)) <= FUZZY_LINE[1]:
        return False
    common = sum((_letters(a) & _letters(b)).values())  # matching blocks hold no more characters than both lines share
    return 2 * common >= SIMILAR * (len(a) + len(b)) and SequenceMatcher(None, a, b, autojunk=False).ratio() >= SIMILAR


@lru_cache(maxsize=10_000)
def _letters(line: str) -> Counter:
    return Counter(line)


def _layout(value: str) -> tuple[list, list, set, list]:
    """(kept lines, their divisions, kinds, all lines) of one text."""
    lines = value.split("\n")
    numbers, headers = page_furniture(lines) if len(lines) > 2 else ({}, set())
    kinds = set()
    if numbers:
        kinds.add("page_number")
    if headers:
        kinds.add("header")
    kept = [line for i, line in enumerate(lines) if i not in numbers and i not in headers]
    return kept, _divisions(kept), kinds, lines


def _divisions(kept: list) -> list:
    """(line, next line, left part, right part) where a word may be divided at a line end."""
    out = []
    for i, line in enumerate(kept[:-1]):
        m = HYPHEN.search(line.rstrip())
        if not m:
            continue
        j = i + 1
        while j < len(kept) and not kept[j].strip():
            j += 1
        if j == len(kept):
            continue
        n = TOKEN.match(kept[j].lstrip())
        left = m.group(1)
        if not n or not any(map(str.isalpha, left)) or not any(map(str.isalpha, n.group())):
            continue
        if n.group()[0].isupper() and not left.isupper():
            continue
        out.append((i, j, left, n.group()))
    return out


def _tokens_of(value: str) -> list:
    if "@" in value or "at)" in value or "at]" in value:
        value = ADDRESS.sub(" ", value)
    return TOKEN.findall(value)


def _words(kept: list, divisions: list):
    """Tokens of a text, the parts of divided words left out."""
    if not divisions:
        yield from _tokens_of("\n".join(kept))
        return
    ends, starts = {d[0] for d in divisions}, {d[1] for d in divisions}
    for i, line in enumerate(kept):
        tokens = _tokens_of(line)
        if i in ends:
            tokens = tokens[:-1]
        if i in starts:
            tokens = tokens[1:]
        yield from tokens


def _furniture_words(kept: list, lines: list) -> list:
    """Tokens of the lines that were taken out, each different line once."""
    return _tokens_of("\n".join(set(lines).difference(kept)))


def _survey(batches):
    """Layout findings (id, field, kind, left, right) and word counts (word, n) of each batch."""
    for batch in batches:
        counts: Counter = Counter()
        rows: list = []
        keys = batch.column(0).to_pylist()
        for field, column in zip(FIELDS, batch.columns[1:]):
            for key, value in zip(keys, column.to_pylist()):
                if not value or value.startswith("ENC:"):
                    continue
                if "\n" not in value:
                    counts.update(_tokens_of(value))
                    continue
                kept, divisions, kinds, lines = _layout(value)
                counts.update(_words(kept, divisions))
                if kinds:
                    counts.update(_furniture_words(kept, lines))
                rows += [(key, field, kind, None, None, None) for kind in kinds]
                rows += [(key, field, "hyphenation", left, right, None) for _, _, left, right in divisions]
        rows += [(None, None, None, word, None, n) for word, n in counts.items() if not word.isdigit() and len(word) <= LONGEST_WORD]
        arrays = list(zip(*rows)) or [[]] * 6
        types = [pa.int64(), *[pa.string()] * 4, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], names=["k", "field", "kind", "a", "b", "n"])


_SURVEY = "k long, field string, kind string, a string, b string, n long"


def readings(word: str) -> dict:
    """What may have been written where ``word`` was read, in lower case, with the frequency ratio asked of it."""
    out: dict = {}
    if len(word) > LONGEST_WORD:
        return out
    low = word.lower()
    digits = [c for c in low if c.isdigit()]
    letters = len(low) - len(digits)
    if digits:
        # Letters read as digits: all of them, each by its first or second likeness.
        if letters >= 1 and len(digits) <= 3 and not low.isdigit() and (letters >= len(digits)) and all(c in DIGITS for c in digits):
            for pick in (0, -1):
                v = "".join(DIGITS[c][pick] if c.isdigit() else c for c in low)
                if len(v) > 2 or not word[-1].isdigit():
                    out[v] = RATIO_DIGIT
                    for extra, ratio in readings(v).items() if len(v) > 4 else ():
                        out.setdefault(extra, ratio)
        return out
    if word[0] == "J" and "J" in word[1:] and word[1:2].islower():
        out[word[1:].split("J")[0].lower()] = RATIO
        return out
    if len(low) < 4:
        return out
    for read, written in CONFUSIONS:
        at = low.find(read)
        if at >= 0 and low.count(read) > 1:
            out[low.replace(read, written)] = RATIO
        while at >= 0:
            out[low[:at] + written + low[at + len(read) :]] = RATIO
            at = low.find(read, at + 1)
    if low[0] == low[1]:
        out[low[1:]] = RATIO
    if not word.isupper():
        for c in "HN":
            if c in word:
                out[word.replace(c, "w").lower()] = RATIO
    out.pop(low, None)
    return out


def _readings(batches):
    for batch in batches:
        words, numbers, read, ratios = [], [], [], []
        for word, n, low_n in zip(*(c.to_pylist() for c in batch.columns)):
            for v, ratio in readings(word).items():
                words.append(word)
                numbers.append(max(n, low_n))
                read.append(v)
                ratios.append(ratio)
        types = [pa.string(), pa.int64(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip((words, numbers, read, ratios), types)], names=["word", "n", "low", "ratio"])


def survey(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layout, vocabulary, divided): findings, ``low, n`` of each word, and candidates of divided words."""
    rows = frames.select(F.col("id").cast("long").alias("k"), *FIELDS).mapInArrow(_survey, _SURVEY)
    rows = materialize(rows)
    words = materialize(rows.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")))
    divided = rows.where("kind = 'hyphenation'").select("k", "field", "a", "b", F.lower(F.concat("a", "b")).alias("low"))
    return rows.where("n is null and kind <> 'hyphenation'").select("k", "field", "kind"), words, divided


def misreadings(words: DataFrame, divided: DataFrame) -> DataFrame:
    """``word, true_word`` of each distinct word that is a misreading, divided words included."""
    low = words.groupBy(F.lower("word").alias("low")).agg(F.sum("n").alias("low_n"))
    low = materialize(low)
    joined = divided.select(F.concat("a", "b").alias("word")).distinct().join(words.select("word"), "word", "left_anti")
    every = words.unionByName(joined.withColumn("n", F.lit(1).cast("long"))).withColumn("low", F.lower("word"))
    every = every.join(low, "low", "left").select("word", "n", F.coalesce("low_n", F.lit(0)).alias("low_n"))
    candidates = every.mapInArrow(_readings, "word string, n long, low string, ratio int")
    better = candidates.join(low, "low").where(F.col("low_n") >= F.col("n") * F.col("ratio"))
    return better.groupBy("word").agg(F.max_by("low", F.struct("low_n", "low")).alias("true_word"))


def divided_words(words: DataFrame, divided: DataFrame, wrong: DataFrame) -> DataFrame:
    """Candidates that are divided words: known when joined, misread when joined, or made of parts that are no words."""
    low = words.groupBy(F.lower("word").alias("low")).agg(F.sum("n").alias("n"))
    pairs = divided.select("a", "b", "low").distinct()
    pairs = pairs.join(low.withColumnRenamed("n", "whole"), "low", "left")
    pairs = pairs.join(wrong.select(F.col("word").alias("w"), F.lit(1).alias("misread")), F.concat("a", "b") == F.col("w"), "left").drop("w")
    for part in ("a", "b"):
        pairs = pairs.join(low.select(F.col("low").alias("p"), F.col("n").alias(f"n_{part}")), F.lower(part) == F.col("p"), "left").drop("p")
    parts_are_words = (F.coalesce("n_a", F.lit(0)) > 2) & (F.coalesce("n_b", F.lit(0)) > 2)
    return pairs.where(F.col("whole").isNotNull() | F.col("misread").isNotNull() | ~parts_are_words).select("a", "b")


def _frames_tokens(batches):
    """(id, field, word) of each distinct word: the way for a table of misreadings too large to send out."""
    for batch in batches:
        keys, fields, words = [], [], []
        for field, column in zip(FIELDS, batch.columns[1:]):
            for key, value in zip(batch.column(0).to_pylist(), column.to_pylist()):
                for word in _tokens(value):
                    keys.append(key)
                    fields.append(field)
                    words.append(word)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fields, pa.string()), pa.array(words, pa.string())], names=["k", "field", "word"])


def _tokens(value) -> set:
    if not value or value.startswith("ENC:"):
        return set()
    if "\n" not in value:
        return set(_tokens_of(value))
    if not MAY_DIVIDE.search(value):
        return set(_tokens_of(value))
    kept, divisions, kinds, lines = _layout(value)
    words = set(_words(kept, divisions))
    words.update(left + right for _, _, left, right in divisions)
    if kinds:  # words of headers are looked up like all others
        words.update(_furniture_words(kept, lines))
    return words


def _frames_misread(table):
    def run(batches):
        known = table.value
        for batch in batches:
            keys, fields = [], []
            for field, column in zip(FIELDS, batch.columns[1:]):
                for key, value in zip(batch.column(0).to_pylist(), column.to_pylist()):
                    if not known.keys().isdisjoint(_tokens(value)):
                        keys.append(key)
                        fields.append(field)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fields, pa.string())], names=["k", "field"])

    return run


def scan_noise(frames: DataFrame) -> DataFrame:
    """``id, field, kind``: one row per frame, field and kind of noise it holds at least once.

    Null, empty and blank values and ENC: ciphertext hold none. Rows of one id that repeat give one row. Texts of any
    length are judged whole. Extra columns are not read. An empty table gives no rows.
    """
    spark = frames.sparkSession
    layout, words, divided = survey(frames)
    wrong = materialize(misreadings(words, divided))
    true_divisions = divided_words(words, divided, wrong)
    hyphens = divided.join(true_divisions, ["a", "b"], "left_semi").select("k", "field").withColumn("kind", F.lit("hyphenation"))
    values = frames.select(F.col("id").cast("long").alias("k"), *FIELDS)
    if wrong.count() <= BROADCAST_WORDS:
        table = spark.sparkContext.broadcast(dict(wrong.collect()))
        misread = values.mapInArrow(_frames_misread(table), "k long, field string")
    else:
        tokens = values.mapInArrow(_frames_tokens, "k long, field string, word string")
        misread = tokens.join(wrong.select("word"), "word").select("k", "field")
    misread = misread.withColumn("kind", F.lit("misread"))
    found = layout.unionByName(hyphens).unionByName(misread).distinct()
    return found.select(F.col("k").alias("id"), "field", "kind")


def _cased(word: str, true_word: str) -> str:
    return true_word.upper() if word.isupper() and len(word) > 1 else true_word.capitalize() if word[0].isupper() or word[0].isdigit() and false_start(word) else true_word


def false_start(word: str) -> bool:
    """A digit read at the start of a word whose second letter is small: a capital, as in 0pen."""
    return word[0] == "0" and word[1:2].islower()


def _repaired(value, known: dict, divisions_ok: set):
    if not value or value.startswith("ENC:"):
        return value
    kept, divisions, kinds, _ = _layout(value)
    joined = {(i, j): left + right for i, j, left, right in divisions if (left, right) in divisions_ok}
    scanned = bool(kinds or joined)
    lines = [line.rstrip() for line in kept]
    for (i, j), word in reversed(joined.items()):
        right = TOKEN.match(lines[j].lstrip()).end()
        stripped = lines[j].lstrip()
        lines[i] = HYPHEN.sub("", lines[i]) + word
        lines[j] = stripped[right:].lstrip(" ") if stripped[right : right + 1].isspace() else stripped[right:]
        if lines[j][:1] and not lines[j][:1].isalnum():  # punctuation stays with its word
            k = next((x for x, c in enumerate(lines[j]) if c.isspace() or c.isalnum()), len(lines[j]))
            lines[i], lines[j] = lines[i] + lines[j][:k], lines[j][k:].lstrip()
        for k in range(i + 1, j):
            lines[k] = "\u0000"
    if scanned:
        out: list = []
        for line in lines:
            if line == "\u0000":
                continue
            bare = line.strip()
            if out and bare and out[-1]:
                out[-1] += " " + bare
            elif out and not bare and out[-1] and not re.search(r"[.?!:]['\"”)]*$", out[-1]):
                continue  # a page break within a sentence is no end of a paragraph
            else:
                out.append(bare)
        text = "\n".join(line for line in out if line)
    else:
        text = value

    def true(m):
        word = m.group()
        if word not in known:
            return word
        if word[0] == "J" and "J" in word[1:]:
            return word.replace("J", "/")
        return _cased(word, known[word])

    return TOKEN.sub(true, text)


def _value_divisions(batches):
    """(h, value) to (h, a, b) of each place where a word may be divided."""
    for batch in batches:
        rows = [
            (h, left, right)
            for h, value in zip(*(c.to_pylist() for c in batch.columns))
            if not value.startswith("ENC:")
            for _, _, left, right in _layout(value)[1]
        ]
        arrays = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in arrays], names=["h", "a", "b"])


def _joined_words(batches):
    """(h, value, joins) to (h, word) of each word of the value after its divided words are joined."""
    for batch in batches:
        rows = [
            (h, word)
            for h, value, joins in zip(*(c.to_pylist() for c in batch.columns))
            if not value.startswith("ENC:")
            for word in set(TOKEN.findall(_repaired(value, {}, _pairs(joins))))
        ]
        arrays = list(zip(*rows)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in arrays], names=["h", "word"])


def _pairs(joins) -> set:
    return {(j["a"], j["b"]) for j in joins or ()}


def _repaired_alone(batches):
    """(id, and value, joins, fixes of each field) to the repaired fields."""
    for batch in batches:
        keys, *columns = (c.to_pylist() for c in batch.columns)
        fields = []
        for k in range(0, len(columns), 3):
            fields.append(pa.array([_repaired(v, {f["word"]: f["true_word"] for f in x or ()}, _pairs(j)) for v, j, x in zip(*columns[k : k + 3])], pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *fields], names=["id", *FIELDS])


def _repaired_by_shuffle(values: DataFrame, wrong: DataFrame, pairs: DataFrame) -> DataFrame:
    """What :func:`repair_scans` gives, where the tables are too large to send out: words are looked up by distinct value."""
    every = values.select(F.explode(F.array(*FIELDS)).alias("value")).where("value <> ''").distinct().select(F.sha2("value", 256).alias("h"), "value")
    divided = every.mapInArrow(_value_divisions, "h string, a string, b string").distinct()
    joins = materialize(divided.join(pairs, ["a", "b"]).groupBy("h").agg(F.collect_list(F.struct("a", "b")).alias("joins")))
    words = every.join(joins, "h", "left").mapInArrow(_joined_words, "h string, word string")
    fixes = materialize(words.join(wrong, "word").groupBy("h").agg(F.collect_list(F.struct("word", "true_word")).alias("fixes")))
    for field in FIELDS:
        values = values.withColumn("h", F.sha2(field, 256)).join(joins.withColumnRenamed("joins", f"joins_{field}"), "h", "left")
        values = values.join(fixes.withColumnRenamed("fixes", f"fixes_{field}"), "h", "left").drop("h")
    columns = [c for field in FIELDS for c in (field, f"joins_{field}", f"fixes_{field}")]
    return values.select("id", *columns).mapInArrow(_repaired_alone, "id long, text string, window_title string")


def repair_scans(frames: DataFrame) -> DataFrame:
    """``id, text, window_title`` as continuous readable paragraphs and titles; every row comes out.

    Page headers and numbers go, divided words are joined, lines of scanned pages run on within a paragraph, misread
    words are written as the corpus writes them. Values without noise stay as they are, nulls stay null.
    The tables of misreadings and divisions hold distinct words; beyond BROADCAST_WORDS of them each value gets its
    own entries by shuffle. Either way a value is repaired once, with all entries that concern it.
    """
    spark = frames.sparkSession
    _, words, divided = survey(frames)
    wrong = materialize(misreadings(words, divided))
    pairs = materialize(divided_words(words, divided, wrong))
    values = frames.select(F.col("id").cast("long").alias("id"), *FIELDS)
    if max(wrong.count(), pairs.count()) > BROADCAST_WORDS:
        return _repaired_by_shuffle(values, wrong, pairs)
    table = spark.sparkContext.broadcast((dict(wrong.collect()), {tuple(r) for r in pairs.collect()}))

    def run(batches):
        known, ok = table.value
        for batch in batches:
            fields = [pa.array([_repaired(v, known, ok) for v in c.to_pylist()], pa.string()) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fields], names=["id", *FIELDS])

    return values.mapInArrow(run, "id long, text string, window_title string")
