"""Encoding of a corpus with a public tokenizer through a table of distinct words.

A word here is a run of signs with the blanks in front of it. The tokenizer never joins what stands on both sides of
such a place, so the ids of a text are the ids of its words one after another, and byte-pair merges work within a word.
The corpus is split and counted once (combined per task before the shuffle), each distinct word is encoded once, and the
ids are joined back by position: the texts are split again where they are read and each word is looked up. The most
frequent words, a bounded number of bounded length, are looked up in the workers, which leaves only what is rare to a
shuffle; a text's rare words are joined by word and put back at their positions. No list of positions is ever shuffled.
"""

from __future__ import annotations

import importlib.util
import os
import re
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.runtime import materialize, stored

VOCABULARY = "byte_bpe_50k.json"
#: Words that are sent to the workers: so many of the most frequent, none longer than this.
HOT_WORDS, HOT_WORD_BYTES = 50_000, 256
#: A rare word is one key of a join; one with more than this share of all occurrences is spread over several.
HEAVY_SHARE, HEAVY_COPIES = 1 / 2000, 32
#: Words counted in a task before they are handed on, and token ids in a batch of results.
COUNTED, BATCH_IDS = 200_000, 1_000_000
#: Signs of a word beyond which it is divided as the tokenizer divides it.
LONG_WORD = 64

# The blanks of the tokenizer's splitting rule.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """``folder``, else LUMENFRAME_TOKENIZERS, else the installed public_tokenizers package, else /opt/tokenizers."""
    folder = folder or os.environ.get("LUMENFRAME_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # text that looks like a special token is ordinary text
    return tokenizer


def words_of(text: str, tokenizer):
    """Lists of the words of a text, which are the text again when joined; a long text gives several lists."""
    if len(text) < 1_000_000:
        lists = [_WORD.findall(text)]
    else:
        found = (m.group() for m in _WORD.finditer(text))
        lists = iter(lambda: list(islice(found, 100_000)), [])
    for words in lists:
        if max(map(len, words), default=0) > LONG_WORD:
            words = [x for w in words for x in (_divided(w, tokenizer) if len(w) > LONG_WORD else (w,))]
        yield words


def _divided(word: str, tokenizer) -> list:
    return [word[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(word)]


def _counted(path: str):
    """(text) to (word, n): words counted in the task."""

    def run(batches):
        tokenizer, counts = _tokenizer(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in words_of(text, tokenizer) if text else ():
                    counts.update(words)
                    if len(counts) > COUNTED:
                        yield _count_rows(counts)
                        counts = Counter()
        yield _count_rows(counts)

    return run


def _count_rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _encoded(path: str):
    """Adds the ids of each word."""

    def run(batches):
        encode = _tokenizer(path).encode
        for batch in batches:
            ids = [encode(word, add_special_tokens=False).ids for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


class _Table(dict):
    """Words to ids; an unknown word stands as the negative number, from -1 down, of its place among the text's unknown words."""

    def __init__(self, known: dict):
        super().__init__(known)
        self.unknown: dict = {}

    def __missing__(self, word):
        return (-1 - self.unknown.setdefault(word, len(self.unknown)),)


_RARE = "array<struct<word:string,times:int>>"


def _looked_up(path: str, known):
    """(kept columns, text) to the kept columns, the text's ids and its words that aren't known."""

    def run(batches):
        tokenizer, table = _tokenizer(path), _Table(known.value)
        for batch in batches:
            *kept, texts = batch.columns
            start, ids, ends, rare = 0, array("i"), [], []
            for at, text in enumerate(texts.to_pylist()):
                for words in words_of(text, tokenizer) if text else ():
                    ids.extend(chain.from_iterable(map(table.__getitem__, words)))
                rare.append([(w, 1) for w in table.unknown])
                table.unknown = {}
                ends.append(len(ids))
                if len(ids) > BATCH_IDS or at + 1 == len(texts):
                    flat = pa.array(np.frombuffer(ids, dtype=np.int32) if ids else [], pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(np.array([0, *ends], dtype=np.int32)), flat)
                    yield _found_rows(kept, start, at + 1, lists, rare)
                    start, ids, ends, rare = at + 1, array("i"), [], []

    return run


class _Sizes(dict):
    """Words to numbers of ids; unknown words count 0 and are noted with their occurrences."""

    def __init__(self, known: dict):
        super().__init__(known)
        self.unknown: Counter = Counter()

    def __missing__(self, word):
        self.unknown[word] += 1
        return 0


def _measured(path: str, known):
    """(kept columns, text) to the kept columns, the number of ids of the text's known words and its words that aren't known."""

    def run(batches):
        tokenizer, table = _tokenizer(path), _Sizes({w: len(ids) for w, ids in known.value.items()})
        for batch in batches:
            *kept, texts = batch.columns
            sizes, rare = [], []
            for text in texts.to_pylist():
                sizes.append(sum(sum(map(table.__getitem__, words)) for words in words_of(text, tokenizer)) if text else 0)
                rare.append(list(table.unknown.items()))
                table.unknown.clear()
            if sizes:
                yield _found_rows(kept, 0, len(sizes), pa.array(sizes, pa.int64()), rare)

    return run


def _found_rows(kept, start: int, stop: int, values, rare) -> pa.RecordBatch:
    words = pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("times", pa.int32())])))
    names = [f"k{i}" for i in range(len(kept))] + ["value", "rare"]
    return pa.RecordBatch.from_arrays([*(k.slice(start, stop - start) for k in kept), values, words], names=names)


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """``word, n, ids``: each distinct word of column ``text`` with its occurrences and its ids, encoded once."""
    counts = texts.select("text").mapInArrow(_counted(path), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.mapInArrow(_encoded(path), "word string, n long, ids array<int>"))


def _joined(documents: DataFrame, kept: list, text: str, path: str, sizes_only: bool) -> DataFrame:
    """``k0 .. , value``: the kept columns of each row with its ids, or their number."""
    spark = documents.sparkSession
    names = [f"k{i}" for i in range(len(kept))]
    rows = documents.select(*[F.col(c).alias(n) for n, c in zip(names, kept)], F.col(text).alias("text"))
    table = word_table(rows, path)
    hot = table.where(F.octet_length("word") <= HOT_WORD_BYTES).orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect()
    known = spark.sparkContext.broadcast({r.word: tuple(r.ids) for r in hot})
    types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    if sizes_only:
        found = rows.mapInArrow(_measured(path, known), f"{types}, value long, rare {_RARE}")
    else:
        found = rows.mapInArrow(_looked_up(path, known), f"{types}, value array<int>, rare {_RARE}")
    if table.count() == len(hot):
        return found.select(*names, "value")
    found = stored(found.withColumn("r", F.monotonically_increasing_id()))
    done = found.where(F.size("rare") == 0).select(*names, "value")
    # Rare words by shuffle. Heavy ones among them are at most 1 / HEAVY_SHARE many and go over several keys.
    hot_words = F.broadcast(spark.createDataFrame([(r.word,) for r in hot], "word string"))
    left = table.join(hot_words, "word", "left_anti").withColumn("h", F.xxhash64("word"))
    total = table.agg(F.sum("n")).head()[0]
    heavy = F.broadcast(left.where(F.col("n") > F.lit(total * HEAVY_SHARE)).select("h", F.lit(HEAVY_COPIES).alias("copies")).distinct())
    copies = F.coalesce("copies", F.lit(1))
    spread = left.join(heavy, "h", "left").select("word", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), "ids")
    asked = found.select("r", F.posexplode("rare").alias("at", "x")).select("r", "at", "x.word", "x.times", F.xxhash64("x.word").alias("h"))
    asked = asked.join(heavy, "h", "left").withColumn("salt", F.pmod(F.xxhash64("r", "at"), copies).cast("int"))
    met = asked.join(spread, ["word", "salt"])
    rest = found.where(F.size("rare") > 0)
    if sizes_only:
        more = met.groupBy("r").agg(F.sum(F.size("ids") * F.col("times").cast("long")).alias("more"))
        rest = rest.join(more, "r").withColumn("value", F.col("value") + F.col("more"))
    else:
        parts = met.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        each = F.transform("value", lambda x: F.when(x < 0, F.element_at("parts", -x)["ids"]).otherwise(F.array(x)))
        rest = rest.join(parts, "r").withColumn("value", F.flatten(each))
    return done.unionByName(rest.select(*names, "value"))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key, ids``: one row for each row of ``documents`` with the token ids of its text, without special tokens.

    Null and empty texts both give an empty list. Every row comes out, also where keys repeat or are null. Extra
    columns are not read. Very long texts are encoded whole. An empty table gives no rows. The vocabulary's file is a
    parameter and must be readable on every executor. The splitting rule is that of byte-level vocabularies.
    """
    joined = _joined(documents, [key], text, vocabulary or vocabulary_path(), False)
    return joined.select(F.col("k0").alias(key), F.col("value").alias("ids"))


def token_counts(documents: DataFrame, kept: list | None = None, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The ``kept`` columns (doc_id) and ``n_tokens`` of every row of ``documents``; null and empty texts have 0 tokens.

    By the same table of distinct words, of which only the number of ids is looked up.
    """
    kept = kept or ["doc_id"]
    joined = _joined(documents, kept, text, vocabulary or vocabulary_path(), True)
    return joined.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("value").alias("n_tokens"))


def pieces(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """``token_id, piece``: the bytes of each id; as many rows as the vocabulary has ids."""
    tokenizer = _tokenizer(vocabulary or vocabulary_path())
    # The byte alphabet: printable Latin-1 characters stand for themselves, all other bytes for U+0100 and up.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    rows = [(i, bytearray(byte_of[c] for c in token)) for token, i in tokenizer.get_vocab().items() if all(c in byte_of for c in token)]
    return spark.createDataFrame(rows, "token_id int, piece binary")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``key, text``: the texts of ids through a join with the table of pieces, in order of position.

    An empty list gives ''. The table of pieces is broadcast: it has one row for each id of the fixed vocabulary.
    """
    table = pieces(encoded.sparkSession, vocabulary)
    rows = materialize(encoded.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k"), F.col(ids).alias("ids")))
    tokens = rows.select("r", "k", F.posexplode_outer("ids").alias("at", "token_id"))
    part = F.struct("at", F.hex("piece").alias("x"))
    joined = tokens.join(F.broadcast(table), "token_id", "left").groupBy("r", "k").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), ""))
    return joined.select(F.col("k").alias(key), F.decode(whole, "UTF-8").alias("text"))
