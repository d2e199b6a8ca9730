"""Near-duplicates by LSH forests: several sorted orders of signatures, neighbours with a long common prefix.

Texts. A text's set of distinct words gives 64 MinHash bytes. Equal sets are one representative, whatever their number,
so copies never meet each other in a bucket. Each tree is a sorted order of the representatives by its own signature
bytes; no byte is in two trees, so the trees miss a pair independently. All representatives of a region, those that
share a prefix, meet each other, and those whose sketches agree become candidates; every candidate is verified on the
words themselves. Depth is adapted per region: one of more than OPEN representatives is opened by the prefixes of the
trees behind its own, so that a pair has to share two prefixes there, and not just longer ones of one tree. Regions
which are still too large for one task after that are compared block by block by many tasks. Which prefixes are
frequent is counted first, in a table of fixed size, so that no task ever sorts or holds a frequent one.

Hashes (perceptual). Two 64-bit hashes that differ in fewer than 6 bits agree on at least two of seven blocks of bits,
so the 21 orders that begin with two of the blocks find every such pair: no link is lost. Regions that share two
blocks and are still large are opened deeper by splitting the other five blocks' bits again into seven blocks.

Nothing here is collected on the driver but counts.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.runtime import broadcast_if_small, materialize, shuffle_partitions, stored

THRESHOLD = 0.8
MIN_WORDS = 20
SIGNATURE = 64
TREES = 16
#: Prefix bytes of a tree's regions. A pair of similarity s is missed by all trees with (1 - s ** DEPTH) ** TREES: 0.02 %
#: at the threshold. In opened regions it must share two prefixes: 0.26 % at the threshold, 0.02 % at 0.85.
DEPTH = SIGNATURE // TREES
#: Representatives in a region beyond which it is opened (texts) or compared in blocks by many tasks (hashes, opened regions).
OPEN, SPREAD = 4_000, 20_000
#: Counters of prefixes, and rows of a copied text or of a block beyond which it is spread over several keys.
BUCKETS, COPIES = 1 << 14, 2_000
#: Two bits of 56 signature bytes and one of 8 are compared: at similarity 0.8 12 of the 120 bits differ on average,
#: with a deviation of 3.9, so one true pair in some ten thousand at the very threshold differs in more than this.
SKETCH_BITS, SKETCH_DIFFER = 56, 27
#: Largest filter of ids (2 MB) and largest table of region sizes that are broadcast.
FILTER_BITS, BROADCAST_KEYS = 1 << 24, 100_000
WORD = re.compile(r"[^\W_]+")

_random = np.random.default_rng(7919)
_MULTIPLY = _random.integers(1, 2**63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
_ADD = _random.integers(0, 2**63, SIGNATURE, dtype=np.uint64)
_ORDERS = _random.permutation(SIGNATURE).reshape(TREES, DEPTH)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def word_set(text: str) -> set:
    return set(WORD.findall(text.lower()))


def _signatures(batches):
    """(id, text) to (id, h, g, n, signature) for texts of enough distinct words; h, g: 128-bit hash of the set."""
    for keys, sizes, flat, starts in _hashed_sets(batches):
        with np.errstate(over="ignore"):
            signature = np.empty((len(keys), SIGNATURE), dtype=np.uint8)
            for i in range(SIGNATURE):
                least = np.minimum.reduceat(_mix(flat * _MULTIPLY[i] + _ADD[i]), starts)
                signature[:, i] = (_mix(least) & np.uint64(0xFF)).astype(np.uint8)
        h, g = _set_hash(flat, starts)
        data = pa.Array.from_buffers(
            pa.binary(SIGNATURE), len(keys), [None, pa.py_buffer(np.ascontiguousarray(signature).tobytes())]
        ).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(h), pa.array(g), pa.array(sizes, pa.int32()), data],
            names=["id", "h", "g", "n", "signature"],
        )


_SIGNATURE = "id long, h long, g long, n int, signature binary"


def _set_hash(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set of word hashes, whatever the order of its words."""
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_mix(hashes), starts).view(np.int64)
        g = np.bitwise_xor.reduceat(_mix(hashes + np.uint64(0x9E3779B97F4A7C15)), starts).view(np.int64)
    return h, g


def _hashed_sets(batches, cache=None):
    """(ids, sizes, word hashes of all sets one after another, where each begins) of each batch."""
    cache = {} if cache is None else cache
    for batch in batches:
        keys, sizes, hashes = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = word_set(text) if text else ()
            if len(words) < MIN_WORDS:
                continue
            keys.append(key)
            sizes.append(len(words))
            for w in words:
                h = cache.get(w)
                if h is None:
                    if len(cache) > 1_000_000:
                        cache.clear()
                    h = cache[w] = _word_hash(w)
                hashes.append(h)
        if keys:
            yield keys, sizes, np.array(hashes, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _prefixes(signature: np.ndarray):
    """The key of each tree's prefix, one array a tree. The low four bits are the tree's number."""
    powers = np.uint64(256) ** np.arange(DEPTH, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for tree, order in enumerate(_ORDERS):
            key = _mix(signature[:, order].astype(np.uint64) @ powers + np.uint64(tree << 40))
            yield (key & ~np.uint64(TREES - 1)) | np.uint64(tree)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SIGNATURE)


def _bucket_counts(batches):
    """(signature) to (bucket, n): how many prefixes fall into each of BUCKETS counters; one table a task."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            for keys in _prefixes(_matrix(batch.column(0))):
                counts += np.bincount(_bucket(keys), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])


def _sketches(sizes: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the signature that are compared before texts are; the set's size stands in the low byte of the first."""
    bits = (signature[:, :SKETCH_BITS] & 1).astype(np.uint64)
    scale = np.minimum(255, np.round(32 * np.log(sizes.astype(np.float64)))).astype(np.uint64)
    first = ((bits << np.arange(SKETCH_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8)) | scale
    bits = np.concatenate([signature[:, :SKETCH_BITS] >> 1 & 1, signature[:, SKETCH_BITS:] & 1], axis=1).astype(np.uint64)
    return first, (bits << np.arange(SIGNATURE, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


_ORDER = "key long, id long, sketch long, second long"


def _order_rows(keys, ids, sketch, second) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(ids), pa.array(sketch.view(np.int64)), pa.array(second.view(np.int64))], names=["key", "id", "sketch", "second"]
    )


def _orders(frequent: frozenset, wanted: bool):
    """Each representative once for each tree whose prefix is (``wanted``) or isn't among the frequent ones."""

    def run(batches):
        hot = np.zeros(BUCKETS, dtype=bool)
        hot[list(frequent)] = True
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, signature = np.asarray(batch.column(0)), _matrix(batch.column(2))
            sketch, second = _sketches(np.asarray(batch.column(1)), signature)
            for start in range(0, len(ids), 4096):
                part = slice(start, start + 4096)
                keys = np.concatenate(list(_prefixes(signature[part])))
                columns = [keys, *(np.tile(c[part], TREES) for c in (ids, sketch, second))]
                if frequent:
                    kept = hot[_bucket(keys)] == wanted
                    columns = [c[kept] for c in columns]
                yield _order_rows(*columns)

    return run


def _opened(batches):
    """Rows of large regions (id, key, sketch, second, signature) once for each tree behind the region's own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, keys, sketch, second = (np.asarray(batch.column(i)) for i in range(4))
        keys = keys.view(np.uint64)
        tree = keys & np.uint64(TREES - 1)
        with np.errstate(over="ignore"):
            for number, prefix in enumerate(_prefixes(_matrix(batch.column(4)))):
                at = np.flatnonzero(tree < np.uint64(number))
                if len(at):
                    inner = _mix(keys[at] * np.uint64(0x9E3779B97F4A7C15) ^ prefix[at])
                    yield _order_rows(inner, ids[at], sketch[at].view(np.uint64), second[at].view(np.uint64))


def _agree(x, y, x2, y2):
    """Whether two sketches may belong to sets of the wanted similarity."""
    differ = np.bitwise_count((x ^ y) >> np.uint64(8)) + np.bitwise_count(x2 ^ y2) <= SKETCH_DIFFER
    a, b = (x & np.uint64(255)).astype(np.int16), (y & np.uint64(255)).astype(np.int16)
    return differ & (np.abs(a - b) <= 8)  # 32 ln(1 / 0.8) is 7.1


def _neighbours(region: np.ndarray, check, longest: int):
    """Pairs of positions (i, j) in the same region (equal, sorted labels) for which ``check(i, j)`` holds."""
    left = np.arange(len(region))
    for step in range(1, longest):
        left = left[: np.searchsorted(left, len(region) - step)]
        left = left[region[left] == region[left + step]]  # who has no partner so far on has none further on
        if not len(left):
            break
        i = left[check(left, left + step)]
        if len(i):
            yield i, i + step


def _emit(*columns):
    """a, b of a pair, or a, null, key, sketch, second of a row of a region too large for one task."""
    empty = pa.nulls(len(columns[0]), pa.int64())
    arrays = [empty if c is None else pa.array(c) for c in columns] + [empty] * (5 - len(columns))
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "key", "sketch", "second"])


def _regions(batches, limit: int):
    """(columns, small) of sorted rows: whole regions of equal keys of up to ``limit`` rows, or rows of larger ones.

    No more than a batch and ``limit`` rows are held, however large a region is.
    """
    kept, large = None, None
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        if large is not None:
            more = int(np.searchsorted(columns[0] != large, True)) if len(columns[0]) else 0
            if more:
                yield [c[:more] for c in columns], False
            columns = [c[more:] for c in columns]
            if len(columns[0]):
                large = None
        if not len(columns[0]):
            continue
        columns = columns if kept is None else [np.concatenate(c) for c in zip(kept, columns)]
        other = np.flatnonzero(columns[0] != columns[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from _by_size([c[:cut] for c in columns], limit)
        kept = [c[cut:] for c in columns]
        if len(kept[0]) > limit:
            yield kept, False
            kept, large = None, columns[0][-1]
    if kept is not None:
        yield from _by_size(kept, limit)


def _by_size(columns, limit: int):
    begins = np.concatenate([[True], columns[0][1:] != columns[0][:-1]])
    sizes = np.diff(np.append(np.flatnonzero(begins), len(begins)))
    if sizes.max() <= limit:
        yield columns, True
        return
    large = np.repeat(sizes > limit, sizes)
    yield [c[large] for c in columns], False
    if not large.all():
        yield [c[~large] for c in columns], True


def _labels(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each region and the size of the largest."""
    begins = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.cumsum(begins), int(np.diff(np.append(np.flatnonzero(begins), len(begins))).max())


def _text_candidates(limit: int):
    """Candidate pairs within regions; rows of a region of more than ``limit`` come out as they are."""

    def run(batches):
        for (signed, ids, sketches, seconds), small in _regions(batches, limit):
            if not small:
                yield _emit(ids, None, signed, sketches, seconds)
                continue
            sketch, second = sketches.view(np.uint64), seconds.view(np.uint64)
            label, longest = _labels(signed)
            for i, j in _neighbours(label, lambda i, j, s=sketch, r=second: _agree(s[i], s[j], r[i], r[j]), longest):
                yield _emit(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]))

    return run


_PAIR = "a long, b long, key long, sketch long, second long"


def _blockwise(far: DataFrame, check_name: str) -> DataFrame:
    """Pairs within regions of any size: rows go to blocks by hash, each pair of blocks of a region is one group."""
    checks = {"text": _agree, "hash": lambda x, y, x2, y2: _close(x, y)}
    blocks = F.greatest(F.lit(2), F.ceil(F.col("n") / F.lit(SPREAD / 4))).cast("int")
    sizes = materialize(far.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", blocks.alias("blocks")))
    rows = far.join(broadcast_if_small(sizes, sizes.count(), BROADCAST_KEYS), "key").withColumn("mine", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))

    def compare(keys, table):
        ids, sketch = np.asarray(table["a"]), np.asarray(table["sketch"]).view(np.uint64)
        second = np.asarray(table["second"]).view(np.uint64)
        mine = np.asarray(table["mine"])
        x, y = keys[1].as_py(), keys[2].as_py()
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        out_a, out_b = [], []
        for i in left:
            others = right[ids[right] > ids[i]] if x == y else right
            hit = others[checks[check_name](sketch[i], sketch[others], second[i], second[others])]
            out_a.append(np.minimum(ids[i], ids[hit]))
            out_b.append(np.maximum(ids[i], ids[hit]))
        a = np.concatenate(out_a) if out_a else np.array([], dtype=np.int64)
        b = np.concatenate(out_b) if out_b else np.array([], dtype=np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long")


def _verify(batches):
    """(a, b, words of a, words of b) to the pairs of the wanted similarity, judged on the words."""
    for batch in batches:
        a, b, similarity = [], [], []
        cache: dict = {}

        def words(key, text, cache=cache):
            if key not in cache:
                cache[key] = word_set(text)
            return cache[key]

        for x, y, s, t in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = words(x, s), words(y, t)
            common = len(u & v)
            union = len(u) + len(v) - common
            if 5 * common >= 4 * union:
                a.append(x)
                b.append(y)
                similarity.append(common / union)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])


def text_links(texts: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members). links: ``a, b, similarity`` between representatives; members: ``id, rep`` of every text.

    Only texts of at least MIN_WORDS distinct words (runs of letters or digits, in lower case) take part. A
    representative is the smallest id with its set of words. Null and short texts, also heartbeats, have no member
    row. Ciphertext (ENC:) is no text. Keys must be unique; rows that repeat a key with the same text count once.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.length("text") >= 2 * MIN_WORDS - 1) & ~F.col("text").startswith("ENC:"))
    signed = stored(rows.mapInArrow(_signatures, _SIGNATURE))
    classes = signed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    ordered = classes.select(F.col("rep").alias("id"), "n", "signature")
    counts = signed.select("signature").mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    most = OPEN + 4 * sum(r.n for r in counts) // BUCKETS
    frequent = frozenset(r.bucket for r in counts if r.n > most)
    found = materialize(_within_regions(ordered.mapInArrow(_orders(frequent, False), _ORDER), OPEN))
    pairs, far = found.where(F.col("b").isNotNull()).select("a", "b"), found.where(F.col("b").isNull()).select("a", "key", "sketch", "second")
    if frequent:
        more = ordered.mapInArrow(_orders(frequent, True), _ORDER)
        far = far.unionByName(more.select(F.col("id").alias("a"), "key", "sketch", "second"))
    if frequent or far.limit(1).count():
        opened = far.join(signed.select(F.col("id").alias("a"), "signature"), "a").mapInArrow(_opened, _ORDER)
        inner = materialize(_within_regions(opened, SPREAD))
        pairs = pairs.unionByName(inner.where(F.col("b").isNotNull()).select("a", "b"))
        far = inner.where(F.col("b").isNull()).select("a", "key", "sketch", "second")
        if far.limit(1).count():
            pairs = pairs.unionByName(_blockwise(far, "text"))
    pairs = stored(pairs.where(F.col("a") < F.col("b")).distinct())
    asked = _among(rows, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * pairs.count())
    joined = pairs.join(asked.select(F.col("id").alias("a"), F.col("text").alias("s")), "a")
    joined = joined.join(asked.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    links = materialize(joined.select("a", "b", "s", "t").mapInArrow(_verify, "a long, b long, similarity double").distinct())
    # Only classes of several ids are joined back to their members, by the hash of the set; no class is one row of ids.
    copied = signed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copied = copied.where(F.col("last") > F.col("rep")).select("h", "g", "rep")
    members = signed.select("id", "h", "g").distinct().join(copied, ["h", "g"], "left")
    return links, materialize(members.select("id", F.coalesce("rep", "id").alias("rep")))


def _within_regions(orders: DataFrame, limit: int) -> DataFrame:
    """Rows of all orders sorted by their keys, and what :func:`_text_candidates` makes of them."""
    ordered = orders.repartition(shuffle_partitions(orders.sparkSession), "key").sortWithinPartitions("key")
    return ordered.mapInArrow(_text_candidates(limit), _PAIR)


def _among(rows: DataFrame, key: str, ids: DataFrame, count: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't among ``ids``; none of these gets lost.

    A filter of bits, at most FILTER_BITS whatever the tables, is broadcast as rows of 64 bits each.
    """
    bits = min(FILTER_BITS, 1 << max(16, (4 * count).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")
    # The place within 64 bits comes from the low bits of the hash, the row from the others: both are fixed by the key.
    table = ids.select(F.shiftright(at, 6).alias("_at"), mask.alias("_mask")).groupBy("_at").agg(F.bit_or("_mask").alias("_bits"))
    marked = rows.withColumn("_at", F.shiftright(at, 6)).join(F.broadcast(table), "_at")
    return marked.where(F.col("_bits").bitwiseAND(mask) != 0).select(*rows.columns)


# Perceptual hashes

HASH_DISTANCE = 6
BLOCKS = 7
KEPT = BLOCKS - (HASH_DISTANCE - 1)


def _block_masks(bits: list) -> list:
    """One mask for each choice of KEPT of the BLOCKS blocks into which ``bits`` (positions) are divided."""
    parts = [p.tolist() for p in np.array_split(np.array(bits), BLOCKS)]
    return [sum(1 << b for part in chosen for b in part) for chosen in combinations(parts, KEPT)]


_FIRST_MASKS = _block_masks(list(range(64)))


def _close(x, y):
    return np.bitwise_count(x ^ y) < HASH_DISTANCE


def _as_signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash_orders(batches):
    """Each distinct hash once for each order: key (of the order and the blocks it begins with), representative, hash."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, hashes = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
        with np.errstate(over="ignore"):
            keys = np.concatenate([_mix((hashes & np.uint64(m)) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)) for i, m in enumerate(_FIRST_MASKS)])
        orders = np.repeat(np.arange(len(_FIRST_MASKS), dtype=np.int32), len(ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(np.tile(ids, len(_FIRST_MASKS))), pa.array(np.tile(hashes.view(np.int64), len(_FIRST_MASKS))), pa.array(orders)],
            names=["key", "id", "hash", "tree"],
        )


def _within(hashes: np.ndarray, mask: int, index: np.ndarray, depth: int):
    """Pairs of positions in ``index`` closer than HASH_DISTANCE; large regions are opened by blocks of the free bits."""
    if len(index) <= 256 or depth > 3:
        for n, i in enumerate(index[:-1]):
            rest = index[n + 1 :]
            hit = rest[_close(hashes[i], hashes[rest])]
            if len(hit):
                yield np.full(len(hit), i), hit
        return
    free = [b for b in range(64) if not mask >> b & 1]
    for deeper in _block_masks(free):
        part = hashes[index] & np.uint64(deeper)
        order = np.argsort(part, kind="stable")
        part, sub = part[order], index[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s > 1:
                yield from _within(hashes, mask | deeper, sub[s:e], depth + 1)


def _hash_pairs(limit: int):
    """Pairs of distinct hashes closer than HASH_DISTANCE within regions of equal key; huge regions come out as rows."""

    def run(batches):
        for (signed, ids, hashes, trees), whole in _regions(batches, limit):
            if not whole:
                yield _emit(ids, None, signed, hashes, hashes)
                continue
            edges = np.flatnonzero(np.concatenate([[True], signed[1:] != signed[:-1], [True]]))
            sizes = np.diff(edges)
            label = np.repeat(np.arange(len(sizes)), sizes)
            small = np.repeat(sizes <= 256, sizes)
            values = hashes.view(np.uint64)
            lab, pos = label[small], np.flatnonzero(small)
            if len(lab):
                for i, j in _neighbours(lab, lambda i, j, p=pos, v=values: _close(v[p[i]], v[p[j]]), int(sizes[sizes <= 256].max())):
                    x, y = ids[pos[i]], ids[pos[j]]
                    yield _emit(np.minimum(x, y), np.maximum(x, y))
            for r in np.flatnonzero(sizes > 256):
                index = np.arange(edges[r], edges[r + 1])
                for i, j in _within(values, _FIRST_MASKS[trees[index[0]]], index, 0):
                    x, y = ids[i], ids[j]
                    yield _emit(np.minimum(x, y), np.maximum(x, y))

    return run


def hash_links(captures: DataFrame, key: str = "capture_id", phash: str = "phash") -> tuple[DataFrame, DataFrame]:
    """(links, members) as in :func:`text_links`, for perceptual hashes of 16 hex digits in either case.

    Null, empty and malformed hashes have no member row. A row delivered twice counts once. Links are between
    representatives of different hashes that differ in fewer than HASH_DISTANCE of 64 bits; ``similarity`` isn't given.
    """
    spark = captures.sparkSession
    rows = captures.select(F.col(key).cast("long").alias("id"), F.lower(F.col(phash)).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").rlike("^[0-9a-f]{16}$"))
    high, low = F.conv(F.substring("x", 1, 8), 16, 10).cast("long"), F.conv(F.substring("x", 9, 8), 16, 10).cast("long")
    rows = rows.select("id", F.shiftleft(high, 32).bitwiseOR(low).alias("hash")).distinct()
    classes = materialize(rows.groupBy("hash").agg(F.min("id").alias("rep")))
    orders = classes.select(F.col("rep").alias("id"), "hash").mapInArrow(_hash_orders, "key long, id long, hash long, tree int")
    orders = orders.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    found = materialize(orders.mapInArrow(_hash_pairs(SPREAD), _PAIR))
    pairs = found.where(F.col("b").isNotNull()).select("a", "b")
    far = found.where(F.col("b").isNull()).select("a", "key", "sketch", "second")
    if far.limit(1).count():
        pairs = pairs.unionByName(_blockwise(far, "hash"))
    links = materialize(pairs.where(F.col("a") < F.col("b")).distinct())
    return links, materialize(rows.join(classes, "hash").select("id", "rep"))


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``id_a, id_b`` of all pairs of texts: copies of one representative, and members of linked representatives.

    The number of rows is what a list of all pairs asks for; tasks get (member, representative) rows, never a group.
    """
    # A copied text's members are spread over blocks of about COPIES rows, so that none is one key.
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    copied = materialize(sizes.where("n > 1").select("rep", "blocks"))
    placed = members.join(copied, "rep", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("at", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at")
    twins = placed.join(copied.select("rep"), "rep", "left_semi")
    same = twins.select("rep", "at", F.col("id").alias("x")).join(twins.select("rep", F.col("id").alias("y"), every), ["rep", "at"]).where("x < y")
    across = links.select("a", "b")
    for end, name in (("a", "x"), ("b", "y")):
        across = across.join(copied.withColumnRenamed("rep", end), end, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        across = across.select("a", "b", *(["x"] if end == "b" else []), every)
        across = across.join(placed.select(F.col("rep").alias(end), "at", F.col("id").alias(name)), [end, "at"]).drop("at")
    pairs = same.select("x", "y").unionByName(across.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def link_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``id, group_id, links``: the connected group of each text, named by its smallest id, and its number of links.

    Copies count as links among themselves. Components by smallest neighbour with pointer jumping over links of
    representatives only; each round is checkpointed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both)
    names = both.select(F.col("a").alias("rep")).distinct().withColumn("to", F.col("rep"))
    while True:
        near = both.join(names.select(F.col("rep").alias("b"), F.col("to").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = names.join(near.withColumnRenamed("a", "rep"), "rep").select("rep", "to", F.least("to", "m").alias("next"))
        far = step.select(F.col("rep").alias("next"), F.col("next").alias("far"))
        step = materialize(step.join(far, "next").select("rep", "to", F.least("next", "far").alias("next")))
        changed = step.where("next <> to").limit(1).count()
        names = step.select("rep", F.col("next").alias("to"))
        if not changed:
            break
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    degree = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("across"))
    info = sizes.join(degree, "rep", "left").join(names, "rep", "left")
    info = info.select("rep", F.coalesce("to", "rep").alias("group_id"), (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    return members.join(info, "rep").select("id", "group_id", "links")
