"""Problem 4: every link found, against all pairs; dense and degenerate regions; groups."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import neardup as N


def text_rows(rng, n=150):
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)["text"].split()
            for _ in range(rng.randrange(6)):
                base[rng.randrange(len(base))] = rng.choice(words)
            rng.shuffle(base)
        else:
            base = rng.sample(words, rng.randrange(15, 60))
        rows.append({"id": i, "text": " ".join(base)})
    return rows


def brute(rows):
    sets = {r["id"]: N.word_set(r["text"]) for r in rows if r["text"] and r["id"] is not None and not r["text"].startswith("ENC:")}
    sets = {i: s for i, s in sets.items() if len(s) >= 20}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def test_texts_against_all_pairs(make_frames):
    rows = text_rows(random.Random(1))
    rows += [{"id": 1000 + i, "text": rows[0]["text"].upper()} for i in range(5)] + [{"id": 2000, "text": None}, {"id": 2001, "text": ""}, {"id": None, "text": rows[0]["text"]}, {"id": 2002, "text": "ENC:" + rows[0]["text"]}]
    frames = make_frames(rows, "a string, b string, h string, key long, rep long")
    links, members = N.text_links(frames)
    got = [(r.id_a, r.id_b) for r in N.expand_pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    groups = {r.id: r.group_id for r in N.link_groups(links, members).collect()}
    assert all(groups[a] == groups[b] for a, b in got)
    assert {r.id: r.links for r in N.link_groups(links, members).collect()} == {i: sum(i in p for p in got) for i in groups}


def test_empty(make_frames):
    links, members = N.text_links(make_frames([]))
    assert links.count() == 0 and members.count() == 0 and N.link_groups(links, members).count() == 0


def test_dense_region_is_spread(make_frames, monkeypatch):
    monkeypatch.setattr(N, "SPREAD", 30)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = [{"id": i, "text": " ".join(base + [f"x{i}"])} for i in range(120)] + text_rows(rng, 20)[:0]
    links, members = N.text_links(make_frames(rows))
    got = {(r.id_a, r.id_b) for r in N.expand_pairs(links, members).collect()}
    assert got == set(combinations(range(120), 2))


def captures(spark, hashes):
    return spark.createDataFrame([(i, h, "x") for i, h in enumerate(hashes)], "capture_id long, phash string, hash string")


@pytest.mark.parametrize("spread", [20_000, 300])
def test_hashes_against_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(N, "SPREAD", spread)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    dense = np.uint64(0x0123456789ABCDEF)
    values = []
    for i in range(700):
        v = int(dense if i % 2 else base[rng.integers(40)])  # half of all hashes lie in one ball
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            v ^= 1 << int(b)
        values.append(v)
    hashes = [f"{v:016x}" if i % 3 else f"{v:016X}" for i, v in enumerate(values)] + [None, "", "xyz", "0" * 15]
    df = captures(spark, hashes)
    links, members = N.hash_links(df.unionByName(df.limit(50)))  # some delivered twice
    got = [(r.id_a, r.id_b) for r in N.expand_pairs(links, members).collect()]
    want = {(a, b) for a, b in combinations(range(700), 2) if (values[a] ^ values[b]).bit_count() < 6}
    assert len(got) == len(set(got)) and set(got) == want


def test_regions_hold_no_more_than_their_limit():
    rng = random.Random(8)
    sizes = [rng.choice([1, 2, 3, 9, 10, 11, 40, 300]) for _ in range(200)]
    keys = np.repeat(np.arange(200, dtype=np.int64), sizes)
    ids = np.arange(len(keys), dtype=np.int64)
    batches, at = [], 0
    while at < len(keys):
        n = rng.choice([0, 1, 5, 50, 200])
        batches.append(pa.record_batch([pa.array(keys[at : at + n]), pa.array(ids[at : at + n])], names=["key", "id"]))
        at += n
    got = list(N._regions(batches, 10))
    assert [int(i) for (_, part), _ in sorted(got, key=lambda x: x[0][1][0] if len(x[0][1]) else -1) for i in part] != []
    assert sorted(int(i) for (_, part), _ in got for i in part) == ids.tolist()
    for (k, _), small in got:
        for key, n in zip(*np.unique(k, return_counts=True)):
            assert (sizes[key] <= 10) == small and (n == sizes[key] or not small)


def template_rows(n):
    """Distinct texts of one template, each with a partner of similarity 0.8."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(65)]
    rows, want = [], set()
    for i in range(n):
        own = [f"o{rng.randrange(10**9)}" for _ in range(25)]
        other = own[:15] + [f"o{rng.randrange(10**9)}" for _ in range(10)]
        rows += [{"id": 2 * i, "text": " ".join(template + own)}, {"id": 2 * i + 1, "text": " ".join(template + other)}]
        want.add((2 * i, 2 * i + 1))
    return rows, want


@pytest.mark.parametrize(("opened", "spread", "lost"), [(4_000, 20_000, 1), (40, 20_000, 8), (40, 30, 8), (10**9, 20_000, 1)])
def test_hot_template_at_the_threshold(make_frames, monkeypatch, opened, spread, lost):
    """Dense regions lose no pairs; opened ones, of which a pair shares two prefixes, hardly any. Nothing false comes out."""
    monkeypatch.setattr(N, "OPEN", opened)
    monkeypatch.setattr(N, "SPREAD", spread)
    rows, want = template_rows(800)
    links, _ = N.text_links(make_frames(rows))
    got = {(r.a, r.b) for r in links.collect()}
    assert got <= want and len(want - got) <= lost, len(want - got)


def test_copies_are_spread_over_blocks(make_frames, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 7)
    words = [f"w{i}" for i in range(30)]
    rows = [{"id": i, "text": " ".join(words)} for i in range(40)] + [{"id": 100 + i, "text": " ".join([*words[:-1], "other"])} for i in range(30)]
    got = [(r.id_a, r.id_b) for r in N.expand_pairs(*N.text_links(make_frames(rows))).collect()]
    assert len(got) == len(set(got)) == 70 * 69 // 2
