"""Topics, coherence, re-ranking and snippets against plain computations."""

import math
import random
import re
import sqlite3
from collections import Counter
from itertools import combinations

from lumenframe.functions.terms import STOP_WORDS
from lumenframe.operators import search as S
from lumenframe.operators import tfidf


def plain_terms(text):
    low = text.lower()
    found = re.findall(r"\b[a-z]{3,25}\b", low) + re.findall(r"[a-z]+_[a-z]+", low) + re.findall(r"\.\w{1,6}\b", low)
    return [t for t in found if len(t) >= 3 and t not in STOP_WORDS]


def plain_topics(rows, n):
    counts = {r["id"]: Counter(plain_terms(f"{r['window_title']} {r['text']}")) for r in rows}
    df = Counter(t for c in counts.values() for t in c)
    left = {}
    for i, c in counts.items():
        size = sum(c.values())
        if size:
            left[i] = {t: k / size * (math.log((len(rows) + 1) / (df[t] + 1)) + 1) for t, k in c.items()}
    top = lambda docs, k: sorted(((round(sum(d.get(t, 0) for d in docs), 12), t) for t in {t for d in docs for t in d}), key=lambda x: (-x[0], x[1]))[:k]
    out = []
    for topic in range(n):
        seeds = top(left.values(), 1)
        if not seeds:
            break
        members = {i: d for i, d in left.items() if seeds[0][1] in d}
        left = {i: d for i, d in left.items() if i not in members}
        if len(members) < 2:
            continue
        words = [t for _, t in top(members.values(), 8)]
        unit = [{t: w / math.sqrt(sum(x * x for x in members[i].values())) for t, w in members[i].items()} for i in sorted(members)[:20]]
        pairs = [sum(w * b.get(t, 0) for t, w in a.items()) for a, b in combinations(unit, 2)]
        mine = [r for r in rows if r["id"] in members]
        times = [r["timestamp"] for r in mine]
        out.append((topic, " / ".join(words[:3]), words, len(members), sorted({r["app_name"] for r in mine})[:5], (min(times), max(times)), sum(pairs) / len(pairs)))
    return out


def test_topics(make_frames):
    rng = random.Random(9)
    themes = [["harbour", "crane", "ballast", "deck_log"], ["ledger", "audit", "payroll", "close.csv"], ["orchard", "graft", "pruning"], ["lonely"]]
    rows = []
    for i in range(70):
        words = rng.choices(themes[i % 3] if i else themes[3], k=rng.randrange(1, 12)) + rng.choices(["meeting", "people", "the", "and"], k=2)
        rows.append({"id": i, "timestamp": float(i), "app_name": rng.choice(["Ink", "Mail", ""]), "window_title": rng.choice(themes[i % 3]), "text": " ".join(words)})
    rows.append({"id": 99, "timestamp": 99.0, "app_name": "Ink", "window_title": "", "text": ""})
    want = plain_topics(rows, 6)
    got = sorted(tfidf.discover_topics(make_frames(rows), 6).collect(), key=lambda r: r.topic_id)
    assert len(want) > 2 and [(r.topic_id, r.label, r.keywords, r.frame_count, r.apps, tuple(r.time_range)) for r in got] == [w[:-1] for w in want]
    assert all(abs(r.coherence - w[-1]) <= 0.00501 for r, w in zip(got, want))
    assert tfidf.discover_topics(make_frames([])).count() == 0


def search_rows():
    rng = random.Random(4)
    words = "budget budgets review log meeting people plan".split()
    return [
        {"id": i, "timestamp": float(i), "text": " ".join(rng.choices(words, k=rng.randrange(1, 38))) + rng.choice(["", " [heartbeat]"]), "extra_context": "", "app_name": rng.choice(["Budget App", "Ink"]), "window_title": rng.choice(["Budget", "x"]), "project": rng.choice(["Alpha", "beta", None])}
        for i in range(1, 120)
    ]


def test_smart_search(make_frames):
    frames = make_frames(search_rows())
    for project, hidden in ((None, True), ("ALPH", False)):
        found = S.search(frames, "budget", 30).collect()
        kept = [r for r in found if not (hidden and "[heartbeat" in r.text) and (project is None or project.lower() in r.project.lower())]
        score = lambda r: 3 * ("budget" in r.window_title.lower()) + 2 * ("budget" in r.app_name.lower()) + ("budget" in r.text[:200].lower())
        want = [(r.id, score(r)) for r in sorted(kept, key=lambda r: -score(r))][:10]
        assert [(r.id, r.score) for r in S.smart_search(frames, "budget", 10, project, hidden).collect()] == want


def test_snippets_like_sqlite(make_frames):
    rows = search_rows()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, app_name, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, text, app_name) VALUES (?,?,?)", [(r["id"], r["text"], r["app_name"]) for r in rows])
    want = dict(con.execute("SELECT rowid, snippet(f, 0, '>>>', '<<<', '...', 40) FROM f WHERE f MATCH 'reviews'"))
    assert {r.id: r.text for r in S.search(make_frames(rows), "reviews", 200).collect()} == want
