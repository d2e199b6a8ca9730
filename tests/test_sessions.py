import random

from lumenframe.operators.sessions import build_sessions


def brute(rows, gap):
    out = []
    users: dict = {}
    for r in rows:
        if r["timestamp"] is not None and r["id"] is not None:
            users.setdefault(r["user_id"], []).append((r["timestamp"], r["id"], r.get("app_name")))
    for user, events in users.items():
        events.sort(key=lambda e: e[:2])
        run = [events[0]]
        for e in [*events[1:], None]:
            if e and e[0] - run[-1][0] <= gap:
                run.append(e)
                continue
            apps = sorted({a for _, _, a in run if a})
            out.append((user, run[0][1], run[-1][1], run[0][0], run[-1][0], len(run), apps))
            run = [e]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.user_id, r.first_id, r.last_id, r.start, r.end, r.frame_count, list(r.apps)) for r in df.collect()), key=repr)


def test_against_brute_force(spark, make_frames):
    rng = random.Random(5)
    for chunk in (50.0, 400.0, 1e6):
        rows = [
            {
                "id": i,
                "timestamp": rng.choice([None, *[rng.randrange(0, 3000) / 8 * rng.choice([1, 40]) for _ in range(12)]]),
                "user_id": rng.choice([1, 1, 1, 2, None]),
                "app_name": rng.choice(["a", "b", "", None]),
            }
            for i in range(300)
        ]
        assert found(build_sessions(make_frames(rows), 60.0, chunk_seconds=chunk)) == brute(rows, 60.0)


def test_gap_of_exact_length_and_chunk_borders(make_frames):
    times = [0.0, 900.0, 1800.125, 14399.0, 14400.0, 15300.0, 28800.0]
    frames = make_frames([{"id": i, "timestamp": t} for i, t in enumerate(times)])
    assert [(r.first_id, r.last_id) for r in build_sessions(frames, 900.0).orderBy("start").collect()] == [(0, 1), (2, 2), (3, 5), (6, 6)]


def test_ties_repeats_nan_and_extra_columns(make_frames):
    rows = [{"id": i, "timestamp": 5.0, "k": "x"} for i in (3, 1, 2, 2)] + [{"id": 9, "timestamp": float("nan")}, {"id": None, "timestamp": 5.0}]
    out = build_sessions(make_frames(rows, "k string, n long, border string, s long"), 900.0).collect()
    assert [(r.first_id, r.last_id, r.frame_count) for r in out] == [(1, 3, 4)]


def test_empty(make_frames):
    assert build_sessions(make_frames([]), 900.0).count() == 0
