"""Problems 2, 6 and 9 on small fixtures with known cases."""

from lumenframe.llm import personal, scans
from lumenframe.llm.personal import personal_fields, redact_personal
from lumenframe.llm.scans import page_furniture, readings, repair_scans, scan_noise
from lumenframe.llm.truncation import ending_weights, line_shape, score_truncation, truncation_rates

PLAIN = "The modern amber certificate returned to the tramway before the forecast of the people."


def scan_rows():
    rows = [{"id": i, "text": PLAIN, "window_title": "Amber forecast"} for i in range(40)]
    page = "Record of the Brittle Margin{}\n{}The arnber certificate went to the tram-\nway before the f0recast of the peo-\nple.\n"
    rows.append({"id": 100, "text": page.format("", "[4]\n") + page.format(".", "[5]\n").replace("The arnber", "Another amber").replace("before", "after") + "The end."})
    rows.append({"id": 101, "text": "Item k7m2g costs 12\n13\n14\n15", "window_title": "arnber tramway"})
    rows += [{"id": 102, "text": None}, {"id": 103, "text": ""}, {"id": 104, "text": "ENC:arnber f0recast"}, {"id": None, "text": "x"}]
    return rows


def test_scan_noise(make_frames):
    frames = make_frames(scan_rows(), "k string, kind string, a string, n long")
    got = {(r.id, r.field, r.kind) for r in scan_noise(frames).collect()}
    assert got == {(100, "text", k) for k in ("header", "page_number", "hyphenation", "misread")} | {(101, "window_title", "misread")}
    fixed = {r.id: (r.text, r.window_title) for r in repair_scans(frames).collect()}
    assert fixed[100][0].startswith("The amber certificate went to the tramway before the forecast of the people.")
    assert "Record" not in fixed[100][0] and "[4]" not in fixed[100][0]
    assert fixed[101] == ("Item k7m2g costs 12\n13\n14\n15", "amber tramway") and fixed[104][0] == "ENC:arnber f0recast" and fixed[102][0] is None
    assert len(fixed) == len(scan_rows()) and scan_noise(make_frames([])).count() == 0


def test_furniture():
    body = ["some words of the page go here", "and some more of them"]
    numbers, headers = page_furniture(["7  Guide to the Patch", *body, "Guide to the Patch | 8", *body, "9  Guide to thc Patch", *body])
    assert sorted(numbers) == [0, 3, 6] and {0, 3, 6} <= headers
    assert page_furniture(["12", "13", "14", "words"]) == ({}, set())  # a column of figures
    assert page_furniture(["ix", *body, "x", *body])[0].keys() == {0, 3}


def test_furniture_of_any_width():
    body = ["some words of the page go here", "and some more of them"]
    assert page_furniture(["Handover", "", *body, "[4]", "Handovcr", *body, "[5]"])[1] == {0, 5}  # no word in common
    wide = " " * 200 + "Guide to the Patch"
    assert page_furniture([wide, *body, "[4]", wide + " ", *body, "[5]"])[1] == {0, 4}
    name = "Guide to the northern patch of the lenient ledger " * 4
    numbers, headers = page_furniture([f"{name}| 7", *body, f"{name}| 8", *body])
    assert sorted(numbers) == [0, 3] and headers == {0, 3}
    assert page_furniture(["vii", "first words here", "12", "viii", "another part of it", "x"])[1] == set()


def test_misread_words_of_headers_are_found(make_frames):
    """Whether or not a word of the text is divided, and also beside a very long run of letters."""
    rows = [{"id": i, "text": PLAIN} for i in range(60)]
    page = "Forecast of the arnber\n[{}]\nThe certificate went to the {}\nbefore the people.\n" + "z" * 300 + "\n"
    rows += [{"id": 100, "text": page.format(4, "tram-\nway") + page.format(5, "tramway")}, {"id": 101, "text": page.format(4, "tramway") + page.format(5, "tramway")}]
    got = {r.id for r in scan_noise(make_frames(rows)).where("kind = 'misread'").collect()}
    assert got == {100, 101}


def test_readings():
    assert "trarnway" in readings("trarnway") or "tramway" in readings("trarnway")
    assert "open" in readings("0pen") and "preview" in readings("previeH") and "bracket" in readings("bbracket")
    assert readings("1204") == {}


NAMES = [("Ada", "given"), ("Bo", "given"), ("Cyd", "given"), ("Stone", "surname"), ("Field", "surname"), ("Marsh", "surname"), (None, "given")]
CASES = [
    ("Please ask Ada Stone about the chart; the number is +1 415 555 0101.", {"name", "phone"}),
    ("Please ask Bo Field about the chart; the number is +44 20 7946 0000.", {"name", "phone"}),
    ("Please ask Cyd Marsh about the chart; the number is +33 1 99 00 11 22.", {"name", "phone"}),
    ("Please ask ADA K. MARSH about it; the number is (415) 555-0102.", {"name", "phone"}),
    ("Please ask Field, Bo about it; the number is (415) 555-0103.", {"name", "phone"}),
    ("Please ask C. Stone about it; the number is (415) 555-0104.", {"name", "phone"}),
    ("Please ask Ada Unseen about the plan today.", {"name"}),
    ("Please ask Bo Unseen about the plan today.", {"name"}),
    ("Please ask Cyd Unseen about the plan today.", {"name"}),
    ("Please ask B. Unseen about the plan today.", {"name"}),
    ("Reply to ada.stone+x@mail.example before noon", {"email"}),
    ("Reply to bo (at) mail[dot]example before noon", {"email"}),
    ("Icons live in banner@2x.png and @payroll", set()),
    ("me@host:~$ tail log", set()),
    ("We could not match 123-45-6789 with it", {"id_number"}),
    ("Applicant QQ 12 34 56 A", {"id_number"}),
    ("The parcel goes to 12 Millrace Street, Town", {"address"}),
    ("The parcel goes to Millraceweg 12, 01234 Town", {"address"}),
    ("The parcel goes to 9b rue Heron, 01234 Town", {"address"}),
    ("The Millrace Lane redesign and the Ada build", set()),
    ("Order 35971 78202 55814 left on Monday", set()),
    ("Address 10.0.35.7 port 57050, version 4.10.22", set()),
    ("Ada stays the working name", set()),
    (None, set()),
    ("", set()),
]


def test_personal(spark, make_frames):
    parts = spark.createDataFrame(NAMES, "name_part string, kind string")
    rows = [{"id": i, "text": t, "window_title": None, "extra_context": t} for i, (t, _) in enumerate(CASES)]
    frames = make_frames(rows, "k string, field string, a string, form string")
    got: dict = {}
    for r in personal_fields(frames, parts).collect():
        got.setdefault((r.id, r.field), set()).add(r.kind)
    for i, (text, kinds) in enumerate(CASES):
        assert got.get((i, "text"), set()) == got.get((i, "extra_context"), set()) == kinds, text
    safe = {r.id: r for r in redact_personal(frames, parts).collect()}
    assert safe[0].text == "Please ask [NAME] about the chart; the number is [PHONE]." and safe[0].window_title is None
    assert safe[10].extra_context == "Reply to [EMAIL] before noon" and safe[23].text is None and len(safe) == len(rows)
    assert personal_fields(make_frames([]), parts).count() == 0
    assert personal_fields(frames, parts.limit(0)).where("kind = 'name'").count() == 0


def test_names_of_any_order_and_spoken_addresses(spark, make_frames, monkeypatch):
    """Forms beyond the seeds: learned parts turned, no capitals, addresses in words by context; whatever the filter of parts lets through."""
    parts = spark.createDataFrame(NAMES, "name_part string, kind string")
    learn = [f"Please ask {g} {s} about the plan today." for g in ("Ada", "Bo", "Cyd", "Dagny") for s in ("Stone", "Field", "Unseen")]
    mails = [f"Reply to a{i}@mail.example before noon" for i in range(4)]
    cases = [
        ("See Unseen, Dagny there", {"name"}), ("See Unseen, D. there", {"name"}), ("See Unseen Dagny there", {"name"}), ("then ada stone left", {"name"}), ("then ada left", set()),
        ("STONE ADA", {"name"}), ("Reply to bo at mail dot example before noon", {"email"}), ("Reply to al at post dot example please", {"email"}), ("Look at mail dot example again", set()), ("Paris, Texas", set()),
    ]
    rows = [{"id": 100 + i, "text": t} for i, t in enumerate(learn + mails)] + [{"id": i, "text": t} for i, (t, _) in enumerate(cases)]
    frames = make_frames(rows)
    for bits in (1 << 20, 8):
        monkeypatch.setattr(personal, "FILTER_BITS", bits)
        got: dict = {}
        for r in personal_fields(frames, parts).where("id < 100").collect():
            got.setdefault(r.id, set()).add(r.kind)
        for i, (text, kinds) in enumerate(cases):
            assert got.get(i, set()) == kinds, text


def test_truncation(spark):
    rows = []
    sentence = "The amber cache was cancelled again by the finance desk. "
    for i in range(200):
        text = (sentence * 30)[: 300 + 7 * (i % 40)]
        rows.append((i, text[: text.rfind(".") + 1], "free"))
    for i in range(40):
        rows.append((1000 + i, (f"Note {i} of the desk goes on here. " + sentence * 20)[:500].rstrip()[:500], "limited"))
    ends = {
        2000: ("A list\n\n- amber cache for Bo", False), 2001: ("def f(x):\n    return x", False), 2002: ("a | b\nx | 12", False), 2003: ("See it here.\nhttps://a.example/b/12", False),
        2004: ("All is well.\n\n-- finance desk, Bo", False), 2005: ("All is well.\n(end of note)", False), 2006: ("The cache was canc", True), 2007: ("The cache was cancelled aga...", True),
        2008: ("The cache was cancelled by the", True), 2009: (None, False), 2010: ("", False), 2011: (" \n ", False), 2012: ("Is it?", False), 2013: ("It was cut on the wa�", True), 2014: ("The cache was canc\n\n-- finance desk, Bo", True),
    }
    rows += [(i, t, "free") for i, (t, _) in ends.items()] + [(3000 + i, "x " * i + "done.\n\nMore to follow…", None) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in score_truncation(df).where("truncated").collect()}
    texts = {i: t for i, t, _ in rows}
    assert {i for i in got if i >= 2000} == {i for i, (_, cut) in ends.items() if cut}
    assert {i for i in got if i < 2000} == {i for i in range(1000, 1040) if not texts[i].endswith(".")}
    rates = {r.source: r for r in truncation_rates(df).collect()}
    assert rates["limited"].limit_chars in (499, 500) and rates["limited"].rate > 0.8 and rates[None].truncated == 0 and rates["free"].documents == 200 + len(ends)
    assert score_truncation(df.limit(0)).count() == 0 and line_shape("Bo cache 12") == "A a 9"


def test_stock_lines_are_relative_to_the_corpus(spark):
    """A tail cut by chance at several lengths is no closing phrase; one that no line goes on from is."""
    rows = []
    for i in range(60):
        rows.append((i, f"Note {i} of the desk is here.\n" + "The desk has it.\n" * (i % 9) + "While waiting for the tram the desk wrote it down.\nAll is well.", "free"))
    for i in range(6):
        rows.append((100 + i, "The desk has it.\n" * (i + 1) + "\nWhile waiting for th", "free"))
        rows.append((200 + i, "The desk has it.\n" * (i + 1) + "It was late.\nSeen by the desk", "free"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in score_truncation(df).where("truncated").collect()}
    assert got == set(range(100, 106))


def test_a_sure_limit_outweighs_the_form_of_the_ending(spark):
    """List entries, code, rows and heading shapes cut at a fixed limit are found; copies and chance lengths are no limit."""
    ends = ["- amber cache for the des", "    return ledger_of_the", "x | the ledger of the", "Amber Cache"]
    rows = [(i, "The desk has it. " * (3 + i % 50) + "\n\nAmber Desk\n\n" + "It is late.", "list") for i in range(300)]
    for i in range(80):
        end = "\n\n" + ends[i % 4]
        rows.append((1000 + i, f"Note {i:03d} " + "of the desk has it. " * 60 + end, "list"))
    size = min(len(t) for _, t, _ in rows[300:])
    rows = rows[:300] + [(i, t[: size - len(t.split("\n\n")[1]) - 3] + ".\n\n" + t.split("\n\n")[1], s) for i, t, s in rows[300:]]
    rows += [(2000 + i, "The desk has it.\n\n- amber cache for Bo", "list") for i in range(40)]
    rows += [(3000 + i, "The desk has it. " * (i + 3) + "\n\n" + ends[i % 4], "list") for i in range(40)]
    assert len({len(t) for i, t, _ in rows if 1000 <= i < 2000}) == 1
    got = {r.doc_id for r in score_truncation(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("truncated").collect()}
    assert got == set(range(1000, 1080))


def test_the_same_ending_flips_with_the_lengths_of_its_source(spark):
    """One text, in a source that stops at its length and in one that doesn't; the weight of its ending is learned."""
    base = "The desk has it. "
    text = base * 20 + "It is late.\n\n- amber cache for the des"
    size = len(text)
    rows = [(i, base * (3 + i % 60) + "It is late.", s) for s in ("limited", "free") for i in range(400)]
    rows = [(i, t, s) for i, t, s in rows if s == "free" or len(t) < size]
    for i in range(60):
        body = f"Note {i:02d} of the desk. " + base * 30
        rows.append((0, (body[: size - 26] + "\n\n- amber cache for the des")[:size] if i % 2 else body[: size - 1] + "k", "limited"))
    rows += [(0, base * (i + 2) + "It is late.\n\n- amber cache for the des", "free") for i in range(40)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)] + [(90_000, text, "limited"), (90_001, text, "free")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in score_truncation(df).collect()}
    assert got[90_000].truncated and not got[90_001].truncated
    assert got[90_000].ending == got[90_001].ending == "complete" and got[90_000].limit_posterior > 0.9 and got[90_001].limit_posterior == 0
    rates = {r.source: r for r in truncation_rates(df).collect()}
    assert rates["limited"].limit_chars == size and rates["limited"].truncated == 61 and rates["free"].truncated == 0


def test_ending_weights():
    weights, rate = ending_weights([(0.99, "open", 900), (0.99, "form", 100), (0.0, "closed", 9000), (0.0, "form", 900), (0.0, "open", 100)])
    assert -2 < weights["form"] < 0.5 < weights["open"] and weights["closed"] < -5 and 0.008 < rate < 0.03
    assert ending_weights([]) [1] == 0.01


def test_long_closing_lines_are_stock_phrases_too(spark):
    phrase = "This entry was written by the desk of the amber cache and may be read by all who come by"
    rows = [(i, "The desk has it.\n" * (i + 1) + "It was late.\n" + phrase, "free") for i in range(30)]
    rows += [(100 + i, "The desk has it. " * (i + 1) + "All is well.", "free") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert score_truncation(df).where("truncated").count() == 0


def test_repair_is_the_same_for_tables_of_any_size(make_frames, monkeypatch):
    """Tables too large to send out give the same texts: a value is repaired once, with all its words."""
    page = "Record of the Brittle Margin\n[{}]\nThe mod-\nern am-\nber certi-\nficate retur-\nned to the tram-\nway be-\nfore the fore-\ncast of the peo-\nple.\n"
    rows = scan_rows() + [{"id": 200, "text": page.format(4) + page.format(5), "window_title": "arnber f0recast"}]
    frames = make_frames(rows, "k string, kind string, a string, n long")
    key = lambda r: (r.id or -1, r.text or "", r.window_title or "")
    want = sorted(map(key, repair_scans(frames).collect()))
    monkeypatch.setattr(scans, "BROADCAST_WORDS", 1)
    assert sorted(map(key, repair_scans(frames).collect())) == want
