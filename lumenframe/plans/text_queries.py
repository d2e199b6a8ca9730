"""Redaction, recognition repair, term weights and full-text search over stored frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import ocr
from lumenframe.functions.redact import PATTERNS, redact
from lumenframe.functions.runtime import read_table
from lumenframe.functions.terms import STOP_WORDS, frame_terms
from lumenframe.operators import search as S
from lumenframe.operators import tfidf

NON_ASCII = r"[^\x00-\x7F]"
QUERY = "budget migration review of yesterday.log"


def _frames(spark, sf_dir):
    return read_table(spark, sf_dir, "frames")


def _ascii(spark, sf_dir):
    """Frames with other than ASCII characters as blanks, so that engines agree on what a word is."""
    plain = {c: F.regexp_replace(F.coalesce(c, F.lit("")), NON_ASCII, " ") for c in ("text", "window_title")}
    return _frames(spark, sf_dir).withColumns(plain)


def _secrets(spark, sf_dir):
    """Texts with secrets added by id, as the tables hold few."""
    k = F.col("id")
    digits = F.lpad((k % 10000).cast("string"), 4, "0")
    secret = (
        F.when(k % 11 == 0, F.concat(F.lit(" ssn 123-45-"), digits))
        .when(k % 13 == 0, F.concat(F.lit(" card 4000 1234-5678 "), digits))
        .when(k % 17 == 0, F.concat(F.lit(" Bearer abcdefghijklmnopqrst"), digits))
        .when(k % 19 == 0, F.concat(F.lit(" password: hunter"), digits, F.lit(" mysql://root@host/"), digits))
        .when(k % 23 == 0, F.concat(F.lit(" AKIAABCDEFGHIJKL"), digits, F.lit(" api_key = 'abcdefghijklmnop"), digits, F.lit("'")))
        .when(k % 29 == 0, F.concat(F.lit(" sk-abcdefghijklmnop"), digits, F.lit(" credential: abcdefghijklmnopqrstuvwxyz012345"), digits))
        .when(k % 31 == 0, F.concat(F.lit(" -----BEGIN RSA PRIVATE KEY-----\n"), digits, F.lit("\n-----END RSA PRIVATE KEY----- done")))
        .otherwise("")
    )
    return _ascii(spark, sf_dir).withColumn("text", F.concat("text", secret))


def redact_text(spark, sf_dir):
    return _secrets(spark, sf_dir).select("id", redact(F.col("text"))["text"].alias("text"))


def redact_counts(spark, sf_dir):
    out = _secrets(spark, sf_dir).select("id", redact(F.col("text")).alias("r"))
    return out.select("id", F.col("r.redacted_count").alias("redacted_count"), F.col("r.redacted_types").alias("redacted_types"))


def redact_by_type(spark, sf_dir):
    out = _secrets(spark, sf_dir).select(F.explode(redact(F.col("text"))["redacted_types"]).alias("redacted_type"))
    return out.groupBy("redacted_type").agg(F.count(F.lit(1)).alias("frames"))


def _ocr(function, name):
    return lambda spark, d: _ascii(spark, d).select("id", function(F.col("text")).alias(name))


def ocr_stats(spark, sf_dir):
    out = _ascii(spark, sf_dir).select("id", ocr.clean_with_stats(F.col("text")).alias("r"))
    return out.select("id", "r.text", F.to_json("r.stats").alias("stats"))


def tokenize_terms(spark, sf_dir):
    return _ascii(spark, sf_dir).select("id", F.array_sort(frame_terms(F.col("window_title"), F.col("text"))).alias("terms"))


def tfidf_vectors(spark, sf_dir):
    return tfidf.weights(_ascii(spark, sf_dir)).select("id", "term", F.round("weight", 6).alias("weight"))


def _rounded(found):
    return found.select("id", F.round("similarity", 6).alias("similarity"), "shared_terms")


def tfidf_similar(spark, sf_dir):
    frames = _ascii(spark, sf_dir)
    first = frames.where(F.length("text") > 300).agg(F.min("id")).head()[0]
    return tfidf.similar(frames, first if first is not None else -1).select("id", F.round("similarity", 6).alias("similarity"))


def topic_coherence(spark, sf_dir):
    return tfidf.discover_topics(_ascii(spark, sf_dir), 3).select("topic_id", "label", "frame_count", "coherence")


#: Unstemmed queries of the search language; each is checked against SQL over the same tokens.
SEARCHES = {
    "fts_term": "lighthouse",
    "fts_and": "lighthouse AND sudden migration",
    "fts_or": "lighthouse OR telescope",
    "fts_not": "lighthouse NOT turbine",
    "fts_prefix": "light*",
    "fts_column": "window_title : lighthouse",
    "fts_phrase": '"payroll audit"',
    "fts_near": "NEAR(payroll needs, 4)",
    "fts_near_three": "NEAR(payroll audit needs, 6)",
    "fts_first": "^when + the",
}


def _match(query):
    return lambda spark, d: S.matching(_frames(spark, d), query, stemmed=False).select("id", F.round("rank", 6).alias("rank"))


def fts_search(spark, sf_dir):
    """The best frames for words in other forms than theirs, with what is shown beside the snippet."""
    return S.search(_frames(spark, sf_dir), "reviewing budgets", limit=20).select("id", F.round("rank", 6).alias("rank"), "app_name", "window_title")


def fts_snippets(spark, sf_dir):
    return S.search(_frames(spark, sf_dir), "reviewing budgets", limit=20).select("id", "text")


def fts_stemmed(spark, sf_dir):
    return S.matching(_frames(spark, sf_dir), "audits OR reviewing").select("id", F.round("rank", 6).alias("rank"))


def smart_search(spark, sf_dir):
    return S.smart_search(_frames(spark, sf_dir), "budget", limit=20)


def substring_search(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    now = (frames.agg(F.max("timestamp")).head()[0] or 0.0) + 1.0
    return S.substring_search(frames, "kestrel", now).select("id", "stage")


QUERIES = {
    "redact_text": redact_text,
    "redact_counts": redact_counts,
    "redact_by_type": redact_by_type,
    "ocr_clean_regex": _ocr(ocr.repair_context, "text"),
    "ocr_clean_words": _ocr(ocr.clean, "text"),
    "ocr_confidence": _ocr(ocr.confidence, "confidence"),
    "ocr_stats": ocr_stats,
    "tokenize_terms": tokenize_terms,
    "doc_freq": lambda spark, d: tfidf.document_frequency(tfidf.term_counts(_ascii(spark, d))),
    "tfidf_vectors": tfidf_vectors,
    "tfidf_top_terms": lambda spark, d: tfidf.top_terms(tfidf.weights(_ascii(spark, d))).select("term", F.round("score", 6).alias("score")),
    "tfidf_search": lambda spark, d: _rounded(tfidf.search(_ascii(spark, d), QUERY)),
    "tfidf_similar": tfidf_similar,
    "topic_discovery": lambda spark, d: tfidf.discover_topics(_ascii(spark, d)),
    "topic_coherence": topic_coherence,
    **{name: _match(query) for name, query in SEARCHES.items()},
    "fts_search": fts_search,
    "fts_snippets": fts_snippets,
    "fts_stemmed": fts_stemmed,
    "smart_search": smart_search,
    "encrypted_search": substring_search,
}


def _q(s: str) -> str:
    return s.replace("'", "''")


_ASCII = r"""a AS (SELECT id, timestamp, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g') AS text,
              regexp_replace(coalesce(window_title, ''), '[^\x00-\x7F]', ' ', 'g') AS window_title FROM frames)"""
_SECRETS = f"""WITH {_ASCII}, s AS (SELECT id, text || CASE
    WHEN id % 11 = 0 THEN ' ssn 123-45-' || lpad((id % 10000)::VARCHAR, 4, '0')
    WHEN id % 13 = 0 THEN ' card 4000 1234-5678 ' || lpad((id % 10000)::VARCHAR, 4, '0')
    WHEN id % 17 = 0 THEN ' Bearer abcdefghijklmnopqrst' || lpad((id % 10000)::VARCHAR, 4, '0')
    WHEN id % 19 = 0 THEN ' password: hunter' || lpad((id % 10000)::VARCHAR, 4, '0') || ' mysql://root@host/' || lpad((id % 10000)::VARCHAR, 4, '0')
    WHEN id % 29 = 0 AND NOT (id % 11 = 0 OR id % 13 = 0 OR id % 17 = 0 OR id % 19 = 0 OR id % 23 = 0)
        THEN ' sk-abcdefghijklmnop' || lpad((id % 10000)::VARCHAR, 4, '0') || ' credential: abcdefghijklmnopqrstuvwxyz012345' || lpad((id % 10000)::VARCHAR, 4, '0')
    WHEN id % 31 = 0 AND NOT (id % 11 = 0 OR id % 13 = 0 OR id % 17 = 0 OR id % 19 = 0 OR id % 23 = 0)
        THEN ' -----BEGIN RSA PRIVATE KEY-----' || chr(10) || lpad((id % 10000)::VARCHAR, 4, '0') || chr(10) || '-----END RSA PRIVATE KEY----- done'
    WHEN id % 23 = 0 THEN ' AKIAABCDEFGHIJKL' || lpad((id % 10000)::VARCHAR, 4, '0') || ' api_key = ''abcdefghijklmnop' || lpad((id % 10000)::VARCHAR, 4, '0') || ''''
    ELSE '' END AS x0 FROM a)"""


def _redact_sql(select: str) -> str:
    steps = [
        f", s{i + 1} AS (SELECT *, len(regexp_extract_all(x{i}, '{_q(p)}')) AS c{i}, regexp_replace(x{i}, '{_q(p)}', '[REDACTED:{n}]', 'g') AS x{i + 1} FROM s{i if i else ''})"
        for i, (n, p) in enumerate(PATTERNS)
    ]
    return _SECRETS + "".join(steps) + select.replace("{last}", str(len(PATTERNS)))


_NAMES = list(dict.fromkeys(n for n, _ in PATTERNS))
_TYPE_LIST = "list_filter([" + ", ".join(
    "CASE WHEN " + " + ".join(f"c{i}" for i, (m, _) in enumerate(PATTERNS) if m == n) + f" > 0 THEN '{n}' END" for n in _NAMES
) + "], lambda t: t IS NOT NULL)"
_COUNT = " + ".join(f"c{i}" for i in range(len(PATTERNS)))


def _repair_steps():
    """(name, count of {x}, replacement in {x}) of each contextual repair; no look-around in this engine."""
    for pattern, replacement, name in ocr.REPAIRS:
        new = replacement.replace("$1", "\\1")
        if pattern.startswith("(?<=[a-zA-Z])"):  # twice, for overlapping letters; doubled letters keep neighbours apart in the count
            digit = pattern[len("(?<=[a-zA-Z])")]
            once = f"regexp_replace({{x}}, '([a-zA-Z]){digit}([a-zA-Z])', '\\1{new}\\2', 'g')"
            count = f"len(regexp_extract_all(regexp_replace({{x}}, '([a-zA-Z])', '\\1\\1', 'g'), '[a-zA-Z]{digit}[a-zA-Z]'))"
            yield name, count, once.replace("{x}", once)
            continue
        plain = pattern.replace(r"(?<!\w)", r"\b").replace(r"(?=/|\b)", r"\b")
        yield name, f"len(regexp_extract_all({{x}}, '{plain}'))", f"regexp_replace({{x}}, '{plain}', '{new}', 'g')"


def repaired_sql(table: str, text: str, key: str = "id", words: bool = False) -> str:
    """CTEs r0 .. of ``table``: ``key, x, c0 ..``: the text after each repair and how often the repair was made. Last: ``done``."""
    out = f", w AS (SELECT {key}, {text} AS raw, {text} AS x FROM {table})"
    if words:  # one word after the other, longest first: no replacement is a word to replace
        for i, word in enumerate(sorted(ocr.WORDS, key=lambda w: (-len(w), w))):
            out += f", w{i} AS (SELECT {key}, raw, CASE WHEN contains(x, '{word}') THEN regexp_replace(x, '\\b{word}\\b', '{ocr.WORDS[word]}', 'g') ELSE x END AS x FROM w{i - 1 if i else ''})"
    last = f"w{len(ocr.WORDS) - 1}" if words else "w"
    steps = list(_repair_steps())
    for i, (_, count, new) in enumerate(steps):
        cols = ", ".join(f"c{j}" for j in range(i)) + (", " if i else "")
        out += f", r{i} AS (SELECT {key}, raw, {cols}{count.replace('{x}', 'x')} AS c{i}, {new.replace('{x}', 'x')} AS x FROM {last})"
        last = f"r{i}"
    return out + f", done AS (SELECT * FROM {last})"


def _stats_sql() -> str:
    names = [name for name, _, _ in _repair_steps()]
    parts = [f"""CASE WHEN c{i} > 0 THEN '"regex:{n}":' || c{i} END""" for i, n in enumerate(names)]
    words = f"""'"word_substitutions":' || len(regexp_extract_all(raw, '{_q(ocr.word_pattern())}'))"""
    total = """'"regex_fixes_total":' || (""" + " + ".join(f"c{i}" for i in range(len(names))) + ")"
    listed = f"list_filter([{words}, {', '.join(parts)}, {total}], lambda p: p IS NOT NULL)"
    return f"CASE WHEN raw = '' THEN '{{}}' ELSE '{{' || array_to_string({listed}, ',') || '}}' END"


def _signs_sql() -> str:
    counts = []
    for p in [*ocr.SIGNS, ocr.word_pattern()]:
        if p.startswith("(?<=[a-zA-Z])"):
            digit = p[len("(?<=[a-zA-Z])")]
            # Digits between letters: mark each by doubling letters first, so that neighbours don't share one.
            counts.append(f"len(regexp_extract_all(regexp_replace(text, '([a-zA-Z])', '\\1\\1', 'g'), '[a-zA-Z]{digit}[a-zA-Z]'))")
        else:
            counts.append(f"len(regexp_extract_all(text, '{_q(p)}'))")
    return f"""WITH {_ASCII}, w AS (SELECT id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM a)
    SELECT id, CASE WHEN b = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1.0 - ({" + ".join(counts)})::DOUBLE / len(regexp_split_to_array(b, '\\s+')) / 0.3)), 3) END AS confidence FROM w"""


_TERMS = f"""WITH {_ASCII}, l AS (SELECT id, lower(window_title || ' ' || text) AS v FROM a),
k AS (SELECT id, list_filter(list_concat(list_concat(regexp_extract_all(v, '\\b[a-z]{{3,25}}\\b'), regexp_extract_all(v, '[a-z]+_[a-z]+')),
      regexp_extract_all(v, '\\.\\w{{1,6}}\\b')), lambda t: len(t) >= 3 AND NOT list_contains({STOP_WORDS!r}, t)) AS terms FROM l)"""
_WEIGHTS = (
    _TERMS
    + """, e AS (SELECT id, unnest(terms) AS term FROM k), c AS (SELECT id, term, count(*) AS n FROM e GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), z AS (SELECT id, sum(n) AS size FROM c GROUP BY 1),
i AS (SELECT term, ln((SELECT count(*) + 1 FROM frames) / (df + 1)) + 1 AS idf FROM d),
v AS (SELECT c.id, c.term, n / size * idf AS weight, idf FROM c JOIN z ON z.id = c.id JOIN i ON i.term = c.term),
norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY 1)"""
)
_COSINE = """ SELECT id, round(similarity, 6) AS similarity{shared} FROM (SELECT v.id, round(sum(weight * q) / (any_value(norm) * (SELECT sqrt(sum(q * q)) FROM qv)), 12) AS similarity,
    list(v.term ORDER BY position) AS shared_terms FROM v JOIN qv ON qv.term = v.term JOIN norms ON norms.id = v.id WHERE {other} GROUP BY v.id HAVING sum(weight * q) > 0)
    ORDER BY round(similarity, 12) DESC, id LIMIT {k}"""
_ASKED = ["budget", "migration", "review", "yesterday", "log", ".log"]
_ASKED = [t for t in _ASKED if t not in STOP_WORDS]

_COLS = ["text", "extra_context", "app_name", "window_title"]


def _tokens_sql(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({column}, ''))), '[\\p{{L}}\\p{{N}}]+')"


_TOKENS = "WITH t AS (SELECT id, " + ", ".join(f"{_tokens_sql(c)} AS t_{c}" for c in _COLS) + " FROM frames), b AS (SELECT *, " + " + ".join(f"len(t_{c})" for c in _COLS) + " AS size FROM t)"


def fts_sql(leaves: list[str], holds: str, score: list[str] | None = None) -> str:
    """leaves: hit counts h0.. of a frame; score: hit counts that score, the leaves if none are given."""
    score = score or leaves
    cols = ", ".join([f"{x} AS h{i}" for i, x in enumerate(leaves)] + [f"{x} AS f{i}" for i, x in enumerate(score)])
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(score)))
    terms = " + ".join(
        f"CASE WHEN f{i} > 0 THEN greatest(ln((total - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean_size)) ELSE 0 END"
        for i in range(len(score))
    )
    return f"{_TOKENS}, r AS (SELECT id, size, {cols} FROM b), g AS (SELECT count(*) AS total, avg(size) AS mean_size, {stats} FROM r) SELECT id, round(-({terms}), 6) AS rank FROM r, g WHERE {holds}"


def hits(test: str, columns=_COLS) -> str:
    return "(" + " + ".join(f"len(list_filter(t_{c}, lambda x: {test}))" for c in columns) + ")"


def _seq(words: list[str], columns=_COLS) -> str:
    tests = " AND ".join(f"t_{{c}}[i + {j}] = '{w}'" for j, w in enumerate(words))
    return "(" + " + ".join(f"len(list_filter(range(1, len(t_{c}) + 1), lambda i: coalesce({tests.replace('{c}', c)}, false)))" for c in columns) + ")"


_TERM = {w: hits(f"x = '{w}'") for w in ("lighthouse", "sudden", "migration", "telescope", "turbine", "payroll", "needs")}
def _at(word: str, column: str) -> str:
    return f"list_filter(range(1, len(t_{column}) + 1), lambda i: t_{column}[i] = '{word}')"


# A clump: some start m such that each word has a start from m - 1 - n to m; its members are the starts that stand in one.
def _near_sql(words: list[str], n: int) -> str:
    def clump(word: str, c: str) -> str:
        others = " AND ".join(f"len(list_filter(p_{c}_{w}, lambda r: r <= m AND m - r - 1 <= {n})) > 0" for w in words if w != word)
        every = f"flatten([{', '.join(f'p_{c}_{w}' for w in words)}])"
        return f"len(list_filter(p_{c}_{word}, lambda s: len(list_filter({every}, lambda m: s <= m AND m - s - 1 <= {n} AND {others})) > 0))"

    places = ", ".join(f"{_at(w, c)} AS p_{c}_{w}" for c in _COLS for w in words)
    members = [" + ".join(clump(w, c) for c in _COLS) + f" AS f{i}" for i, w in enumerate(words)]
    whole = [" + ".join(f"len(p_{c}_{w})" for c in _COLS) + f" AS g{i}" for i, w in enumerate(words)]
    stats = ", ".join(f"count(*) FILTER (WHERE g{i} > 0) AS n{i}" for i in range(len(words)))
    terms = " + ".join(
        f"CASE WHEN f{i} > 0 THEN greatest(ln((total - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean_size)) ELSE 0 END"
        for i in range(len(words))
    )
    return f"""{_TOKENS}, p AS (SELECT id, size, {places} FROM b), r AS (SELECT id, size, {", ".join(members + whole)} FROM p),
    g AS (SELECT count(*) AS total, avg(size) AS mean_size, {stats} FROM r) SELECT id, round(-({terms}), 6) AS rank FROM r, g WHERE f0 > 0"""


#: Words of the tables that share a stem with those of the stemmed queries.
REVIEW, BUDGET, AUDIT = (r"'^(?:%s)$'" % w for w in ("review(?:s|ed|ing)?", "budget(?:s|ed|ing)?", "audit(?:s|ed|ing)?"))


def _like(pattern: str) -> str:
    return hits(f"regexp_matches(x, {pattern})")


SQL = {
    "redact_text": _redact_sql(" SELECT id, x{last} AS text FROM s{last}"),
    "redact_counts": _redact_sql(f" SELECT id, ({_COUNT})::INT AS redacted_count, {_TYPE_LIST} AS redacted_types FROM s{{last}}"),
    "redact_by_type": _redact_sql(f" SELECT redacted_type, count(*) AS frames FROM (SELECT unnest({_TYPE_LIST}) AS redacted_type FROM s{{last}}) GROUP BY 1"),
    "ocr_clean_regex": f"WITH {_ASCII}" + repaired_sql("a", "text") + " SELECT id, x AS text FROM done",
    "ocr_clean_words": f"WITH {_ASCII}" + repaired_sql("a", "text", words=True) + " SELECT id, x AS text FROM done",
    "ocr_stats": f"WITH {_ASCII}" + repaired_sql("a", "text", words=True) + f" SELECT id, x AS text, {_stats_sql()} AS stats FROM done",
    "ocr_confidence": _signs_sql(),
    "tokenize_terms": _TERMS + " SELECT id, list_sort(terms) AS terms FROM k",
    "doc_freq": _WEIGHTS + " SELECT term, df FROM d",
    "tfidf_vectors": _WEIGHTS + " SELECT id, term, round(weight, 6) AS weight FROM v",
    "tfidf_top_terms": _WEIGHTS + " SELECT term, round(score, 6) AS score FROM (SELECT term, round(sum(weight), 12) AS score FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)",
    "tfidf_search": _WEIGHTS
    + f""", asked AS (SELECT unnest({_ASKED!r}) AS term, unnest(range(0, {len(_ASKED)})) AS position),
    qv AS (SELECT asked.term, position, 1.0 / {len(_ASKED)} * coalesce(idf, 1.0) AS q FROM asked LEFT JOIN i ON i.term = asked.term)"""
    + _COSINE.replace("{shared}", ", shared_terms").replace("{other}", "true").replace("{k}", "10"),
    "tfidf_similar": _WEIGHTS
    + """, own AS (SELECT min(id) AS id FROM a WHERE len(text) > 300),
    qv AS (SELECT term, 0 AS position, weight AS q FROM v WHERE id = (SELECT id FROM own))"""
    + _COSINE.replace("{shared}", "").replace("{other}", "v.id <> (SELECT id FROM own)").replace("{k}", "5"),
    "fts_term": fts_sql([_TERM["lighthouse"]], "h0 > 0"),
    "fts_and": fts_sql([_TERM["lighthouse"], _TERM["sudden"], _TERM["migration"]], "h0 > 0 AND h1 > 0 AND h2 > 0"),
    "fts_or": fts_sql([_TERM["lighthouse"], _TERM["telescope"]], "h0 > 0 OR h1 > 0"),
    "fts_not": fts_sql([_TERM["lighthouse"], _TERM["turbine"]], "h0 > 0 AND h1 = 0"),
    "fts_prefix": fts_sql([hits("starts_with(x, 'light')")], "h0 > 0"),
    "fts_column": fts_sql([hits("x = 'lighthouse'", ["window_title"])], "h0 > 0"),
    "fts_phrase": fts_sql([_seq(["payroll", "audit"])], "h0 > 0"),
    "fts_near": _near_sql(["payroll", "needs"], 4),
    "fts_near_three": _near_sql(["payroll", "audit", "needs"], 6),
    "fts_stemmed": fts_sql([_like(AUDIT), _like(REVIEW)], "h0 > 0 OR h1 > 0"),
    "fts_search": f"""SELECT id, rank, coalesce(app_name, '') AS app_name, coalesce(window_title, '') AS window_title FROM
        ({fts_sql([_like(REVIEW), _like(BUDGET)], "h0 > 0 AND h1 > 0").replace("round(-(", "(-(").replace(", 6) AS rank", ") AS exact, round(exact, 6) AS rank")} ORDER BY exact, id LIMIT 20) JOIN frames USING (id)""",
    "fts_first": fts_sql(["(" + " + ".join(f"CASE WHEN coalesce(t_{c}[1] = 'when' AND t_{c}[2] = 'the', false) THEN 1 ELSE 0 END" for c in _COLS) + ")"], "h0 > 0"),
    "encrypted_search": """WITH f1 AS (SELECT * FROM frames WHERE app_name ILIKE '%kestrel%' OR project ILIKE '%kestrel%' ORDER BY "timestamp" DESC, id DESC LIMIT 100),
    h1 AS (SELECT id, "timestamp" AS t, 1 AS stage FROM f1 WHERE lower(text || ' ' || coalesce(window_title, '') || ' ' || coalesce(extra_context, '')) LIKE '%kestrel%'),
    f2 AS (SELECT * FROM frames WHERE "timestamp" > (SELECT max("timestamp") + 1 FROM frames) - 7200 ORDER BY "timestamp" DESC, id DESC LIMIT 500),
    h2 AS (SELECT id, "timestamp" AS t, 2 AS stage FROM f2 WHERE lower(text || ' ' || coalesce(window_title, '') || ' ' || coalesce(extra_context, '')) LIKE '%kestrel%' AND id NOT IN (SELECT id FROM h1))
    SELECT id, stage FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) ORDER BY stage, t DESC, id DESC LIMIT 20""",
}
