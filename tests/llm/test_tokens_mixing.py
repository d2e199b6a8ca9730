"""Problems 7 and 8."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import tokens
from lumenframe.llm.mixing import fit_lengths, mix_to_shares
from lumenframe.llm.tokens import _tokenizer, decode_corpus, encode_corpus, token_counts, vocabulary_path

TEXTS = [None, "", " ", "\n\n", "Hello world", "  two  blanks\t\r\n tab", "<|endoftext|> is text", "naïve café 한국어 مرحبا 👩‍👩‍👧 ＡＢＣ", "don't we'll I'M they'VE", "x" * 5000, "a b " * 20_000, "0000000000123456789012345678901234567890", "é ı̈ ​ 　end", "\x00\x1f"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, "w") for i, t in enumerate(texts)], "doc_id long, text string, k string, r int, word string")


def test_ids_equal_the_tokenizer(spark):
    tokenizer = _tokenizer(vocabulary_path())
    df = documents(spark, TEXTS)
    encoded = encode_corpus(df.unionByName(df)).cache()
    rows = encoded.collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id]
        assert r.ids == (tokenizer.encode(text, add_special_tokens=False).ids if text else [])
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {r.doc_id: len(r.ids) for r in rows}
    assert {r.doc_id: r.text for r in decode_corpus(encode_corpus(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize(("hot", "long"), [(2, 256), (50_000, 3), (0, 256)])
def test_rare_words_by_shuffle(spark, monkeypatch, hot, long):
    """Words beyond the table that is sent out are joined by shuffle, heavy ones over several keys, with the same ids."""
    want = {r.doc_id: r.ids for r in encode_corpus(documents(spark, TEXTS)).collect()}
    monkeypatch.setattr(tokens, "HOT_WORDS", hot)
    monkeypatch.setattr(tokens, "HOT_WORD_BYTES", long)
    monkeypatch.setattr(tokens, "BATCH_IDS", 10)
    monkeypatch.setattr(tokens, "COUNTED", 3)
    df = documents(spark, TEXTS)
    got = encode_corpus(df.unionByName(df)).collect()
    assert len(got) == 2 * len(TEXTS) and all(r.ids == want[r.doc_id] for r in got)
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {i: len(ids) for i, ids in want.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a'sZ é\u0301\n\r\t\x0b\x1c\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u3000١9²!.<|>_한🙂\u200d\ue000\U0001fae9")))
def test_words_are_encoded_alone_as_in_the_text(text):
    tokenizer = _tokenizer(vocabulary_path())
    words = [w for part in tokens.words_of(text, tokenizer) for w in part]
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    assert "".join(words) == text and [i for w in words for i in encode(w)] == encode(text)


def test_long_texts_are_split_in_parts():
    tokenizer = _tokenizer(vocabulary_path())
    text = ("some words 12\n\n  more " + "y" * 300 + "! ") * 4000
    words = [w for part in tokens.words_of(text, tokenizer) for w in part]
    assert "".join(words) == text and [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


def test_empty_and_null_keys(spark):
    assert encode_corpus(documents(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(len(r.ids) for r in encode_corpus(df).collect()) == [1, 2]


@pytest.mark.parametrize("largest", [12, 60, 400])
def test_fit_is_exact(largest):
    """The best total of all subsets, on 2,000 random cases, also of few and large lengths."""
    rng = random.Random(largest)
    for _ in range(700):
        lengths = np.array(rng.sample(range(0, largest), rng.randrange(1, 6)))
        counts = np.array([rng.randrange(0, 7) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 5)
        taken = fit_lengths(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        reach = {0}
        for size, count in zip(lengths, counts):
            reach = {r + int(size) * k for r in reach for k in range(count + 1)}
        assert int((lengths * taken).sum()) == max(r for r in reach if r <= budget), (lengths, counts, budget)


def test_fit_gives_back():
    assert fit_lengths(np.array([3, 27]), np.array([6, 2]), 63).tolist() == [3, 2]
    lengths, counts = np.arange(1, 3000), np.full(2999, 10**6)
    assert int((lengths * fit_lengths(lengths, counts, 10**12 + 7)).sum()) == 10**12 + 7


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(1, 40))), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(400)] + [(900, None, "a"), (901, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, None), ("gone", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_to_shares(df, targets)
    report = {r.source: r for r in report.collect()}
    assert report["gone"].mixed_tokens == 0 and abs(sum(r.fitted_share for r in report.values()) - 1) < 1e-9
    for name in "abc":
        r = report[name]
        assert r.mixed_tokens == r.budget_tokens and abs(r.actual_share - r.fitted_share) < 0.01 and r.most_copies <= r.max_repeats
    mixed = mix.collect()
    assert len({r.doc_id for r in mixed}) == len(mixed) and {r.source for r in mixed} == {"a", "b", "c"}
    assert [tuple(r) for r in mix_to_shares(df, targets)[0].orderBy("doc_id").collect()] == [tuple(r) for r in mix.orderBy("doc_id").collect()]


def test_report_equals_sql(spark):
    """Shares, budgets and totals by SQL over the token counts."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    df, targets = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "mix_targets"))
    sizes = token_counts(df, ["doc_id", "source"]).toPandas()  # noqa: F841
    con = duckdb.connect()
    want = con.execute(f"""WITH t AS (SELECT source, sum(target_share) AS share, min(coalesce(max_repeats, 1)) AS cap FROM '{folder}/mix_targets.parquet' GROUP BY 1),
        k AS (SELECT t.*, coalesce(sum(n_tokens), 0) AS tokens, count(doc_id) AS documents FROM t LEFT JOIN sizes USING (source) GROUP BY ALL),
        f AS (SELECT *, CASE WHEN tokens > 0 AND share > 0 AND cap >= 1 THEN share / sum(share) FILTER (WHERE tokens > 0 AND share > 0 AND cap >= 1) OVER () ELSE 0 END AS fitted FROM k),
        b AS (SELECT *, floor(fitted * min(CASE WHEN fitted > 0 THEN cap * tokens / fitted END) OVER () + 0.5) AS budget FROM f)
        SELECT source, documents, tokens, fitted, budget FROM b ORDER BY source""").fetchall()
    got = mix_to_shares(df, targets)[1].orderBy("source").collect()
    assert [(r.source, r.documents, r.available_tokens, r.budget_tokens) for r in got] == [(s, d, int(k), int(b)) for s, d, k, _, b in want]
    assert all(abs(r.fitted_share - f) < 1e-9 and r.most_copies <= r.max_repeats for r, (_, _, _, f, _) in zip(got, want))


def test_one_id_in_two_sources_and_null_ids(spark):
    rows = [(1, "one two three four", "a"), (1, "one", "b"), (None, "one two", "a"), (None, "one two", "b"), (2, "one two three", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_to_shares(df, targets)
    got = sorted(((r.doc_id or 0), r.source, r.n_tokens, r.copies) for r in mix.collect())
    assert got == [(0, "a", 2, 1), (0, "b", 2, 1), (1, "a", 4, 1), (1, "b", 1, 1), (2, "b", 3, 1)]
    assert {r.source: (r.documents, r.mixed_tokens) for r in report.collect()} == {"a": (2, 6), "b": (3, 6)}


def test_mix_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_to_shares(df, targets)
    assert mix.count() == 0 and report.head().actual_share == 0.0


def test_vocabulary_is_a_parameter(spark):
    with pytest.raises(Exception):  # noqa: B017
        encode_corpus(documents(spark, ["a"]), vocabulary="/nowhere.json").collect()
