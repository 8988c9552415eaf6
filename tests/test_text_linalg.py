import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cascadia.operators import linalg, text

MESSY = ["  theaancatdog house", "bobthe builder  ", "dog the 123 dog\nHouse!", "", None, "é è  the\tcat", "a"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(MESSY)), "row_id long, t string")


def char_grams(s, low, high):
    import re

    s = re.sub(r"\s\s+", " ", s or "")
    return [s[i : i + n] for n in range(low, high + 1) for i in range(len(s) - n + 1)]


def sparse(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def test_char_counts_golden(spark):
    df = spark.createDataFrame([(0, "catcatcat"), (1, "dogdogdog"), (2, "elephantcat")], "row_id long, t string")
    vocab = text.vocabulary(spark, ["the", "a", "an ox", "cat", "dog", "house"])
    assert sparse(text.count_vectorize(text.grams(df, "row_id", "t", "char", (2, 5)), "row_id", vocab)) == {(0, 3): 3, (1, 4): 3, (2, 3): 1}


def test_char_counts_overlap(docs, spark):
    terms = ["th", "he", "the", "o", "  ", "é ", "\n"]
    got = sparse(text.count_vectorize(text.grams(docs, "row_id", "t", "char", (1, 3)), "row_id", text.vocabulary(spark, terms)))
    want = {}
    for i, t in enumerate(MESSY):
        for g, n in Counter(char_grams(t, 1, 3)).items():
            if g in terms:
                want[i, terms.index(g)] = n
    assert got == want


@pytest.mark.parametrize("terms", [["th", "he", "the", "o", "  ", "é ", "\n", "aa", "a", ".*", "x|y", "[", "\\Q"], ["dog"], ["é", "èé"]])
def test_known_grams_are_the_grams_in_the_vocabulary(spark, terms):
    texts = [*MESSY, "aaaa aa", "x|y .* [\\Q", "🎉aa🎉", "the" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    vocab = text.vocabulary(spark, terms)
    got = sparse(text.count_vectorize(text.known_grams(df, "row_id", "t", terms), "row_id", vocab))
    assert got == sparse(text.count_vectorize(text.grams(df, "row_id", "t", "char", (1, 3)), "row_id", vocab))
    lower = [t for t in terms if t == t.lower()]
    assert text.known_grams(df, "row_id", "t", lower, lowercase=True).count() >= text.known_grams(df, "row_id", "t", lower).count()


def test_counts_give_what_occurrences_give(docs):
    grams = text.grams(docs, "row_id", "t", "char", (1, 2))
    counts = text.document_counts(grams, "row_id")
    vocab = text.fit_vocabulary(counts, "row_id", len(MESSY), max_features=20)
    assert vocab.collect() == text.fit_vocabulary(grams, "row_id", len(MESSY), max_features=20).collect()
    assert sparse(text.count_vectorize(counts, "row_id", vocab)) == sparse(text.count_vectorize(grams, "row_id", vocab))
    one, other = (sparse(text.tfidf(x, "row_id", vocab)) for x in (counts, grams))
    assert one == pytest.approx(other)


def test_fitted_tfidf_against_plain_python(docs):
    grams = text.grams(docs, "row_id", "t", "char", (2, 3))
    vocab = text.fit_vocabulary(grams, "row_id", len(MESSY), min_df=2)
    got = sparse(text.tfidf(grams, "row_id", vocab))
    own = [Counter(char_grams(t, 2, 3)) for t in MESSY]
    df = Counter(g for c in own for g in c)
    terms = sorted(g for g, n in df.items() if n >= 2)
    for i, c in enumerate(own):
        raw = {terms.index(g): n * (math.log((1 + len(MESSY)) / (1 + df[g])) + 1) for g, n in c.items() if g in terms}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for k, v in raw.items():
            assert got.pop((i, k)) == pytest.approx(v / norm)
    assert not got


def test_word_ngrams_and_short_tokens(spark):
    df = spark.createDataFrame([(0, "a cat, a dog! naïve")], "row_id long, t string")
    assert sorted(r[1] for r in text.grams(df, "row_id", "t", "word", (1, 2)).collect()) == ["cat", "cat dog", "dog", "dog naïve", "naïve"]
    assert "a cat" in [r[1] for r in text.grams(df, "row_id", "t", "word", (2, 2), least_length=1).collect()]
    with pytest.raises(ValueError):
        text.grams(df, "row_id", "t", "char_wb", (1, 1))


def test_vocabulary_limits(docs):
    grams = text.grams(docs, "row_id", "t", "word", (1, 1), lowercase=True)
    top = text.fit_vocabulary(grams, "row_id", len(MESSY), max_features=2, stop_words=["the"]).orderBy("idx").collect()
    assert [r["term"] for r in top] == ["cat", "dog"] or [r["term"] for r in top] == ["dog", "house"]
    assert text.fit_vocabulary(grams.limit(0), "row_id", 0).count() == 0


def test_ascii_lower_and_cleaning(spark):
    df = spark.createDataFrame([("aA,.,.a",), ("B,,b",), ("c34234C",), ("ÀZ",)], "t string")
    assert [r[0] for r in df.select(text.ascii_lower(F.col("t"))).collect()] == ["aa,.,.a", "b,,b", "c34234c", "Àz"]
    df = spark.createDataFrame([("a  b\tc \n d",), ("é--è_1",)], "t string")
    assert [r[0] for r in df.select(text.collapse_spaces(F.col("t"))).collect()] == ["a b\tc d", "é--è_1"]
    assert [r[0] for r in df.select(text.word_clean(F.col("t"))).collect()] == ["a b c d", "é è_1"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \té\n", max_size=12), min_size=1, max_size=5))
def test_char_grams_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    got = Counter((r[0], r[1]) for r in text.grams(df, "row_id", "t", "char", (1, 3)).collect())
    assert got == Counter((i, g) for i, t in enumerate(texts) for g in char_grams(t, 1, 3))


def test_arithmetic_goldens(spark):
    df = spark.createDataFrame([([1.1, 2.2, 3.3], [4, 5, 6])], "x array<double>, y array<long>")
    assert df.select(linalg.vector_binop(F.col("x"), "+", F.col("y"))).first()[0] == pytest.approx([5.1, 7.2, 9.3])
    df = spark.createDataFrame([(1, 4, 0), (2, 5, 1), (3, 6, 0)], "a long, b long, c long")
    a, b, c = map(F.col, "abc")
    assert [r[0] for r in df.select(linalg.binop(linalg.binop(a, "-", c), "+", linalg.binop(b, "*", c))).collect()] == [1, 6, 3]
    total = linalg.binop(a, "+", b)
    assert [r[0] for r in df.select(linalg.binop(total, "*", total, "long")).collect()] == [25, 49, 81]
    assert [r[0] for r in df.select(linalg.binop(a, "/", c)).collect()] == [None, 2.0, None]


def test_linear_goldens(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 1.0, 1.0, 0.0],), ([0.0, 0.0, 0.0, 0.0, 3.0, 0.0],)], "v array<double>")
    score = linalg.linear_vector(F.col("v"), [0.1, 0.2, 0.3, 0.4, -0.5, 0.6], 0.2)
    assert [r[0] for r in df.select(linalg.classify(score)).collect()] == [1, 0]


def test_sparse_stack_and_score(spark):
    rows = spark.createDataFrame([(0,), (1,)], "row_id long")
    a = spark.createDataFrame([(0, 1, 2.0)], "row_id long, idx int, value double")
    b = spark.createDataFrame([(0, 0, 3)], "row_id long, idx int, value int")
    both = linalg.stack_sparse("row_id", [(a, 4), (b, 2)])
    assert sparse(both) == {(0, 1): 2.0, (0, 4): 3.0}
    weights = spark.createDataFrame([(1, 10.0), (4, 1.0)], "idx int, weight double")
    assert sparse(linalg.linear_sparse(rows, "row_id", both, weights, 0.5).select("row_id", F.lit(0), "score")) == {(0, 0): 23.5, (1, 0): 0.5}


def test_dense_reshape_ratios(spark):
    df = spark.createDataFrame([(4.0, 9.0, -1.0)], "a double, b double, c double")
    v = linalg.dense(["a", "b", "c"])
    assert df.select(linalg.reshape(linalg.stack_dense(v, v), 3)).first()[0] == [[4, 9, -1], [4, 9, -1]]
    assert df.select(linalg.pair_ratios(v, [(0, 1), (1, 2)])).first()[0] == [4 / 3, None]


def test_rounding_keeps_the_sign_of_zero_and_halves_go_away_from_zero(spark):
    # 0.285 is scaled to 28.499999999999996, 1.005 to 100.49999999999999, and 2.675 to 267.5
    given = [-0.001, 0.001, -0.0, 0.0, -0.125, 0.125, 0.375, 0.285, 1.005, 2.675, 1e305, -1e306, 4503599627370497.5, math.inf, -math.inf, math.nan, None]
    want = [-0.0, 0.0, -0.0, 0.0, -0.13, 0.13, 0.38, 0.28, 1.0, 2.68, 1e305, -1e306, 4503599627370497.5, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").orderBy("i")
    assert [str(r[0]) for r in df.select(linalg.rounded("x", 2)).collect()] == [str(x) for x in want]
    assert [str(x) for x in df.coalesce(1).agg(F.collect_list("x").alias("v")).select(F.transform("v", lambda x: linalg.rounded(x, 2))).first()[0]] == [str(x) for x in want[:-1]]


def test_dense_queries_round_to_zero_as_their_sql_does(spark, tmp_path):
    import duckdb

    from cascadia.queries import ORACLE_SQL, QUERIES

    wide = [-4e-7, 0.25, 3e-7, 0.5] + [0.1] * 60
    rows = [(0, wide, 1), (1, [-1e-6] + [0.5] * 63, None), (2, None, 3), (3, [-0.0, math.nan, math.inf, 0.0078125] * 16, 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("stack_dense_blocks", "wide_row_ratios"):
        got = sorted(str(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(str(r) for r in con.execute(ORACLE_SQL[name]).fetchall()), name


@pytest.mark.parametrize("piece", [1, 2, 5, 1000])
@pytest.mark.parametrize("low, high", [(1, 3), (2, 3), (1, 1)])
def test_gram_counts_by_pieces(monkeypatch, piece, low, high):
    monkeypatch.setattr(text, "PIECE", piece)
    for t in ["the cat the dog", "a", "ab", "\x00🎉\x00🎉\U0010ffff", "z" * 99]:
        want = Counter(t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1))
        keys, n = text._gram_counts(t, low, high)
        unpacked = ["".join(chr((k >> s & (1 << 21) - 1) - 1) for s in (42, 21, 0) if k >> s & (1 << 21) - 1) for k in keys.tolist()]
        assert unpacked == sorted(want) and n.tolist() == [want[g] for g in unpacked]
        for known in (keys[::2], np.r_[keys, np.arange(2, 500) << 42 | 7]):
            known = np.unique(known)
            at, n = text._gram_counts(t, low, high, known)
            assert dict(zip(known[at].tolist(), n.tolist())) == {k: want[g] for k, g in zip(keys.tolist(), unpacked) if k in known}


@pytest.mark.parametrize("most, share, held", [(20, 0.0, 1 << 18), (1000, 0.0, 40), (12, 0.3, 1), (1000, 0.9, 1 << 18)])
@pytest.mark.parametrize("repeated", [False, True])
def test_fitted_grams_are_those_of_the_counts(spark, monkeypatch, most, share, held, repeated):
    monkeypatch.setattr(text, "MOST_HELD", held)
    texts = [*MESSY, "aaaa aa", "a\x00b\x00", "🎉aa🎉\U0010ffff", "the cat " * 40, "zz" * 70]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "theta")] + [(3, "over the"), (3, "theatre"), (None, "cat")] * repeated
    df = spark.createDataFrame(rows, "row_id long, t string").repartition(3)
    counts = text.document_counts(text.grams(df, "row_id", "t", "char", (1, 3)), "row_id")
    vocab = text.fit_vocabulary(counts, "row_id", len(rows), math.ceil(share * len(rows)), most)
    want, got = (sparse(x) for x in (text.tfidf(counts, "row_id", vocab), text.fitted_char_tfidf(df, "row_id", "t", (1, 3), share, most)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_fitted_grams_of_texts_dont_reach_a_shuffle(spark, tmp_path):
    from cascadia.queries import QUERIES

    spark.createDataFrame(list(enumerate(["the cat", "the dog", None] * 9)), "doc_id long, text string").coalesce(4).write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["char_tfidf_fitted"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Aggregate", "Window", "Join"))
