import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cascadia.operators import relational as rel

DATA = [(1, 4, -50), (2, 5, 6), (2, 2, 3), (3, 5, 5), (1, 3, 2)]
META = [(1, 1.2, 1.3), (2, 2.2, 2.3), (3, 3.2, 3.3)]


@pytest.fixture
def data(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(DATA)], "row_id long, key long, data1 long, data2 long")


@pytest.fixture
def meta(spark):
    return spark.createDataFrame(META, "key long, m1 double, m2 double")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_lookup_join(data, meta):
    out = rel.lookup_join(data, meta, "key").select("row_id", "m1", "m2")
    assert [r[1] for r in rows(out, "row_id")] == [1.2, 2.2, 2.2, 3.2, 1.2]
    assert [r[2] for r in rows(out, "row_id")] == [1.3, 2.3, 2.3, 3.3, 1.3]


def test_missing_keys_are_zero_and_null_keys_match_nothing(spark, meta):
    left = spark.createDataFrame([(0, 1), (1, 5), (2, None)], "row_id long, key int")
    assert [r[2] for r in rows(rel.lookup_join(left, meta, "key"), "row_id")] == [1.2, 0.0, 0.0]


def test_repeated_keys(spark, data):
    twice = spark.createDataFrame([(1, 1.0, "b"), (1, 2.0, "a")], "key long, v double, s string")
    assert rows(rel.lookup_join(data, twice, "key").where("key = 1").select("row_id", "v", "s"), "row_id") == [(0, 3.0, "a"), (4, 3.0, "a")]
    assert rel.lookup_join(data, twice, "key", "fanout").count() == 7
    with pytest.raises(PySparkException):
        rel.lookup_join(data, twice, "key", "error").collect()


def test_several_keys_and_clashes(spark):
    left = spark.createDataFrame([(1, 0, 9), (2, 1, 8)], "a long, b long, v long")
    right = spark.createDataFrame([(1, 0, 1.5), (2, 0, 2.5)], "a long, b long, v double")
    with pytest.raises(ValueError):
        rel.lookup_join(left, right, ["a", "b"])
    assert rows(rel.lookup_join(left, right, ["a", "b"], suffix="_r"), "a") == [(1, 0, 9, 1.5), (2, 1, 8, 0.0)]


def test_join_order_follows_dependence():
    assert rel.join_order(["k"], [(["c"], ["c", "x"]), (["k"], ["k", "c"])]) == [1, 0]
    assert rel.independent_lookups(["k"], [(["c"], []), (["k"], [])]) == [False, True]
    with pytest.raises(ValueError):
        rel.join_order(["k"], [(["z"], ["z"])])


def test_unused_lookup_is_removed(data, meta):
    plan = rel.lookup_join(data, meta, "key").select("row_id", "data1")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_group_features_skip_nan_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("b", None), (None, 7.0)], "k string, v double")
    out = rel.agg_features(df, ["k"], {"v": ["min", "max", "mean", "sum", "var", "nunique"]}, "p", "size")
    assert out.columns == ["k", "P_V_MIN", "P_V_MAX", "P_V_MEAN", "P_V_SUM", "P_V_VAR", "P_V_NUNIQUE", "P_SIZE"]
    assert rows(out, "k") == [("a", 1.0, 1.0, 1.0, 1.0, None, 1, 2), ("b", None, None, None, 0.0, None, 0, 1)]


def test_one_hot_factorize_nullify(spark):
    df = spark.createDataFrame([(0, "z"), (1, None), (2, "a"), (3, "z")], "i long, c string")
    assert rel.one_hot(df, "c").columns == ["i", "c", "c_a", "c_z", "c_nan"]
    assert [tuple(r)[2:] for r in rows(rel.one_hot(df, "c"), "i")] == [(0, 1, 0), (0, 0, 1), (1, 0, 0), (0, 1, 0)]
    assert [r[2] for r in rows(rel.factorize(df, "c", "i", "code").select("i", "c", "code"), "i")] == [0, -1, 1, 0]
    assert [r[1] for r in rows(rel.nullify(df, "c", "z"), "i")] == [None, None, "a", None]
    with pytest.raises(ValueError):
        rel.one_hot(df, "c", most=1)


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0), (math.nan, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(rel.clamp_zero(F.col("a"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.limit(2).select(rel.ratio(F.col("a"), F.col("b"))).collect()] == [None, -0.5]
    assert df.where(rel.not_equal(F.col("a"), 1.0)).count() == 3
    assert spark.createDataFrame([(None, "x")], "a string, b string").select(rel.text_concat(F.col("a"), F.col("b"))).first()[0] == " x"


def test_concat_select_split(spark, data):
    left, right = data.select("row_id", "data1"), data.select("row_id", "data2")
    assert rel.hconcat("row_id", left, right).columns == ["row_id", "data1", "data2"]
    assert rel.select_columns(["data2", "data1"], left, right, row_id="row_id").columns == ["row_id", "data2", "data1"]
    assert rel.vconcat(left, right).count() == 10
    a, b = rel.hash_split(spark.range(10_000).withColumnRenamed("id", "row_id"), "row_id", 75)
    assert a.count() + b.count() == 10_000 and 7300 < a.count() < 7700


def test_popularity(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1)], "k string, t int")
    out = rows(rel.popularity_features(df, "k", F.col("t") == 1, "s"), "k")
    assert out[0] == ("a", 2.0, 1.0, 1.0, pytest.approx(2 / 3, 1e-6), 1.0, 0.5)


def test_empty_tables(data, meta):
    none = data.limit(0)
    assert rel.lookup_join(none, meta, "key").count() == 0
    assert [r[0] for r in rel.lookup_join(data, meta.limit(0), "key").select("m1").collect()] == [0.0] * 5
    assert rel.agg_features(none, ["key"], {"data1": ["sum"]}, "p").count() == 0
    assert rel.popularity_features(none, "key", F.lit(True), "p").count() == 0


def test_factorize_and_sparse_one_hot_of_many_values(spark):
    rows = [(i, None if i % 50 == 0 else f"v{(i * 7919) % 997}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, v string").repartition(7)
    codes, want = {}, {}
    for i, v in rows:
        want[i] = -1 if v is None else codes.setdefault(v, len(codes))
    assert {r["id"]: r["code"] for r in rel.factorize(df, "v", "id", "code").collect()} == want
    place = {v: i for i, v in enumerate(sorted(codes), 1)}
    assert {r["id"]: (r["idx"], r["value"]) for r in rel.one_hot_sparse(df, "v", "id").collect()} == {i: (place.get(v, 0), 1) for i, v in rows}
    with pytest.raises(ValueError):
        rel.one_hot(df, "v", most=100)
    assert rel.one_hot_sparse(df.limit(0), "v", "id").count() == 0
