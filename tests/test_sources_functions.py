import time

from pyspark.sql import Observation, functions as F

from cascadia.functions import udf
from cascadia.sources import io
from cascadia.streaming.stream import run_on_stream


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k, v\n1, 1.5\n2, 2.5\n")
    (tmp_path / "b.csv").write_text("1,x\n2,y\n")
    (tmp_path / "c.tsv").write_text("k\tv\n1\ta b\n")
    (tmp_path / "vocab.txt").write_text("the\na\nan ox\n")
    (tmp_path / "labels").write_text("1\n0\n")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "a.csv"), "k long, v double").collect()] == [(1, 1.5), (2, 2.5)]
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "b.csv"), "k long, v string", header=False, rows=1).collect()] == [(1, "x")]
    assert io.read_tsv(spark, str(tmp_path / "c.tsv"), "k long, v string").first()["v"] == "a b"
    assert io.read_vocabulary(spark, str(tmp_path / "vocab.txt")) == ["the", "a", "an ox"]
    assert io.read_lines(spark, str(tmp_path / "vocab.txt")).count() == 3
    assert [r[0] for r in io.read_labels(spark, str(tmp_path / "labels")).collect()] == [1, 0]


def test_sinks(spark, tmp_path):
    df = io.from_memory(spark, [(1, "a"), (2, None)], "k long, v string")
    io.write_parquet(df, str(tmp_path / "p"), ["k"])
    io.write_csv(df, str(tmp_path / "c"))
    io.save_json(spark, {"threshold": 0.6}, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    assert io.load_json(spark, str(tmp_path / "j")) == {"threshold": 0.6}


def test_feature_store(spark):
    store, seen = io.FeatureStore(spark, buckets=2), Observation()
    store.load("users", spark.createDataFrame([(1, 0.5), (2, 0.7)], "k long, f double"), "k")
    out = store.batch("users", spark.createDataFrame([(1,), (3,), (1,)], "k long"), "k", seen)
    assert sorted(((r[0], r[1]) for r in out.collect()), key=str) == [(1, 0.5), (1, 0.5), (3, None)]
    assert seen.get["queries"] == 3
    assert store.point("users", "k", 2) == {"k": 2, "f": 0.7} and store.point("users", "k", 9) is None


def test_feature_store_in_a_folder(spark):
    store = io.FeatureStore(spark, folder=io.shared_folder(spark))
    for shift in (0, 5):
        store.load("shifted", spark.range(10).selectExpr("id as k", f"id + {shift} as v"), "k")
    assert store.point("shifted", "k", 3)["v"] == 8 and store.point("shifted", "k", 99) is None
    assert store.batch("shifted", spark.createDataFrame([(1,), (77,)], "k long"), "k").where("v is null").count() == 1


def test_cached_map_calls_once_per_argument(spark):
    calls = spark.sparkContext.accumulator(0)

    def f(a):
        calls.add(1)
        return None if a is None else a * 2.0

    df = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(300, None)], "i long, a int")
    out = udf.cached_map(df, f, ["a"], "b", "double").collect()
    assert len(out) == 301 and calls.value <= 8
    assert all(r["b"] == (None if r["a"] is None else r["a"] * 2.0) for r in out)


def test_async_map_overlaps(spark):
    df = spark.range(8).coalesce(1)
    udf.async_map(df, lambda i: i, ["id"], "x", "long").collect()
    start = time.time()
    out = udf.async_map(df, lambda i: time.sleep(0.5) or i, ["id"], "x", "long").collect()
    assert [r["x"] for r in out] == list(range(8)) and time.time() - start < 3


def test_lru_and_vectorized(spark):
    cache = udf.Cache(lambda x: x + 1, 2)
    assert [cache(x) for x in (1, 2, 1, 3, 1, 2)] == [2, 3, 2, 4, 2, 3]
    assert cache.calls == 4 and len(cache.held) == 2
    df = spark.range(3)
    assert [r[0] for r in df.select(udf.vectorized(lambda s: s + 1, "long")(F.col("id"))).collect()] == [1, 2, 3]
    assert [r["y"] for r in udf.lru_map(df, lambda x: x * x, ["id"], "y", "long").collect()] == [0, 1, 4]


def test_plan_on_a_stream(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = run_on_stream(stream, lambda df: df.withColumn("x", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("x")).first()[0] == 20


def test_spread_deals_small_scans_only(spark):
    cores = spark.sparkContext.defaultParallelism
    small, large = spark.range(10, numPartitions=1), spark.range(10, numPartitions=cores + 1)
    assert io.spread(small).rdd.getNumPartitions() == cores and sorted(r[0] for r in io.spread(small).collect()) == list(range(10))
    assert io.spread(large) is large


def test_lru_map_runs_functions_of_columns_in_the_same_process(spark, tmp_path):
    from cascadia.queries import QUERIES

    df = spark.createDataFrame([(1, "a", 2.0), (None, "b", None), (3, None, 0.5)], "id long, t string, x double").coalesce(1)
    out = udf.lru_map(df, lambda i, t: f"{i}{t}", ["id", "t"], "y", "string", whole={"z": (lambda s: s * 2, "x", "double"), "n": (lambda s: s.isna(), "t", "boolean")})
    assert out.dtypes == [*df.dtypes, ("y", "string"), ("z", "double"), ("n", "boolean")]
    assert [tuple(r) for r in out.collect()] == [(1, "a", 2.0, "1a", 4.0, False), (None, "b", None, "Noneb", None, False), (3, None, 0.5, "3None", 1.0, True)]
    events = spark.createDataFrame([(1, "click", 9, 0.25)], "event_id long, event_type string, user_id long, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    plan = QUERIES["udf_lru_and_vectorized"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan
