import numpy as np
import pytest
from pyspark.sql import functions as F

from cascadia.functions import metrics
from cascadia.operators import models, ranks
from cascadia.operators.models import Callbacks, LinearModel
from cascadia.plans import blocks, cascade, train
from cascadia.plans.plan import FeatureGroup, FeaturePlan


def toy_callbacks():
    """The model is its first two columns: their sum is the probability; a sum of 0 means "ask the last column"."""

    def total(model):
        return sum((F.col(c) for c in model[:2]), F.lit(0.0))

    def fit(df, columns, label):
        return list(columns)

    def predict(model, df):
        s = total(model)
        return df.withColumn("predict", (F.when(s == 0, F.col(model[-1])).otherwise(s) > 0.5).cast("double"))

    def proba(model, df):
        s = total(model)
        return df.withColumn("predict_proba", F.when(s == 0, 0.5).otherwise(s))

    return Callbacks(fit, predict, proba, lambda df, label: metrics.auc(df, label, "predict"))


@pytest.fixture(scope="module")
def easy_and_hard(spark):
    rng = np.random.default_rng(42)
    x = rng.random((1000, 3))
    x[:950, :2] /= 2
    x[950:, :2] = 0
    y = np.where(np.arange(1000) < 950, x[:, 0] + x[:, 1] > 0.5, x[:, 2] > 0.5).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id long, x0 double, x1 double, x2 double, y int").cache()


def toy_plan(calls=None):
    def group(i, cost):
        return FeatureGroup(f"f{i}", lambda rows: rows.withColumn(f"c{i}", F.col(f"x{i}")), [f"c{i}"], cost)

    return FeaturePlan("row_id", (group(0, 0.1), group(1, 0.1), group(2, 0.25)))


@pytest.fixture(scope="module")
def trained(easy_and_hard):
    return train.train_cascade(easy_and_hard, toy_plan(), "y", toy_callbacks())


def test_synthetic_cascade_finds_its_split(trained, easy_and_hard):
    assert sorted(trained.important) == ["f0", "f1"]
    assert trained.cost_cutoff == 0.5
    assert trained.threshold == 0.6
    out = cascade.CascadeExecutor(toy_plan(), toy_callbacks(), trained).batch(easy_and_hard).join(easy_and_hard, "row_id")
    assert out.count() == 1000
    assert out.where("predict <> y").count() == 0


def test_cascade_point(trained, easy_and_hard):
    executor = cascade.CascadeExecutor(toy_plan(), toy_callbacks(), trained)
    for i in (3, 970):
        row = easy_and_hard.where(F.col("row_id") == i)
        assert executor.point(row).select("predict").first()[0] == row.first()["y"]
    assert executor.point(easy_and_hard.limit(0)).count() == 0


def test_threshold_of_one_is_the_full_model(trained, easy_and_hard):
    executor = cascade.CascadeExecutor(toy_plan(), toy_callbacks(), trained, threshold=1.0)
    full = {tuple(r) for r in executor.big(easy_and_hard).collect()}
    assert {tuple(r) for r in executor.batch(easy_and_hard).collect()} == full


def test_hard_rows_alone_reach_an_expensive_feature(spark, easy_and_hard, trained):
    seen = spark.sparkContext.accumulator(0)

    def costly(rows):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(c2=b.x2)

        return rows.mapInPandas(run, rows.schema.simpleString()[7:-1] + ", c2:double")

    groups = toy_plan().groups
    plan = FeaturePlan("row_id", (groups[0], groups[1], FeatureGroup("f2", costly, ["c2"], 0.25)))
    executor = cascade.CascadeExecutor(plan, toy_callbacks(), trained)
    hard = executor.labelled(easy_and_hard).where("small_label = 2").count()
    seen.value = 0
    executor.batch(easy_and_hard).collect()
    assert 0 < seen.value == hard < 1000


def test_tri_state_bounds(spark):
    df = spark.createDataFrame([(0.6,), (0.61,), (0.4,), (0.39,), (None,)], "p double")
    assert [r[0] for r in df.select(cascade.tri_state(F.col("p"), 0.6)).collect()] == [2, 1, 2, 0, 2]


def test_combine(spark):
    small = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "row_id long, label int")
    big = spark.createDataFrame([(2, 1.0)], "row_id long, label double")
    assert sorted(tuple(r) for r in cascade.combine(small, big, "row_id", "label", "double").collect()) == [(1, 0.0), (2, 1.0), (3, 1.0)]


def test_candidates_keep_ties_and_allow_more_than_there_are(spark):
    df = spark.createDataFrame([(i, float(i // 2)) for i in range(6)], "row_id long, p double")
    assert cascade.candidates(df, "p", "row_id", 3).count() == 4
    assert cascade.candidates(df, "p", "row_id", 100).count() == 6
    assert cascade.candidates(df.limit(0), "p", "row_id", 3).count() == 0


def test_top_k_scores_pruned_rows_zero(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "row_id long, x double")
    plan = FeaturePlan("row_id", (FeatureGroup("a", lambda r: r.withColumn("a", F.col("x")), ["a"], 1.0), FeatureGroup("b", lambda r: r.withColumn("b", -F.col("x")), ["b"], 1.0)))
    made = cascade.fixed(LinearModel({"a": 1.0}, kind="regression"), LinearModel({"a": 2.0, "b": 0.5}, kind="regression"), ["a"], 1.0, ratio=2)
    out = {r[0]: r[1] for r in cascade.CascadeExecutor(plan, cascade.linear_callbacks(), made).top_k(df, 5).collect()}
    assert len(out) == 100 and out[99] == 148.5 and out[90] == 135.0 and out[89] == 0.0


def test_knapsack():
    assert train.knapsack({"a": 0.3, "b": 0.2, "c": 0.5}, {"a": 0.1, "b": 0.1, "c": 0.25}, 0.5) == (["a", "b"], 444)
    assert train.knapsack({"a": 1.0}, {"a": 1.0}, 0.5) == ([], 0)


def test_permutation_keeps_every_value(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), F.col("id").alias("b"))
    out = train.permuted(df, "row_id", ["a"], 5)
    assert out.count() == 1000
    assert out.agg(F.sum("a")).first()[0] == 499500 and out.where("a = b").count() < 100


def test_ratio_search():
    rng = np.random.default_rng(0)
    big = rng.random(4000)
    assert train.ratio_search(big, big, 100)[0] == 1
    assert train.ratio_search(big + rng.normal(0, 0.05, 4000), big, 100)[0] > 1


def test_trained_top_k(easy_and_hard):
    made = train.train_top_k(easy_and_hard, toy_plan(), "y", toy_callbacks(), 20)
    assert made.ratio >= 1 and made.important


def test_ratio_search_over_a_table(spark):
    rng = np.random.default_rng(4)
    big = rng.random(4000).round(3)
    small = big + rng.normal(0, 0.02, 4000).round(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(small, big))]
    df = spark.createDataFrame([*rows, (4000, None, float("nan"))], "row_id long, s double, b double")
    h = np.array([r[0] for r in df.orderBy("row_id").select(F.xxhash64("row_id", F.lit(42), F.lit("ratio"))).collect()])
    small, big = np.r_[small, -np.inf], np.r_[big, -np.inf]
    for k in (3, 100, 4001, 5000):
        needed = []
        for i in range(train.SAMPLES):
            own = np.flatnonzero(train.in_sample(h, i))
            own_k = max(1, round(k * len(own) / 4001))
            top = own[np.lexsort((h[own], -big[own]))][:own_k]
            order = own[np.lexsort((h[own], -small[own]))]
            needed.append(next((r for r in range(1, len(own) // own_k + 2) if len(np.intersect1d(top, order[: own_k * r])) / own_k >= train.PRECISION), 9999))
        least = sorted(needed)[train.NEEDED - 1]
        got = train.ratio_search_rows(df, "row_id", "s", "b", k)
        assert (got and got[0]) == (None if least == 9999 else least)
    assert train.ratio_search_rows(df.limit(0), "row_id", "s", "b", 3) is None


def test_top_k_is_trained_on_all_validation_rows(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    rare = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(750)) == 0
    rows = spark.range(600_000).select(F.col("id").alias("row_id"), F.when(rare, 0.98 + u / 50).otherwise(u).alias("x0"), F.when(rare, 10.0).otherwise(1e-9).alias("x1"))
    groups = [FeatureGroup(f"f{i}", lambda r, i=i: r.withColumn(f"c{i}", F.col(f"x{i}")), [f"c{i}"], cost) for i, cost in ((0, 0.1), (1, 0.9))]
    made = train.train_top_k(rows.withColumn("y", (F.col("x0") > 0.5).cast("int")), FeaturePlan("row_id", tuple(groups)), "y", toy_callbacks(), 380)
    # the best 95 of a sample of 75,000 lie within its first 1,500 by the small score
    assert made.important == ["f0"] and 13 <= made.ratio <= 17


def test_ml_models_and_stack(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(a + b > 0)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double, y double")
    lr = models.ml_callbacks(models.logistic_regression(), lambda d, label: metrics.auc(d, label, "predict"))
    assert lr.score(lr.predict(lr.train(df, ["a", "b"], "y"), df), "y") > 0.95
    stacked = models.Stacked({"one": (lr, ["a"]), "two": (lr, ["b"])}, lr).fit(df, "y")
    out = stacked.predict_proba(df)
    assert out.columns == [*df.columns, "predict_proba"] and metrics.auc(out, "y", "predict_proba") > 0.95
    scaled = np.array([r[0][0] for r in models.scaled_components(df, ["a", "b"], 1).transform(df).select("components").collect()])
    assert len(scaled) == 400 and scaled.mean() == pytest.approx(0, abs=1e-9) and scaled.std() == pytest.approx(1)


def test_models_without_probabilities_are_refused(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b), float(a > b), float(3 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "row_id long, a double, b double, y double, z double")
    accuracy = lambda d, label: float(d.agg(metrics.accuracy(F.col(label), F.col("predict"))).first()[0])
    svc = models.ml_callbacks(models.support_vectors(), accuracy)
    model = svc.train(df, ["a", "b"], "y")
    assert svc.score(svc.predict(model, df), "y") > 0.95
    with pytest.raises(TypeError):
        svc.predict_proba(model, df)
    net = models.ml_callbacks(models.perceptron([2, 4, 2]), accuracy)
    model = net.train(df, ["a", "b"], "y")
    assert net.score(net.predict(model, df), "y") > 0.9 and net.predict_proba(model, df).where("predict_proba between 0 and 1").count() == 300
    loss = lambda d, label: -float(d.agg(metrics.rmse(F.col(label), F.col("predict"))).first()[0])
    trees = models.ml_callbacks(models.boosted_regressor(10, 4), loss)
    model = trees.train(df, ["a", "b"], "z")
    assert trees.score(trees.predict(model, df), "z") > -1.2 and "predict_proba" in trees.predict_proba(model, df).columns


def test_neural_regressor(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(a), float(b), float(np.maximum(a, 0) * 2 + b * b)) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))] + [(5000, None, 1.0, None)], "row_id long, a double, b double, z double")
    loss = lambda d, label: -float(d.agg(metrics.rmse(F.col(label), F.col("predict"))).first()[0])
    net = models.neural_regressor([16, 8], loss)
    model = net.train(df, ["a", "b"], "z")
    x = rng.normal(size=(4, 2))
    h = (x - model.mean) / model.scale
    for w, b in model.layers[:-1]:
        h = np.maximum(h @ w + b, 0)
    want = (h @ model.layers[-1][0] + model.layers[-1][1])[:, 0]
    got = net.predict(model, spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")).collect()
    assert [r["predict"] for r in got] == pytest.approx(want.tolist())
    assert net.score(net.predict(model, df), "z") > -0.3 and net.predict(model, df).count() == 2001
    assert net.predict(model, df.limit(0)).count() == 0


def test_cascade_over_blocks_builds_the_rest_for_unsure_rows_alone(spark):
    rows = spark.createDataFrame([(i, float(i), float(i % 7)) for i in range(100)], "row_id long, a double, b double")
    seen = spark.sparkContext.accumulator(0)

    def second(given):
        def count(x):
            seen.add(1)
            return x

        counted = given.withColumn("b", F.udf(count, "double")("b"))
        return counted.select("row_id", F.lit(1).alias("idx"), F.col("b").alias("value"))

    plan = blocks.BlockPlan("row_id", (blocks.Block("a", lambda r: r.select("row_id", F.lit(0).alias("idx"), F.col("a").alias("value")), 1), blocks.Block("b", second, 3)))

    def model(weights, intercept):
        return blocks.SparseModel(spark.createDataFrame(weights, "idx int, weight double"), intercept)

    made = blocks.BlockCascade(plan, ["a"], model([(0, 0.1)], -5.0), model([(0, 0.1), (2, -1.0)], -3.0), 0.7)
    got = {r["row_id"]: (r["predict"], r["answered_by"]) for r in made.batch(rows).collect()}
    unsure = [i for i in range(100) if 0.3 <= 1 / (1 + np.exp(5 - 0.1 * i)) <= 0.7]
    assert seen.value == len(unsure) > 0 and len(got) == 100
    for i in range(100):
        want = (int(0.1 * i - i % 7 - 3.0 > 0), "big") if i in unsure else (int(i > 50), "small")
        assert got[i] == want
    assert made.held and made.release() is None and not made.held
    with pytest.raises(ValueError):
        plan.stack(rows, [])


def test_stored_frames_are_freed(trained, easy_and_hard):
    with cascade.CascadeExecutor(toy_plan(), toy_callbacks(), trained) as run:
        out = run.batch(easy_and_hard)
        assert out.count() == 1000 and run.held[0].is_cached
        held = run.held[0]
    assert not held.is_cached and not run.held and out.count() == 1000


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (1, None)], "y int, s double")
    assert metrics.auc(df, "y", "s") == pytest.approx(0.875)
    assert np.isnan(metrics.auc(df.where("y = 1"), "y", "s"))


def exact_auc(y, s):
    order = np.argsort(s, kind="stable")
    _, inverse, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p)) if len(order) else np.nan


def test_auc_of_a_million_scores_is_exact_and_stable(spark, tmp_path):
    u = F.pmod(F.xxhash64("id"), F.lit(2**40)) / 2.0**40
    rows = spark.range(1_200_000).select(F.when(F.col("id") % 6 == 0, F.round(u, 2)).otherwise(u).alias("s"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) < 200 + 300 * u).cast("int").alias("y"))
    rows.write.parquet(str(tmp_path / "scores"))
    df = spark.read.parquet(str(tmp_path / "scores"))
    got = df.toArrow()
    want = exact_auc(got.column("y").to_numpy(), got.column("s").to_numpy())
    assert df.select("s").distinct().count() > 10**6
    for parts in ("4", "23", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert metrics.auc(df, "y", "s") == pytest.approx(want, abs=1e-12)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranges_follow_from_values(spark):
    values = [-1.5, 0.0, 0.0, 2.0, 7.5, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for bounds in ([], [0.0], [-1.0, 0.0, 2.0, 3.0, 8.0], [float(i) / 8 for i in range(100)]):
        got = [r[0] for r in df.select(ranks.range_number(F.col("v"), bounds)).collect()]
        assert got == [0 if v is None else len(bounds) if v != v else sum(b <= v for b in bounds) for v in values]
    assert ranks.range_bounds(df.where("v < 9").distinct(), "v", 2, 2) in ([0.0], [2.0], [7.5]) and ranks.range_bounds(df.limit(0), "v", 4) == []
    texts = spark.createDataFrame([(c,) for c in "hgfedcba"], "v string")
    assert len(ranks.range_bounds(texts, "v", 4, 2)) == 3


def test_broadcast_only_of_what_the_plan_bounds(spark):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(ranks.bounded(ranks.small_table(spark, [(1,), (2,)], "a int"))) and hinted(ranks.bounded(spark.range(10**7).limit(5)))
    assert not hinted(ranks.bounded(spark.range(10**7))) and not hinted(ranks.bounded(spark.range(10**7).limit(50), 49))
    assert not hinted(ranks.bounded(spark.range(100).groupBy((F.col("id") % 7).alias("a")).count(), 10))


def test_running_totals(spark):
    df = spark.range(1000).selectExpr("id as k", "1 as v")
    assert [r[0] for r in ranks.running_totals(df, "k", "v", "t").orderBy("k").select("t").collect()] == list(range(1, 1001))


def counted_plan(spark):
    """A plan of two features, and how many rows they were built for."""
    built = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        built.add(1)
        return x

    def group(i):
        return FeatureGroup(f"f{i}", lambda rows: rows.withColumn(f"c{i}", slow(f"x{i}")), [f"c{i}"], [0.1, 0.3][i])

    return FeaturePlan("row_id", (group(0), group(1))), built


def test_importances_build_features_once(easy_and_hard, spark):
    plan, built = counted_plan(spark)
    values = train.importances(plan.build(easy_and_hard), plan, toy_callbacks(), ["c0", "c1"], "y")
    assert built.value == 2 * 1000
    plain = FeaturePlan("row_id", toy_plan().groups[:2])
    assert values == train.importances(plain.build(easy_and_hard), plain, toy_callbacks(), ["c0", "c1"], "y")


@pytest.mark.parametrize("search", [train.train_cascade, lambda *a: train.train_top_k(*a, 20)])
def test_training_stores_no_columns_but_features(easy_and_hard, spark, search):
    plan, built = counted_plan(spark)
    toy, seen, parts = toy_callbacks(), set(), set()

    def fit(df, columns, label):
        seen.add(tuple(sorted(df.columns)))
        parts.add(df.rdd.getNumPartitions())
        return toy.train(df, columns, label)

    wide = easy_and_hard.withColumn("text", F.lit("long")).repartition(40)
    search(wide, plan, "y", Callbacks(fit, toy.predict, toy.predict_proba, toy.score))
    assert seen == {("c0", "c1", "row_id", "y")} and parts == {spark.sparkContext.defaultParallelism}
    assert built.value == 2 * 1000
