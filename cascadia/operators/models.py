"""Models behind four callbacks: train, predict, predict_proba and score; and the models that need more than one fit."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from .linalg import linear, linear_vector, logistic


@dataclass(frozen=True)
class Callbacks:
    """train(df, columns, label) -> model; predict and predict_proba(model, df) add a column of their name; score(df, label) is higher for better."""

    train: Callable[[DataFrame, Sequence[str], str], object]
    predict: Callable[[object, DataFrame], DataFrame]
    predict_proba: Callable[[object, DataFrame], DataFrame]
    score: Callable[[DataFrame, str], float]


@dataclass(frozen=True)
class VectorModel:
    """Fixed coefficients for array columns: blocks of a dense feature vector, each with weights of its own."""

    weights: Mapping[str, Sequence[float]]
    intercept: float = 0.0

    @property
    def columns(self) -> list[str]:
        return list(self.weights)

    def score(self) -> Column:
        return sum((linear_vector(F.col(c), w, 0.0) for c, w in self.weights.items()), F.lit(float(self.intercept)))

    def proba(self) -> Column:
        return logistic(self.score())

    def label(self) -> Column:
        return (self.score() > 0).cast("int")


@dataclass(frozen=True)
class LinearModel:
    """Fixed coefficients by column: one expression, so scoring stays in generated code."""

    weights: Mapping[str, float]
    intercept: float = 0.0
    kind: str = "logistic"

    @property
    def columns(self) -> list[str]:
        return list(self.weights)

    def proba(self) -> Column:
        score = linear(self.weights, self.intercept)
        return logistic(score) if self.kind == "logistic" else score

    def label(self) -> Column:
        score = linear(self.weights, self.intercept)
        return (score > 0).cast("int") if self.kind == "logistic" else score


def ml_callbacks(estimator: Callable[[], Estimator], score: Callable[[DataFrame, str], float]) -> Callbacks:
    """Any Spark ML estimator over assembled columns."""

    def train(df: DataFrame, columns: Sequence[str], label: str) -> PipelineModel:
        stage = estimator().setFeaturesCol("_features").setLabelCol(label)
        assembler = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="keep")
        return Pipeline(stages=[assembler, stage]).fit(df)

    def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumn("predict", F.col("prediction")).drop(*[c for c in out.columns if c not in df.columns])

    def predict_proba(model: PipelineModel, df: DataFrame) -> DataFrame:
        """A regressor's prediction stands for itself; a classifier without probabilities can't tell sure rows from others and is refused."""
        out = model.transform(df)
        if "rawPrediction" in out.columns and "probability" not in out.columns:
            raise TypeError(f"{type(model.stages[-1]).__name__} gives no probabilities: it may answer rows, but not as the small model of a cascade or for top-K")
        p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        return out.withColumn("predict_proba", p).drop(*[c for c in out.columns if c not in df.columns])

    return Callbacks(train, predict, predict_proba, score)


def logistic_regression(iterations: int = 50, regularisation: float = 0.0) -> Callable[[], Estimator]:
    return lambda: LogisticRegression(maxIter=iterations, regParam=regularisation)


def boosted_trees(iterations: int = 20, depth: int = 5, seed: int = 42) -> Callable[[], Estimator]:
    return lambda: GBTClassifier(maxIter=iterations, maxDepth=depth, seed=seed)


def boosted_regressor(iterations: int = 20, depth: int = 5, seed: int = 42) -> Callable[[], Estimator]:
    return lambda: GBTRegressor(maxIter=iterations, maxDepth=depth, seed=seed)


def support_vectors(iterations: int = 50) -> Callable[[], Estimator]:
    return lambda: LinearSVC(maxIter=iterations)


def perceptron(layers: Sequence[int], seed: int = 42) -> Callable[[], Estimator]:
    return lambda: MultilayerPerceptronClassifier(layers=list(layers), seed=seed)


def scaled_components(df: DataFrame, columns: Sequence[str], k: int, out: str = "components") -> PipelineModel:
    """Principal components, centred and divided by their population deviation, fitted on the rows."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="_raw"), PCA(k=k, inputCol="_raw", outputCol="_pca"), StandardScaler(withMean=True, inputCol="_pca", outputCol="_scaled")]
    n = df.count()
    # Spark divides by the sample's deviation
    stages.append(ElementwiseProduct(scalingVec=[math.sqrt(n / (n - 1)) if n > 1 else 1.0] * k, inputCol="_scaled", outputCol=out))
    return Pipeline(stages=stages).fit(df)


@dataclass
class NeuralModel:
    """A multi-layer regressor: rectified layers and a linear output, in numpy."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    columns: list[str]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and every layer's output."""
        out = [(np.nan_to_num(x) - self.mean) / self.scale]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if i == len(self.layers) - 1 else np.maximum(z, 0))
        return out


def neural_regressor(hidden: Sequence[int], score: Callable[[DataFrame, str], float], most_rows: int = 200_000, epochs: int = 30, batch: int = 256, rate: float = 0.01, seed: int = 42) -> Callbacks:
    """Learns by Adam on squared errors from at most ``most_rows`` rows, those with the smallest hash; predicts every row on executors, batch by batch. Null counts as 0."""

    def train(df: DataFrame, columns: Sequence[str], label: str) -> NeuralModel:
        rows = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("_y"))
        drawn = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(most_rows).toArrow()
        data = np.column_stack([np.nan_to_num(np.array(drawn.column(c).to_numpy(), float)) for c in rows.columns])
        x, y = data[:, :-1], data[:, -1]
        rng, sizes = np.random.default_rng(seed), [len(columns), *hidden, 1]
        model = NeuralModel(x.mean(0), x.std(0) + 1e-9, [(rng.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])], list(columns))
        model.layers[-1][1][:] = y.mean()
        moments = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in model.layers]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                t += 1
                at = order[i : i + batch]
                outs = model.forward(x[at])
                d = 2 * (outs[-1] - y[at, None]) / len(at)
                for k in range(len(model.layers) - 1, -1, -1):
                    grads = outs[k].T @ d, d.sum(0)
                    if k:
                        d = (d @ model.layers[k][0].T) * (outs[k] > 0)
                    for p, g, m in zip(model.layers[k], grads, moments[k]):
                        m[0] = 0.9 * m[0] + 0.1 * g
                        m[1] = 0.999 * m[1] + 0.001 * g * g
                        p -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
        return model

    def predict(model: NeuralModel, df: DataFrame, out: str = "predict") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def run(rows: pd.Series) -> pd.Series:
            return pd.Series(shared.value.forward(np.stack(rows.to_numpy()).astype(float))[-1][:, 0] if len(rows) else [], dtype=float)

        return df.withColumn(out, run(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.columns])))

    return Callbacks(train, predict, lambda model, df: predict(model, df, "predict_proba"), score)


def partitioned_linear(df: DataFrame, key: str, vector: str, coefficients: DataFrame, out: str = "score") -> DataFrame:
    """One linear model for each key: ``coefficients`` is (key, weights array, intercept). Keys without a model score 0."""
    products = F.zip_with(F.col(vector), F.col("weights"), lambda x, w: x.cast("double") * w)
    value = F.when(F.col("weights").isNull(), F.lit(0.0)).otherwise(F.aggregate(products, F.col("intercept"), lambda a, x: a + x))
    return df.join(coefficients.select(key, "weights", "intercept"), key, "left").withColumn(out, value).drop("weights", "intercept")


@dataclass
class Stacked:
    """Base models whose probabilities are the features of a meta model."""

    bases: Mapping[str, tuple[Callbacks, Sequence[str]]]
    meta: Callbacks
    fitted: dict[str, object] = field(default_factory=dict)

    def _levels(self, df: DataFrame) -> DataFrame:
        for name, (callbacks, _) in self.bases.items():
            df = callbacks.predict_proba(self.fitted[name], df).withColumnRenamed("predict_proba", f"_base_{name}")
        return df

    def fit(self, df: DataFrame, label: str) -> Stacked:
        for name, (callbacks, columns) in self.bases.items():
            self.fitted[name] = callbacks.train(df, columns, label)
        self.fitted["_meta"] = self.meta.train(self._levels(df), [f"_base_{n}" for n in self.bases], label)
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        out = self.meta.predict_proba(self.fitted["_meta"], self._levels(df))
        return out.drop(*[f"_base_{n}" for n in self.bases])


def save(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
