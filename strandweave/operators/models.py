"""Scoring with pluggable models, ensembles, baselines and data splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Named transforms a user adds to: ``DataFrame -> DataFrame`` with keyword parameters.
STACKS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        STACKS[name] = f
        return f

    return add


def stack(df: DataFrame, steps: list[tuple[Callable[..., DataFrame], dict]]) -> DataFrame:
    """Transforms one after the other."""
    return reduce(lambda now, step: now.transform(step[0], **step[1]), steps, df)


def extract(df: DataFrame, extractor: Callable[[DataFrame], DataFrame], premodel: Callable[[DataFrame], DataFrame] | None = None, postprocess: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] | None = None, aggregate: dict[str, str] | None = None) -> DataFrame:
    """An extractor between its hooks: what prepares its input, what cleans its output, and by ``keys`` what ``aggregate`` (column: function) makes of that."""
    out = df if premodel is None else df.transform(premodel)
    out = out.transform(extractor)
    out = out if postprocess is None else out.transform(postprocess)
    return out if not aggregate else out.groupBy(*(keys or [])).agg(*[F.expr(f"{how}({column})").alias(column) for column, how in aggregate.items()])


def score(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], np.ndarray]], columns: list[str], out: str) -> DataFrame:
    """Add an array<double> that a model gives for batches; ``make_model`` runs once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch), float)))

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<double>")(F.struct(*columns)))


def input_times_gradient(values: str, gradients: str):
    """Importances from supplied gradients."""
    return F.zip_with(values, gradients, lambda x, g: x * g)


def ensemble(predictions: list[DataFrame], keys: list[str], value: str, z: float = 2.576) -> DataFrame:
    """Mean over models with its confidence interval."""
    whole = reduce(DataFrame.unionByName, predictions)
    half = z * F.stddev_pop(value) / F.sqrt(F.count(F.lit(1)))
    return whole.groupBy(*keys).agg(F.avg(value).alias(value), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: both classes count alike."""
    sums = df.agg(F.avg(F.col(label).cast("double")).alias("_share"))
    weight = F.when(F.col(label) == 1, F.try_divide(F.lit(0.5), F.col("_share"))).otherwise(F.try_divide(F.lit(0.5), 1 - F.col("_share")))
    return df.crossJoin(F.broadcast(sums)).withColumn("weight", weight).drop("_share")


def random_forest(train: DataFrame, test: DataFrame, features: str, label: str, trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """A forest on an array column; returns ``test`` with ``probability`` (array) and ``prediction``."""
    vectors = lambda df: df.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    model = RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(vectors(train))
    return model.transform(vectors(test)).withColumn("probability", vector_to_array("probability")).drop("_v", "rawPrediction")


def perceptron(train: DataFrame, test: DataFrame, features: str, label: str, layers: list[int], seed: int = 42) -> DataFrame:
    vectors = lambda df: df.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    model = MultilayerPerceptronClassifier(featuresCol="_v", labelCol=label, layers=layers, seed=seed).fit(vectors(train))
    return model.transform(vectors(test)).withColumn("probability", vector_to_array("probability")).drop("_v", "rawPrediction")


def split(df: DataFrame, folds: dict[str, int], valid: int, test: int, chrom: str = "chrom") -> dict[str, DataFrame]:
    """train, valid and test by the fold of the chromosome; a negative of the genome-wide kind goes to test only."""
    table = F.broadcast(df.sparkSession.createDataFrame(list(folds.items()), "_c string, _fold int"))
    rows = df.join(table, df[chrom] == table["_c"]).drop("_c")
    wide = F.lit(False) if "example_type" not in df.columns else F.col("example_type") == "genomewide_negatives"
    parts = {"train": ~F.col("_fold").isin(valid, test) & ~wide, "valid": (F.col("_fold") == valid) & ~wide, "test": F.col("_fold") == test}
    return {name: rows.where(c).drop("_fold") for name, c in parts.items()}


def train_until(step: Callable[[int], float], patience: int = 3, most: int = 30) -> tuple[int, float]:
    """Early stopping: best round and its loss, given a step that trains a round and returns its validation loss."""
    best = (0, float("inf"))
    for i in range(most):
        loss = step(i)
        if loss < best[1]:
            best = (i, loss)
        elif i - best[0] >= patience:
            break
    return best
