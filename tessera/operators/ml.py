"""Fits that need pyspark.ml: a tabular ranker, a frozen probe and cluster leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .association import association


def numeric_columns(df: DataFrame, candidates: Sequence[str], never: Sequence[str] = ()) -> list[str]:
    """Candidates with at least two numbers and two distinct values, in one aggregate pass."""
    names = [c for c in candidates if c not in never]
    tests = [F.struct(F.count(F.col(c).try_cast("double")).alias("n"), F.approx_count_distinct(F.col(c).try_cast("double")).alias("d")).alias(c) for c in names]
    row = df.agg(*tests).first() if tests else None
    return [c for c in names if row[c]["n"] >= 2 and row[c]["d"] > 1]


def fit_ranker(train: DataFrame, features: Sequence[str], label: str, trees: int = 40, seed: int = 7):
    """Median impute, standardise, balanced class weights, random forest."""
    sizes = train.groupBy(label).agg(F.count("*").alias("__n"))
    total, classes = train.agg(F.count("*")).scalar(), sizes.agg(F.count("*")).scalar()
    rows = train.join(sizes, label).withColumn("__w", total / (classes * F.col("__n")))
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in features], label, "__w")
    filled = [f"{c}__f" for c in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="__raw", handleInvalid="keep"),
            StandardScaler(inputCol="__raw", outputCol="features", withMean=True),
            StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip", stringOrderType="alphabetAsc"),
            RandomForestClassifier(labelCol="__y", weightCol="__w", numTrees=trees, maxDepth=5, seed=seed),
        ]
    ).fit(rows)


def apply_ranker(model, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, ranker_bucket, ranker_confidence, ranker_prob_<class>...)."""
    labels = model.stages[3].labels
    stages = [s for i, s in enumerate(model.stages) if i != 3]
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in features])
    for s in stages:
        rows = s.transform(rows)
    p = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_max(p)
    return rows.select(
        key, F.element_at(names, F.array_position(p, best).cast("int")).alias("ranker_bucket"), best.alias("ranker_confidence"), *[p[i].alias(f"ranker_prob_{x}") for i, x in enumerate(labels)]
    )


def linear_probe(df: DataFrame, vector: str, label: str):
    """Standardised multinomial logistic regression on an array column."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("__raw"), F.col(label).alias("__class"))
    return Pipeline(
        stages=[
            StandardScaler(inputCol="__raw", outputCol="features", withMean=True),
            StringIndexer(inputCol="__class", outputCol="label", stringOrderType="alphabetAsc"),
            LogisticRegression(regParam=0.01, maxIter=50),
        ]
    ).fit(rows)


def cluster_leakage(df: DataFrame, vector: str, group: str, k: int, seed: int = 7) -> DataFrame:
    """NMI (arithmetic mean of entropies) between k-means clusters of vectors and a group column."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), group)
    found = KMeans(k=k, seed=seed, maxIter=15).fit(rows).transform(rows).select(group, "prediction")
    got = association(found, "prediction", group)
    return got.select("n", "mi", F.coalesce(F.try_divide(2.0 * F.col("mi"), F.col("h_a") + F.col("h_b")), F.lit(0.0)).alias("nmi"))
