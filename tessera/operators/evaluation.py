"""F1, agreement, cluster bootstrap, gates and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import violated
from ..session import stored


def confusion(df: DataFrame, truth: str, guess: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, tp, fp, fn) over a fixed label list."""
    hit = F.explode(F.array_distinct(F.array(truth, guess))).alias("label")
    rows = df.select(*by, truth, guess, hit).where(F.col("label").isin(*labels))
    t, g = F.col(truth) == F.col("label"), F.col(guess) == F.col("label")
    return rows.groupBy(*by, "label").agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def macro_f1(df: DataFrame, truth: str, guess: str, labels: Sequence[str]) -> DataFrame:
    """Mean F1 over the label list; a label that never occurs counts 0."""
    got = confusion(df, truth, guess, labels).agg(F.sum(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("s"))
    return got.select((F.coalesce("s", F.lit(0.0)) / F.lit(float(len(labels)))).alias("macro_f1"))


def draws(spark, iterations: int, clusters: int, seed: str) -> DataFrame:
    """(iteration, place), a row per draw: clusters drawn with replacement, from hashes of iteration and draw.

    The rows are a range of known length, so that the planner does not take them for few.
    """
    each = max(clusters, 1)
    i, d = F.expr(f"id div {each}"), F.col("id") % each
    word = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), i.cast("string"), d.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return spark.range(iterations * clusters).select(i.alias("iteration"), (word % each).alias("place"))


def _cluster_counts(df: DataFrame, cluster: str, truth: str, guesses: Sequence[str], labels: Sequence[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """One row per cluster with the confusion counts of each guess and label side by side; the names
    of these columns; and per guess its macro F1 over them. Clusters without any label count too."""
    counts, scores = [], []
    for j, guess in enumerate(guesses):
        parts = []
        for i, label in enumerate(labels):
            t, g = F.col(truth) == label, F.col(guess) == label
            names = [f"__{c}_{j}_{i}" for c in ("tp", "fp", "fn")]
            counts += [F.count_if(x).alias(n) for n, x in zip(names, (t & g, ~t & g, t & ~g))]
            parts.append(f1(*[F.col(n) for n in names]))
        scores.append(sum(parts[1:], parts[0]) / F.lit(float(len(labels))))
    names = [f"__{c}_{j}_{i}" for j in range(len(guesses)) for i in range(len(labels)) for c in ("tp", "fp", "fn")]
    return stored(df.groupBy(cluster).agg(*counts), "cluster-counts"), names, scores


def _drawn_counts(counts: DataFrame, names: Sequence[str], cluster: str, iterations: int, seed: str) -> DataFrame:
    """(iteration, names...): sums of the counts of clusters drawn with replacement.

    Draws and clusters both grow with the input, so neither side of their join is broadcast.
    """
    from .select import global_rank

    ranked = global_rank(counts.withColumn("__h", F.sha2(F.col(cluster).cast("string"), 256)), "__h", cluster, "__r").select((F.col("__r") - 1).alias("place"), *names)
    drawn = draws(counts.sparkSession, iterations, counts.count(), seed).hint("merge").join(ranked, "place")
    return drawn.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in names])


def cluster_bootstrap(df: DataFrame, cluster: str, truth: str, guess: str, labels: Sequence[str], iterations: int, seed: str) -> DataFrame:
    """Bounds (2.5 %, 97.5 %) and mean of macro F1 when whole clusters are drawn again.

    Confusion counts per cluster are made once; an iteration adds those of its draws.
    """
    counts, names, (f,) = _cluster_counts(df, cluster, truth, [guess], labels)
    score = _drawn_counts(counts, names, cluster, iterations, seed).select(f.alias("f"))
    return score.agg(F.count("*").alias("iterations"), F.avg("f").alias("mean"), F.percentile("f", 0.025).alias("low"), F.percentile("f", 0.975).alias("high"))


def paired_bootstrap(df: DataFrame, cluster: str, truth: str, first: str, second: str, labels: Sequence[str], iterations: int, seed: str) -> DataFrame:
    """Macro F1 of ``first`` minus that of ``second``, and its bounds under the same draws."""
    counts, names, (f, g) = _cluster_counts(df, cluster, truth, [first, second], labels)
    deltas = _drawn_counts(counts, names, cluster, iterations, seed).select((f - g).alias("d"))
    point = counts.agg(*[F.sum(c).alias(c) for c in names]).select((f - g).alias("p")).scalar()
    return deltas.agg(F.count("*").alias("iterations"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high")).withColumn("delta", F.coalesce(point, F.lit(0.0)))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected agreement and Cohen's kappa (1 when chance alone agrees fully)."""
    n = df.agg(F.count("*")).scalar().cast("double")
    left = df.groupBy(F.col(a).alias("l")).agg(F.count("*").alias("na"))
    right = df.groupBy(F.col(b).alias("l")).agg(F.count("*").alias("nb"))
    expected = left.join(right, "l").agg(F.sum(F.col("na") * F.col("nb")).alias("s")).select("s").scalar() / (n * n)
    got = df.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed")).withColumn("expected", F.coalesce(expected, F.lit(0.0)))
    return got.withColumn("kappa", F.when(F.col("expected") >= 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1.0 - F.col("expected"))))


def gates(df: DataFrame, value: str, threshold: str, direction: str) -> DataFrame:
    """Adds passed; a missing or NaN value never passes."""
    v = F.col(value)
    fine = v.isNotNull() & ~F.isnan(v)
    ok = F.when(F.col(direction) == "min", v >= F.col(threshold)).otherwise(v <= F.col(threshold))
    return df.withColumn("passed", fine & ok)


def go_decision(deltas: Sequence[Column], thresholds: Sequence[float], low: Column, seeds_positive: Column, leakage: Column, most_leakage: float = 0.02) -> tuple[Column, Column]:
    """(decision, reasons): GO only when every rule holds."""
    rules = [(f"delta_{i + 1}_below_threshold", ~F.coalesce(d >= t, F.lit(False))) for i, (d, t) in enumerate(zip(deltas, thresholds))]
    rules += [("interval_includes_zero", ~F.coalesce(low > 0, F.lit(False))), ("seed_not_positive", ~F.coalesce(seeds_positive, F.lit(False))), ("leakage", ~F.coalesce(leakage <= most_leakage, F.lit(False)))]
    reasons = violated(rules)
    return F.when(F.size(reasons) == 0, "GO").otherwise("NO_GO"), F.array_join(reasons, ";")
