"""Counts, association, agreement, bootstrap, gates, model statistics and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import association as A
from ..operators import evaluation as E
from ..operators import ml
from ..operators.validation import manifest_audit as audit
from .tables import EVENTS_SQL, TAKES_SQL, events, r6, read, takes

EV = f"ev AS ({EVENTS_SQL})"
TYPES = ("click", "purchase", "view", "signup", "error")
#: Truth and guess of an event: its type, and the type of the user's next event.
PAIRED = f"pr AS (SELECT event_id, user_id, event_type AS truth, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id), event_type) AS guess, k FROM ({EVENTS_SQL}))"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, sf_dir).select("event_id", "user_id", F.col("event_type").alias("truth"), F.coalesce(F.lead("event_type").over(w), F.col("event_type")).alias("guess"), "k")


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by label, with a row total."""
    t = takes(spark, sf_dir).withColumn("q", F.when(F.col("usable_for") == "", "missing").otherwise(F.col("usable_for")))
    wide = t.groupBy("parent_task").pivot("q", ["tokenizer_main", "loco_aux", "diagnostic_candidate", "discard", "missing"]).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumn("total", F.col("tokenizer_main") + F.col("loco_aux") + F.col("diagnostic_candidate") + F.col("discard") + F.col("missing"))


CROSSTAB_SQL = f"""SELECT parent_task, count(*) FILTER (WHERE usable_for = 'tokenizer_main') AS tokenizer_main, count(*) FILTER (WHERE usable_for = 'loco_aux') AS loco_aux, count(*) FILTER (WHERE usable_for = 'diagnostic_candidate') AS diagnostic_candidate,
 count(*) FILTER (WHERE usable_for = 'discard') AS discard, count(*) FILTER (WHERE usable_for = '') AS missing, count(*) AS total FROM ({TAKES_SQL}) GROUP BY 1"""


def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(12)


TOP_COUNTS_SQL = "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12"


def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders have how many lines."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


HISTOGRAM_SQL = "SELECT size, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY 1"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", ((F.col("k") * 7 + F.col("user_id")) % 64).alias("code"))


CODES = f"cd AS (SELECT event_id, user_id, event_type, (k * 7 + user_id) % 64 AS code FROM ({EVENTS_SQL}))"


def code_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.usage(_codes(spark, sf_dir), "code", 64)
    return got.select("used", *[r6(c, c) for c in ("usage_fraction", "effective_codes", "max_fraction")])


USAGE_SQL = f"WITH {CODES}, n AS (SELECT code, count(*) AS c FROM cd GROUP BY 1), p AS (SELECT c / (SELECT CAST(sum(c) AS DOUBLE) FROM n) AS p FROM n) SELECT count(*) AS used, round(count(*) / 64e0, 6) AS usage_fraction, round(exp(-sum(p * ln(p))), 6) AS effective_codes, round(max(p), 6) AS max_fraction FROM p"


def zero_filled_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per code; the last sixteen of 80 codes never occur."""
    return A.zero_filled(_codes(spark, sf_dir), "code", 80)


ZERO_SQL = f"WITH {CODES} SELECT CAST(range AS BIGINT) AS code, count(event_id) AS n FROM range(80) LEFT JOIN cd ON code = range GROUP BY 1"


def describe_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events(spark, sf_dir).groupBy("event_type").agg(*A.describe("value"))
    return got.select("event_type", "n", *[r6(c, c) for c in ("mean", "std", "stderr", "lower_median", "p90", "min", "max")])


DESCRIBE_SQL = """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_pop(value) / sqrt(count(value)), 6) AS stderr, round(quantile_disc(value, 0.5), 6) AS lower_median,
 round(quantile_cont(value, 0.9), 6) AS p90, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1"""


def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping modes stand for ablation modes; the key is the part."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.round(F.avg("l_discount"), 9).alias("mse"))
    got = A.ablation(rows, "l_partkey", "l_returnflag", "mse", "N")
    return got.select(F.col("l_returnflag").alias("mode"), "n", *[r6(c, c) for c in ("delta_mean", "delta_median", "ratio", "fraction_worse")])


ABLATION_SQL = """WITH m AS (SELECT l_partkey, l_returnflag, round(avg(l_discount), 9) AS mse FROM lineitem GROUP BY 1, 2), j AS (SELECT a.l_returnflag AS mode, a.mse, b.mse AS base FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND b.l_returnflag = 'N' WHERE a.l_returnflag <> 'N')
SELECT mode, count(*) AS n, round(avg(mse - base), 6) AS delta_mean, round(quantile_cont(mse - base, 0.5), 6) AS delta_median, round(avg(mse) / avg(base), 6) AS ratio, round(avg(CASE WHEN mse - base > 0 THEN 1e0 ELSE 0e0 END), 6) AS fraction_worse FROM j GROUP BY 1"""

_NAMES = ("h_a", "h_b", "mi", "nmi", "purity_a_given_b", "purity_b_given_a", "h_a_given_b", "h_b_given_a")


def association(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.association(_codes(spark, sf_dir), "code", "event_type")
    return got.select("n", *[r6(c, c) for c in _NAMES])


def _assoc_sql(src: str, a: str, b: str, by: str = "1") -> str:
    return f"""ab AS (SELECT {by} AS g, {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY 1, 2, 3), tt AS (SELECT g, sum(n) AS t FROM ab GROUP BY 1),
ma AS (SELECT g, a, sum(n) AS n, max(n) AS top FROM ab GROUP BY 1, 2), mb AS (SELECT g, b, sum(n) AS n, max(n) AS top FROM ab GROUP BY 1, 2),
ha AS (SELECT g, -sum(n / t * ln(n / t)) AS h, sum(top) / max(t) AS p FROM ma JOIN tt USING (g) GROUP BY 1), hb AS (SELECT g, -sum(n / t * ln(n / t)) AS h, sum(top) / max(t) AS p FROM mb JOIN tt USING (g) GROUP BY 1),
mi AS (SELECT ab.g, sum(ab.n / t * ln(ab.n * t / (ma.n * mb.n))) AS mi FROM ab JOIN tt USING (g) JOIN ma ON ab.g = ma.g AND ab.a = ma.a JOIN mb ON ab.g = mb.g AND ab.b = mb.b GROUP BY 1),
assoc AS (SELECT g, CAST(t AS BIGINT) AS n, ha.h AS h_a, hb.h AS h_b, mi, CASE WHEN ha.h * hb.h > 0 THEN mi / sqrt(ha.h * hb.h) ELSE 0e0 END AS nmi, hb.p AS purity_a_given_b, ha.p AS purity_b_given_a, ha.h - mi AS h_a_given_b, hb.h - mi AS h_b_given_a FROM tt JOIN ha USING (g) JOIN hb USING (g) JOIN mi USING (g))"""


ASSOCIATION_SQL = f"WITH {CODES}, {_assoc_sql('cd', 'code', 'event_type')} SELECT n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES) + " FROM assoc"


def conditional_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.conditional_association(_codes(spark, sf_dir), "code", "event_type", "user_id", 60)
    return got.select("groups", "rows", r6("nmi", "nmi"), r6("mi", "mi"))


CONDITIONAL_SQL = f"WITH {CODES}, {_assoc_sql('cd', 'code', 'event_type', 'user_id')} SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, round(sum(nmi * n) / sum(n), 6) AS nmi, round(sum(mi * n) / sum(n), 6) AS mi FROM assoc WHERE n >= 60"


def top_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_conditional(_codes(spark, sf_dir), "code", "event_type", 5, 10, 2).select("code", "event_type", "n", "retained", "rank")


TOP_CONDITIONAL_SQL = f"""WITH {CODES}, n AS (SELECT code, event_type, count(*) AS n FROM cd GROUP BY 1, 2 HAVING count(*) >= 5), k AS (SELECT code, CAST(sum(n) AS BIGINT) AS retained FROM n GROUP BY 1 ORDER BY retained DESC, code LIMIT 10)
SELECT code, event_type, n, retained, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, event_type) AS rank FROM n JOIN k USING (code)) WHERE rank <= 2"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = takes(spark, sf_dir).withColumn("label", F.nullif("usable_for", F.lit("")))
    return t.groupBy("split").agg(F.count("label").alias("filled"), r6(F.count("label") / F.count("*"), "fraction"), F.count_distinct("label").alias("distinct_labels"))


COVERAGE_SQL = f"SELECT split, count(nullif(usable_for, '')) AS filled, round(count(nullif(usable_for, '')) / CAST(count(*) AS DOUBLE), 6) AS fraction, count(DISTINCT nullif(usable_for, '')) AS distinct_labels FROM ({TAKES_SQL}) GROUP BY 1"


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro_f1(paired(spark, sf_dir), "truth", "guess", TYPES).select(r6("macro_f1", "macro_f1"))


_LABELS = "(SELECT unnest([" + ", ".join(repr(t) for t in TYPES) + "]) AS label)"
_COUNTS = "count(*) FILTER (WHERE truth = label AND guess = label) AS tp, count(*) FILTER (WHERE truth <> label AND guess = label) AS fp, count(*) FILTER (WHERE truth = label AND guess <> label) AS fn"
MACRO_SQL = f"WITH {PAIRED}, c AS (SELECT label, {_COUNTS} FROM pr, {_LABELS} GROUP BY 1) SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END), 6) AS macro_f1 FROM c"


ITERATIONS = 200  # of the bootstraps registered here; the operators take any number


def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.cluster_bootstrap(paired(spark, sf_dir), "user_id", "truth", "guess", TYPES, ITERATIONS, "boot")
    return got.select("iterations", *[r6(c, c) for c in ("mean", "low", "high")])


BOOTSTRAP_SQL = f"""WITH {PAIRED}, c AS (SELECT user_id, label, {_COUNTS} FROM pr, {_LABELS} GROUP BY 1, 2), u AS (SELECT user_id, row_number() OVER (ORDER BY sha256(CAST(user_id AS VARCHAR)), user_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM pr)),
d AS (SELECT i.range AS iteration, CAST('0x' || substr(sha256('boot:' || i.range || ':' || j.range), 1, 8) AS BIGINT) % (SELECT max(n) FROM u) AS place FROM range({ITERATIONS}) i, range((SELECT max(n) FROM u)) j),
s AS (SELECT iteration, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM d JOIN u USING (place) JOIN c USING (user_id) GROUP BY 1, 2), f AS (SELECT iteration, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END) AS f FROM s GROUP BY 1)
SELECT count(*) AS iterations, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.975), 6) AS high FROM f"""


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.kappa(paired(spark, sf_dir), "truth", "guess").select("n", *[r6(c, c) for c in ("observed", "expected", "kappa")])


KAPPA_SQL = f"""WITH {PAIRED}, x AS (SELECT count(*) AS n, avg(CASE WHEN truth = guess THEN 1e0 ELSE 0e0 END) AS observed FROM pr), e AS (SELECT sum(a.n * b.n) / CAST((SELECT n * n FROM x) AS DOUBLE) AS expected
 FROM (SELECT truth AS l, count(*) AS n FROM pr GROUP BY 1) a JOIN (SELECT guess AS l, count(*) AS n FROM pr GROUP BY 1) b USING (l))
SELECT n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(CASE WHEN expected >= 1 THEN 1e0 ELSE (observed - expected) / (1e0 - expected) END, 6) AS kappa FROM x, e"""


def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.when(F.col("user_id") % 5 == 0, "heldout").otherwise("train").alias("split"), "user_id", (F.col("t") - 1704067200.0).alias("t"), (F.col("k") % 2 == 0).alias("pose"), (F.col("value") > 50).alias("flow"))
    got = audit(e, "split", "user_id", "t", ["pose", "flow"])
    return got.select("split", "rows", "groups", "least_rows", "most_rows", F.round("first_time", 3).alias("first_time"), F.round("last_time", 3).alias("last_time"), "pose_true", "flow_true")


MANIFEST_SQL = f"""WITH {EV}, m AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'heldout' ELSE 'train' END AS split, user_id, t - 1704067200e0 AS t, k % 2 = 0 AS pose, value > 50 AS flow FROM ev), g AS (SELECT split, user_id, count(*) AS n, min(t) AS t0, max(t) AS t1, count(*) FILTER (WHERE pose) AS pose, count(*) FILTER (WHERE flow) AS flow FROM m GROUP BY 1, 2)
SELECT split, CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, min(n) AS least_rows, max(n) AS most_rows, round(min(t0), 3) AS first_time, round(max(t1), 3) AS last_time, CAST(sum(pose) AS BIGINT) AS pose_true, CAST(sum(flow) AS BIGINT) AS flow_true FROM g GROUP BY 1"""


def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: three gates on its statistics, and whether all pass."""
    s = events(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("top"))
    long = s.select("event_type", F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.lit(t).alias("threshold"), F.lit(d).alias("direction")) for n, t, d in (("mean", 20.0, "min"), ("std", 25.0, "max"), ("top", 100.0, "max"))])).alias("g")).select("event_type", "g.*")
    got = E.gates(long, "value", "threshold", "direction")
    return got.groupBy("event_type").agg(F.count_if("passed").alias("passed"), F.bool_and("passed").alias("all_pass"))


GATE_SQL = """WITH s AS (SELECT event_type, avg(value) >= 20 AS a, stddev_pop(value) <= 25 AS b, max(value) <= 100 AS c FROM events GROUP BY 1) SELECT event_type, CAST(CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) AS BIGINT) AS passed, a AND b AND c AS all_pass FROM s"""


def go_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision per user from deltas between event types."""
    e = events(spark, sf_dir)
    base = F.avg("value")
    rows = e.groupBy("user_id").agg(*[(F.coalesce(F.avg(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0)) / base - 1.0).alias(f"d{i}") for i, t in enumerate(TYPES[:3])], (F.min("value") - 0.5).alias("low"), (F.max("k") % 4 / 100.0).alias("leak"), (F.min("k") >= 0).alias("seeds"))
    decision, reasons = E.go_decision([F.col(f"d{i}") for i in range(3)], [0.05, 0.03, 0.03], F.col("low"), F.col("seeds"), F.col("leak"))
    return rows.select("user_id", decision.alias("decision"), reasons.alias("reasons"))


GO_SQL = f"""WITH {EV}, r AS (SELECT user_id, {', '.join(f"coalesce(avg(value) FILTER (WHERE event_type = '{t}'), 0e0) / avg(value) - 1e0 AS d{i}" for i, t in enumerate(TYPES[:3]))}, min(value) - 0.5e0 AS low, max(k) % 4 / 100e0 AS leak FROM ev GROUP BY 1),
x AS (SELECT user_id, list_filter([CASE WHEN d0 < 0.05e0 THEN 'delta_1_below_threshold' END, CASE WHEN d1 < 0.03e0 THEN 'delta_2_below_threshold' END, CASE WHEN d2 < 0.03e0 THEN 'delta_3_below_threshold' END, CASE WHEN low <= 0 THEN 'interval_includes_zero' END, CASE WHEN leak > 0.02e0 THEN 'leakage' END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT user_id, CASE WHEN len(l) = 0 THEN 'GO' ELSE 'NO_GO' END AS decision, array_to_string(l, ';') AS reasons FROM x"""


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over the distances to eight code vectors (the first eight embeddings)."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("v"))
    codes = e.where("vec_id < 8").select(F.col("vec_id").alias("code"), F.col("v").alias("c"))
    book = codes.agg(F.sort_array(F.collect_list(F.struct("code", "c"))).alias("book")).scalar()  # eight rows
    d = F.transform(F.col("book"), lambda b: F.sqrt(V.dot(F.zip_with("v", b["c"], lambda x, y: x - y), F.zip_with("v", b["c"], lambda x, y: x - y))))
    e = e.withColumn("book", book).withColumn("d", d).withColumn("x", F.transform("d", lambda x: F.exp(-x / 0.5)))
    return e.withColumn("s", F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).withColumn("p", F.transform("x", lambda x: x / F.col("s"))).drop("book", "x", "s", "v")


ASSIGN = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), pr AS (SELECT a.vec_id, a.label, b.vec_id AS code, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON b.vec_id < 8),
sm AS (SELECT *, exp(-d / 0.5e0) / sum(exp(-d / 0.5e0)) OVER (PARTITION BY vec_id) AS p FROM pr)"""


def soft_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest code, assignment entropy and confidence of every vector."""
    a = _assignments(spark, sf_dir)
    best = F.array_position("d", F.array_min("d")) - 1
    h = V.entropy("p")
    return a.select("vec_id", best.cast("bigint").alias("code"), r6(h, "entropy"), r6(1.0 - h / F.ln(F.lit(8.0)), "confidence"))


SOFT_SQL = f"WITH {ASSIGN} SELECT vec_id, arg_min(code, d) AS code, round(-sum(p * ln(p)), 6) AS entropy, round(1e0 + sum(p * ln(p)) / ln(8e0), 6) AS confidence FROM sm GROUP BY 1"


def usage_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _assignments(spark, sf_dir).select("label", F.posexplode("p").alias("code", "p"))
    return A.kl_to_uniform(long, "label", "code", "p", 8).select("label", r6("kl", "kl"))


KL_SQL = f"WITH {ASSIGN} SELECT label, round(sum(0.125e0 * ln(0.125e0 / greatest(q, 1e-9))), 6) AS kl FROM (SELECT label, code, avg(p) AS q FROM sm GROUP BY 1, 2) GROUP BY 1"


def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("x", F.when(F.col("k") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).withColumn("w", F.when(F.col("k") % 7 == 0, None).otherwise((F.col("k") % 3) / F.lit(100.0)))
    return e.groupBy("user_id").agg(r6(A.masked_mean(F.col("x"), F.col("w")), "loss"))


MASKED_SQL = f"WITH {EV}, a AS (SELECT user_id, value, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 0e0 ELSE (k % 3) / 100e0 END AS w FROM ev) SELECT user_id, round(sum(value * w) / greatest(sum(w), 1e0), 6) AS loss FROM a GROUP BY 1"


def phase_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference of consecutive vectors of a label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.lag("embedding").over(w).alias("before"))
    return e.where("before IS NOT NULL").select("vec_id", r6(V.mean_abs_difference("embedding", "before"), "step"))


STEPS_SQL = """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, lag(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_avg(list_transform(list_zip(v, b), lambda x: abs(x[1] - x[2]))), 6) AS step FROM a WHERE b IS NOT NULL"""

FEATURES = ("scene_only_score", "interaction_score", "loco_score", "fine_dexterous_score", "temporal_diversity_score", "n_chars")


def ranker_fit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest on the labelled rows, applied to all: class, confidence, probabilities."""
    t = takes(spark, sf_dir)
    names = ml.numeric_columns(t, FEATURES)
    train = t.where("usable_for <> '' AND take_uid % 4 <> 0").select(*names, "usable_for")
    return ml.apply_ranker(ml.fit_ranker(train, names, "usable_for"), t, "take_uid", names).select("take_uid", "ranker_bucket", r6("ranker_confidence", "ranker_confidence"))


def frozen_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    model = ml.linear_probe(e.where("vec_id % 4 <> 0"), "embedding", "label")
    from pyspark.ml.functions import array_to_vector

    rows = e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("__raw"))
    scored = model.stages[2].transform(model.stages[0].transform(rows.drop("label")))
    return scored.select("vec_id", F.col("prediction").cast("bigint").alias("prediction"))


def kmeans_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.cluster_leakage(read(spark, sf_dir, "embeddings"), "embedding", "label", 8)


QUERIES = {
    "crosstab": (crosstab, CROSSTAB_SQL),
    "top_counts": (top_counts, TOP_COUNTS_SQL),
    "size_histogram": (size_histogram, HISTOGRAM_SQL),
    "code_usage": (code_usage, USAGE_SQL),
    "zero_filled_codes": (zero_filled_codes, ZERO_SQL),
    "describe_metric": (describe_metric, DESCRIBE_SQL),
    "ablation_delta": (ablation_delta, ABLATION_SQL),
    "association": (association, ASSOCIATION_SQL),
    "conditional_association": (conditional_association, CONDITIONAL_SQL),
    "top_conditional": (top_conditional, TOP_CONDITIONAL_SQL),
    "coverage": (coverage, COVERAGE_SQL),
    "macro_f1": (macro_f1, MACRO_SQL),
    "cluster_bootstrap": (cluster_bootstrap, BOOTSTRAP_SQL),
    "kappa": (kappa, KAPPA_SQL),
    "manifest_audit": (manifest_audit, MANIFEST_SQL),
    "gate_table": (gate_table, GATE_SQL),
    "go_decision": (go_decision, GO_SQL),
    "soft_assign": (soft_assign, SOFT_SQL),
    "usage_kl": (usage_kl, KL_SQL),
    "masked_mean": (masked_mean, MASKED_SQL),
    "phase_steps": (phase_steps, STEPS_SQL),
    "ranker_fit_apply": (ranker_fit_apply, None),
    "frozen_probe": (frozen_probe, None),
    "kmeans_leakage": (kmeans_leakage, None),
}
