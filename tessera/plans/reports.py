"""Bindings of reports, ordered picks and text helpers, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as X
from ..operators import reports as R
from ..operators import weights as W
from ..operators.select import dense_index
from ..sources.artifacts import phase_label, resolved_capability
from .losses import ASSIGN, assignments
from .tables import EVENTS_SQL, TAKES_SQL, events, r6, read, takes

EV = f"ev AS ({EVENTS_SQL})"


def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = takes(spark, sf_dir).select("usable_for", (F.col("take_uid") % 3 == 0).alias("pose"), F.when(F.col("take_uid") % 4 > 0, F.col("take_uid") % 4 > 1).alias("mask"))
    return R.strata_counts(t, "usable_for", ["pose", "mask"])


STRATA_SQL = f"""SELECT concat_ws('|', usable_for, 'pose=' || CAST(take_uid % 3 = 0 AS VARCHAR), 'mask=' || CAST(take_uid % 4 > 1 AS VARCHAR)) AS stratum, count(*) AS n FROM ({TAKES_SQL}) GROUP BY 1"""


def group_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("w", F.col("value") - 20.0)
    return R.group_mass(e, "user_id", "w").select("user_id", F.round("mass", 4).alias("mass"))


MASS_SQL = "SELECT user_id, round(sum(greatest(value - 20e0, 0e0)), 4) AS mass FROM events GROUP BY 1"


def offset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("offset", F.col("value") - 40.0)
    return R.offset_stats(e, ["event_type"], "offset").select("event_type", *[r6(c, c) for c in ("most", "median", "p90")])


OFFSET_SQL = """SELECT event_type, round(max(abs(value - 40e0)), 6) AS most, round(quantile_cont(abs(value - 40e0), 0.5), 6) AS median, round(quantile_cont(abs(value - 40e0), 0.9), 6) AS p90 FROM events GROUP BY 1"""


def mapped_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents against their language and source, of those that are mapped."""
    t = takes(spark, sf_dir)
    got = R.mapped_precision(t.withColumn("mapped", F.col("usable_for") != ""), "mapped", {"main": F.col("usable_for") == "tokenizer_main", "cooking": F.col("parent_task") == "Cooking"}, 0.1)
    return got.select("n", *[r6(c, c) for c in ("coverage", "main_precision", "cooking_precision")], "passed")


PRECISION_SQL = f"""WITH t AS (SELECT usable_for <> '' AS m, usable_for = 'tokenizer_main' AS a, parent_task = 'Cooking' AS b FROM ({TAKES_SQL})), s AS (SELECT count(*) AS n, avg(CASE WHEN m THEN 1e0 ELSE 0e0 END) AS c, avg(CASE WHEN m AND a THEN 1e0 ELSE 0e0 END) AS p, avg(CASE WHEN m AND b THEN 1e0 ELSE 0e0 END) AS q FROM t)
SELECT n, round(c, 6) AS coverage, round(p, 6) AS main_precision, round(q, 6) AS cooking_precision, least(p, q) >= 0.1e0 AS passed FROM s"""


def review_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").selectExpr("CASE WHEN doc_id % 3 = 0 THEN 'No' ELSE ' yes' END AS a", "CASE WHEN doc_id % 5 = 0 THEN 'no' WHEN doc_id % 101 = 0 THEN 'maybe' ELSE 'YES' END AS b")
    return R.review_fraction(d, ["a", "b"], 0.5).select("n", "n_passed", "invalid", r6("fraction", "fraction"), "gate")


REVIEW_FRACTION_SQL = """WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 101 <> 0) AS p, count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 101 = 0) AS i FROM documents)
SELECT n, p AS n_passed, i AS invalid, round(p / CAST(n AS DOUBLE), 6) AS fraction, i = 0 AND p / CAST(n AS DOUBLE) >= 0.5 AS gate FROM s"""


def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.token_report(assignments(spark, sf_dir), 8)
    return got.select("n", "token_min", "token_max", "used_codes", "in_range", *[r6(c, c) for c in ("confidence_min", "confidence_mean", "confidence_max", "entropy_mean")])


TOKEN_SQL = f"""WITH {ASSIGN}, h AS (SELECT view, sample, slot, -sum(p * ln(least(greatest(p, 1e-8), 1e0))) AS h FROM lg GROUP BY 1, 2, 3)
SELECT (SELECT count(*) FROM s) AS n, CAST((SELECT min(code) FROM s) AS INTEGER) AS token_min, CAST((SELECT max(code) FROM s) AS INTEGER) AS token_max, (SELECT count(DISTINCT code) FROM s) AS used_codes, true AS in_range,
 round(min(1e0 - h / ln(8e0)), 6) AS confidence_min, round(avg(1e0 - h / ln(8e0)), 6) AS confidence_mean, round(max(1e0 - h / ln(8e0)), 6) AS confidence_max, round(avg(h), 6) AS entropy_mean FROM h"""


def campaign_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types are controls, users modulo 3 seeds."""
    e = events(spark, sf_dir).select("event_type", (F.col("user_id") % 3).alias("seed"), "value", (F.col("k") * 1.0).alias("leak"))
    got = R.campaign_rollup(e, "event_type", "seed", "value", "leak", "click")
    return got.select("event_type", "seeds", r6("delta", "delta"), "positive_seeds", r6("worst_leakage", "worst_leakage"))


CAMPAIGN_SQL = f"""WITH {EV}, p AS (SELECT event_type, user_id % 3 AS seed, avg(value) AS s, avg(k * 1e0) AS l FROM ev GROUP BY 1, 2)
SELECT p.event_type, count(*) AS seeds, round(avg(p.s - b.s), 6) AS delta, count(*) FILTER (WHERE p.s > b.s) AS positive_seeds, round(max(p.l - b.l), 6) AS worst_leakage FROM p JOIN p b ON b.event_type = 'click' AND p.seed = b.seed WHERE p.event_type <> 'click' GROUP BY 1"""


def raster_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit rasters of two words per event, joined per user."""
    e = events(spark, sf_dir).select("user_id", F.expr("array(shiftleft(1L, CAST(k % 60 AS INT)), CAST(event_id % 1024 AS BIGINT)) AS bits"))
    return X.raster_union(e, ["user_id"], "bits").select("user_id", F.array_join(F.transform("bits", lambda b: b.cast("string")), ",").alias("bits"))


RASTER_SQL = f"WITH {EV} SELECT user_id, CAST(bit_or(CAST(1 AS BIGINT) << CAST(k % 60 AS INTEGER)) AS VARCHAR) || ',' || CAST(bit_or(event_id % 1024) AS VARCHAR) AS bits FROM ev GROUP BY 1"


def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = takes(spark, sf_dir)
    return R.top_examples(t, (F.col("usable_for") == "discard") & (F.col("scene_only_score") < 0.8), "interaction_score", "take_uid").select("take_uid", r6("interaction_score", "interaction_score"))


EXAMPLES_SQL = f"SELECT take_uid, round(interaction_score, 6) AS interaction_score FROM ({TAKES_SQL}) WHERE usable_for = 'discard' AND scene_only_score < 0.8 ORDER BY interaction_score DESC, take_uid LIMIT 12"


def custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred takes by label in a custom order, then by id, with their place."""
    t = R.in_custom_order(takes(spark, sf_dir).select("usable_for", "take_uid"), "usable_for", ["diagnostic_candidate", "loco_aux", "discard", "tokenizer_main"], "take_uid").limit(100)
    return t.select("take_uid", "usable_for")


CUSTOM_SQL = f"SELECT take_uid, usable_for FROM ({TAKES_SQL}) ORDER BY CASE usable_for WHEN 'diagnostic_candidate' THEN 1 WHEN 'loco_aux' THEN 2 WHEN 'discard' THEN 3 WHEN 'tokenizer_main' THEN 4 ELSE 5 END, take_uid LIMIT 100"


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 50 to 89 of the sorted list."""
    return R.page(dense_index(read(spark, sf_dir, "orders"), "o_orderkey", "place"), "place", 50, 40)


PAGE_SQL = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 50"


def strongest_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ship mode the return flag whose mean discount rises most above the least one."""
    m = read(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.round(F.avg("l_discount"), 9).alias("delta"))
    return R.strongest(m, ["l_linenumber"], "l_returnflag", "delta").select("l_linenumber", "l_returnflag", r6("delta", "delta"))


STRONGEST_SQL = """WITH m AS (SELECT l_linenumber, l_returnflag, round(avg(l_discount), 9) AS delta FROM lineitem GROUP BY 1, 2)
SELECT l_linenumber, l_returnflag, round(delta, 6) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY delta DESC, l_returnflag) AS rn FROM m) WHERE rn = 1"""


def partition_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id")
    parts = {"a": e.where("user_id % 5 < 3"), "b": e.where("user_id % 5 = 4"), "c": e.where("user_id % 10 = 0").union(spark.range(-3, 0))}
    return R.partition_proof(parts, e, "user_id")


PARTITION_SQL = """SELECT count(DISTINCT user_id) AS keys, count(DISTINCT user_id) FILTER (WHERE user_id % 10 = 0) AS shared, count(DISTINCT user_id) FILTER (WHERE user_id % 5 = 3) AS uncovered, CAST(3 AS BIGINT) AS "foreign" FROM events"""


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, padding, last parts and patterns of part names."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    named = p.withColumn("file", F.concat(F.lit("run/step_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, ".bin").otherwise(":old")))
    digest = F.when(F.col("p_partkey") % 2 == 0, F.sha2("p_name", 256)).otherwise(F.upper(F.sha2("p_name", 256)))
    return named.select(
        "p_partkey", R.slug(F.concat(F.lit(" *"), "p_name", F.lit("& "), "p_type")).alias("slug"), R.padded(F.col("p_partkey") * 7).alias("padded"), R.after_last("file", ":").alias("last"),
        R.checkpoint_step("file").alias("step"), R.checkpoint_step(F.coalesce("p_brand", F.lit(""))).isNull().alias("no_step"), R.is_sha256(digest).alias("digest"),
    )


TEXT_SQL = """WITH a AS (SELECT *, 'run/step_' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.bin' ELSE ':old' END AS file FROM part)
SELECT p_partkey, trim(regexp_replace(lower(trim(' *' || p_name || '& ' || p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN p_partkey * 7 >= 1000 THEN CAST(p_partkey * 7 AS VARCHAR) ELSE lpad(CAST(p_partkey * 7 AS VARCHAR), 4, '0') END AS padded,
 CASE WHEN p_partkey % 4 = 0 THEN file ELSE 'old' END AS last, CAST(p_partkey AS BIGINT) AS step, true AS no_step, p_partkey % 2 = 0 AS digest FROM a"""

def labelled_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels of some confidence over automatic ones, with weights per label."""
    d = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'main' WHEN doc_id % 3 = 1 THEN ' ' END AS label", "CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE CAST((doc_id % 10) / 10e0 AS STRING) END AS conf",
        "CASE WHEN doc_id % 2 = 0 THEN 'phase' ELSE 'odd' END AS auto", "CASE WHEN doc_id % 7 = 0 THEN '-1' ELSE '0.5' END AS tw",
    )
    got = W.labelled_weight(F.col("label"), F.col("conf"), F.col("auto"), F.col("tw"), {"main": 1.0, "phase": 0.6}, 0.5)
    return d.select("doc_id", *[c.alias(n) for n, c in got.items()])


LABELLED_SQL = """WITH a AS (SELECT doc_id, doc_id % 3 = 0 AND (doc_id % 5 = 0 OR doc_id % 10 >= 5) AS human FROM documents), b AS (SELECT doc_id, human, CASE WHEN human THEN 'main' WHEN doc_id % 2 = 0 THEN 'phase' ELSE 'odd' END AS label FROM a)
SELECT doc_id, label, CASE WHEN human THEN 'human' ELSE 'auto' END AS label_source, greatest(CASE label WHEN 'main' THEN 1e0 WHEN 'phase' THEN 0.6e0 ELSE 0e0 END * CASE WHEN doc_id % 7 = 0 THEN -1e0 ELSE 0.5e0 END, 0e0) AS weight FROM b"""


def next_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").selectExpr("CASE WHEN doc_id % 9 > 0 THEN 36 + doc_id % 20 END AS used", "CASE WHEN doc_id % 9 > 0 THEN (doc_id % 60) / 100e0 END AS nmi")
    return d.groupBy(W.next_recipe(F.col("used"), F.col("nmi")).alias("recipe")).agg(F.count(F.lit(1)).alias("n"))


RECIPE_SQL = """WITH d AS (SELECT doc_id % 9 AS r, 36 + doc_id % 20 AS u, (doc_id % 60) / 100e0 AS m FROM documents)
SELECT CASE WHEN r = 0 THEN 'first_round' WHEN u < 45 AND m <= 0.45 THEN 'usage_repair' WHEN u < 45 THEN 'dense_group_repair' WHEN m > 0.35 THEN 'leakage_repair' ELSE 'causality_repair' END AS recipe, count(*) AS n FROM d GROUP BY 1"""


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capability from a nested map, an alias column or a sidecar."""
    d = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 4 = 0 THEN map('flow', doc_id % 8 = 0) WHEN doc_id % 4 = 1 THEN map('pose', true) END AS nested", "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'yes' END AS has_flow", "doc_id % 5 = 0 AS side"
    )
    got = resolved_capability(d, "flow", nested="nested", aliases=["absent", "has_flow"], sidecar="side")
    return d.select("doc_id", got.alias("flow"))


CAPABILITY_SQL = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 = 0 WHEN doc_id % 3 = 1 THEN true ELSE doc_id % 5 = 0 END AS flow FROM documents"


def phase_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases from the preferred field, the usual ones, or the first segment."""
    d = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS mine", "CASE WHEN doc_id % 3 = 1 THEN source END AS step", "CASE WHEN doc_id % 2 = 0 THEN array(named_struct('label', '', 'step_name', lang)) ELSE array() END AS phase_segments"
    )
    return d.select("doc_id", phase_label(d, "mine").alias("phase"))


PHASE_LABEL_SQL = "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN nullif(lang, '') END, CASE WHEN doc_id % 3 = 1 THEN nullif(source, '') END, CASE WHEN doc_id % 2 = 0 THEN nullif(lang, '') END, '') AS phase FROM documents"

QUERIES = {
    "labelled_weight": (labelled_weight, LABELLED_SQL),
    "next_recipe": (next_recipe, RECIPE_SQL),
    "capabilities": (capabilities, CAPABILITY_SQL),
    "phase_labels": (phase_labels, PHASE_LABEL_SQL),
    "strata_counts": (strata_counts, STRATA_SQL),
    "group_mass": (group_mass, MASS_SQL),
    "offset_stats": (offset_stats, OFFSET_SQL),
    "mapped_precision": (mapped_precision, PRECISION_SQL),
    "review_fraction": (review_fraction, REVIEW_FRACTION_SQL),
    "token_report": (token_report, TOKEN_SQL),
    "campaign_rollup": (campaign_rollup, CAMPAIGN_SQL),
    "raster_union": (raster_union, RASTER_SQL),
    "top_examples": (top_examples, EXAMPLES_SQL),
    "custom_order": (custom_order, CUSTOM_SQL),
    "page_rows": (page_rows, PAGE_SQL),
    "strongest_degradation": (strongest_degradation, STRONGEST_SQL),
    "partition_proof": (partition_proof, PARTITION_SQL),
    "text_helpers": (text_helpers, TEXT_SQL),
}
