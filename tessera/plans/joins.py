"""Join family: as-of, band, overlap, donors, audits, tiers, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import donors, joins, splits
from ..operators.normalize import spread_in_group
from ..operators.validation import submission_failures
from ..sources import readers
from .tables import EVENTS_SQL, TAKES_SQL, events, r6, read, takes

HOUR = 3600.0
EV = f"ev AS ({EVENTS_SQL})"


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest purchase-like event of the same user within six hours, ties to the earlier."""
    e = events(spark, sf_dir)
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("match"), F.col("t").alias("at"))
    left = e.where("event_type <> 'purchase'").select("user_id", "event_id", "t")
    return joins.nearest(left, right, "user_id", "event_id", "t", "at", "at", 6 * HOUR, ["match"]).select("event_id", "match", r6("gap", "gap"))


_ASOF = """SELECT event_id, match, gap FROM (SELECT l.event_id, r.event_id AS match, abs(l.t - r.t) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.t, r.event_id) AS rn
 FROM ev l JOIN ev r ON l.user_id = r.user_id AND abs(l.t {shift} - r.t) <= 21600.000000001 WHERE l.event_type <> 'purchase' AND r.event_type = 'purchase') WHERE rn = 1"""
ASOF_SQL = f"WITH {EV} SELECT event_id, match, round(gap, 6) AS gap FROM ({_ASOF.format(shift='')})"


def asof_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of at the start and at the end (half an hour later); both must be found."""
    e = events(spark, sf_dir)
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("match"), F.col("t").alias("at"))
    left = e.where("event_type <> 'purchase'").select("user_id", "event_id", "t", (F.col("t") + HOUR / 2).alias("t_end"))
    a = joins.nearest(left.drop("t_end"), right, "user_id", "event_id", "t", "at", "at", 6 * HOUR, ["match"])
    b = joins.nearest(left.drop("t"), right, "user_id", "event_id", "t_end", "at", "at", 6 * HOUR, ["match"])
    return a.select("event_id", F.col("match").alias("start_match")).join(b.select("event_id", F.col("match").alias("end_match")), "event_id")


ASOF_PAIR_SQL = f"""WITH {EV}, e2 AS (SELECT *, t + 1800e0 AS u FROM ev), a AS ({_ASOF.format(shift='')}),
b AS (SELECT event_id, match FROM (SELECT l.event_id, r.event_id AS match, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.u - r.t), r.t, r.event_id) AS rn
 FROM e2 l JOIN ev r ON l.user_id = r.user_id AND abs(l.u - r.t) <= 21600.000000001 WHERE l.event_type <> 'purchase' AND r.event_type = 'purchase') WHERE rn = 1)
SELECT event_id, a.match AS start_match, b.match AS end_match FROM a JOIN b USING (event_id)"""


def _intervals(e: DataFrame) -> DataFrame:
    return e.select("user_id", F.col("event_id").alias("step_id"), F.col("t").alias("s"), (F.col("t") + 1800.0 * (1 + F.col("k"))).alias("e"), F.col("event_type").alias("step"))


INTERVALS_SQL = "iv AS (SELECT user_id, event_id AS step_id, t AS s, t + 1800e0 * (1 + k) AS e, event_type AS step FROM ev)"


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return joins.containing(e.select("user_id", "event_id", "t"), _intervals(e), "user_id", "event_id", "t", ("s", "e"), ["step_id"], ["step", "step_id"], 24 * HOUR).select("event_id", "step", "step_id")


POINT_SQL = f"""WITH {EV}, {INTERVALS_SQL} SELECT event_id, step, step_id FROM (SELECT ev.event_id, iv.step, iv.step_id, row_number() OVER (PARTITION BY ev.event_id ORDER BY iv.s, iv.step_id) AS rn
 FROM ev JOIN iv ON ev.user_id = iv.user_id AND ev.t BETWEEN iv.s AND iv.e) WHERE rn = 1"""


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.where("event_type = 'click'").select("user_id", "event_id", "t")
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("other"), F.col("t").alias("at"))
    got = joins.band(left, right, "user_id", "t", "at", 4 * HOUR)
    row = F.struct(F.abs(F.col("t") - F.col("at")).alias("d"), "at", "other")
    return got.groupBy("event_id").agg(F.sort_array(F.collect_list(row)).alias("l")).select("event_id", F.size("l").cast("bigint").alias("n"), F.array_join(F.transform("l", lambda x: x["other"].cast("string")), ",").alias("others"))


BAND_SQL = f"""WITH {EV} SELECT l.event_id, count(*) AS n, string_agg(CAST(r.event_id AS VARCHAR), ',' ORDER BY abs(l.t - r.t), r.t, r.event_id) AS others
 FROM ev l JOIN ev r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 14400 WHERE l.event_type = 'click' AND r.event_type = 'view' GROUP BY 1"""


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.select("user_id", "event_id", F.col("t").alias("a"), (F.col("t") + 2 * HOUR).alias("b"))
    got = joins.overlapping(left, _intervals(e), "user_id", ("a", "b", "s", "e"), 24 * HOUR)
    return got.groupBy("event_id").agg(F.count("*").alias("n"), r6(F.max("overlap"), "longest"))


OVERLAP_SQL = f"""WITH {EV}, {INTERVALS_SQL}, l AS (SELECT user_id, event_id, t AS a, t + 7200e0 AS b FROM ev)
SELECT event_id, count(*) AS n, round(max(least(b, e) - greatest(a, s)), 6) AS longest FROM l JOIN iv ON l.user_id = iv.user_id AND least(b, e) - greatest(a, s) > 0 GROUP BY 1"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").cast("double").alias("t"), V.unit("embedding").alias("v"))
    return e


_UNIT = "(WITH u AS (SELECT vec_id, label, CAST(vec_id AS DOUBLE) AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v0 FROM embeddings) SELECT vec_id, label, t, list_transform(v0, lambda x: x / greatest(sqrt(list_inner_product(v0, v0)), 1e-8)) AS v FROM u)"


def same_group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best same-label donors at a gap of 2 to 60, farthest vectors first, with spread weights."""
    pairs = donors.same_group_pairs(_vectors(spark, sf_dir), "label", "vec_id", "t", 2.0, 60.0, ["v"])
    score = F.round(1.0 - V.dot("v", "v_d") + 0.1 * F.least(F.col("gap") / 12.0, F.lit(1.0)), 9)
    top = donors.top_donors(pairs, "vec_id", score, 3, "vec_id_d")
    top = top.withColumn("weight", spread_in_group(F.col("score"), "vec_id"))
    return top.select("vec_id", "rank", F.col("vec_id_d").alias("donor"), r6("score", "score"), F.round("weight", 4).alias("weight"))


_PAIRS = "a.label = b.label AND a.vec_id <> b.vec_id AND abs(a.t - b.t) BETWEEN 2 AND 60"
SAME_GROUP_SQL = f"""WITH e AS {_UNIT}, p AS (SELECT a.vec_id, b.vec_id AS donor, round(1e0 - list_inner_product(a.v, b.v) + 0.1e0 * least(abs(a.t - b.t) / 12e0, 1e0), 9) AS score FROM e a JOIN e b ON {_PAIRS}),
q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, donor) AS rank FROM p), r AS (SELECT * FROM q WHERE rank <= 3)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, donor, round(score, 6) AS score, round(CASE WHEN count(*) OVER w = 1 THEN 1e0 ELSE 0.75e0 + 0.5e0 * (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-6) END, 4) AS weight
 FROM r WINDOW w AS (PARTITION BY vec_id)"""


def mined_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different motion halves, similar context quarters of either view, plus a time bonus."""
    e = _vectors(spark, sf_dir).select("vec_id", "label", "t", F.slice("v", 1, 32).alias("ego"), F.slice("v", 33, 32).alias("exo"), F.slice("v", 1, 16).alias("ego_ctx"), F.slice("v", 33, 16).alias("exo_ctx"))
    pairs = donors.same_group_pairs(e, "label", "vec_id", "t", 2.0, 60.0, ["ego", "exo", "ego_ctx", "exo_ctx"])
    score = F.round(0.45 * (1.0 - V.cosine("ego", "ego_d")) + 0.45 * (1.0 - V.cosine("exo", "exo_d")) - 0.25 * (1.0 - V.cosine("ego_ctx", "ego_ctx_d")) - 0.15 * (1.0 - V.cosine("exo_ctx", "exo_ctx_d")) + 0.10 * F.least(F.col("gap") / 12.0, F.lit(1.0)), 9)
    return donors.top_donors(pairs, "vec_id", score, 2, "vec_id_d").select("vec_id", "rank", F.col("vec_id_d").alias("donor"), r6("score", "score"))


def _cos(x: str, lo: int, hi: int) -> str:
    a, b = f"a.v[{lo}:{hi}]", f"b.v[{lo}:{hi}]"
    return f"list_inner_product({a}, {b}) / (greatest(sqrt(list_inner_product({a}, {a})), 1e-8) * greatest(sqrt(list_inner_product({b}, {b})), 1e-8))"


MINED_SQL = f"""WITH e AS {_UNIT}, p AS (SELECT a.vec_id, b.vec_id AS donor, round(0.45e0 * (1e0 - {_cos("ego", 1, 32)}) + 0.45e0 * (1e0 - {_cos("exo", 33, 64)}) - 0.25e0 * (1e0 - {_cos("ego_ctx", 1, 16)}) - 0.15e0 * (1e0 - {_cos("exo_ctx", 33, 48)})
 + 0.10e0 * least(abs(a.t - b.t) / 12e0, 1e0), 9) AS score FROM e a JOIN e b ON {_PAIRS}), q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, donor) AS rank FROM p)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, donor, round(score, 6) AS score FROM q WHERE rank <= 2"""


def temporal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor whose distance in time is nearest to two hours."""
    e = events(spark, sf_dir)
    pairs = donors.same_group_pairs(e.select("user_id", "event_id", "t"), "user_id", "event_id", "t", 1.0, 24 * HOUR, [])
    score = F.round(-F.abs(F.col("gap") - 2 * HOUR), 6)
    return donors.top_donors(pairs, "event_id", score, 1, "event_id_d").select("event_id", F.col("event_id_d").alias("donor"), "score")


TEMPORAL_SQL = f"""WITH {EV}, p AS (SELECT a.event_id, b.event_id AS donor, round(-abs(abs(a.t - b.t) - 7200e0), 6) AS score FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.t - b.t) BETWEEN 1 AND 86400)
SELECT event_id, donor, score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, donor) AS rn FROM p) WHERE rn = 1"""


def wrong_phase_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return donors.other_phase(events(spark, sf_dir), "user_id", "event_id", "t", "event_type", 7).select("event_id", "donor", r6("far", "far"))


WRONG_PHASE_SQL = f"""WITH {EV} SELECT event_id, donor, round(far, 6) AS far FROM (SELECT a.event_id, b.event_id AS donor, abs(a.t - b.t) AS far,
 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t) DESC, sha256('7:' || a.event_id || ':' || b.event_id)) AS rn FROM ev a JOIN ev b ON a.user_id = b.user_id AND lower(trim(a.event_type)) <> lower(trim(b.event_type))) WHERE rn = 1"""


def offset_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = e.select("event_id")
    rows = e
    for k in (1, 4, 8):
        rows = donors.offset_donor(rows, "user_id", "event_id", ["t", "event_id"], k).withColumnRenamed("donor", f"donor_{k}")
    return rows.select("event_id", "donor_1", "donor_4", "donor_8")


OFFSET_SQL = f"WITH {EV} SELECT event_id, " + ", ".join(f"coalesce(lead(event_id, {k}) OVER w, lag(event_id, {k}) OVER w, event_id) AS donor_{k}" for k in (1, 4, 8)) + " FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"


def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return donors.derangement(events(spark, sf_dir), "user_id", "event_id", "13").select("event_id", "donor")


DERANGEMENT_SQL = f"WITH {EV} SELECT event_id, coalesce(lead(event_id) OVER w, first_value(event_id) OVER w) AS donor FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sha256('13:' || event_id))"


def nn_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest odd vector of every even one, and whether it counts as a duplicate."""
    e = read(spark, sf_dir, "embeddings")
    got = donors.nearest_across(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding")
    return got.select("vec_id", "match", r6("cosine", "cosine"), (F.col("cosine") >= 0.995).alias("violation"))


NN_SQL = f"""WITH e AS {_UNIT} SELECT vec_id, match, round(c, 6) AS cosine, c >= 0.995 AS violation FROM (SELECT a.vec_id, b.vec_id AS match, list_inner_product(a.v, b.v) AS c,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS rn FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) WHERE rn = 1"""


def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared samples, groups and frames of two halves of the events."""
    e = events(spark, sf_dir).withColumn("frame", F.concat_ws(":", F.col("user_id").cast("string"), F.rint(F.col("t") / 60.0).cast("bigint").cast("string")))
    return splits.set_overlap(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), {"sample": "event_id", "group": "user_id", "frame": "frame", "type": "event_type"})


OVERLAP_AUDIT_SQL = f"""WITH {EV}, f AS (SELECT event_id, CAST(event_id AS VARCHAR) AS sample, CAST(user_id AS VARCHAR) AS grp, user_id || ':' || CAST(round_even(t / 60e0, 0) AS BIGINT) AS frame, event_type FROM ev)
""" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) AS shared FROM (SELECT {c} FROM f WHERE event_id % 2 = 0 INTERSECT SELECT {c} FROM f WHERE event_id % 2 = 1)" for k, c in (("sample", "sample"), ("group", "grp"), ("frame", "frame"), ("type", "event_type"))
)


def pairwise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_type", "user_id")
    return splits.pairwise_overlap(e, "event_type", "user_id")


PAIRWISE_SQL = "WITH v AS (SELECT DISTINCT event_type, user_id FROM events) SELECT a.event_type AS left_name, b.event_type AS right_name, count(*) AS shared FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2"


def tiered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents matched to labels by id, else by row number, else by source and rounded size."""
    d = takes(spark, sf_dir).select("take_uid", F.col("task_name"), (F.col("take_uid") + 1).alias("row_index"), F.rint(F.col("n_chars") / 500.0).cast("bigint").alias("size_key"))
    r = takes(spark, sf_dir).where("usable_for <> ''").select(
        F.when(F.col("take_uid") % 2 == 0, F.col("take_uid")).alias("take_uid"), F.when(F.col("take_uid") % 3 == 0, F.col("take_uid")).alias("row_index"), "task_name",
        F.rint(F.col("n_chars") / 500.0).cast("bigint").alias("size_key"), F.col("usable_for").alias("label"), F.col("take_uid").alias("pos"),
    )
    return joins.tiered(d, r, [["take_uid"], ["row_index"], ["task_name", "size_key"]], "label", ["pos"]).select("take_uid", "label", "tier")


TIERED_SQL = f"""WITH t AS ({TAKES_SQL}), d AS (SELECT take_uid, task_name, take_uid + 1 AS row_index, CAST(round_even(n_chars / 500e0, 0) AS BIGINT) AS size_key FROM t),
r AS (SELECT CASE WHEN take_uid % 2 = 0 THEN take_uid END AS take_uid, CASE WHEN take_uid % 3 = 0 THEN take_uid END AS row_index, task_name, CAST(round_even(n_chars / 500e0, 0) AS BIGINT) AS size_key, usable_for AS label, take_uid AS pos FROM t WHERE usable_for <> ''),
a AS (SELECT take_uid, arg_max(label, pos) AS l FROM r WHERE take_uid IS NOT NULL GROUP BY 1), b AS (SELECT row_index, arg_max(label, pos) AS l FROM r WHERE row_index IS NOT NULL GROUP BY 1),
c AS (SELECT task_name, size_key, arg_max(label, pos) AS l FROM r GROUP BY 1, 2)
SELECT d.take_uid, coalesce(a.l, b.l, c.l) AS label, CASE WHEN a.l IS NOT NULL THEN 1 WHEN b.l IS NOT NULL THEN 2 WHEN c.l IS NOT NULL THEN 3 ELSE 0 END AS tier FROM d LEFT JOIN a USING (take_uid) LEFT JOIN b USING (row_index) LEFT JOIN c USING (task_name, size_key)"""


def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = takes(spark, sf_dir).select("take_uid", F.col("scene_only_score").alias("score"), F.col("usable_for").alias("label"))
    extra = base.where("take_uid % 2 = 0").select("take_uid", F.when(F.col("take_uid") % 4 == 0, "").otherwise("0.5").alias("score"), F.when(F.col("take_uid") % 6 == 0, "manual").otherwise("").alias("label"))
    return joins.override(base, extra, "take_uid", ["score", "label"]).select("take_uid", r6("score", "score"), "label")


OVERRIDE_SQL = f"""WITH t AS ({TAKES_SQL}) SELECT take_uid, round(CASE WHEN take_uid % 2 = 0 AND take_uid % 4 <> 0 THEN 0.5e0 ELSE scene_only_score END, 6) AS score, CASE WHEN take_uid % 6 = 0 THEN 'manual' ELSE usable_for END AS label FROM t"""


def semi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    active = e.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 66")
    return e.join(active, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


SEMI_SQL = "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 66) GROUP BY 1"


def anti_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


ANTI_SQL = "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return readers.union_all([c, s]).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


UNION_SQL = "SELECT segment, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_acctbal, NULL FROM supplier) GROUP BY 1"


def exact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.coverage(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


COVERAGE_SQL = "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS unexpected, count(*) AS total FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"


def subset_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    child = parent.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 77 == 0, "X").otherwise(F.col("o_orderstatus")))
    child = child.unionAll(spark.range(1).select((-F.col("id") - 1).alias("o_orderkey"), F.lit(0).cast("bigint"), F.lit("O")))
    return splits.subset_mismatch(child, parent, "o_orderkey", ["o_custkey", "o_orderstatus"])


SUBSET_SQL = "SELECT count(*) + 1 AS rows, CAST(1 AS BIGINT) AS orphans, count(*) FILTER (WHERE o_orderkey % 77 = 0 AND o_orderstatus <> 'X') AS differing FROM orders WHERE o_orderkey % 7 = 0"


def lineage_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "part").select("p_partkey")
    edges = nodes.select(F.col("p_partkey").alias("c"), F.when(F.col("p_partkey") > 8, F.floor(F.col("p_partkey") / 3).cast("bigint")).alias("p"))
    return joins.lineage(edges, "c", "p")


LINEAGE_SQL = """WITH RECURSIVE e AS (SELECT p_partkey AS c, CASE WHEN p_partkey > 8 THEN p_partkey // 3 END AS p FROM part), walk(node, place, depth) AS (SELECT c, p, 1 FROM e WHERE p IS NOT NULL
 UNION ALL SELECT w.node, e.p, w.depth + 1 FROM walk w JOIN e ON e.c = w.place WHERE e.p IS NOT NULL AND w.depth < 20) SELECT node, arg_max(place, depth) AS root, max(depth) AS depth FROM walk GROUP BY 1"""


def validate_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, frozen columns and rules of a submitted copy with planted faults."""
    e = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s = e.where("s_suppkey % 10 <> 3").select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 4, "changed").otherwise(F.col("s_name")).alias("s_name"), "s_nationkey", F.when(F.col("s_suppkey") % 4 == 1, "yes").otherwise("maybe").alias("answer"))
    s = s.unionAll(e.where("s_suppkey % 50 = 7").select(F.col("s_suppkey") + 1000000, "s_name", "s_nationkey", F.lit("no")))
    got = submission_failures(e, s, "s_suppkey", ["s_name", "s_nationkey"], [("bad_answer", ~F.col("s_answer").isin("yes", "no"))])
    return got.groupBy("rule").agg(F.count("*").alias("n"))


SUBMISSION_SQL = """WITH e AS (SELECT s_suppkey AS k FROM supplier), r AS (SELECT 'missing_row' AS rule FROM e WHERE k % 10 = 3 UNION ALL SELECT 'unexpected_row' FROM e WHERE k % 50 = 7
 UNION ALL SELECT 'changed_s_name' FROM e WHERE k % 10 <> 3 AND k % 9 = 4 UNION ALL SELECT 'bad_answer' FROM e WHERE k % 10 <> 3 AND k % 4 <> 1) SELECT rule, count(*) AS n FROM r GROUP BY 1"""

QUERIES = {
    "asof_nearest": (asof_nearest, ASOF_SQL),
    "asof_pair": (asof_pair, ASOF_PAIR_SQL),
    "point_in_interval": (point_in_interval, POINT_SQL),
    "band_join": (band_join, BAND_SQL),
    "overlap_join": (overlap_join, OVERLAP_SQL),
    "same_group_topk": (same_group_topk, SAME_GROUP_SQL),
    "mined_topk": (mined_topk, MINED_SQL),
    "temporal_topk": (temporal_topk, TEMPORAL_SQL),
    "wrong_phase_donor": (wrong_phase_donor, WRONG_PHASE_SQL),
    "offset_donor": (offset_donor, OFFSET_SQL),
    "derangement": (derangement, DERANGEMENT_SQL),
    "nn_audit": (nn_audit, NN_SQL),
    "overlap_audit": (overlap_audit, OVERLAP_AUDIT_SQL),
    "pairwise_overlap": (pairwise_overlap, PAIRWISE_SQL),
    "tiered_join": (tiered_join, TIERED_SQL),
    "override_join": (override_join, OVERRIDE_SQL),
    "semi_select": (semi_select, SEMI_SQL),
    "anti_select": (anti_select, ANTI_SQL),
    "union_by_name": (union_by_name, UNION_SQL),
    "exact_coverage": (exact_coverage, COVERAGE_SQL),
    "subset_proof": (subset_proof, SUBSET_SQL),
    "lineage_walk": (lineage_walk, LINEAGE_SQL),
    "validate_submission": (validate_submission, SUBMISSION_SQL),
}
