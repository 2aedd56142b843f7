"""Bindings of row contracts, lookups, in-batch donors, samplers and reports, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import hash_order
from ..operators import contracts as C
from ..operators import enrich as X
from .tables import EVENTS_SQL, events, r6, read

EV = f"ev AS ({EVENTS_SQL})"


def _pick(expr: str, *values: str) -> str:
    """One of several texts by a whole number; both engines read it."""
    return f"CASE ({expr}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _documents(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _table(columns: dict[str, str], source: str = "documents") -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


# --------------------------------------------------------------------------- annotations

_LEVELS = ("0", "1", "2", "", "3")
ANNOTATED = {
    "take_uid": "CASE WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 37 = 0 THEN 'same' ELSE CAST(doc_id AS STRING) END",
    "take_relevance": _pick("doc_id", *C.TAKE_ENUMS["take_relevance"], "", "bogus"),
    "ego_hand_visibility": _pick("doc_id + 1", *_LEVELS),
    "exo_body_visibility": _pick("doc_id * 3", *_LEVELS),
    "object_interaction": _pick("doc_id * 7 + 2", *_LEVELS[:4]),
    "phase_diversity": _pick("doc_id * 5 + 1", *_LEVELS[:3]),
    "scene_only_risk": _pick("doc_id * 11", *_LEVELS[:3]),
    "ego_exo_sync_quality": _pick("doc_id * 13", "ok", "minor_issue", "bad", "unsure"),
    "usable_for": _pick("doc_id * 17 + 3", "tokenizer_main", "loco_aux", "discard", "diagnostic_candidate", "tokenizer_main", "loco_aux"),
}


def take_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of take annotations by rule."""
    got = C.take_annotation_failures(_documents(spark, sf_dir, ANNOTATED))
    return got.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _annotation_sql() -> str:
    parts = []
    for c, allowed in C.TAKE_ENUMS.items():
        parts.append(f"SELECT 'missing_{c}' AS rule FROM a WHERE {c} = ''")
        parts.append(f"SELECT 'invalid_{c}' FROM a WHERE {c} <> '' AND {c} NOT IN {_listed(allowed)}")
    main, loco = "usable_for = 'tokenizer_main'", "usable_for = 'loco_aux'"
    parts += [
        f"SELECT 'main_not_interaction_rich' FROM a WHERE {main} AND take_relevance <> 'A_interaction_rich'",
        f"SELECT 'main_without_signal' FROM a WHERE {main} AND ego_hand_visibility = '0' AND object_interaction = '0'",
        f"SELECT 'main_with_scene_risk' FROM a WHERE {main} AND scene_only_risk = '2'",
        f"SELECT 'main_with_bad_sync' FROM a WHERE {main} AND ego_exo_sync_quality = 'bad'",
        f"SELECT 'loco_without_signal' FROM a WHERE {loco} AND exo_body_visibility = '0' AND phase_diversity = '0'",
        f"SELECT 'scene_only_in_training' FROM a WHERE take_relevance = 'D_scene_only' AND ({main} OR {loco})",
        "SELECT 'missing_key' FROM a WHERE take_uid = ''",
        "SELECT 'duplicate_key' FROM (SELECT take_uid FROM a WHERE take_uid <> '' GROUP BY 1 HAVING count(*) > 1)",
    ]
    return f"WITH a AS ({_table(ANNOTATED)}), r AS ({' UNION ALL '.join(parts)}) SELECT rule, count(*) AS n FROM r GROUP BY 1"


GOLD = {
    "sample_id": "CASE WHEN doc_id % 53 = 0 THEN ' ' WHEN doc_id % 31 = 0 THEN 'again' ELSE CAST(doc_id AS STRING) END",
    "representation_training_valid": _pick("doc_id", "false", "False ", "0", "true", ""),
    "effect_label": _pick("doc_id * 3", *C.EFFECTS, "odd"),
    "contact_label": _pick("doc_id * 7", *C.CONTACTS, ""),
    "ambiguous_reason": _pick("doc_id", "", "hidden", " "),
    "annotator_id": _pick("doc_id", "ann", "bob", ""),
}


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.gold_failures(_documents(spark, sf_dir, GOLD))
    return got.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


GOLD_SQL = f"""WITH a AS ({_table(GOLD)}), r AS (SELECT 'missing_key' AS rule FROM a WHERE trim(sample_id) = ''
 UNION ALL SELECT 'training_valid' FROM a WHERE lower(trim(representation_training_valid)) NOT IN ('false', '0')
 UNION ALL SELECT 'invalid_effect' FROM a WHERE effect_label NOT IN {_listed(C.EFFECTS)}
 UNION ALL SELECT 'invalid_contact' FROM a WHERE contact_label NOT IN {_listed(C.CONTACTS)}
 UNION ALL SELECT 'reason_missing' FROM a WHERE effect_label = 'ambiguous' AND trim(ambiguous_reason) = ''
 UNION ALL SELECT 'annotator_missing' FROM a WHERE annotator_id = ''
 UNION ALL SELECT 'duplicate_key' FROM (SELECT sample_id FROM a WHERE trim(sample_id) <> '' GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'several_annotators' WHERE (SELECT count(DISTINCT annotator_id) FROM a WHERE annotator_id <> '') > 1)
SELECT rule, count(*) AS n FROM r GROUP BY 1"""

TEMPLATE = {
    "review_id": "CAST(doc_id AS STRING)",
    "image": "concat('img/', CAST(doc_id AS STRING))",
    **{c: ("CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE '' END" if c == "notes" else "''") for c in C.EDITABLE},
}
SUBMITTED = {
    "review_id": "CASE WHEN doc_id % 29 = 0 THEN concat('new', CAST(doc_id AS STRING)) WHEN doc_id % 43 = 0 THEN '' ELSE CAST(doc_id AS STRING) END",
    "image": "concat('img/', CAST(doc_id + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS STRING))",
    "effect_label": _pick("doc_id * 3", *C.EFFECTS, "odd", "no_effect "),
    "contact_label": _pick("doc_id * 7", *C.CONTACTS, "often"),
    "ambiguous_reason": _pick("doc_id", "", "hidden", "", "", " "),
    "annotator_id": _pick("doc_id", "ann.1", "ann.1", "x", "a b"),
    "notes": "CASE WHEN doc_id % 23 = 0 THEN repeat('n', 1001) ELSE '' END",
}


def blind_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.blind_failures(_documents(spark, sf_dir, TEMPLATE), _documents(spark, sf_dir, SUBMITTED), tasks=7, annotator="ann.1")
    return got.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _blind_sql() -> str:
    rules = {
        "image_changed": "s.image <> t.image",
        "untrimmed_effect_label": "s.effect_label <> trim(s.effect_label)",
        "untrimmed_ambiguous_reason": "s.ambiguous_reason <> trim(s.ambiguous_reason)",
        "invalid_effect": f"trim(s.effect_label) NOT IN {_listed(C.EFFECTS)}",
        "invalid_contact": f"s.contact_label NOT IN {_listed(C.CONTACTS)}",
        "reason_missing": "trim(s.effect_label) = 'ambiguous' AND trim(s.ambiguous_reason) = ''",
        "reason_not_blank": "trim(s.effect_label) <> 'ambiguous' AND trim(s.ambiguous_reason) <> ''",
        "invalid_annotator": "NOT regexp_full_match(s.annotator_id, '[A-Za-z0-9._-]{2,64}')",
        "notes_too_long": "length(s.notes) > 1000",
    }
    parts = [f"SELECT '{n}' AS rule FROM s JOIN t USING (review_id) WHERE {c}" for n, c in rules.items()]
    parts += [
        "SELECT 'missing_row' FROM t ANTI JOIN s USING (review_id)",
        "SELECT 'unexpected_row' FROM s ANTI JOIN t USING (review_id)",
        "SELECT 'template_not_blank' FROM t WHERE notes <> ''",
        "SELECT 'submission_blank_key' FROM s WHERE review_id = ''",
        "SELECT 'several_annotators' WHERE (SELECT count(DISTINCT annotator_id) FROM s) > 1",
        "SELECT 'unexpected_annotator' WHERE EXISTS (SELECT 1 FROM s WHERE annotator_id <> 'ann.1')",
        "SELECT 'wrong_task_count' WHERE (SELECT count(*) FROM t) <> 7",
    ]
    return f"WITH t AS ({_table(TEMPLATE)}), s AS ({_table(SUBMITTED)}), r AS ({' UNION ALL '.join(parts)}) SELECT rule, count(*) AS n FROM r GROUP BY 1"


ROLES = {
    "doc_id": "doc_id",
    "role": _pick("doc_id", "train", "Probe-Train", " locked ", "aux", "Hold-Out", "VAL", "valid ", "calibration-dev", "assembly101", "dev", "training"),
    "source_role": _pick("doc_id * 3", "main", "diagnostic set", "main"),
    "flag": _pick("doc_id", "0", "yes", "no", "", "off", "0.0", "false"),
    "usable": _pick("doc_id * 5", "true", "1", "no", "Y"),
}


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may train, counted by role."""
    got = C.training_rows(_documents(spark, sf_dir, ROLES), ["role", "source_role"], banned=["flag"], required=["usable"])
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


ROLES_SQL = f"SELECT role, count(*) AS n FROM ({_table(ROLES)}) WHERE role IN ('train', 'aux', 'Hold-Out', 'training') AND source_role = 'main' AND flag <> 'yes' AND usable <> 'no' GROUP BY 1"

IDS = {
    "sample_id": "concat(CAST(doc_id % 50 + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS STRING), ':', CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE CAST(doc_id + CASE WHEN doc_id % 11 = 0 THEN 0.5e0 ELSE 0e0 END AS STRING) END)",
    "take": "CAST(doc_id % 50 AS STRING)",
    "t": "CAST(doc_id AS DOUBLE)",
    "doc_id": "doc_id",
}


def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.sample_id_failures(_documents(spark, sf_dir, IDS), "sample_id", "take", "t")
    return got.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


IDS_SQL = """SELECT rule, count(*) AS n FROM (SELECT 'no_time' AS rule FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT 'other_time' FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 11 = 0
 UNION ALL SELECT 'other_group' FROM documents WHERE doc_id % 17 = 0) GROUP BY 1"""


def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a catalogue by normalised split, and their labels under a calibration gate."""
    d = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang AS split0", "doc_id % 7 = 0 AS dropped", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 <> 1 END AS validated", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS path", "doc_id % 2 = 0 AS valid"
    )
    kept = d.where(C.catalogue_candidate("dropped", "validated", ["path"])).withColumn("split", C.normalised_split("split0", ("en", "fr"), "en"))
    return kept.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(C.gated_validity(True, "valid")).alias("valid"), F.count_if(C.gated_validity(False, "valid")).alias("ungated"))


CATALOGUE_SQL = """SELECT CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en' END AS split, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS valid, CAST(0 AS BIGINT) AS ungated FROM documents
 WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 1 AND doc_id % 3 <> 0 AND coalesce(trim(source), '') <> '' GROUP BY 1"""

# --------------------------------------------------------------------------- lookups


def weight_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of orders' customers: the last order's price class, some of them no number."""
    o = read(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(floor(o_totalprice / 1e5) AS STRING) END AS w")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    got = X.weight_lookup(c, o, "o_custkey", "w", "o_orderkey", floor=0.5)
    return got.groupBy("weight", "matched").agg(F.count(F.lit(1)).alias("n"))


WEIGHT_SQL = """WITH l AS (SELECT o_custkey, arg_max(CASE WHEN o_orderkey % 11 = 0 THEN 0e0 ELSE floor(o_totalprice / 1e5) END, o_orderkey) AS w FROM orders GROUP BY 1)
SELECT CASE WHEN w IS NULL THEN 0e0 ELSE greatest(w, 0.5e0) END AS weight, w IS NOT NULL AS matched, count(*) AS n FROM customer LEFT JOIN l ON o_custkey = c_custkey GROUP BY 1, 2"""

_SUBJECT = "CASE event_type WHEN 'click' THEN 'left-Hand' WHEN 'view' THEN 'Wrist watch' ELSE event_type END"


def nearest_frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per purchase the masked entries on the nearest ten-minute frame, at most 15 frames off."""
    e = events(spark, sf_dir).selectExpr("user_id", "event_id", "event_type", "CAST(floor(t / 600) AS BIGINT) AS frame", f"{_SUBJECT} AS subject", "concat('cam0', CAST(k % 3 AS STRING)) AS camera", "CASE WHEN value > 10 THEN 'm' END AS mask")
    entries = X.mask_entries(e, "subject", "camera", "cam0", "mask").where("event_type <> 'purchase'").select("user_id", "frame", F.col("event_id").alias("entry"))
    targets = e.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("frame") + 1).alias("target"))
    return X.nearest_frame_rows(targets, entries, "user_id", "event_id", "target", "frame", 15, ["entry"]).select("event_id", "frame", "entry")


NEAREST_FRAME_SQL = f"""WITH {EV}, e AS (SELECT user_id, event_id, event_type, CAST(floor(t / 600) AS BIGINT) AS frame, value FROM ev), n AS (SELECT user_id, frame, event_id AS entry FROM e WHERE value > 10 AND event_type NOT IN ('click', 'view', 'purchase')),
b AS (SELECT event_id, user_id, frame FROM (SELECT p.event_id, p.user_id, n.frame, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(n.frame - p.frame - 1), n.frame) AS rn FROM e p JOIN (SELECT DISTINCT user_id, frame FROM n) n ON p.user_id = n.user_id AND abs(n.frame - p.frame - 1) <= 15 WHERE p.event_type = 'purchase') WHERE rn = 1)
SELECT event_id, frame, entry FROM b JOIN n USING (user_id, frame)"""

DONORS = {
    "doc_id": "doc_id",
    "take": "doc_id % 20",
    "phase": "CASE WHEN doc_id % 23 = 0 THEN 'Unknown' WHEN doc_id % 29 = 0 THEN NULL ELSE lang END",
    "donor": "CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN doc_id WHEN doc_id % 10 = 3 THEN doc_id + 1 ELSE doc_id + 20 END",
    "valid": "doc_id % 6 <> 0",
}


def donor_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir, DONORS)
    return X.donor_failures(d, "doc_id", "take", "phase", "donor").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_KNOWN = "coalesce(lower(trim(phase)), '')"
DONOR_SQL = f"""WITH d AS (SELECT *, {_KNOWN} AS p FROM ({_table(DONORS)})), m AS (SELECT d.doc_id, d.take, d.donor, d.p, o.doc_id AS od, o.take AS ot, o.p AS op FROM d LEFT JOIN d o ON d.donor = o.doc_id),
r AS (SELECT 'unknown_phase' AS rule FROM m WHERE p IN ('', 'unknown', 'none') UNION ALL SELECT 'own_donor' FROM m WHERE donor = doc_id UNION ALL SELECT 'donor_missing' FROM m WHERE od IS NULL
 UNION ALL SELECT 'donor_of_other_group' FROM m WHERE ot <> take UNION ALL SELECT 'donor_of_same_phase' FROM m WHERE op = p AND donor <> doc_id) SELECT rule, count(*) AS n FROM r GROUP BY 1"""


def eligibility_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.eligibility_report(_documents(spark, sf_dir, DONORS), "valid", "phase", "donor")


_UNKNOWN = f"{_KNOWN} IN ('', 'unknown', 'none')"
ELIGIBLE_SQL = f"""SELECT count(*) AS n, count(*) FILTER (WHERE NOT valid) AS nontraining, count(*) FILTER (WHERE valid AND {_UNKNOWN}) AS unknown_phase,
 count(*) FILTER (WHERE valid AND NOT {_UNKNOWN} AND donor IS NULL) AS no_donor, count(*) FILTER (WHERE valid AND NOT {_UNKNOWN} AND donor IS NOT NULL) AS eligible FROM ({_table(DONORS)})"""


def cyclic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", "t")
    return X.cyclic_shift(e, ["user_id"], "event_id", ["t", "event_id"], 4).select("event_id", "donor")


SHIFT_SQL = f"""WITH {EV}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT a.event_id, b.event_id AS donor FROM r a JOIN r b ON a.user_id = b.user_id AND b.i = (a.i - CASE WHEN 4 % a.n = 0 THEN 1 ELSE 4 % a.n END + a.n) % a.n"""


def action_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 vectors by id; halves of a vector are context and action."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))
    e = e.select(F.floor(F.col("vec_id") / 64).alias("batch"), "label", "vec_id", F.slice("v", 1, 32).alias("ctx"), F.slice("v", 33, 32).alias("act"), ((F.col("vec_id") % 10) / 10.0).alias("conf"))
    got = X.action_donors(e, ["batch", "label"], "vec_id", "ctx", "act", "conf")
    return got.select("vec_id", "donor", r6("weight", "weight"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.{c}, b.{c}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
ACTION_SQL = f"""WITH e AS (SELECT vec_id // 64 AS batch, label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE))[1:32] AS ctx, list_transform(embedding, lambda x: CAST(x AS DOUBLE))[33:64] AS act, (vec_id % 10) / 10e0 AS conf FROM embeddings),
p AS (SELECT a.batch, a.vec_id, b.vec_id AS donor, least(a.conf, b.conf) AS w, {_DIST.format(c="act")} AS ad, round({_DIST.format(c="act")} - 0.35e0 * {_DIST.format(c="ctx")}, 9) AS s FROM e a JOIN e b ON a.batch = b.batch AND a.label = b.label AND a.vec_id <> b.vec_id),
q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, donor) AS rn FROM p), g AS (SELECT *, avg(ad) OVER (PARTITION BY batch) AS m FROM q WHERE rn = 1)
SELECT e.vec_id, coalesce(donor, e.vec_id) AS donor, round(coalesce(w * least(greatest(ad / greatest(m, 1e-6), 0.25e0), 2e0), 0e0), 6) AS weight FROM e LEFT JOIN g USING (vec_id)"""


def other_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another code than an event's own, and a dropout mask of 30 %, both by hash."""
    e = events(spark, sf_dir).select("event_id", (F.col("k") % 64).alias("code"))
    draw = F.conv(F.substring(hash_order("code", "event_id"), 1, 8), 16, 10).cast("bigint")
    return e.select("event_id", "code", X.other_code(F.col("code"), 64, draw).alias("other"), X.kept_by_hash(0.3, "drop", "event_id").alias("kept"))


def _word(seed: str, expr: str) -> str:
    return f"CAST('0x' || substr(sha256('{seed}:' || {expr}), 1, 8) AS BIGINT)"


OTHER_CODE_SQL = f"WITH {EV} SELECT event_id, k % 64 AS code, (k % 64 + 1 + {_word('code', 'event_id')} % 63) % 64 AS other, CASE WHEN {_word('drop', 'event_id')} / 4294967296e0 >= 0.3e0 THEN 1 ELSE 0 END AS kept FROM ev"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five donors of every vector: the next ids, with falling scores, some negative."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    return e.select("vec_id", (F.col("vec_id") + F.col("rank") * F.col("rank")).alias("donor"), "rank", (2.0 - F.col("rank") * 0.6).alias("score"))


RANKED = "rk AS (SELECT vec_id, vec_id + j * j AS donor, j AS rank, 2e0 - j * 0.6e0 AS score FROM embeddings, range(1, 6) r(j))"


def batch_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are ids modulo 3; the first four donors count."""
    m = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("batch"), "vec_id")
    return X.batch_donors(m, _ranked(spark, sf_dir), "batch", "vec_id", 4).select("vec_id", F.coalesce("donor", F.lit(-1)).alias("donor"), r6("weight", "weight"))


BATCH_DONOR_SQL = f"""WITH {RANKED}, m AS (SELECT vec_id, vec_id % 3 AS batch FROM embeddings), b AS (SELECT a.batch, a.vec_id, arg_min(r.donor, r.rank) AS donor, greatest(arg_min(r.score, r.rank), 0e0) AS w FROM m a JOIN rk r ON a.vec_id = r.vec_id AND r.rank <= 4 JOIN m d ON d.vec_id = r.donor AND d.batch = a.batch GROUP BY 1, 2),
f AS (SELECT m.batch, m.vec_id, donor, coalesce(w, 0e0) AS w FROM m LEFT JOIN b USING (vec_id)) SELECT vec_id, coalesce(donor, -1) AS donor, round(coalesce(w / greatest(avg(CASE WHEN w > 0 THEN w END) OVER (PARTITION BY batch), 1e-6), 0e0), 6) AS weight FROM f"""


def pair_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors in hash order, sixteen a batch, with one of three donors that exist."""
    e = read(spark, sf_dir, "embeddings").select("vec_id")
    there = _ranked(spark, sf_dir).join(e.withColumnRenamed("vec_id", "donor"), "donor", "left_semi")
    return X.pair_batches(e, there, "vec_id", 16, "pairs", 3)


PAIR_SQL = f"""WITH {RANKED}, a AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('pairs:' || vec_id), vec_id) AS p FROM embeddings),
d AS (SELECT vec_id, arg_min(donor, sha256('pairs:' || vec_id || ':' || donor)) AS donor FROM rk WHERE rank <= 3 AND donor IN (SELECT vec_id FROM embeddings) GROUP BY 1)
SELECT (p - 1) // 16 AS batch, vec_id, coalesce(donor, vec_id) AS donor FROM a LEFT JOIN d USING (vec_id)"""


def group_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty batches of four users with three of their events each."""
    return X.group_batches(events(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id", 50, 4, 3, "batch")


GROUP_BATCH_SQL = f"""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS g, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)), m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
s AS (SELECT b, s, {_word('batch', "b || ':' || s")} % (SELECT count(*) FROM u) AS g FROM range(50) x(b), range(4) y(s))
SELECT b AS batch, CAST(s * 3 + r AS INTEGER) AS place, user_id, event_id FROM s JOIN u USING (g) JOIN m USING (user_id), range(3) z(r) WHERE m.i = {_word('batch', "b || ':' || s || ':' || r")} % n"""


def quality_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the bucket of their label and a weight for every third."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    human = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "tokenizer_main").otherwise(" discard ").alias("bucket"))
    weights = d.where("doc_id % 3 = 0").select("doc_id", ((F.col("doc_id") % 5) / 4.0).alias("weight"))
    got = X.quality_index(d, human, weights, "doc_id")
    return got.select("doc_id", "quality_bucket", "quality_weight", "take_quality", "derived_weight_valid", F.size("annotation_refs").alias("refs"))


QUALITY_SQL = """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabeled' WHEN quality = 1 THEN 'tokenizer_main' ELSE 'discard' END AS quality_bucket, CASE WHEN d.doc_id % 3 = 0 THEN (d.doc_id % 5) / 4e0 ELSE 1e0 END AS quality_weight,
 l.doc_id IS NOT NULL AS take_quality, d.doc_id % 3 = 0 AS derived_weight_valid, CAST(l.doc_id IS NOT NULL AS INTEGER) + CAST(d.doc_id % 3 = 0 AS INTEGER) AS refs FROM documents d LEFT JOIN labels l USING (doc_id)"""


def fill_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", "source", "CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN lang END AS tongue")
    best = read(spark, sf_dir, "documents").groupBy("source").agg(F.min("lang").alias("tongue"))
    return X.fill_empty(d, best, "source", ["tongue"]).select("doc_id", "tongue")


FILL_SQL = "WITH b AS (SELECT source, min(lang) AS m FROM documents GROUP BY 1) SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 1 THEN nullif(trim(lang), '') END, m) AS tongue FROM documents LEFT JOIN b USING (source)"


def labelled_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 9 == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")).alias("doc_id"))
    return X.labelled_report(read(spark, sf_dir, "documents"), labels, "doc_id")


REPORT_SQL = """WITH l AS (SELECT DISTINCT CASE WHEN doc_id % 9 = 0 THEN doc_id + 10000000 ELSE doc_id END AS doc_id FROM labels)
SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled_rows, count(*) FILTER (WHERE d.doc_id IS NULL) AS labels_without_row FROM documents d FULL JOIN l ON d.doc_id = l.doc_id"""


def allowlist_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the labelled documents, in falling order, stand in the documents sorted by id."""
    from ..operators.select import dense_index

    d = dense_index(read(spark, sf_dir, "documents"), "doc_id", "position")
    allowed = dense_index(read(spark, sf_dir, "labels").select((-F.col("doc_id")).alias("neg")), "neg", "place").select((-F.col("neg")).alias("doc_id"), "place")
    return X.positions_of(allowed, d, "doc_id", "place", "position")


ALLOW_SQL = """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS place FROM (SELECT DISTINCT doc_id FROM labels)), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM (SELECT DISTINCT doc_id FROM documents))
SELECT place, doc_id, position FROM a LEFT JOIN d USING (doc_id)"""


def view_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second view of a vector comes from its donor, where that exists."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("ego"), F.round(F.element_at("embedding", 64).cast("double"), 6).alias("exo"))
    return X.substituted(e, e.select("vec_id", (F.col("vec_id") * 2).alias("donor")), "vec_id", ["exo"])


SUBSTITUTE_SQL = """WITH e AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS ego, round(CAST(embedding[64] AS DOUBLE), 6) AS exo FROM embeddings)
SELECT a.vec_id, a.ego, CASE WHEN b.vec_id IS NULL THEN a.exo ELSE b.exo END AS exo, a.vec_id * 2 AS donor FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id * 2"""


def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents looked up in two overlapping sources, with a group and a time to agree on."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("take"), F.col("n_chars").cast("double").alias("t"))
    first = d.where("doc_id % 3 <> 0").withColumn("t", F.col("t") + F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(0.0005))
    second = d.where("doc_id % 4 = 0").withColumn("take", F.when(F.col("doc_id") % 8 == 0, "xx").otherwise(F.col("take")))
    return X.source_lookup(d, {"first": first, "second": second}, "doc_id", "take", "t")


LOOKUP_SQL = """SELECT doc_id, CASE WHEN a AND NOT b THEN 'first' WHEN b AND NOT a THEN 'second' END AS source, CASE WHEN NOT a AND NOT b THEN 'missing' WHEN a AND b THEN 'ambiguous' WHEN b AND doc_id % 8 = 0 THEN 'other_group'
 WHEN a AND doc_id % 7 = 0 THEN 'other_time' ELSE 'ok' END AS status FROM (SELECT doc_id, doc_id % 3 <> 0 AS a, doc_id % 4 = 0 AS b FROM documents)"""


def content_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of a user with the very value of another, nearest to the hinted time."""
    e = events(spark, sf_dir).select("user_id", "event_id", F.round("value").cast("int").cast("string").alias("content"))
    rows = e.groupBy("user_id").agg(F.max_by("content", "event_id").alias("content"), F.min("event_id").alias("hint"))
    return X.content_match(rows, e, "user_id", "content", "event_id", "hint")


CONTENT_SQL = """WITH e AS (SELECT user_id, event_id, CAST(CAST(round(value) AS INTEGER) AS VARCHAR) AS content FROM events), r AS (SELECT user_id, arg_max(content, event_id) AS content, min(event_id) AS hint FROM e GROUP BY 1),
m AS (SELECT r.user_id, e.event_id, row_number() OVER (PARTITION BY r.user_id ORDER BY abs(e.event_id - hint), e.event_id) AS rn, count(*) OVER (PARTITION BY r.user_id) AS n FROM r JOIN e USING (user_id, content)) SELECT user_id, event_id, n AS matches FROM m WHERE rn = 1"""


def deblinded(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("review_id"), "lang")
    first = _documents(spark, sf_dir, SUBMITTED)
    second = first.where("notes = ''").withColumn("annotator_id", F.when(F.col("review_id").endswith("7"), "ANN.1 ").otherwise("zoe")).withColumn("effect_label", F.lit("no_effect"))
    got = X.deblinded(frozen, first, second, "review_id", ["effect_label"])
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("a_effect_label") == F.col("b_effect_label")).alias("agree"))


DEBLIND_SQL = f"""WITH s AS ({_table(SUBMITTED)}) SELECT lang, count(*) AS n, count(*) FILTER (WHERE trim(effect_label) = 'no_effect') AS agree FROM documents JOIN s ON review_id = CAST(doc_id AS VARCHAR)
 WHERE notes = '' AND NOT (ends_with(review_id, '7') AND annotator_id = 'ann.1') GROUP BY 1"""

QUERIES = {
    "take_annotations": (take_annotations, _annotation_sql()),
    "gold_rows": (gold_rows, GOLD_SQL),
    "blind_submission": (blind_submission, _blind_sql()),
    "training_rows": (training_rows, ROLES_SQL),
    "sample_ids": (sample_ids, IDS_SQL),
    "catalogue_rows": (catalogue_rows, CATALOGUE_SQL),
    "weight_lookup": (weight_lookup, WEIGHT_SQL),
    "nearest_frame_rows": (nearest_frame_rows, NEAREST_FRAME_SQL),
    "donor_contract": (donor_contract, DONOR_SQL),
    "eligibility_report": (eligibility_report, ELIGIBLE_SQL),
    "cyclic_shift": (cyclic_shift, SHIFT_SQL),
    "action_donors": (action_donors, ACTION_SQL),
    "other_codes": (other_codes, OTHER_CODE_SQL),
    "batch_donors": (batch_donors, BATCH_DONOR_SQL),
    "pair_batches": (pair_batches, PAIR_SQL),
    "group_batches": (group_batches, GROUP_BATCH_SQL),
    "quality_index": (quality_index, QUALITY_SQL),
    "fill_empty": (fill_empty, FILL_SQL),
    "labelled_report": (labelled_report, REPORT_SQL),
    "allowlist_positions": (allowlist_positions, ALLOW_SQL),
    "view_substitution": (view_substitution, SUBSTITUTE_SQL),
    "source_lookup": (source_lookup, LOOKUP_SQL),
    "content_match": (content_match, CONTENT_SQL),
    "deblinded": (deblinded, DEBLIND_SQL),
}
