"""Bindings of operator roles to tables, as expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6)
    return out.alias(name) if name else out


def _mod(a: int, b: int, m: int = 997) -> str:
    return f"((doc_id * {a} + {b}) % {m}) / {m - 1}e0"


PARENT = "CASE lang WHEN 'en' THEN 'Cooking' WHEN 'fr' THEN 'Music' WHEN 'de' THEN 'Soccer' ELSE 'Other' END"
USABLE = "CASE WHEN quality = 1 AND toxic = 0 THEN 'tokenizer_main' WHEN quality = 1 THEN 'loco_aux' WHEN toxic = 0 THEN 'discard' WHEN toxic = 1 THEN 'diagnostic_candidate' ELSE '' END"

#: Feature columns of a "take" (a document), by name.
TAKE = {
    "take_uid": "doc_id",
    "parent_task": PARENT,
    "task_name": "source",
    "split": "CASE WHEN doc_id % 5 = 0 THEN 'heldout' ELSE 'train' END",
    "usable_for": USABLE,
    "scene_only_score": _mod(131, 7),
    "interaction_score": _mod(17, 3),
    "loco_score": _mod(29, 11),
    "fine_dexterous_score": _mod(43, 5),
    "temporal_diversity_score": _mod(59, 1),
    "hand_object_contact_score": _mod(71, 19),
    "interacting_object_score": _mod(83, 23),
    "object_motion_proxy": _mod(97, 2),
    "exo_body_visibility_score": _mod(101, 31),
    "exo_body_motion_score": _mod(107, 37),
    "loco_motion_score": _mod(113, 41),
    "contact_state_change_score": _mod(127, 43),
    "pose_state_change_score": _mod(137, 47),
    "body_phase_diversity_score": _mod(139, 53),
    "ego_hand_visibility_prob": _mod(149, 59),
    "vlm_confidence": f"CASE WHEN doc_id % 3 = 0 THEN {_mod(151, 61)} ELSE 0e0 END",
    "vlm_prob_tokenizer_main": _mod(157, 67),
    "vlm_prob_loco_aux": _mod(163, 71),
    "vlm_prob_discard": _mod(167, 73),
    "vlm_prob_diagnostic_candidate": _mod(173, 79),
    "n_chars": "n_chars",
}
TAKES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in TAKE.items()) + " FROM documents LEFT JOIN labels USING (doc_id)"


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").selectExpr(*[f"{e} AS {n}" for n, e in TAKE.items()])


EVENTS_SQL = """SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions: user is the group, t seconds since the epoch in UTC."""
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "value", f"{micros} / 1e6 AS t", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k"
    )
