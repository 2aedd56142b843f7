"""Row contracts of annotations, gold rows, blind submissions, sample ids and training roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import violated, yes

#: The enumerations of the annotation formats.
TAKE_ENUMS = {
    "take_relevance": (
        "A_interaction_rich", "B_loco_body", "C_active_view_only", "D_scene_only", "E_fine_dexterous", "F_bad_or_unclear", "F_uncertain",
    ),
    "ego_hand_visibility": ("0", "1", "2"),
    "exo_body_visibility": ("0", "1", "2"),
    "object_interaction": ("0", "1", "2"),
    "phase_diversity": ("0", "1", "2"),
    "scene_only_risk": ("0", "1", "2"),
    "ego_exo_sync_quality": ("ok", "minor_issue", "bad"),
    "usable_for": ("tokenizer_main", "loco_aux", "discard", "diagnostic_candidate"),
}
EFFECTS = (
    "no_effect", "approach_align", "acquire_control", "state_change_or_manipulate", "transport_reposition", "release_complete", "recover_abort", "ambiguous",
)
CONTACTS = ("none", "onset", "stable", "release", "unknown")
EDITABLE = ("effect_label", "contact_label", "ambiguous_reason", "annotator_id", "notes")
FORBIDDEN_PARTS = ("probe", "diagnostic", "locked")
FORBIDDEN_ROLES = ("test", "heldout", "holdout", "val", "valid", "validation", "dev", "calibration_dev", "locked_test", "assembly101")


def text(c: str | Column) -> Column:
    """Trimmed text, empty for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _key_failures(df: DataFrame, key: str) -> DataFrame:
    again = df.select(text(key).alias(key)).where(f"{key} <> ''").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return again.select(key, F.lit("duplicate_key").alias("rule"))


def take_annotation_failures(df: DataFrame, key: str = "take_uid", allow_empty: bool = False) -> DataFrame:
    """(key, rule) of broken enumerations and cross-field rules, missing and repeated keys.

    With ``allow_empty`` a row without any annotation passes.
    """
    v = {c: text(c) for c in TAKE_ENUMS}
    main, loco = v["usable_for"] == "tokenizer_main", v["usable_for"] == "loco_aux"
    rules = []
    for c, allowed in TAKE_ENUMS.items():
        rules += [(f"missing_{c}", v[c] == ""), (f"invalid_{c}", (v[c] != "") & ~v[c].isin(*allowed))]
    rules += [
        ("main_not_interaction_rich", main & (v["take_relevance"] != "A_interaction_rich")),
        ("main_without_signal", main & (v["ego_hand_visibility"] == "0") & (v["object_interaction"] == "0")),
        ("main_with_scene_risk", main & (v["scene_only_risk"] == "2")),
        ("main_with_bad_sync", main & (v["ego_exo_sync_quality"] == "bad")),
        ("loco_without_signal", loco & (v["exo_body_visibility"] == "0") & (v["phase_diversity"] == "0")),
        ("scene_only_in_training", (v["take_relevance"] == "D_scene_only") & (main | loco)),
    ]
    found = violated(rules)
    if allow_empty:
        found = F.when(F.concat(*v.values()) == "", F.array().cast("array<string>")).otherwise(found)
    found = F.concat(found, violated([("missing_key", text(key) == "")]))
    return df.select(text(key).alias(key), F.explode(found).alias("rule")).unionAll(_key_failures(df, key))


def _annotators(df: DataFrame) -> DataFrame:
    """One row with rule several_annotators if more than one is named."""
    named = df.select(text("annotator_id").alias("a")).where("a <> ''")
    return named.agg(F.count_distinct("a").alias("n")).where("n > 1").select(F.lit("").alias("key"), F.lit("several_annotators").alias("rule"))


def gold_failures(df: DataFrame, complete: bool = True) -> DataFrame:
    """(sample_id, rule) of gold rows: keys, training flag, labels, reasons, one annotator."""
    rules = [("missing_key", text("sample_id") == ""), ("training_valid", ~F.lower(text("representation_training_valid")).isin("false", "0"))]
    if complete:
        rules += [
            ("invalid_effect", ~text("effect_label").isin(*EFFECTS)),
            ("invalid_contact", ~text("contact_label").isin(*CONTACTS)),
            ("reason_missing", (text("effect_label") == "ambiguous") & (text("ambiguous_reason") == "")),
            ("annotator_missing", text("annotator_id") == ""),
        ]
    out = df.select(text("sample_id").alias("sample_id"), F.explode(violated(rules)).alias("rule")).unionAll(_key_failures(df, "sample_id"))
    return out.unionAll(_annotators(df)) if complete else out


def blind_failures(template: DataFrame, submitted: DataFrame, tasks: int | None = None, annotator: str | None = None) -> DataFrame:
    """(review_id, rule) of a blind submission against its template.

    Both have exactly review_id, image and the editable columns, else rule ``columns``. Rules:
    blank template cells, keys, coverage, unchanged image, trimmed cells, enumerations, a reason
    if and only if ambiguous, annotator form, lengths, one annotator, the delivered count.
    """
    spark = template.sparkSession
    wanted = ["review_id", "image", *EDITABLE]
    heads = [(side, "columns") for side, df in (("template", template), ("submission", submitted)) if df.columns != wanted]
    if heads:
        return spark.createDataFrame(heads, "review_id string, rule string")
    filled = template.where(F.concat(*[text(c) for c in EDITABLE]) != "").select("review_id", F.lit("template_not_blank").alias("rule"))
    out = filled.unionAll(_key_failures(template, "review_id").withColumn("rule", F.lit("template_duplicate")))
    out = out.unionAll(_key_failures(submitted, "review_id"))
    for side, df in (("template", template), ("submission", submitted)):
        out = out.unionAll(df.where(text("review_id") == "").select(text("review_id"), F.lit(f"{side}_blank_key")))
    raw = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EDITABLE}
    there = submitted.select("review_id", F.coalesce("image", F.lit("")).alias("s_image"), *[v.alias(c) for c, v in raw.items()], F.lit(True).alias("__s"))
    both = template.select("review_id", F.coalesce("image", F.lit("")).alias("t_image"), F.lit(True).alias("__t")).join(there, "review_id", "full")
    effect, reason, name = F.trim("effect_label"), F.trim("ambiguous_reason"), F.trim("annotator_id")
    met = [
        ("image_changed", F.col("s_image") != F.col("t_image")),
        *[(f"untrimmed_{c}", F.col(c) != F.trim(c)) for c in EDITABLE],
        ("invalid_effect", ~effect.isin(*EFFECTS)),
        ("invalid_contact", ~F.trim("contact_label").isin(*CONTACTS)),
        ("reason_missing", (effect == "ambiguous") & (reason == "")),
        ("reason_not_blank", (effect != "ambiguous") & (reason != "")),
        ("invalid_annotator", ~name.rlike(r"^[A-Za-z0-9._-]{2,64}$")),
        ("reason_too_long", F.length(reason) > 256),
        ("notes_too_long", F.length("notes") > 1000),
    ]
    paired = F.col("__s").isNotNull() & F.col("__t").isNotNull()
    rules = [("missing_row", F.col("__s").isNull()), ("unexpected_row", F.col("__t").isNull()), *[(n, paired & c) for n, c in met]]
    out = out.unionAll(both.select("review_id", F.explode(violated(rules)).alias("rule"))).unionAll(_annotators(submitted))
    if annotator is not None:
        others = submitted.where(text("annotator_id") != annotator).limit(1)
        out = out.unionAll(others.select(F.lit(""), F.lit("unexpected_annotator")))
    if tasks is not None:
        out = out.unionAll(template.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != tasks).select(F.lit(""), F.lit("wrong_task_count")))
    return out


def forbidden_role(value: Column) -> Column:
    """Whether a role names a probe, diagnostic or locked use, or is one of the fixed values."""
    v = F.replace(F.lower(text(value)), F.lit("-"), F.lit("_"))
    out = v.isin(*FORBIDDEN_ROLES)
    for part in FORBIDDEN_PARTS:
        out = out | v.contains(part)
    return out


def training_rows(df: DataFrame, roles: Sequence[str], banned: Sequence[str] = (), required: Sequence[str] = (), drop: bool = True) -> DataFrame:
    """Rows that may train: no forbidden role, no ``banned`` flag set, every ``required`` flag set.

    With ``drop=False`` a row that may not is an error instead.
    """
    bad = F.lit(False)
    for c in roles:
        bad = bad | forbidden_role(F.col(c))
    for c in banned:
        bad = bad | F.coalesce(yes(c), F.lit(False))
    for c in required:
        bad = bad | ~F.coalesce(yes(c), F.lit(False))
    if not drop:
        row = df.where(bad).limit(1).collect()
        if row:
            raise ValueError(f"a row may not train: {row[0].asDict()}")
    return df.where(~bad)


def sample_id_failures(df: DataFrame, key: str, group: str, time: str, tolerance: float = 0.002) -> DataFrame:
    """(key, rule): the id is ``group:time``; its head must be the group, its tail the time."""
    head, tail = F.regexp_extract(key, r"^(.*):[^:]*$", 1), F.element_at(F.split(key, ":"), -1).try_cast("double")
    rules = [("no_time", tail.isNull()), ("other_time", F.abs(tail - F.col(time)) > tolerance), ("other_group", head != F.col(group).cast("string"))]
    return df.select(key, F.explode(violated(rules)).alias("rule"))


def normalised_split(c: str, known: Sequence[str] = ("train", "heldout"), default: str = "train") -> Column:
    """The split where it is known, else the default."""
    return F.when(F.col(c).isin(*known), F.col(c)).otherwise(default)


def gated_validity(gate: Column | bool, valid: str) -> Column:
    """A label is valid only if its calibration gate passed and its row is valid."""
    gate = F.lit(gate) if isinstance(gate, bool) else gate
    return F.coalesce(gate, F.lit(False)) & F.coalesce(F.col(valid), F.lit(False))


def assert_columns(df: DataFrame, allowed: Sequence[str], required: Sequence[str] = (), blank: Sequence[str] = ()) -> DataFrame:
    """``df`` itself; raises on columns outside the list, missing ones, or filled ``blank`` cells."""
    extra, missing = [c for c in df.columns if c not in allowed], [c for c in required if c not in df.columns]
    if extra or missing:
        raise ValueError(f"unexpected columns {extra}, missing columns {missing}")
    if blank and df.where(F.concat(*[text(c) for c in blank]) != "").limit(1).count():
        raise ValueError(f"cells of {list(blank)} must be blank")
    return df


def catalogue_candidate(dropped: str, validated: str, paths: Sequence[str]) -> Column:
    """Not dropped, validated (true where unknown), and every path there."""
    out = ~F.coalesce(F.col(dropped), F.lit(False)) & F.coalesce(F.col(validated), F.lit(True))
    for p in paths:
        out = out & (text(p) != "")
    return out


def agreement_of_pair(a: Column, b: Column) -> Column:
    """Two annotators are two: their names differ in lower case."""
    return F.lower(F.trim(a)) != F.lower(F.trim(b))
