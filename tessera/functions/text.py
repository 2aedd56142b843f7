"""Text normalisation and the ordered phrase lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import ColumnLike, col, ordered_case

# Fixed values: (effect id, contact id, phrases), tried in this order.
LEXICON = (
    (5, 3, ("release", "let go", "drop", "set down", "put down")),
    (6, 4, ("abort", "recover", "retry", "fail", "miss", "undo")),
    (2, 1, ("grasp", "grab", "pick up", "take hold", "acquire", "hold")),
    (3, 2, ("open", "close", "cut", "slice", "pour", "stir", "press", "turn", "rotate", "insert", "remove", "attach", "detach", "tighten", "loosen", "fold")),
    (4, 2, ("carry", "transport", "reposition", "transfer", "place", "move to", "put in")),
    (1, 0, ("approach", "reach", "align", "move toward", "position near")),
    (0, 0, ("wait", "look", "inspect", "observe", "no action", "idle")),
)
UNMATCHED_EFFECT, UNMATCHED_CONTACT = 7, 4


def normalized_text(c: ColumnLike) -> Column:
    lowered = F.replace(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("_"), F.lit("-"))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, r"[^a-z0-9\- ]+", " "), r"\s+", " "))


def phrase_match(text: Column) -> Column:
    """First phrase of the lexicon, in its order, that is a substring; null without one."""
    pairs = [(text.contains(p), p) for _, _, phrases in LEXICON for p in phrases]
    return ordered_case(pairs, F.lit(None).cast("string"))


def with_phrase(df: DataFrame, primary: str, secondary: str, out: str = "phrase") -> DataFrame:
    """Adds the phrase that labels a row: the primary text decides before the secondary.

    Each text is normalised once, in a projection below the long list of conditions.
    """
    texts = df.withColumn("__a", normalized_text(primary)).withColumn("__b", normalized_text(secondary))
    return texts.withColumn(out, F.coalesce(phrase_match(F.col("__a")), phrase_match(F.col("__b")))).drop("__a", "__b")


def phrase_labels(phrase: Column) -> dict[str, Column]:
    """effect, contact and validity that a phrase stands for."""
    return {
        "effect": ordered_case([(phrase.isin(*p), e) for e, _, p in LEXICON], UNMATCHED_EFFECT),
        "contact": ordered_case([(phrase.isin(*p), c) for _, c, p in LEXICON], UNMATCHED_CONTACT),
        "valid": phrase.isNotNull(),
    }


def weak_labels(primary: ColumnLike, secondary: ColumnLike) -> Column:
    """struct(phrase, effect, contact, valid) as one expression, for a row at a time."""
    phrase = F.coalesce(phrase_match(normalized_text(primary)), phrase_match(normalized_text(secondary)))
    return F.struct(phrase.alias("phrase"), *[c.alias(n) for n, c in phrase_labels(phrase).items()])
