"""Casts, fallbacks, clamps, rule lists and key builders as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: ColumnLike) -> Column:
    """Trimmed text, null when empty: one spelling for missing."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def number(c: ColumnLike, default: float | None = 0.0) -> Column:
    """Safe cast to double; unparseable or missing gives ``default``."""
    got = col(c).try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(float(default)))


def first_filled(columns: Sequence[ColumnLike], default: float = 0.0) -> Column:
    """The first non-empty column, then cast: a bad cast gives the default, not the next column."""
    return number(F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in columns]), default)


def first_number(columns: Sequence[ColumnLike], default: float = 0.0) -> Column:
    """The first column that parses as a number: falls through on bad casts too."""
    return F.coalesce(*[number(c, None) for c in columns], F.lit(float(default)))


def clip(c: ColumnLike, low: float = 0.0, high: float = 1.0) -> Column:
    """``max(low, min(high, v))``; NaN becomes ``high``."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(c)))


def clip_finite(c: ColumnLike) -> Column:
    """Clip to 0..1 with anything that is not finite counted as 0."""
    v = col(c)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(clip(v))


def scaled(c: ColumnLike, scale: float) -> Column:
    """``v / scale`` clipped to 0..1; 0 for a scale that is not positive."""
    return clip(col(c) / F.lit(float(scale))) if scale > 0 else F.lit(0.0)


def half_even(c: ColumnLike, digits: int = 6) -> Column:
    return F.bround(col(c), digits)


def ordered_case(rules: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out: Column | None = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    rest = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return rest if out is None else out.otherwise(rest)


def violated(rules: Iterable[tuple[str, Column]]) -> Column:
    """Names of the rules whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]))


def yes(c: ColumnLike) -> Column:
    """Bool-like text: common words, else a number that is not zero, else null."""
    v = F.lower(F.trim(col(c).cast("string")))
    return (
        F.when(v.isin("1", "true", "yes", "y", "on", "t"), True).when(v.isin("0", "false", "no", "n", "off", "f", ""), False).otherwise(v.try_cast("double") != 0)
    )


def band(c: ColumnLike, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """Label of the first (descending) cut that the value reaches."""
    return ordered_case([(col(c) >= cut, name) for cut, name in cuts], rest)


def sample_key(source: ColumnLike, split: ColumnLike, sample: ColumnLike) -> Column:
    return F.concat_ws("/", col(source), col(split), col(sample))


def timed_id(group: ColumnLike, seconds: ColumnLike) -> Column:
    """``group:seconds`` with three decimals."""
    return F.concat(col(group).cast("string"), F.lit(":"), F.format_string("%.3f", col(seconds).cast("double")))


def frame(seconds: ColumnLike, fps: float) -> Column:
    """Frame number, halves to even."""
    return F.rint(col(seconds) * F.lit(float(fps))).cast("bigint")


def hash_order(seed: object, *keys: ColumnLike) -> Column:
    """A reproducible random order: sha256 of ``seed:key:...``; stands in for every shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]), 256)


def opaque_id(nonce: str, key: ColumnLike) -> Column:
    """First 16 hex digits of HMAC-SHA256(nonce, key), spelled out with its two paddings."""
    raw = nonce.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(col(key).cast("string"), "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 16)
