"""Checked artifacts: typed manifests, verified caches, row subsets, snapshots, claims, policies."""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import MANIFEST, assert_unique, union_all


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed manifest lines; a malformed line or a repeated key is an error that shows it."""
    bad = "_malformed"
    schema = T.StructType([*MANIFEST.fields, T.StructField(bad, T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    line = F.trim("value")
    wrong = spark.read.text(path).where(line != "").where(F.from_json("value", "map<string,string>").isNull() | F.get_json_object("value", "$.sample_key").isNull())
    shown = wrong.limit(1).collect()
    if shown:
        raise ValueError(f"invalid manifest record in {path}: {shown[0][0][:200]}")
    first = rows.select(*MANIFEST.names, bad).where(F.col(bad).isNotNull()).limit(1).collect()
    if first:
        raise ValueError(f"invalid manifest record in {path}: {first[0][bad][:200]}")
    return assert_unique(rows.drop(bad), "sample_key")


def table_shape(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Rows and column names of a Parquet table; both come from the footers."""
    df = spark.read.parquet(path)
    return df.count(), df.columns


def resolved_capability(df: DataFrame, name: str, nested: str | None = None, aliases: Sequence[str] = (), sidecar: str | None = None) -> Column:
    """The nested map's value, else the first non-empty alias column, else the sidecar, else false."""
    from ..functions.expr import yes

    tiers: list[Column] = [F.element_at(F.col(nested), name)] if nested in df.columns else []
    tiers += [yes(F.nullif(F.trim(F.col(a).cast("string")), F.lit(""))) for a in aliases if a in df.columns]
    tiers += [F.col(sidecar).cast("boolean")] if sidecar in df.columns else []
    return F.coalesce(*tiers, F.lit(False))


def phase_label(df: DataFrame, preferred: str, segments: str = "phase_segments") -> Column:
    """The first non-empty of the preferred field, the usual ones, and the first segment's names."""
    flat = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in (preferred, "phase_label", "phase", "label", "step") if c in df.columns]
    if segments in df.columns:
        inner = df.schema[segments].dataType.elementType
        head = F.try_element_at(F.col(segments), F.lit(1))
        names = [n for n in ("step", "label", "step_name", "step_description") if n in inner.fieldNames()] if isinstance(inner, T.StructType) else []
        flat += [F.nullif(head[n].cast("string"), F.lit("")) for n in names] or [F.nullif(head.cast("string"), F.lit(""))]
    return F.coalesce(*flat, F.lit(""))


def verified(df: DataFrame, content: str, digest: str) -> DataFrame:
    """Rows whose content has the stated sha256; another content is an error when the row is read."""
    same = F.sha2(F.col(content).cast("binary"), 256) == F.lower(F.col(digest))
    return df.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("content does not match "), F.coalesce(F.col(digest), F.lit("a missing digest")))).cast("boolean")))


def view_columns(df: DataFrame, view: str) -> DataFrame:
    """The columns of one view, named without its prefix."""
    return df.select(*[F.col(c).alias(c[len(view) + 1 :]) for c in df.columns if c.startswith(f"{view}_")])


def rows_at(df: DataFrame, index: str, wanted: DataFrame) -> DataFrame:
    """The rows at the wanted indices, each once, with ``source_row_index``."""
    return df.join(wanted.select(index).distinct(), index, "left_semi").withColumn("source_row_index", F.col(index))


def verified_rows_at(df: DataFrame, index: str, wanted: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """Like rows_at; repeated or foreign indices, or metadata other than the parent's, are errors."""
    assert_unique(wanted, index)
    p = df.select(index, *[F.col(c).alias(f"__{c}") for c in metadata], F.lit(True).alias("__p"))
    met = wanted.select(index, *metadata).join(p, index, "left")
    differ = F.col("__p").isNull()
    for c in metadata:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    row = met.where(differ).limit(1).collect()
    if row:
        raise ValueError(f"subset row differs from its parent: {row[0].asDict()}")
    return rows_at(df, index, wanted)


def pending(rows: DataFrame, done: DataFrame | None, key: str, identity: str) -> DataFrame:
    """Rows that still have no result; a result under another identity is an error."""
    if done is None:
        return rows
    met = rows.select(key, identity).join(done.select(key, F.col(identity).alias("__i")), key)
    row = met.where(~F.col(identity).eqNullSafe(F.col("__i"))).limit(1).collect()
    if row:
        raise ValueError(f"a result of another configuration is there: {row[0].asDict()}")
    return rows.join(done.select(key), key, "left_anti")


def merge_features(shards: Sequence[DataFrame], key: str, features: str, checkpoint: str) -> DataFrame:
    """Feature shards of one checkpoint and one length, unique ids, in the order of the id."""
    out = assert_unique(union_all(shards), key)
    kinds = out.agg(F.count_distinct(checkpoint).alias("c"), F.count_distinct(F.size(features)).alias("d")).first()
    if kinds.c > 1 or kinds.d > 1:
        raise ValueError(f"shards of {kinds.c} checkpoints and {kinds.d} feature lengths")
    return out.orderBy(key)


def snapshot(path: str) -> tuple[bytes, str]:
    """Content and sha256 of a file read once; an error if it changed meanwhile."""
    with open(path, "rb") as f:
        before = os.fstat(f.fileno())
        data = f.read()
        after = os.fstat(f.fileno())
    now = os.stat(path)
    marks = [(s.st_ino, s.st_size, s.st_mtime_ns) for s in (before, after, now)]
    if len(set(marks)) > 1 or len(data) != before.st_size:
        raise RuntimeError(f"{path} changed while it was read")
    return data, hashlib.sha256(data).hexdigest()


def resolve(candidates: Sequence[str], pattern: str | None = None, strict: bool = False) -> str:
    """The first candidate that exists, else a match of the pattern; strict: more than one is an error."""
    found = [p for p in candidates if os.path.exists(p)]
    if not found and pattern:
        found = sorted(glob.glob(pattern, recursive=True))
    if not found:
        raise FileNotFoundError(f"none of {list(candidates)} is there")
    if strict and len({os.path.realpath(p) for p in found}) > 1:
        raise ValueError(f"several files match: {found[:5]}")
    return found[0]


def claim(path: str, owner: Mapping[str, Any]) -> None:
    """A one-shot claim: the file is made only if it is not there yet."""
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(dict(owner), f, sort_keys=True)


def _scalar(text: str) -> Any:
    text = text.strip()
    if text and text[0] in "'\"" and text[-1] == text[0]:
        return text[1:-1]
    if text.startswith("["):
        return [_scalar(x) for x in text.strip("[]").split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text)


def read_policy(path: str) -> dict[str, Any]:
    """A policy file: JSON, or nested ``key: value`` lines (mappings, scalars, inline lists)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict[str, Any] = {}
    stack: list[tuple[int, dict[str, Any]]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        name, colon, value = body.strip().partition(":")
        if not colon:
            raise ValueError(f"not a policy line: {line!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][name.strip()] = _scalar(value)
        else:
            stack[-1][1][name.strip()] = inner = {}
            stack.append((depth, inner))
    return root


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small result as a Markdown table; more than ``limit`` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows do not make a report")
    shown = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in rows]
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in shown)]) + "\n"
