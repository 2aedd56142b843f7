"""Readers by suffix and checked writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("sample_key", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("take_uid", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("capability_validity", T.MapType(T.StringType(), T.BooleanType())),
        T.StructField("training_valid", T.BooleanType()),
        T.StructField("quality_bucket", T.StringType()),
        T.StructField("quality_weight", T.DoubleType()),
        T.StructField("annotation_refs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_hashes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every value a string."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = True) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, a missing file is empty."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, lists: Sequence[str] = ("samples", "records", "rows", "annotations", "data")) -> DataFrame:
    """Rows of a table by suffix: parquet, csv, jsonl/ndjson, or a JSON document holding a list."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("parquet", "orc"):
        return spark.read.format(suffix).load(path)
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if suffix != "json":
        raise ValueError(f"no reader for {path}")
    doc = spark.read.json(path, multiLine=True)
    for name in lists:
        if name in doc.columns and isinstance(doc.schema[name].dataType, T.ArrayType):
            return doc.select(F.inline(name))
    return doc


def read_ids(spark: SparkSession, path: str, field: str = "take_uid") -> DataFrame:
    """One id a line: a JSON object's field, or the first word."""
    line = F.trim("value")
    found = F.when(line.startswith("{"), F.get_json_object(line, f"$.{field}")).otherwise(F.element_at(F.split(line, r"\s+"), 1))
    return spark.read.text(path).select(found.alias(field)).where(F.coalesce(F.col(field), F.lit("")) != "")


def read_nested(spark: SparkSession, path: str, key: str, value_schema: str) -> DataFrame:
    """(name, value) of a top-level map in a JSON document."""
    doc = spark.read.schema(f"`{key}` MAP<STRING, {value_schema}>").json(path, multiLine=True)
    return doc.select(F.explode(key).alias("name", "value"))


def last_json_row(df: DataFrame, line: str, order: str, field: str) -> DataFrame:
    """The last line (by ``order``) that is a JSON object with ``field``."""
    rows = df.where(F.col(line).rlike(r"^\s*\{") & F.get_json_object(line, f"$.{field}").isNotNull())
    return rows.agg(F.max_by(line, order).alias(line))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing columns are added, null ones filled."""
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()})


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; raises when a key is null or repeated."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    row = bad.where((F.col("n") > 1) | null).limit(1).collect()
    if row:
        raise ValueError(f"key {keys} is missing or repeated: {row[0].asDict()}")
    return df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_shards(shards: Sequence[DataFrame], key: str, expected: DataFrame | None = None) -> DataFrame:
    """Disjoint shards as one table; with ``expected`` its keys must be covered exactly."""
    out = assert_unique(union_all(shards), key)
    if expected is not None:
        for a, b, what in ((expected, out, "missing"), (out, expected, "unexpected")):
            row = a.select(key).join(b.select(key), key, "left_anti").limit(1).collect()
            if row:
                raise ValueError(f"{what} key {row[0][0]}")
    return out


def publish(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write once: an existing target is refused, the committer publishes whole results only."""
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)


def preferred_first(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns in their order, the others sorted behind."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def nested_split(df: DataFrame, split: str, bucket: str, key: str, confidence: str) -> DataFrame:
    """(split, bucket, takes): bucket lists by descending confidence, then key."""
    row = F.struct((-F.col(confidence)).alias("c"), F.col(key).alias("k"))
    return df.groupBy(split, bucket).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["k"]).alias("takes"))


def newest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keyed scan where the last row wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
