"""Session defaults: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again, which cuts its lineage.

    Where that is unset, a session on one machine gets a temporary folder; a cluster is refused.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` keys use ``__`` for dots and win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
