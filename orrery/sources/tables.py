"""Reading input tables, and tables that cut lineage in a folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import distinct_sketch, null_nan

_own_folder = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(df: DataFrame, features: list[str], label: str | None = None, row: str = "row_id") -> DataFrame:
    """Features and label as doubles, NaN as null; the named row column must be unique."""
    missing = [c for c in [*features, row, *([label] if label else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[c for c in df.columns if c not in features and c != label], *[null_nan(f).alias(f) for f in features], *([F.col(label).cast("double").alias(label)] if label else []))


def categorical_columns(df: DataFrame, columns: list[str], most: int = 20) -> list[str]:
    """Columns with at most `most` distinct values, missing ones aside, from one pass of sketches; a column whose
    sketch lies near `most` is counted exactly."""
    row = df.agg(*[distinct_sketch(null_nan(c)).alias(c) for c in columns]).first()
    near = [c for c in columns if 0.9 * most <= (row[c] or 0) <= 1.1 * most + 1]
    exact = df.agg(*[F.size(F.collect_set(null_nan(c))).alias(c) for c in near]).first() if near else {}
    return [c for c in columns if (exact[c] if c in near else row[c] or 0) <= most]


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.  Only a session that runs in one process may do without
    spark.checkpoint.dir; on a cluster a local folder would be another one on each machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _own_folder
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: a cut in the lineage that outlives executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
