"""File sources and sinks: Parquet, CSV, JSON lines and text, with explicit schemas; upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; rows that don't parse are dropped."""
    return spark.read.csv(path, schema=schema, header=True, mode="DROPMALFORMED")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def col_or_null(df: DataFrame, name: str, kind: str):
    """The column, or a typed null where this feed lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[col_or_null(df, f.name, f.dataType.simpleString()).cast(f.dataType).alias(f.name) for f in schema])


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def content_id(*columns: str):
    """A stable id of a row's content, so that landing it twice is harmless."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
