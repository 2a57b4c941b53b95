"""Tables written to the shared folder: they cut lineage, survive lost executors and can be laid out by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .. import session


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet and read back."""
    spark = session.ship(df.sparkSession)
    path = f"{session.shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, key: str, buckets: int | None = None) -> DataFrame:
    """Like :func:`written`, bucketed by ``key``: joins and groupings by it move none of these rows. The catalogue entry goes at once."""
    spark = session.ship(df.sparkSession)
    name = f"splitline_{what}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{session.shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
