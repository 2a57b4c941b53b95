"""Helpers that the corpus operators share: tables, the shared folder, words, packed arrays."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Texts may be long, so Python workers get them in small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    session.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    return session.shared_dir(session.ship(spark))


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`materialize`, as an external table bucketed by ``key``: grouping it by ``key`` later moves none of its rows.

    The frame that is returned knows the files and their buckets, so the catalogue entry goes at once; the files stay in the shared folder.
    """
    spark, name = df.sparkSession, f"splitline_{what}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column is called so (Spark doesn't tell upper from lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for ``rows`` so that none holds more than about ``per_part``, and every core has work."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def planes(values: np.ndarray) -> bytes:
    """Values below 2**32 as byte planes, in their given order; larger ones are an error."""
    if len(values) and int(np.max(values)) >> 32:
        raise OverflowError("a value does not fit 32 bits")
    v = np.ascontiguousarray(values, dtype=np.uint32)
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    p = np.frombuffer(blob, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(p.T).view(np.uint32).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordCache:
    """Maps a word's bytes to a value made once per worker; emptied when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, make, limit: int = 200_000):
        self.make, self.limit, self.known = make, limit, {}

    def __call__(self, words: list[bytes]) -> list:
        known, make = self.known, self.make
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = make(w)
            return [known[w] for w in words]
