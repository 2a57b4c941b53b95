"""Sinks: staged updates, changed rows only, versioned tables, snapshots, exports, page payloads, sized chunks."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def staged_update(table: DataFrame, staging: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``table`` with the staged values of ``columns`` where the key is staged and the value isn't null; keys that are only staged are not added."""
    new = staging.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates([f"_k{i}" for i in range(len(key))])
    got = table.join(new, [table[k] == F.col(f"_k{i}") for i, k in enumerate(key)], "left")
    return got.select(*[F.coalesce(F.col(f"_{c}"), table[c]).alias(c) if c in columns else table[c] for c in table.columns])


def changed_rows(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old`` or whose ``columns`` differ there, nulls being equal: all that a rewrite must touch."""
    before = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    both = new.join(before, [new[k] == F.col(f"_k{i}") for i, k in enumerate(key)], "left")
    differs = F.col("_there").isNull()
    for c in columns:
        differs |= ~new[c].eqNullSafe(F.col(f"_{c}"))
    return both.where(differs).select(*[new[c] for c in new.columns])


class Versioned:
    """A table of versions under one folder: a version is written whole and then named by a pointer file, so readers see the old one or
    the new one, never a part. A pointer's number is taken by an exclusive create, so that of two writers one gets the number and the other
    the next, or, where it named the version it started from, a :class:`Conflict`. The file system must refuse to create a file twice, as
    HDFS does; Hadoop's local one only looks before it creates, so there the operating system's own exclusive create is used."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Writes a version and returns its number. ``after``: the number that must still be the newest (0 for none), else :class:`Conflict`."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{version}")
        number = (max(self._taken(), default=0) if after is None else after) + 1
        while not self._take(number, version):
            if after is not None and not self._abandoned(number):
                raise Conflict(f"version {number} was written meanwhile")
            number += 1
        return number

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _take(self, number: int, version: str) -> bool:
        folder, fs = self._folder()
        if fs.getUri().getScheme() == "file":
            place = fs.makeQualified(folder).toUri().getPath()
            os.makedirs(place, exist_ok=True)
            try:
                with open(f"{place}/{number:019d}", "x") as out:
                    out.write(version)
            except FileExistsError:
                return False
            return True
        try:
            out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:019d}"), False)
        except Exception as e:  # py4j wraps what Hadoop throws
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        out.write(version.encode())
        out.close()
        return True

    def _abandoned(self, number: int, seconds: float = 60.0) -> bool:
        """Whether a pointer has named no version for so long that its writer must be dead."""
        folder, fs = self._folder()
        made = fs.getFileStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:019d}")).getModificationTime()
        return not self._version(number) and made < (time.time() - seconds) * 1000

    def _taken(self) -> list[int]:
        """Numbers of the pointers, also of those whose writer died before it named a version."""
        folder, fs = self._folder()
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder)) if fs.exists(folder) else []

    def _version(self, number: int) -> str:
        """The version that a pointer names; empty where its writer died."""
        return "".join(r["value"] for r in self.spark.read.text(f"{self.path}/current/{number:019d}").collect())

    def newest(self) -> int:
        """The newest number that names a version, 0 for none."""
        return next((n for n in reversed(self._taken()) if self._version(n)), 0)

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{self._version(number or self.newest())}")


class Conflict(RuntimeError):
    """Another writer was first."""


class ClaimQueue:
    """A work queue as a versioned table. A worker claims the best pending rows, and rows whose lease has run out, by writing the next
    version after the one it read; when another worker was first, it reads again. So no row is claimed twice while its lease runs.

    Rows have the queue's own columns and state, worker, token and lease_until (seconds since 1970).
    """

    def __init__(self, spark: SparkSession, path: str, state: str = "state"):
        self.table, self.state = Versioned(spark, path), state

    def fill(self, rows: DataFrame) -> int:
        null = F.lit(None)
        return self.table.write(rows.withColumns({"worker": null.cast("string"), "token": null.cast("string"), "lease_until": null.cast("double")}))

    def claim(self, worker: str, priority: list[Column], per: list[str], batch: int, now: float, lease: float) -> DataFrame:
        """The rows that ``worker`` now holds by this claim, at most ``batch`` of each ``per`` group."""
        token = uuid.uuid4().hex

        def step(queue: DataFrame) -> DataFrame:
            free = (F.col(self.state) == "pending") | ((F.col(self.state) == "claimed") & (F.col("lease_until") < now))
            open_ = queue.withColumn(self.state, F.when(free, "pending").otherwise(F.col(self.state)))
            mine = (F.col(self.state) == "claimed") & (F.coalesce("lease_until", F.lit(-1.0)) < now)  # what was claimed just now still has its old lease
            after = claim(open_, self.state, priority, per, batch)[1]
            return after.withColumns({"worker": F.when(mine, worker).otherwise(F.col("worker")), "token": F.when(mine, token).otherwise(F.col("token")), "lease_until": F.when(mine, F.lit(now + lease)).otherwise(F.col("lease_until"))})

        return self._changed(step).where(F.col("token") == token)

    def done(self, token: str, result: str = "done") -> DataFrame:
        """Marks the rows of a claim that still hold its token; rows that were claimed anew meanwhile stay with their new worker."""
        held = (F.col("token") == token) & (F.col(self.state) == "claimed")
        return self._changed(lambda queue: queue.withColumn(self.state, F.when(held, result).otherwise(F.col(self.state))))

    def _changed(self, step) -> DataFrame:
        while True:
            number = self.table.newest()
            try:
                return self.table.read(self.table.write(step(self.table.read(number)), after=number))
            except Conflict:
                continue


def write_snapshot(df: DataFrame, path: str, day: str) -> None:
    """One dated partition; taking a day's snapshot again replaces it."""
    df.withColumn("snapshot_date", F.lit(day).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def latest_snapshots(snapshots: DataFrame, keep: int) -> DataFrame:
    """The rows of the ``keep`` newest dates."""
    days = snapshots.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(keep)
    return snapshots.join(F.broadcast(days), "snapshot_date", "left_semi")  # at most ``keep`` dates


def prune_snapshots(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Deletes the partitions of all but the ``keep`` newest dates under ``path``, and returns the dates that are gone. Names of partitions are listed,
    no data is read; a reader of a date that is deleted meanwhile fails rather than seeing a part of it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    dated = {x.getPath().getName().removeprefix("snapshot_date="): x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("snapshot_date=")}
    old = sorted(dated)[:-keep] if keep else sorted(dated)
    for day in old:
        fs.delete(dated[day], True)
    return old


def padded(df: DataFrame, sequence: str, length: int, pad) -> DataFrame:
    """``df`` with its sequence cut to the last ``length`` values and filled up before them with ``pad``, and ``mask``, 1 at real values: rows of one
    shape, as a batch of tensors wants them. A null sequence is all padding."""
    kind = df.schema[sequence].dataType.elementType
    own = F.coalesce(sequence, F.array().cast(df.schema[sequence].dataType))
    kept = F.slice(own, F.greatest(F.size(own) - length + 1, F.lit(1)), length)
    missing = F.lit(length) - F.size(kept)
    return df.withColumn(sequence, F.concat(F.array_repeat(F.lit(pad).cast(kind), missing), kept)).withColumn("mask", F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size(kept))))


def safe_cell(value: Column) -> Column:
    """Text for a spreadsheet: a leading = + - @ tab or return gets an apostrophe before it, numbers stay."""
    t = value.cast("string")
    return F.when(t.rlike(r"^[=+\-@\t\r]") & t.try_cast("double").isNull(), F.concat(F.lit("'"), t)).otherwise(t)


def without_empty_columns(df: DataFrame) -> DataFrame:
    """``df`` less the columns that hold no value: one aggregate over all."""
    seen = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if seen[f"c{i}"]])


def export_csv(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as CSV with guarded text cells and without empty columns; what was written is returned."""
    kept = without_empty_columns(df)
    out = kept.select(*[safe_cell(F.col(f"`{c}`")).alias(c) for c in kept.columns])
    out.write.csv(path, header=True)
    return out


def anonymised(df: DataFrame, person: str, day: str, drop: list[str], salt: str) -> DataFrame:
    """``df`` with a code for the person, days rounded to the week's Monday, and the named columns gone."""
    code = F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col(person).cast("string")), 256), 1, 12)
    return df.drop(*drop).withColumn(person, code).withColumn(day, F.to_date(F.date_trunc("week", F.col(day))))


def payloads(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, sig, payload): each key's rows as JSON in ``order``, with a fingerprint of them. A key is a page, whose rows a reader loads at once."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in key and c not in order]))))
    return df.groupBy(*key).agg(body.alias("payload")).withColumn("sig", F.sha2("payload", 256)).select(*key, "sig", "payload")


def stale_keys(fresh: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose fingerprint differs from the stored one, or that are new or gone, with ``what`` happened."""
    a, b = fresh.select(*key, F.col("sig").alias("_new")), stored.select(*key, F.col("sig").alias("_old"))
    what = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_new") != F.col("_old"), "changed")
    return a.join(b, key, "full").withColumn("what", what).where("what IS NOT NULL").select(*key, "what")


def write_chunks(df: DataFrame, path: str, order: list[str], rows: int) -> DataFrame:
    """``df`` in files of ``rows`` rows, the last one shorter, numbered in ``order``; (chunk, n) of what was written is returned."""
    from ..operators.ranks import numbered

    placed = numbered(df, [F.col(c) for c in order], "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / rows)).drop("_n")
    placed.repartition("chunk").write.partitionBy("chunk").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("chunk").agg(F.count("*").alias("n"))


def claim(queue: DataFrame, state: str, priority: list[Column], per: list[str], batch: int) -> tuple[DataFrame, DataFrame]:
    """(claimed, queue after): the best ``batch`` pending rows of each ``per`` group, and the queue with them marked; one writer applies it."""
    from pyspark.sql import Window

    order = Window.partitionBy(*per).orderBy(*priority)
    numbered = queue.withColumn("_k", F.when(F.col(state) == "pending", F.row_number().over(order.partitionBy(*per, F.col(state)))))
    mine = F.coalesce(F.col("_k") <= batch, F.lit(False))
    return numbered.where(mine).drop("_k"), numbered.withColumn(state, F.when(mine, "claimed").otherwise(F.col(state))).drop("_k")


def key_sample(df: DataFrame, key: str, share: float, seed: str = "") -> DataFrame:
    """All rows of about ``share`` of the keys, the same keys wherever they occur: by a hash of the key."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.where(u < share)
