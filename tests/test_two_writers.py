"""Versions and claims with two writers at once; streams that are stopped and run again."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from splitline.sources import sinks
from splitline.streaming import streams


def together(*jobs):
    failed = []

    def run(job):
        try:
            job()
        except Exception as e:  # told to the test below
            failed.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, failed


def test_no_version_number_repeats(spark, tmp_path):
    v = sinks.Versioned(spark, f"file://{tmp_path}/v")
    got = []
    together(*[lambda i=i: got.extend(v.write(spark.range(i + 1)) for _ in range(3)) for i in range(3)])
    assert sorted(got) == list(range(1, 10)) and v.newest() == 9
    first = v.read(1).count()
    assert [v.read(1).count() for _ in range(3)] == [first] * 3
    with pytest.raises(sinks.Conflict):
        v.write(spark.range(1), after=3)
    assert v.write(spark.range(7), after=9) == 10 and v.read().count() == 7


def test_a_writer_that_died_does_not_stop_others(spark, tmp_path):
    v = sinks.Versioned(spark, f"file://{tmp_path}/v")
    v.write(spark.range(2))
    dead = tmp_path / "v" / "current" / f"{2:019d}"
    dead.write_bytes(b"")
    assert v.newest() == 1 and v.read().count() == 2
    with pytest.raises(sinks.Conflict):
        v.write(spark.range(3), after=1)  # it may still be writing
    import os
    os.utime(dead, (1, 1))
    assert v.write(spark.range(3), after=1) == 3 and v.newest() == 3


def test_one_of_many_writers_takes_a_number(spark, tmp_path):
    v = sinks.Versioned(spark, f"file://{tmp_path}/v")
    taken, start = [], threading.Barrier(8)

    def work(name):
        for number in range(1, 101):
            start.wait()
            if v._take(number, f"{name}-{number}"):
                taken.append((number, f"{name}-{number}"))

    together(*[lambda i=i: work(i) for i in range(8)])
    assert [n for n, _ in sorted(taken)] == list(range(1, 101))
    assert all((tmp_path / "v" / "current" / f"{n:019d}").read_text() == name for n, name in taken)


def test_no_row_is_claimed_twice(spark, tmp_path):
    q = sinks.ClaimQueue(spark, f"file://{tmp_path}/q")
    q.fill(spark.range(40).select("id", (F.col("id") % 2).alias("site"), F.lit("pending").alias("state")))
    held = {}

    def work(name):
        held[name] = [r.id for _ in range(2) for r in q.claim(name, [F.asc("id")], ["site"], 4, now=1_000.0, lease=60.0).collect()]

    together(lambda: work("a"), lambda: work("b"))
    assert len(held["a"]) == len(held["b"]) == 16 and len({*held["a"], *held["b"]}) == 32
    late = q.claim("c", [F.asc("id")], ["site"], 100, now=1_059.0, lease=60.0).collect()
    assert {r.id for r in late} == set(range(40)) - {*held["a"], *held["b"]}
    again = q.claim("d", [F.asc("id")], ["site"], 2, now=1_061.0, lease=60.0).collect()  # the first leases have run out
    assert len(again) == 4 and {r.worker for r in again} == {"d"}
    done = q.done(again[0].token)
    assert done.where("state = 'done'").count() == 4
    assert q.done(late[0].token).where("state = 'done'").count() == 12


def test_a_stopped_promotion_leaves_the_same_table(spark, tmp_path):
    rows = [(i % 7, i, float(i * 13 % 10)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "k long, at long, value double").coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    stream = lambda: spark.readStream.schema("k long, at long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    tables = []
    for stop in (None, 0, 1):
        place = f"{tmp_path}/{uuid.uuid4().hex}"
        if stop is not None:
            with pytest.raises(Exception, match="stopped after"):
                streams.promote(stream(), f"{place}/t", f"{place}/s", "k", "at", fail_after=stop)
        streams.promote(stream(), f"{place}/t", f"{place}/s", "k", "at")
        tables.append(sorted(tuple(r) for r in streams.promoted(spark, f"{place}/t", "k", "at").collect()))
    assert tables[0] == tables[1] == tables[2] == sorted((k, *max((a, v) for kk, a, v in rows if kk == k)) for k in range(7))


def test_a_row_function_over_a_stream(spark, tmp_path):
    spark.range(50).repartition(4).write.parquet(f"{tmp_path}/in")

    def squares(frames):
        for f in frames:
            yield f.assign(square=f["id"] ** 2)

    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.row_function(s, squares, "id long, square long", f"{tmp_path}/s", f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.id, r.square) for r in got.collect()} == {(i, i * i) for i in range(50)} and got.select("batch").distinct().count() == 4
