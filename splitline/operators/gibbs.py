"""A Gibbs sampler of y = mu + beta * x + ability + difficulty + noise with normal priors, as grouped Spark aggregates.

Given the rest, every ability is a normal draw from the sums of its own rows, and so is every difficulty. Sums that don't change are made
once per link (person, cell); a round joins the links with one side's draws and sums these for the other side. Links lie in buckets
(:class:`~splitline.operators.solve.Sides`) and are not moved again; difficulties are sent to all tasks. Several chains run side by side, as
columns, as many at a time as can be sent (SENT). Random numbers come from a hash of (seed, chain, round, kind, key), so that a task that is
run again draws the same. Slope, mean and noise need a few sums per chain; those are drawn on the driver. Without a pinned cell, the
constant that mean and difficulties share is drawn too, as the rounds alone would move it by a step of the mean's own, small error each.
Difficulties of every kept round are stored, and the posterior is an aggregate of them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .solve import Sides
from .store import bucketed, written

#: Difficulties (cells times chains) that are sent to all tasks: 32 MB of numbers.
SENT = 4_000_000


def normal(seed: int, kind: str, *keys: Column) -> Column:
    """A standard normal number from the hash of its keys (two uniforms of 32 bits, turned by the polar form)."""
    h = F.md5(F.concat_ws("|", F.lit(f"{seed}|{kind}"), *[k.cast("string") for k in keys]).cast("binary"))
    u = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(9))


def _numbers(values) -> Column:
    """An array of numbers, as one literal."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _step(met: DataFrame, other: str | None, key: str, kind: str, sd: float, now: dict, seed: int, number: int) -> DataFrame:
    """(key, n, sy, sx, w, <kind>): each chain's draw of each unknown from the normal posterior of its rows, chains in arrays. ``met``: links with the
    other side's draws; w: the sums of these over rows. They are 0 where there is no other side yet."""
    w = [F.lit(0.0) if other is None else F.sum(F.col("n") * F.col(other)[i]) for i in range(len(now))]
    own = met.groupBy(key).agg(*[F.sum(v).alias(v) for v in ("n", "sy", "sx")], F.array(*w).alias("w"))

    def drawn(w: Column, p: Column) -> Column:
        precision = F.col("n") / p["sig2"] + 1 / sd**2
        s = F.col("sy") - p["mu"] * F.col("n") - p["beta"] * F.col("sx") - w
        return s / p["sig2"] / precision + normal(seed, f"{kind}|{number}", p["chain"], F.col(key)) / F.sqrt(precision)

    chain = F.sequence(F.lit(min(now)), F.lit(max(now)))
    each = F.arrays_zip(chain.alias("chain"), *[_numbers(v).alias(k) for k, v in zip(("mu", "beta", "sig2"), zip(*now.values()))])
    return own.withColumn(kind, F.zip_with("w", each, drawn))


def draws(df: DataFrame, person: str, cell: str, y: str, x: str | None = None, chains: int = 8, rounds: int = 60, burn: int = 20, sd_ability: float = 0.25, sd_cell: float = 1.0, noise: tuple[float, float] = (2.0, 0.002), seed: int = 0, reference=None, fixed: tuple[float, float, float] | None = None) -> tuple[DataFrame, list[dict]]:
    """(difficulties (chain, round, cell, d) of the kept rounds, parameters of every round and chain).

    ``reference``: a cell pinned at 0 in every round, as abilities and difficulties are known only up to a constant; the prior alone holds that
    constant otherwise. ``fixed``: (mu, beta, noise variance) that are not drawn. ``noise``: shape and rate of its inverse-gamma prior.
    """
    value = F.col(y).cast("double")
    extra = F.lit(0.0) if x is None else F.col(x).cast("double")
    rows = df.select(F.col(person).alias("person"), F.col(cell).alias("cell"), value.alias("y"), extra.alias("x")).where("y IS NOT NULL AND x IS NOT NULL AND person IS NOT NULL AND cell IS NOT NULL")
    total = lambda e, name: F.sum(F.expr(e)).alias(name)
    sums = [F.count("*").cast("double").alias("n"), total("y", "sy"), total("x", "sx")]
    rows = written(rows, "gibbs-rows")
    spark = df.sparkSession
    all_ = rows.agg(*sums, total("y * y", "syy"), total("x * x", "sxx"), total("x * y", "sxy"), F.approx_count_distinct("cell").alias("cells")).first()
    if not all_["n"]:
        return spark.createDataFrame([], "chain int, round int, cell string, d double"), []
    together = max(1, min(chains, SENT // all_["cells"]))
    links = Sides(rows, "person", "cell", together, sums)
    start = tuple(map(float, fixed or (all_["sy"] / all_["n"], 0.0, max(all_["syy"] / all_["n"] - (all_["sy"] / all_["n"]) ** 2, 1e-8))))
    kept, seen = [], []
    for first in range(0, chains, together):
        some = _chains(links, all_, range(first, min(chains, first + together)), start, rounds, burn, sd_ability, sd_cell, noise, seed, reference, fixed is None)
        kept, seen = kept + some[0], seen + some[1]
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out, seen


def _chains(links: Sides, all_, chains: range, start: tuple, rounds: int, burn: int, sd_ability: float, sd_cell: float, noise: tuple[float, float], seed: int, reference, free: bool) -> tuple[list[DataFrame], list[dict]]:
    """(difficulties of each kept round, parameters of every round) of some chains side by side."""
    now, d, kept, seen = dict.fromkeys(chains, start), None, [], []
    for t in range(rounds):
        met = links.rows if d is None else links.met("cell", d)
        a = bucketed(_step(met, None if d is None else "d", "person", "a", sd_ability, now, seed, t).drop("w"), "gibbs_a", "person", links.parts)
        drawn = written(_step(links.met("person", a.select("person", "a")), "a", "cell", "d", sd_cell, now, seed, t), "gibbs-d")
        shift = dict.fromkeys(now, 0.0)
        if free:
            now, level = _parameters(a, drawn, all_, now, noise, sd_cell, seed, t)
            if reference is None:  # mean and difficulties change by the same constant, which leaves every row's fit as it is
                now, shift = {c: (v[0] + level[c], *v[1:]) for c, v in now.items()}, level
        if reference is not None:
            pinned = drawn.where(F.col("cell") == reference).first()  # one row
            shift = dict(zip(now, pinned["d"])) if pinned else shift
        d = drawn.select("cell", F.zip_with("d", _numbers(shift.values()), lambda v, s: v - s).alias("d"))
        if t >= burn:
            kept.append(d.select("cell", F.posexplode("d").alias("_c", "d")).select((F.col("_c") + F.lit(min(now))).alias("chain"), F.lit(t).alias("round"), "cell", "d"))
        seen += [{"round": t, "chain": c, "mu": v[0], "beta": v[1], "sigma": v[2] ** 0.5} for c, v in now.items()]
    return kept, seen


def _parameters(a: DataFrame, d: DataFrame, all_, now: dict, noise: tuple[float, float], sd_cell: float, seed: int, number: int) -> tuple[dict, dict]:
    """(each chain's next (mu, beta, noise variance), the constant to move from its difficulties to mu), from sums over its rows of e = ability +
    difficulty, which are sums over persons and cells: their
    product's is that of each difficulty with the abilities of its rows. A pinned reference moves between the two and leaves e as it is."""
    part = lambda side, kind, *v: side.select("n", "sy", "sx", F.posexplode(F.arrays_zip(F.col(kind).alias("v"), *v)).alias("chain", "e"))
    own = part(a, "a").select("*", F.lit(0.0).alias("w"), F.lit(0).alias("cell")).unionByName(part(d, "d", "w").select("*", F.col("e.w").alias("w"), F.lit(1).alias("cell")).withColumn("e", F.struct("e.v")))
    v = F.col("e.v")
    sums = {"en": v * F.col("n"), "ey": v * F.col("sy"), "ex": v * F.col("sx"), "een": v * (v * F.col("n") + 2 * F.col("w")), "d": v * F.col("cell"), "cells": F.col("cell")}
    got = own.groupBy("chain").agg(*[F.sum(x).alias(k) for k, x in sums.items()]).collect()  # a row a chain
    out, level = {}, {}
    for r in got:
        chain = min(now) + r["chain"]
        rng = np.random.Generator(np.random.Philox(key=[seed, number * 1_000_003 + chain]))
        mu, beta, sig2 = now[chain]
        precision = all_["sxx"] / sig2 + 1.0
        beta = (all_["sxy"] - mu * all_["sx"] - r["ex"]) / sig2 / precision + rng.normal() / math.sqrt(precision)
        precision = all_["n"] / sig2 + 1e-6
        mu = (all_["sy"] - beta * all_["sx"] - r["en"]) / sig2 / precision + rng.normal() / math.sqrt(precision)
        # the sum of (y - e - mu - beta x) ** 2
        rest = all_["syy"] - 2 * r["ey"] + r["een"] + all_["n"] * mu**2 + beta**2 * all_["sxx"] - 2 * mu * (all_["sy"] - r["en"]) - 2 * beta * (all_["sxy"] - r["ex"]) + 2 * mu * beta * all_["sx"]
        out[chain] = (mu, beta, (noise[1] + 0.5 * max(rest, 0.0)) / rng.gamma(noise[0] + 0.5 * all_["n"]))
        # given every row's fit, only the priors of the difficulties and of mu speak of the constant
        precision = r["cells"] / sd_cell**2 + 1e-6
        level[chain] = (r["d"] / sd_cell**2 - 1e-6 * mu) / precision + rng.normal() / math.sqrt(precision)
    return {c: out[c] for c in now}, {c: level[c] for c in now}


def posterior(kept: DataFrame) -> DataFrame:
    """(cell, mean, sd, low, high, draws): the central 95 percent of each cell's difficulty over chains and rounds."""
    q = lambda p: F.percentile("d", p)
    return kept.groupBy("cell").agg(F.avg("d").alias("mean"), F.stddev("d").alias("sd"), q(0.025).alias("low"), q(0.975).alias("high"), F.count("*").alias("draws"))
