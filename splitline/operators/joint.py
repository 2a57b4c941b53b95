"""Joint solve of several coupled blocks of effects: penalised least squares by conjugate gradients on Spark.

A row's value is a sum of terms. A term belongs to a block (abilities, courses,
race days, sport slopes, a season curve ...), names one unknown of it and has a
loading: y = sum of loading * unknown + noise. A block's ``ridge`` is the noise's
variance over the block's own, which is what splits a course from its race days.

An unknown is known by the hash of its block and key, so rows name their unknowns
without meeting a table of them; two with one hash are seen and hashed anew. Where
the vectors are small enough to be sent (``SENT``), rows are kept whole, dealt by
their first unknown: a product with the normal matrix is one pass over them, and
only sums by unknown are shuffled. Beyond that, the design is a table of entries
(row, unknown, loading), kept twice, once bucketed by unknown and once by row:
entries by unknown meet the vector and are summed by row, entries by row meet
those sums and are summed by unknown; only partial sums are shuffled. Vectors
are tables by unknown; the driver computes with scalars. Unknowns that share a group (one
person's ability, sport slope and endurance slope) are inverted together as one
small block of the preconditioner; others are scaled by their own diagonal. A
solve that does not settle is an error.

Where every race lies in one course and there are but persons' effects and a curve beside, :mod:`.swept` solves the same equations in few products.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import swept
from .store import bucketed, written

#: Unknowns whose vectors are sent to all tasks, and a row's terms that are kept side by side.
SENT, WIDE = 2_000_000, 16
#: Members of groups whose matrices one task inverts at a time, on average.
MEMBERS = 20_000

_TERM = "array<struct<key:string,x:double>>"


@dataclass
class Block:
    """One kind of effect. ``terms``: an array of (key, x) per row, null or empty where a row has no such effect. ``group``: what the unknown is
    preconditioned with; none by default. ``parent``: (block, key of its unknown) that these unknowns vary around, with ``ridge`` on the
    difference; without a parent they vary around 0."""

    name: str
    terms: Column
    ridge: float = 0.0
    group: Column | None = None
    parent: tuple[str, Column] | None = None


def term(name: str, key: Column, loading: Column | float = 1.0, ridge: float = 0.0, group: Column | None = None, parent: tuple[str, Column] | None = None) -> Block:
    """A block with one unknown per key; rows whose key is null or whose loading is null or 0 have no term."""
    x = (loading if isinstance(loading, Column) else F.lit(loading)).cast("double")
    return Block(name, F.when(key.isNotNull() & (F.coalesce(x, F.lit(0.0)) != 0), F.array(F.struct(key.cast("string").alias("key"), x.alias("x")))).cast(_TERM), ridge, group, parent)


def curve(name: str, at: Column, knots: list[float], loading: Column | float = 1.0, ridge: float = 0.0) -> Block:
    """A piecewise linear curve with one unknown per knot, level beyond the ends. Its knots are preconditioned together."""
    terms = [F.struct(F.lit(str(i)).alias("key"), x.alias("x")) for i, x in enumerate(hats(at, knots, loading))]
    return Block(name, F.filter(F.array(*terms), lambda t: F.coalesce(t["x"], F.lit(0.0)) != 0).cast(_TERM), ridge, F.lit(name))


def hats(at: Column, knots: list[float], loading: Column | float = 1.0) -> list[Column]:
    """Loadings of a curve's knots."""
    x = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), at.cast("double")))
    load = (loading if isinstance(loading, Column) else F.lit(loading)).cast("double")
    out = []
    for i, k in enumerate(knots):
        parts = [F.lit(1.0)]
        if i:
            parts.append(1 - (F.lit(float(k)) - x) / (k - knots[i - 1]))
        if i + 1 < len(knots):
            parts.append(1 - (x - F.lit(float(k))) / (knots[i + 1] - k))
        hat = F.least(*parts) if len(parts) > 1 else parts[0]
        out.append(F.greatest(hat, F.lit(0.0)) * load)
    return out


@dataclass
class Design:
    """Entries of a set of rows: whole rows, or by unknown and by row; the unknowns, and each row's weighted value."""

    wide: DataFrame | None  # row, u0, x0, u1, x1 ...: unknowns and loadings, null where a row has no more
    by_unknown: DataFrame | None  # row, u, load
    by_row: DataFrame | None  # row, u, load
    unknowns: DataFrame  # u, block, key, grp, ridge, b, diagonal, inverse (this unknown's line in its group's inverse)
    rows: DataFrame  # row, id, y, w
    ties: DataFrame  # block, key, parent_block, parent


def _labelled(b: Block) -> Column:
    group, (above, parent) = F.lit(None) if b.group is None else b.group, b.parent or (None, F.lit(None))
    named = [group.cast("string").alias("grp"), F.lit(above).cast("string").alias("parent_block"), parent.cast("string").alias("parent")]
    return F.transform(F.coalesce(b.terms, F.array().cast(_TERM)), lambda t: F.struct(F.lit(b.name).alias("block"), t["key"].alias("key"), t["x"].alias("x"), *named))


def design(rows: DataFrame, row_id: str, y: Column, blocks: list[Block], weight: Column | None = None) -> Design:
    """Rows without a value take no part. ``row_id`` names rows in :func:`fitted`'s result."""
    ridge = F.create_map(*[F.lit(v) for b in blocks for v in (b.name, 0.0 if b.parent else float(b.ridge))])
    terms = F.concat(*[_labelled(b) for b in blocks])
    w = F.lit(1.0) if weight is None else weight.cast("double")
    kept = rows.select(F.col(row_id).alias("id"), y.cast("double").alias("y"), w.alias("w"), terms.alias("terms")).where("y IS NOT NULL AND w > 0")
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()), "joint-rows")
    entry = kept.select("row", (F.sqrt("w") * F.col("y")).alias("z"), F.sqrt("w").alias("s"), F.explode("terms").alias("t")).select("row", "z", "t.block", "t.key", "t.grp", (F.col("t.x") * F.col("s")).alias("x"), "t.parent_block", "t.parent")
    ties = entry.where("parent IS NOT NULL").groupBy("block", "key").agg(F.min(F.struct("parent_block", "parent")).alias("p")).select("block", "key", "p.*")
    ties = written(ties.withColumn("row", -1 - F.monotonically_increasing_id()), "joint-ties")
    pull = F.sqrt(F.create_map(*[F.lit(v) for b in blocks for v in (b.name, float(b.ridge))])[F.col("block")])
    end = lambda block, key, sign: ties.select("row", F.lit(0.0).alias("z"), F.col(block).alias("block"), F.col(key).alias("key"), F.lit(None).cast("string").alias("grp"), (sign * pull).alias("x"))
    entry = entry.drop("parent_block", "parent").unionByName(end("block", "key", 1)).unionByName(end("parent_block", "parent", -1))
    sums = written(entry.groupBy("block", "key").agg(F.min("grp").alias("grp"), F.sum(F.col("x") * F.col("z")).alias("b"), F.sum(F.col("x") * F.col("x")).alias("square")), "joint-sums")
    seed, n = _seed(sums)
    name = lambda block, key: _name(seed, block, key)
    named = sums.withColumn("u", name(F.col("block"), F.col("key")))
    most = kept.agg(F.max(F.size("terms"))).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = by_unknown = by_row = None
    if n <= SENT and most <= WIDE:
        at = lambda i: F.get("terms", F.lit(i))
        whole = kept.select("row", *[c for i in range(most) for c in (F.when(at(i).isNotNull(), name(at(i)["block"], at(i)["key"])).alias(f"u{i}"), (at(i)["x"] * F.sqrt("w")).alias(f"x{i}"))])
        ends = ties.select("row", name(F.col("block"), F.col("key")).alias("u0"), pull.alias("x0"), name(F.col("parent_block"), F.col("parent")).alias("u1"), (-pull).alias("x1"))
        wide = written(whole.unionByName(ends, allowMissingColumns=True).repartition(parts, "u0"), "joint-wide")
    else:
        entries = entry.select("row", name(F.col("block"), F.col("key")).alias("u"), F.col("x").alias("load"))
        by_unknown, by_row = (bucketed(entries.repartition(parts, k), f"joint_by_{k}", k, parts) for k in ("u", "row"))
    unknowns = named.select("u", "block", "key", F.coalesce("grp", F.concat(F.lit("\0"), F.col("u").cast("string"))).alias("grp"), ridge[F.col("block")].alias("ridge"), "b", (F.col("square") + ridge[F.col("block")]).alias("diagonal"))
    inverse = _inverses(kept, name, ridge, 1 + n // MEMBERS)
    return Design(wide, by_unknown, by_row, written(unknowns.join(inverse, "u", "left").withColumn("inverse", F.coalesce("inverse", F.array(F.when(F.col("diagonal") > 0, 1 / F.col("diagonal")).otherwise(0.0)))), "joint-unknowns"), kept.select("row", "id", "y", "w"), ties.drop("row"))


def _name(seed: int, block: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), block, key)


def _seed(unknowns: DataFrame) -> tuple[int, int]:
    """The first seed by which no two unknowns (block, key) have one hash, and the number of unknowns."""
    for seed in range(100):
        seen = unknowns.select(_name(seed, F.col("block"), F.col("key")).alias("u")).agg(F.count("*").alias("n"), F.count_distinct("u").alias("names")).first()
        if seen["n"] == seen["names"]:
            return seed, seen["n"]
    raise RuntimeError("unknowns are named alike by every seed")


def _inverses(kept: DataFrame, name, ridge: Column, tasks: int) -> DataFrame:
    """(u, inverse): the line of each grouped unknown in the inverse of its group's matrix, members in the order of u. A group holds the unknowns
    of one person or curve, so its matrix is small by nature; many groups are inverted together."""
    one = kept.select("w", "terms", F.explode("terms").alias("a")).where("a.grp IS NOT NULL")
    pairs = one.select("w", "a", F.explode(F.filter("terms", lambda t: t["grp"] == F.col("a.grp"))).alias("b"))
    cells = pairs.groupBy(F.col("a.grp").alias("grp"), name(F.col("a.block"), F.col("a.key")).alias("u"), name(F.col("b.block"), F.col("b.key")).alias("v"), F.col("a.block").alias("block")).agg(F.sum(F.col("a.x") * F.col("b.x") * F.col("w")).alias("m"))
    cells = cells.select("grp", "u", "v", "m", ridge[F.col("block")].alias("ridge"), F.pmod(F.xxhash64("grp"), F.lit(tasks)).alias("task"))

    def invert(p: pd.DataFrame) -> pd.DataFrame:
        members = p[["grp", "u"]].drop_duplicates().sort_values(["grp", "u"], ignore_index=True)
        grp, members["at"] = members.groupby("grp", sort=False).ngroup(), members.groupby("grp", sort=False).cumcount()
        members["g"], members["size"] = grp, members.groupby("grp", sort=False)["u"].transform("size")
        full = p.merge(members, on=["grp", "u"]).merge(members[["grp", "u", "at"]].rename(columns={"u": "v", "at": "to"}), on=["grp", "v"])
        out = []
        for size, own in full.groupby("size"):
            which, g = np.unique(own["g"].to_numpy(), return_inverse=True)
            m = np.zeros((len(which), size, size))
            m[g, own["at"], own["to"]] = own["m"] + np.where(own["u"] == own["v"], own["ridge"], 0.0)
            inverse = np.linalg.pinv(m, rcond=1e-12, hermitian=True)  # a group may hold a direction that only other groups settle
            out.append(pd.DataFrame({"u": members.loc[members["size"] == size, "u"].to_numpy(), "inverse": list(inverse.reshape(-1, size))}))
        return pd.concat(out, ignore_index=True)

    return cells.groupBy("task").applyInPandas(invert, "u long, inverse array<double>")


def _met(d: Design, v: DataFrame, name: str) -> tuple[DataFrame, Column, list[tuple[Column, Column]]]:
    """Whole rows with the vector, sent to all tasks: (rows, each row's sum of loading * unknown, its unknowns and loadings)."""
    rows, sent = d.wide, F.broadcast(v.select("u", F.col(name).alias("p")))  # at most SENT
    terms = [(F.col(f"u{i}"), F.col(f"x{i}")) for i in range((len(rows.columns) - 1) // 2)]
    for i, (u, _) in enumerate(terms):
        rows = rows.join(sent.alias(f"v{i}"), u == F.col(f"v{i}.u"), "left")
    return rows, sum((F.coalesce(x * F.col(f"v{i}.p"), F.lit(0.0)) for i, (_, x) in enumerate(terms)), F.lit(0.0)), terms


def _sums(d: Design, v: DataFrame, name: str) -> DataFrame:
    """(row, z): each row's sum of loading * unknown."""
    if d.wide is not None:
        rows, z, _ = _met(d, v, name)
        return rows.select("row", z.alias("z"))
    return d.by_unknown.join(v.select("u", name), "u").groupBy("row").agg(F.sum(F.col("load") * F.col(name)).alias("z"))


def product(d: Design, v: DataFrame, name: str = "p") -> DataFrame:
    """(u, q): the normal matrix, without ridge, times the column ``name`` of ``v`` (u, ...)."""
    if d.wide is not None:
        rows, z, terms = _met(d, v, name)
        whole = rows.select(z.alias("z"), *[c for t in terms for c in t])
        parts = whole.select(F.explode(F.array(*[F.struct(u.alias("u"), (x * F.col("z")).alias("q")) for u, x in terms])).alias("t")) if terms else whole.select(F.struct(F.lit(None).cast("long").alias("u"), F.col("z").alias("q")).alias("t"))
        return parts.where("t.u IS NOT NULL").groupBy("t.u").agg(F.sum("t.q").alias("q"))
    return d.by_row.join(_sums(d, v, name), "row").groupBy("u").agg(F.sum(F.col("load") * F.col("z")).alias("q"))


def _conditioned(state: DataFrame) -> Column:
    """The preconditioner's value at a row of ``state`` (u, grp, inverse, r)."""
    members = F.array_sort(F.collect_list(F.struct("u", "r")).over(Window.partitionBy("grp")))
    return F.aggregate(F.zip_with("inverse", members, lambda a, m: a * m["r"]), F.lit(0.0), lambda s, v: s + v)


def solve(d: Design, start: DataFrame | None = None, tol: float = 1e-10, most: int = 300) -> tuple[DataFrame, dict]:
    """(unknowns, info): unknowns (u, block, key, value, diagonal). Ends when the preconditioned residual has fallen to ``tol`` of that of zero
    effects; raises where it doesn't within ``most`` products, or grows. ``start``: (block, key, value) of an earlier solve."""
    fixed = ["u", "grp", "ridge", "inverse"]
    state = d.unknowns.select(*fixed, "b")
    if start is None:
        state = state.select(*fixed, F.lit(0.0).alias("x"), F.col("b").alias("r"), "b")
    else:
        old = d.unknowns.select("u", "block", "key").join(start.select("block", "key", F.col("value").alias("x")), ["block", "key"]).select("u", "x")
        state = written(state.join(old, "u", "left").withColumn("x", F.coalesce("x", F.lit(0.0))), "joint-start")
        q = product(d, state, "x")
        state = state.join(q, "u", "left").select(*fixed, "x", (F.col("b") - F.coalesce("q", F.lit(0.0)) - F.col("ridge") * F.col("x")).alias("r"), "b")
    zero = written(d.unknowns.select("u", "grp", "inverse", F.col("b").alias("r")), "joint-zero")
    first = zero.select(F.col("r").alias("v"), _conditioned(zero).alias("z")).agg(F.sum(F.col("v") * F.col("z"))).first()[0] or 0.0
    state = written(state.withColumn("z", _conditioned(state)).drop("b").withColumn("p", F.col("z")), "joint-state")
    rz = state.agg(F.sum(F.col("r") * F.col("z"))).first()[0] or 0.0
    used = 0
    while first and rz > tol * tol * first:
        if used == most or rz > 1e12 * first:
            raise RuntimeError(f"the joint solve did not settle: residual {rz / first:.3g} of the first after {used} products")
        both = written(state.join(product(d, state), "u", "left").withColumn("q", F.coalesce("q", F.lit(0.0)) + F.col("ridge") * F.col("p")), "joint-step")
        pq = both.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not pq > 0:
            raise RuntimeError("the joint solve met a direction without curvature")
        a = rz / pq
        moved = both.select(*fixed, (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("q")).alias("r"), "p")
        moved = written(moved.withColumn("z", _conditioned(moved)), "joint-moved")
        new = moved.agg(F.sum(F.col("r") * F.col("z"))).first()[0]
        state, rz, used = moved.withColumn("p", F.col("z") + F.lit(new / rz) * F.col("p")), new, used + 1
    value = state.select("u", F.col("x").alias("value"))
    return written(d.unknowns.select("u", "block", "key", "diagonal").join(value, "u"), "joint-effects"), {"products": used, "relative": (rz / first) ** 0.5 if first else 0.0}


def fitted(d: Design, effects: DataFrame) -> DataFrame:
    """(row, id, y, w, fit) of every row."""
    return d.rows.join(_sums(d, effects, "value"), "row", "left").select("row", "id", "y", "w", (F.coalesce("z", F.lit(0.0)) / F.sqrt("w")).alias("fit"))


def differences(d: Design, effects: DataFrame) -> DataFrame:
    """(block, key, value, diagonal): effects that vary around a parent, less that parent's value; the others as they are."""
    above = effects.select(F.col("block").alias("parent_block"), F.col("key").alias("parent"), F.col("value").alias("_above"))
    tied = effects.join(d.ties, ["block", "key"], "left").join(above, ["parent_block", "parent"], "left")
    return written(tied.select("block", "key", (F.col("value") - F.coalesce("_above", F.lit(0.0))).alias("value"), "diagonal"), "joint-effects")


@dataclass
class Terms:
    """Which columns of the results play which part; those that are None give no block. Variances are the blocks' own, in units of y squared."""

    ability: str = "person"
    cell: str = "cell"
    race: str | None = "race"
    group: str | None = None  # level of a group of courses
    person: str | None = None  # whose slopes, and whose group in the preconditioner
    side: str | None = None  # loading of the person's sport offset
    endurance: str | None = None  # loading of the person's endurance slope
    day: str | None = None  # day of season, for the form curve
    knots: list[float] = field(default_factory=list)
    amplitude: str | None = None  # the curve's loading
    opener: str | None = None  # 1 at a season's first race, per pool
    pool: str | None = None
    distance: str | None = None  # distance class
    altitude: str | None = None  # loading per group
    front: str | None = None  # field strength, per pool
    variances: dict[str, float] = field(default_factory=lambda: {"cell": 0.04, "race": 0.0025, "side": 0.0025, "endurance": 0.0025})
    small: float = 1e-3  # ridge of the blocks that have no variance of their own

    def blocks(self, sigma2: float, tilt: Column) -> list[Block]:
        """``tilt`` multiplies level, course and race day together."""
        ridge = lambda name: sigma2 / self.variances[name]
        c = lambda name: F.col(name)
        who = c(self.person) if self.person else c(self.ability)
        out = [term("ability", c(self.ability), group=who)]
        if self.race:  # a race's unknown is course and day together, which its rows settle; it varies around its course
            out += [term("race", c(self.race), tilt, ridge("race"), parent=("cell", c(self.cell))), term("cell", F.lit(None), ridge=ridge("cell"))]
        else:
            out.append(term("cell", c(self.cell), tilt, ridge("cell")))
        if self.group:
            out.append(term("group", c(self.group), tilt, self.small))
        if self.side:
            out.append(term("side", who, c(self.side), ridge("side"), who))
        if self.endurance:
            out.append(term("endurance", who, c(self.endurance), ridge("endurance"), who))
        if self.day:
            out.append(curve("curve", c(self.day), self.knots, c(self.amplitude) if self.amplitude else 1.0, self.small))
        if self.opener:
            out.append(term("opener", c(self.pool) if self.pool else F.lit("all"), c(self.opener), self.small))
        if self.distance:
            out.append(term("distance", c(self.distance), ridge=self.small))
        if self.altitude:
            out.append(term("altitude", c(self.group) if self.group else F.lit("all"), c(self.altitude), self.small))
        if self.front:
            out.append(term("front", c(self.pool) if self.pool else F.lit("all"), c(self.front), self.small))
        return out


def joint_solve(rows: DataFrame, row_id: str, y: str, terms: Terms, sigma2: float = 4e-4, outer: int = 1, robust: float | None = None, tilt: float = 0.0, estimate: bool = False, tol: float = 1e-8) -> tuple[DataFrame, dict]:
    """(effects, info): effects (block, key, value, diagonal, centred), centred less its block's mean over unknowns.

    Each of ``outer`` rounds solves anew from the round before. ``robust``: rows whose residual is beyond so many standard errors count
    less, c * sigma / |residual|, and never not at all. ``tilt``: courses weigh 1 + tilt * (rating - 100) / 10, where a rating is 100 at the
    mean ability and falls by 1 for each hundredth of log time, seen between 40 and 200. ``estimate``: sigma2 and the blocks' variances follow
    the residuals and the effects (their mean square and 1 / diagonal as sampling variance).
    """
    got = _swept(rows, y, terms, sigma2, tol) if outer == 1 and not estimate else None
    if got is not None:
        return _centred(written(got[0], "joint-effects")), got[1]
    rows = written(rows.withColumn("_w", F.lit(1.0)).withColumn("_h", F.lit(1.0)), "joint-input")
    base, effects, info = rows.drop("_w", "_h"), None, {}
    for k in range(outer):
        d = design(rows, row_id, F.col(y), terms.blocks(sigma2, F.col("_h")), F.col("_w"))
        effects, info = solve(d, effects, tol)
        if k + 1 == outer and not estimate:
            break
        seen = written(fitted(d, effects).withColumn("off", F.col("y") - F.col("fit")), "joint-fitted")
        spread = seen.agg(F.sum(F.col("w") * F.col("off") ** 2).alias("s"), F.count("*").alias("n")).first()
        if estimate:
            counts = {r["block"]: (r["m"], r["s"], r["v"]) for r in differences(d, effects).groupBy("block").agg(F.count("*").alias("m"), F.avg(F.col("value") ** 2).alias("s"), F.avg(1 / F.col("diagonal")).alias("v")).collect()}
            free = max(1, spread["n"] - counts["ability"][0])
            sigma2 = spread["s"] / free
            terms.variances = {b: counts[b][1] + sigma2 * counts[b][2] if b in counts else v for b, v in terms.variances.items()}
            info |= {"sigma2": sigma2, "variances": dict(terms.variances)}
        if k + 1 < outer:
            rows = base.join(seen.select(F.col("id").alias(row_id), "off"), row_id, "left")
            scale = (spread["s"] / max(1, spread["n"])) ** 0.5
            w = F.lit(1.0) if robust is None else F.least(F.lit(1.0), F.lit(robust * scale) / F.greatest(F.abs("off"), F.lit(1e-12)))
            rows = rows.withColumn("_w", F.coalesce(w, F.lit(1.0))).drop("off")
            if tilt:
                own = effects.where("block = 'ability'").select(F.col("key").alias("_key"), F.col("value").alias("_a"))
                middle = own.agg(F.avg("_a")).first()[0]
                rating = F.greatest(F.lit(40.0), F.least(F.lit(200.0), F.lit(100.0) * F.exp(F.lit(middle) - F.col("_a"))))
                rows = rows.join(own, F.col(terms.ability).cast("string") == own["_key"], "left").withColumn("_h", F.coalesce(1 + F.lit(tilt) * (rating - 100) / 10, F.lit(1.0))).drop("_key", "_a")
            else:
                rows = rows.withColumn("_h", F.lit(1.0))
            rows = written(rows, "joint-input")
    return _centred(differences(d, effects)), info


def _centred(effects: DataFrame) -> DataFrame:
    means = effects.groupBy("block").agg(F.avg("value").alias("_m"))
    return effects.join(F.broadcast(means), "block").select("block", "key", "value", "diagonal", (F.col("value") - F.col("_m")).alias("centred"))  # one row a block


def _swept(rows: DataFrame, y: str, t: Terms, sigma2: float, tol: float) -> tuple[DataFrame, dict] | None:
    """The solve of abilities, sides, races within courses and a curve, all rows weighing the same (:mod:`.swept`); none where there are other
    blocks, rows without a person, race or course, or races in two courses."""
    if not t.race or t.person not in (None, t.ability) or t.group or t.endurance or t.opener or t.distance or t.altitude or t.front:
        return None
    ridge = {name: sigma2 / v for name, v in t.variances.items()}
    shape = hats(F.col(t.day), t.knots, F.col(t.amplitude) if t.amplitude else 1.0) if t.day else []
    laid = swept.Rows(rows, F.col(t.ability), F.col(t.cell), F.col(t.race), F.col(y), F.col(t.side) if t.side else F.lit(0.0), shape, ridge["race"], ridge["cell"])
    return swept.solve(laid, ridge["side"] if t.side else None, t.small, tol) if laid.sound else None
