"""Estimates: modes, samples, baselines, error statistics, calibrated cuts, ridge slopes, variance components, bracket engine, robust curves,
holdouts, provisional effects, monotone curves, features. Rows stay in Spark; systems of a few unknowns are solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import stats
from .joins import interval_bracket, nearest_by_day
from .store import written

#: Rows of a table (two numbers each) that are sent to all tasks.
SENT = 1_000_000


def modes(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value per group, the smallest of equals, by counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    top = counts.groupBy(*group).agg(F.max("_n").alias("n"))
    return counts.join(top, group).where("_n = n").groupBy(*group, "n").agg(F.min(value).alias("mode"))


def reservoir(df: DataFrame, group: list[str], key: str, n: int) -> DataFrame:
    """A uniform sample of ``n`` rows per group, by the smallest hashes of the key: the same rows in every run. Ranks stop at n in each task first."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    w = Window.partitionBy(*group).orderBy("_h", key)
    return df.withColumn("_h", h).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_h", "_k")


def baselines(df: DataFrame, group: list[str], day: str, value: str, today: int, half_life: float) -> DataFrame:
    """Per group: geometric mean, exponentially weighted mean of age ``today - day``, and mean of the two best (largest) values."""
    w = F.pow(F.lit(0.5), (F.lit(today) - F.col(day)) / half_life)
    best = Window.partitionBy(*group).orderBy(F.desc(value))
    two = df.withColumn("_k", F.row_number().over(best)).where("_k <= 2").groupBy(*group).agg(F.avg(value).alias("best2"))
    return df.groupBy(*group).agg(F.exp(F.avg(F.log(value))).alias("geometric"), F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("ewma")).join(two, group)


def benchmark_levels(df: DataFrame, season: str, value: str, q: float, reference: int) -> DataFrame:
    """Per season the ``q`` quantile, and its log ratio to the reference season's."""
    level = df.groupBy(season).agg(F.percentile(value, q).alias("level"))
    ref = level.where(F.col(season) == reference).select(F.col("level").alias("_ref"))
    return level.crossJoin(F.broadcast(ref)).select(season, "level", F.log(F.try_divide(F.col("level"), F.col("_ref"))).alias("log_ratio"))  # one row


def error_stats(df: DataFrame, group: list[str], error: str) -> DataFrame:
    """Bias, median absolute error, its 90th percentile, sd and number."""
    a = F.abs(F.col(error))
    return df.groupBy(*group).agg(F.avg(error).alias("bias"), F.percentile(a, 0.5).alias("median_abs"), F.percentile(a, 0.9).alias("p90"), F.stddev_samp(error).alias("sd"), F.count(error).alias("n"))


def concordance(df: DataFrame, race: str, actual: str, predicted: str) -> DataFrame:
    """Per race: the pairs of runners whose order the prediction gets right, and all pairs with an order.

    No pair is built. Predictions become ranks within their race. Two different ranks first differ at one bit, below the bits they share: so a row
    is counted once for each bit, among the rows of its race with the same higher bits, and meets there as running counts the rows of better
    results with a 0 and with a 1 at that bit. That is the rows times the bits of a rank.
    """
    # dense ranks: equal values are equal, and fit a range frame
    rank = lambda c: F.dense_rank().over(Window.partitionBy(race).orderBy(c)).cast("long")
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(F.col(race).alias("_race"), rank(actual).alias("_a"), rank(predicted).alias("_p"))
    cells = rows.groupBy("_race", "_a", "_p").agg(F.count("*").alias("_n")).checkpoint()
    bits = int(cells.agg(F.max("_p")).first()[0] or 0).bit_length()
    level = cells.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(max(0, bits - 1)))))
    level = level.withColumn("_high", F.expr("shiftright(_p, _bit + 1)")).withColumn("_one", F.expr("shiftright(_p, _bit) & 1"))
    better = Window.partitionBy("_race", "_bit", "_high").orderBy("_a").rangeBetween(Window.unboundedPreceding, -1)
    met = lambda one: F.coalesce(F.sum(F.when(F.col("_one") == one, F.col("_n"))).over(better), F.lit(0)) * F.col("_n")
    counted = level.withColumn("_r", F.when(F.col("_one") == 1, met(0)).otherwise(0)).withColumn("_w", F.when(F.col("_one") == 0, met(1)).otherwise(0))
    out = counted.groupBy(F.col("_race").alias(race)).agg(F.sum("_r").alias("right"), F.sum(F.col("_r") + F.col("_w")).alias("pairs"))
    return out.where("pairs > 0")


def choose_k(df: DataFrame, key: str, day: str, order: str, value: str, ks: list[int], least: int = 3) -> tuple[int, dict[int, float]]:
    """The number of neighbours whose median predicts best: smallest median absolute error, ties to the larger k; and all the errors."""
    errors = {}
    for k in ks:
        near = nearest_by_day(df, key, day, order, value, k)
        off = F.abs(F.col(value) - stats.let(F.array_sort("near"), lambda s: F.when(F.size(s) >= least, stats.median_of(s))))
        errors[k] = near.select(off.alias("_e")).agg(F.percentile("_e", 0.5)).first()[0]
    known = {k: e for k, e in errors.items() if e is not None}
    return min(known, key=lambda k: (round(known[k], 9), -k)), errors


def ridge_slopes(df: DataFrame, group: str, side: str, value: str, ridge: float) -> DataFrame:
    """Per group: the slope of value on a 0/1 side, both centred in the group, with ``ridge`` added to the side's sum of squares."""
    mean = df.groupBy(group).agg(F.avg(side).alias("_s"), F.avg(value).alias("_v"))
    c = df.join(mean, group).select(group, (F.col(side) - F.col("_s")).alias("s"), (F.col(value) - F.col("_v")).alias("v"))
    return c.groupBy(group).agg((F.sum(F.col("s") * F.col("v")) / (F.sum(F.col("s") * F.col("s")) + ridge)).alias("slope"), F.count("*").alias("n"))


def variance_components(df: DataFrame, person: str, cell: str, value: str, difficulty: DataFrame) -> tuple[float, float]:
    """(sigma2, tau2) of a two-way fit: residual variance SSR / (n - persons - (cells - 1)), and the variance of the difficulties beyond their own
    sampling variance sigma2 / diag, at least 0. ``difficulty``: (cell, difficulty, diag)."""
    difficulty = written(difficulty.select(cell, "difficulty", "diag"), "difficulties")
    own = df.select(person, cell, value).join(difficulty.select(cell, "difficulty"), cell).where(F.col(person).isNotNull()).select(person, (F.col(value) - F.col("difficulty")).alias("_y"))
    each = own.groupBy(person).agg((F.var_pop("_y") * F.count("_y")).alias("ss"), F.count("*").alias("n"))  # squares about the person's mean
    r = each.agg(F.sum("ss").alias("ssr"), F.sum("n").alias("n"), F.count("*").alias("p")).first()
    cells = difficulty.where("diag > 0").agg(F.count("*").alias("c"), F.var_samp("difficulty").alias("v"), F.avg(1 / F.col("diag")).alias("u")).first()
    free = r["n"] - r["p"] - (cells["c"] - 1)
    sigma2 = r["ssr"] / free if free > 0 else 0.0
    return sigma2, max(0.0, (cells["v"] or 0.0) - sigma2 * (cells["u"] or 0.0))


def bracket_fit(df: DataFrame, group: list[str], cell: str, day: str, value: str, days: int, rounds: int, damping: float, prior: float) -> DataFrame:
    """(cell, difficulty, n): iterated window comparison. A cell's effect is the mean, shrunk by n / (n + prior), of its rows' differences to the
    group's rows of other cells within ``days``, those corrected by their own cells' effects of the round before; ``damping`` is the step."""
    rows = df.select(*group, cell, day, value).checkpoint()
    effect = rows.select(cell).distinct().withColumn("difficulty", F.lit(0.0))
    for _ in range(rounds):
        own = rows.join(effect, cell).withColumn("_clean", F.col(value) - F.col("difficulty"))
        b = interval_bracket(own, group, cell, day, "_clean", days).where("n_other > 0")
        step = b.groupBy(cell).agg(F.sum("bracket").alias("_s"), F.count("*").alias("_n")).select(cell, (F.col("_s") / (F.col("_n") + prior)).alias("_d"), "_n")
        moved = effect.join(step, cell, "left").select(cell, (F.col("difficulty") + damping * F.coalesce("_d", F.lit(0.0))).alias("difficulty"), F.coalesce("_n", F.lit(0)).alias("n"))
        effect = moved.select(cell, "difficulty").checkpoint()
        last = moved.select(cell, "n")
    return effect.join(last, cell)


def tukey_weights(r: np.ndarray, scale: float, c: float) -> np.ndarray:
    u = np.clip(np.abs(r) / (c * max(scale, 1e-12)), 0, 1)
    return (1 - u**2) ** 2


def robust_shape(edges: DataFrame, a: str, b: str, degree: int, c: float = 4.685, rounds: int = 500) -> list[float]:
    """Coefficients g_1 .. g_degree of a polynomial potential in log distance fitted to edges (log ratio of b over a, with se) by Tukey reweighting.

    The edges are medians per transition, few; they are brought to the driver. Raises where the weights don't settle.
    """
    rows = edges.select(a, b, "edge", "se").collect()
    x = np.array([[np.log(r[1]) ** k - np.log(r[0]) ** k for k in range(1, degree + 1)] for r in rows])
    y, w0 = np.array([r[2] for r in rows]), np.array([1 / r[3] for r in rows])
    w, floor = np.ones(len(y)), 1e-9 * float(np.abs(y * w0).max(initial=0.0))  # below that residuals are rounding
    for _ in range(rounds):
        g = np.linalg.lstsq(x * (w0 * np.sqrt(w))[:, None], y * w0 * np.sqrt(w), rcond=None)[0]
        r = (y - x @ g) * w0
        new = tukey_weights(r, max(1.4826 * float(np.median(np.abs(r - np.median(r)))), floor), c)
        if np.abs(new - w).max() < 1e-9:
            return g.tolist()
        w = new
    raise RuntimeError(f"the robust weights did not settle in {rounds} rounds")


def spline_basis(column: str, knots: list[float]) -> list:
    """Natural cubic spline basis as Columns: the column itself and one term per inner knot, linear beyond the ends."""
    x, last, before = F.col(column), knots[-1], knots[-2]
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), 3)
    tail = lambda k: (cube(k) - cube(last)) / (last - k)
    return [x, *[tail(k) - tail(before) for k in knots[:-2]]]


def era_curve(steps: DataFrame, a: str, b: str, step: str, weight: str, smooth: float, reference: int) -> dict[int, float]:
    """Season levels from steps between seasons (level of b less that of a): weighted least squares with a penalty on second differences, the
    reference at 0. There is one unknown per season."""
    rows = steps.select(a, b, step, weight).collect()
    seasons = sorted({r[0] for r in rows} | {r[1] for r in rows} | {reference})
    at = {s: i for i, s in enumerate(seasons)}
    lines, y = [], []
    for r in rows:
        line = np.zeros(len(seasons))
        line[at[r[1]]], line[at[r[0]]] = np.sqrt(r[3]), -np.sqrt(r[3])
        lines.append(line)
        y.append(r[2] * np.sqrt(r[3]))
    for i in range(1, len(seasons) - 1):
        line = np.zeros(len(seasons))
        line[i - 1], line[i], line[i + 1] = np.sqrt(smooth), -2 * np.sqrt(smooth), np.sqrt(smooth)
        lines.append(line)
        y.append(0.0)
    line = np.zeros(len(seasons))
    line[at[reference]] = 1e6
    g = np.linalg.lstsq(np.array([*lines, line]), np.array([*y, 0.0]), rcond=None)[0]
    return {s: float(g[at[s]] - g[at[reference]]) for s in seasons}


def holdout(df: DataFrame, kind: str, share: float, seed: int, day: str | None = None, since=None) -> DataFrame:
    """``held``: by hash of a key column (a row's, race's or person's id), or forward in time from ``since``."""
    if day is not None:
        return df.withColumn("held", F.col(day) >= since)
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(kind).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("held", u < share)


def race_bootstrap(df: DataFrame, race: str, value: str, repeats: int, seed: int) -> DataFrame:
    """(repeat, mean): means over races drawn with replacement, each race counted as often as a Poisson(1) number from its hash says."""
    per = df.groupBy(race).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    many = per.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "repeat", F.col(race).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    cut, total, p = [], 0.0, float(np.exp(-1))
    for k in range(8):
        total += p
        cut.append((k, total))
        p /= k + 1
    times = F.coalesce(*[F.when(u < c, k) for k, c in cut], F.lit(8))
    return many.withColumn("_t", times).groupBy("repeat").agg(F.try_divide(F.sum(F.col("_t") * F.col("_s")), F.sum(F.col("_t") * F.col("_n"))).alias("mean"))


def provisional_effects(rows: DataFrame, race: str, gap: str, prior: float) -> DataFrame:
    """Each race day's effect: the median gap of its runners, shrunk by n / (n + prior)."""
    return rows.groupBy(race).agg((F.percentile(gap, 0.5) * (F.count("*") / (F.count("*") + prior))).alias("effect"), F.count("*").alias("n"))


def two_fold(rows: DataFrame, race: str, gap: str, key: str, prior: float) -> DataFrame:
    """(slope, n): how one half of a race's runners, by hash of the key, predicts the other half's median: the regression over races of the one on the
    other's shrunk effect."""
    fold = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 1), 16, 10).cast("int") % 2
    halves = [provisional_effects(rows.where(fold == i), race, gap, prior if i == 0 else 0.0).withColumnRenamed("effect", f"e{i}").drop("n") for i in (0, 1)]
    return halves[0].join(halves[1], race).agg(F.regr_slope("e1", "e0").alias("slope"), F.count("*").alias("n"))


def monotone(curve: DataFrame, x: str, y: str, n: str) -> DataFrame:
    """The non-decreasing least-squares curve through (x, y) with weights n, by its min-max form over intervals: max over starts of min over ends
    of the weighted mean. The curve is an aggregate of bounded length (days of a season)."""
    c = curve.select(F.col(x).alias("_x"), (F.col(y) * F.col(n)).alias("_s"), F.col(n).alias("_n"))
    run = Window.orderBy("_x")  # one row per day of a season
    cum = c.withColumn("_cs", F.sum("_s").over(run)).withColumn("_cn", F.sum("_n").over(run)).checkpoint()
    a = cum.select(F.col("_x").alias("a"), (F.col("_cs") - F.col("_s")).alias("s0"), (F.col("_cn") - F.col("_n")).alias("n0"))
    b = cum.select(F.col("_x").alias("b"), F.col("_cs").alias("s1"), F.col("_cn").alias("n1"))
    means = a.join(b, F.col("a") <= F.col("b")).withColumn("m", (F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0")))
    # value at x: max over a <= x of min over b >= x of the mean from a to b
    low = means.withColumn("_low", F.min("m").over(Window.partitionBy("a").orderBy(F.desc("b"))))
    at = low.select("a", F.col("b").alias("_x"), "_low")
    return at.groupBy("_x").agg(F.max("_low").alias("fitted")).select(F.col("_x").alias(x), "fitted")


def history_features(rows: DataFrame, person: str, day: str, order: str, value: str, length: int) -> DataFrame:
    """Each row with its person's last ``length`` earlier (days ago, value) pairs, their number and trend, for a sequence model."""
    w = Window.partitionBy(person).orderBy(day, order)
    past = F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).alias("v"))).over(w.rowsBetween(-length, -1))  # at most ``length``
    got = rows.withColumn("_past", past)
    return got.withColumn("seq", F.transform("_past", lambda s: F.struct((F.col(day) - s["d"]).alias("ago"), s["v"].alias("v")))).withColumn("n_past", F.size("_past")).withColumn(
        "change", F.when(F.size("_past") >= 2, F.element_at("_past", -1)["v"] - F.element_at("_past", 1)["v"])
    ).drop("_past")


def blend_weights(df: DataFrame, predictions: list[str], target: str) -> list[float]:
    """Least-squares weights of several predictions: their Gram matrix is one aggregate."""
    pairs = [(a, b) for a in predictions for b in [*predictions, target]]
    got = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).first()
    gram = np.array([[got[f"{a}|{b}"] for b in predictions] for a in predictions])
    return np.linalg.lstsq(gram, np.array([got[f"{a}|{target}"] for a in predictions]), rcond=None)[0].tolist()


def over_record(rows: DataFrame, race: str, distance: str, value: str, records: list[tuple[float, float]], floor: float, exempt: str) -> DataFrame:
    """(id, reason): 'race' for all rows of a race in which someone not exempt beats the open record at the distance (times: below the curve),
    'row' for single rows below ``floor`` times the record's multiple. ``records``: (distance, time) knots, a power law between them."""
    from ..functions import curves

    limit = curves.power_map(F.col(distance), records)
    marked = rows.withColumn("_beats", (F.col(value) < limit) & ~F.col(exempt)).withColumn("_low", (F.col(value) < limit * floor) & ~F.col(exempt))
    bad = marked.where("_beats").select(race).distinct()
    whole = marked.join(bad, race, "left_semi").select("id", F.lit("race").alias("reason"))
    return whole.unionByName(marked.join(bad, race, "left_anti").where("_low").select("id", F.lit("row").alias("reason")))


def rust(rows: DataFrame, person: str, season: str, day: str, order: str, value: str, pool: str, prior: float, least: int = 2) -> DataFrame:
    """(pool, rust, n): how much a season's first result is off the same season's other results, as the median over persons' seasons with ``least``
    others, shrunk by n / (n + prior). Other results are averaged, so that a long season counts once."""
    opener = F.min(F.struct(day, order)).over(Window.partitionBy(person, season))
    own = rows.where(F.col(value).isNotNull()).withColumn("_first", F.struct(day, order) == opener)
    one = own.groupBy(pool, person, season).agg(F.max(F.when(F.col("_first"), F.col(value))).alias("_o"), F.avg(F.when(~F.col("_first"), F.col(value))).alias("_r"), F.count_if(~F.col("_first")).alias("_n")).where(F.col("_n") >= least)
    n = F.count("*")
    return one.groupBy(pool).agg((F.percentile(F.col("_o") - F.col("_r"), 0.5) * n / (n + prior)).alias("rust"), n.alias("n"))


def paired_bootstrap(df: DataFrame, race: str, first: str, second: str, repeats: int, seed: int) -> DataFrame:
    """(difference, low, high, worse): the mean of ``first`` less ``second`` (two models' errors on the same rows), the central 95 percent of it over
    races drawn with replacement, both models meeting the same draws, and the share of draws in which ``first`` isn't smaller."""
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(race, (F.col(first) - F.col(second)).alias("_d"))
    drawn = race_bootstrap(rows, race, "_d", repeats, seed)
    spread = drawn.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.avg((F.col("mean") >= 0).cast("double")).alias("worse"))
    return rows.agg(F.avg("_d").alias("difference")).crossJoin(F.broadcast(spread))  # one row each


def whole_value_holdout(df: DataFrame, kind: str, held: list, among: str) -> DataFrame:
    """``held``: rows whose ``kind`` (a sport, a distance) is in the list, of those in ``among`` (persons) who also have rows of another kind, so that
    what is held can be predicted at all; the other rows of the list are neither, null."""
    out = F.col(kind).isin(held)
    other = df.where(~out).select(F.col(among).alias("_who")).distinct().withColumn("_known", F.lit(True))
    both = df.join(other, df[among] == other["_who"], "left")
    return both.withColumn("held", F.when(~out, False).when(F.coalesce("_known", F.lit(False)), True)).drop("_who", "_known")


def race_context(rows: DataFrame, race: str, team: str, order: str, base: str, extra: str) -> DataFrame:
    """Each runner with its field: field_n, rank_pct (0 for the best, least ``base``), gap_to_median, gap_ahead, gap_behind (null at the ends), team_n (its
    mates) and team_mean (their mean of ``extra``). Runners are ordered over range partitions, so a race may be most rows; mates come from sums of
    the team less the runner's own."""
    from .ranks import Ordered

    laid = Ordered(rows.where(F.col(race).isNotNull()), [race], [base, order])
    known = F.when(F.col(base).isNotNull(), 1)
    near = laid.around(laid.running(laid.rows, {"_k": F.lit(1), "_at": known}), F.col(base), 1)
    near = laid.whole(near, {"field_n": (F.sum, F.lit(1)), "_known": (F.sum, known)})
    middle = F.when(F.col(base).isNotNull() & (F.abs(2 * F.col("_at") - F.col("_known") - 1) <= 1), F.col(base))  # one or two of the known ones
    near = laid.whole(near, {"_low": (F.min, middle), "_high": (F.max, middle)}).withColumn("_median", 0.5 * F.col("_low") + 0.5 * F.col("_high"))
    both = laid.whole(near, {"_n": (F.sum, F.lit(1)), "_s": (F.sum, F.col(extra)), "_c": (F.sum, F.when(F.col(extra).isNotNull(), 1).otherwise(0))}, team)
    alone = F.col(team).isNull()
    own = F.when(F.col(extra).isNull(), 0).otherwise(1)
    return both.select(
        *rows.columns, "field_n", ((F.col("_k") - 1) / F.greatest(F.col("field_n") - 1, F.lit(1))).alias("rank_pct"), (F.col(base) - F.col("_median")).alias("gap_to_median"),
        (F.col(base) - F.get("_before", F.lit(0))).alias("gap_ahead"), (F.get("_after", F.lit(0)) - F.col(base)).alias("gap_behind"), F.when(alone, 0).otherwise(F.col("_n") - 1).alias("team_n"),
        F.when(~alone, F.try_divide(F.col("_s") - F.coalesce(extra, F.lit(0.0)), F.col("_c") - own)).alias("team_mean"),
    )


def fitted_prior(cells: DataFrame, effect: str, n: str, within: float, least: float = 1.0, most: float = 1e6) -> float:
    """The number of rows that a cell's shrinkage n / (n + prior) should stand against, from the effects themselves: the rows' variance ``within`` over
    the variance of the true effects, which is that of the effects beyond their own sampling variance within / n; ``most`` where nothing is left."""
    got = cells.where(F.col(n) > 0).agg(F.var_samp(effect).alias("v"), F.avg(1 / F.col(n)).alias("u")).first()
    own = (got["v"] or 0.0) - within * (got["u"] or 0.0)
    return most if own <= 0 else min(most, max(least, within / own))


def field_adjusted(rows: DataFrame, race: str, cell: str, value: str, strength: str) -> DataFrame:
    """(race, cell, effect, adjusted): each race's mean value, and that less what its field's strength explains: the slope of races' means on their
    fields' mean strength within cells, so that a course that only strong fields visit isn't made easier by them. Races are written once and are not
    moved again where the cells' means are few enough to be sent."""
    per = written(rows.groupBy(race, cell).agg(F.avg(value).alias("effect"), F.avg(strength).alias("_x")), "fields")
    mean = written(per.groupBy(F.col(cell).alias("_cell")).agg(F.avg("effect").alias("_e"), F.avg("_x").alias("_m")), "field-means")
    both = per.join(F.broadcast(mean) if mean.count() <= SENT else mean, per[cell] == mean["_cell"])
    dx, dy = F.col("_x") - F.col("_m"), F.col("effect") - F.col("_e")
    slope = both.agg(F.coalesce(F.try_divide(F.sum(dx * dy), F.sum(dx * dx)), F.lit(0.0)).alias("_slope"), F.avg("_x").alias("_all"))
    return both.crossJoin(F.broadcast(slope)).select(race, cell, "effect", (F.col("effect") - F.col("_slope") * (F.col("_x") - F.col("_all"))).alias("adjusted"))  # one row
