"""Length distributions: complementary cumulative numbers, power laws and other fits, and fits over several networks.

Power law after Clauset, Shalizi and Newman (2009): for the n lengths of at least xmin, alpha = 1 + n / sum(ln(x / xmin)),
sigma = (alpha - 1) / sqrt(n), D the greatest gap between the empirical and the fitted distribution; the automatic xmin
has the least D. Sums over all lesser or greater lengths go by buckets of lengths first, so that one large network is
many tasks. D's of candidates are bounded by blocks of lengths; only those that may be the least are worked out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftspark.functions.lineage import cut

TINY = 1e-18


def usable(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("length") > TINY)


#: Buckets of lengths for each doubling.
FINE = 64


def running(sizes: DataFrame, by: Sequence[str], sums: dict[str, Column], falling: bool = False) -> DataFrame:
    """sizes (by, length, ...) with the sums over all lengths of the group up to the row's own (falling: from it upwards), and
    over the whole group as <name>_all.

    Windows run over the lengths of a bucket and over the buckets of a group, never over all lengths of a group.
    """
    keyed = sizes.withColumn("__b", F.floor(F.log2("length") * FINE))
    order = lambda c: F.col(c).desc() if falling else F.col(c).asc()
    totals = keyed.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(order("__b")).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, "__b"])]
    earlier = [F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in sums]
    totals = totals.select(*keys, *earlier, *[F.sum(f"__t_{n}").over(Window.partitionBy(*by)).alias(f"{n}_all") for n in sums])
    own = Window.partitionBy(*by, "__b").orderBy(order("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = keyed.select("*", *[F.sum(c).over(own).alias(f"__o_{n}") for n, c in sums.items()])
    on = F.lit(True)
    for i, c in enumerate([*by, "__b"]):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(totals, on)
    return out.select(*[F.col(c) for c in sizes.columns], *[(F.col(f"__o_{n}") + F.col(f"__t_{n}")).alias(n) for n in sums], *[F.col(f"{n}_all") for n in sums])


def ccm(lines: DataFrame, by: Sequence[str] = ("network",), areas: DataFrame | None = None) -> DataFrame:
    """(by, length, ccm): the share of lengths at least as great, divided by the area where areas (by, area) are given.

    Equal lengths give one row. The counts come from a group-by; windows run over the distinct lengths of a bucket.
    """
    up = running(sizes_of(lines, by), by, {"__up": F.col("size")}, falling=True)
    out = up.select(*by, "length", (F.col("__up") / F.col("__up_all")).alias("ccm"))
    if areas is not None:
        out = out.join(areas.select(*by, "area"), list(by)).withColumn("ccm", F.col("ccm") / F.col("area")).drop("area")
    return out


def cut_off(distribution: DataFrame, least: float | str) -> DataFrame:
    """Rows above a cut-off, a number or a column."""
    return distribution.where(F.col("length") > (F.col(least) if isinstance(least, str) else F.lit(least)))


def loglog_fit(distribution: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, slope, intercept, score, n): the straight line of ln ccm over ln length; the score is the distance of R² from 1."""
    x, y = F.log("length"), F.log("ccm")
    out = distribution.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.abs(1 - F.regr_r2(y, x)).alias("score"), F.count("*").alias("n"))
    return out


def fitted(distribution: DataFrame, slope: float, intercept: float) -> DataFrame:
    return distribution.withColumn("fitted", F.exp(F.lit(slope) * F.log("length") + F.lit(intercept)))


def cut_off_share(lines: DataFrame, cut_offs: DataFrame, by: Sequence[str] = ("network",)) -> DataFrame:
    """(by, share): how many lengths are below the cut-off of (by, xmin)."""
    return lines.join(cut_offs, list(by)).groupBy(*by).agg(F.avg((F.col("length") < F.col("xmin")).cast("int")).alias("share"))


def critical_distance(n):
    """The Kolmogorov-Smirnov critical value at 5 %; NaN for 50 lengths or fewer."""
    return F.when(n > 50, 1.36 / F.sqrt(n)).otherwise(float("nan"))


def sizes_of(lines: DataFrame, by: Sequence[str] = ("network",)) -> DataFrame:
    """(by, length, size): how often each length occurs."""
    return usable(lines).groupBy(*by, "length").agg(F.count("*").alias("size"))


def tails(sizes: DataFrame, by: Sequence[str] = ("network",)) -> DataFrame:
    """(by, xmin, n, logs, alpha) of sizes: for each distinct length as xmin, how many are at least as great and their alpha."""
    up = running(sizes, by, {"n": F.col("size"), "__logs": F.col("size") * F.log("length")}, falling=True)
    out = up.select(*by, F.col("length").alias("xmin"), "n", (F.col("__logs") - F.col("n") * F.log("length")).alias("logs"))
    return out.where("logs > 0").withColumn("alpha", 1 + F.col("n") / F.col("logs"))


def _empirical(below: Column) -> Column:
    return (below - F.col("__first")) / F.col("n")


def _powerlaw(length: Column) -> Column:
    return 1 - F.pow(length / F.col("xmin"), 1 - F.col("alpha"))


#: What rounding may add to a bound of D.
SLACK = 1e-9


def least_distances(sizes: DataFrame, candidates: DataFrame, by: Sequence[str] = ("network",), blocks: int = 256) -> DataFrame:
    """Those candidates (by, xmin, n, alpha), each xmin a length, whose power law may be nearest to the lengths of sizes, with d, the
    greatest gap between both; the nearest of all is among them.

    The lengths of a group are cut into blocks of as many distinct lengths. Between the ends of a block both distributions
    only rise, so that the values at the ends bound the gap inside from below and above. Candidates whose lower bound lies
    above the least upper bound can't be nearest; the others meet only the blocks that may hold their greatest gap. That is
    n x blocks rows for n candidates, and lengths of a few blocks for the few that are left.
    """
    by = list(by)
    ranked = running(sizes, by, {"__to": F.col("size"), "__rank": F.lit(1).cast("long")})
    place = F.floor((F.col("__rank") - 1) * F.lit(blocks) / F.col("__rank_all"))
    ranked = cut(ranked.select(*by, "length", (F.col("__to") - F.col("size")).alias("below"), place.alias("__block")))
    ends = ranked.groupBy(*by, "__block").agg(F.min("length").alias("__lo"), F.max("length").alias("__hi"), F.min("below").alias("__blo"), F.max("below").alias("__bhi"))
    first = ranked.select(*by, F.col("length").alias("xmin"), F.col("below").alias("__first"), F.col("__block").alias("__from"))
    tried = candidates.join(first, [*by, "xmin"])

    def met(rows: DataFrame) -> DataFrame:
        lo, blo = F.greatest("__lo", "xmin"), F.greatest("__blo", "__first")
        least = F.greatest(F.abs(_empirical(blo) - _powerlaw(lo)), F.abs(_empirical(F.col("__bhi")) - _powerlaw(F.col("__hi"))))
        most = F.greatest(_empirical(F.col("__bhi")) - _powerlaw(lo), _powerlaw(F.col("__hi")) - _empirical(blo))
        return rows.join(ends, by).where(F.col("__block") >= F.col("__from")).withColumns({"__least": least, "__most": most})

    own = [*by, "xmin", "n", "alpha", "__first", "__from"]
    bounded = cut(met(tried).groupBy(*own).agg(F.max("__least").alias("__d"), F.max("__most").alias("__u")))
    bounded = bounded.join(bounded.groupBy(*by).agg(F.min("__u").alias("__best")), by)
    left = met(bounded.where(F.col("__d") <= F.col("__best") + SLACK)).where(F.col("__most") >= F.col("__d") - SLACK)
    total = left.join(ranked, [*by, "__block"]).where(F.col("length") >= F.col("xmin"))
    gap = F.abs(_empirical(F.col("below")) - _powerlaw(F.col("length")))
    return total.groupBy(*by, "xmin", "n", "alpha").agg(F.max(gap).alias("d"))


def powerlaw_fit(lines: DataFrame, by: Sequence[str] = ("network",), xmin: float | None = None, candidates: int | None = None) -> DataFrame:
    """(by, xmin, n, alpha, sigma, exponent, d, critical): the fit above a given xmin, or above the one of least d.

    candidates: where given, only about so many quantiles of the distinct lengths of a group are tried as xmin, which is
    cheaper and coarser.
    """
    if xmin is not None:
        above = usable(lines).where(F.col("length") >= xmin)
        found = above.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.log(F.col("length") / xmin)).alias("logs")).where("logs > 0")
        found = found.select(*by, F.lit(xmin).cast("double").alias("xmin"), "n", (1 + F.col("n") / F.col("logs")).alias("alpha"))
        tried = _gap_at(above, found, by)
    else:
        sizes = cut(sizes_of(lines, by))
        tail = tails(sizes, by)
        if candidates:
            place = F.ntile(candidates).over(Window.partitionBy(*by).orderBy("xmin"))
            tail = tail.withColumn("__q", place).withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__q").orderBy("xmin"))).where("__r = 1").drop("__q", "__r")
        tried = least_distances(sizes, tail.select(*by, "xmin", "n", "alpha"), by)
    best = tried.groupBy(*by).agg(F.min_by(F.struct("xmin", "n", "alpha", "d"), F.struct("d", "xmin")).alias("f")).select(*by, "f.*")
    alpha = F.col("alpha")
    return best.select(*by, "xmin", "n", "alpha", ((alpha - 1) / F.sqrt("n")).alias("sigma"), (1 - alpha).alias("exponent"), "d", critical_distance(F.col("n")).alias("critical"))


def _gap_at(above: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """d of a fit whose xmin needn't be a length."""
    below = running(sizes_of(above, by), by, {"__to": F.col("size")})
    both = below.select(*by, "length", (F.col("__to") - F.col("size")).alias("below")).join(found, list(by))
    gap = F.abs(F.col("below") / F.col("n") - (1 - F.pow(F.col("length") / F.col("xmin"), 1 - F.col("alpha"))))
    return both.groupBy(*by, "xmin", "n", "alpha").agg(F.max(gap).alias("d"))


def exponential_fit(lines: DataFrame, by: Sequence[str] = ("network",), xmin: float = 0.0) -> DataFrame:
    """(by, n, rate, loglikelihood) of lengths of at least xmin."""
    out = usable(lines).where(F.col("length") >= xmin).groupBy(*by).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    rate = 1 / (F.col("mean") - xmin)
    return out.select(*by, "n", rate.alias("rate"), (F.col("n") * (F.log(rate) - 1)).alias("loglikelihood"))


# Other distributions and comparisons, in numpy: they need erfc and an optimiser


def _log_erfc(z: float) -> float:
    """ln erfc(z), by its asymptotic series where erfc underflows."""
    if z < 25:
        return math.log(math.erfc(z))
    return -z * z - math.log(z * math.sqrt(math.pi)) + math.log1p(-1 / (2 * z * z) + 3 / (4 * z**4))


def _nelder_mead(f: Callable[[np.ndarray], float], start: Sequence[float], rounds: int = 400) -> np.ndarray:
    """A minimum of a function of a few numbers, by the downhill simplex."""
    n = len(start)
    pts = [np.array(start, float)]
    for i in range(n):
        p = pts[0].copy()
        p[i] += 0.25 * abs(p[i]) + 0.05
        pts.append(p)
    vals = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < 1e-12 * (abs(vals[0]) + 1e-12):
            break
        mid = np.mean(pts[:-1], axis=0)
        new = mid + (mid - pts[-1])
        v = f(new)
        if v < vals[0]:
            far = mid + 2 * (mid - pts[-1])
            w = f(far)
            pts[-1], vals[-1] = (far, w) if w < v else (new, v)
        elif v < vals[-2]:
            pts[-1], vals[-1] = new, v
        else:
            near = mid + 0.5 * (pts[-1] - mid)
            w = f(near)
            if w < vals[-1]:
                pts[-1], vals[-1] = near, w
            else:
                pts = [pts[0] + 0.5 * (p - pts[0]) for p in pts]
                vals = [f(p) for p in pts]
    return pts[int(np.argmin(vals))]


# Each fit gives its parameters, the log likelihood of each length and the fitted share of lengths below it


def _power(x: np.ndarray, xmin: float) -> tuple[dict, np.ndarray, np.ndarray]:
    alpha = 1 + len(x) / np.log(x / xmin).sum()
    return {"alpha": alpha}, np.log((alpha - 1) / xmin) - alpha * np.log(x / xmin), 1 - (x / xmin) ** (1 - alpha)


def _exponential(x: np.ndarray, xmin: float) -> tuple[dict, np.ndarray, np.ndarray]:
    rate = 1 / (x.mean() - xmin)
    return {"lambda": rate}, np.log(rate) - rate * (x - xmin), -np.expm1(-rate * (x - xmin))


def _lognormal(x: np.ndarray, xmin: float) -> tuple[dict, np.ndarray, np.ndarray]:
    logs = np.log(x)

    def each(p: np.ndarray) -> np.ndarray:
        mu, sigma = p[0], abs(p[1]) + 1e-9
        tail = _log_erfc((math.log(xmin) - mu) / (math.sqrt(2) * sigma))
        return -logs - math.log(sigma) - 0.5 * math.log(2 * math.pi) - (logs - mu) ** 2 / (2 * sigma**2) - (tail - math.log(2))

    p = _nelder_mead(lambda p: -each(p).sum(), [logs.mean(), logs.std() + 1e-6])
    mu, sigma = float(p[0]), float(abs(p[1]) + 1e-9)
    above = [_log_erfc((v - mu) / (math.sqrt(2) * sigma)) for v in (math.log(xmin), *logs.tolist())]
    return {"mu": mu, "sigma": sigma}, each(p), -np.expm1(np.array(above[1:]) - above[0])


def _truncated(x: np.ndarray, xmin: float) -> tuple[dict, np.ndarray, np.ndarray]:
    """x^-alpha exp(-rate x), normalised by quadrature over ln x."""
    steps = np.linspace(0, 30, 3001)
    grid = xmin * np.exp(steps * math.log(x.max() / xmin + 1) / 3)

    def each(p: np.ndarray) -> np.ndarray:
        alpha, rate = abs(p[0]), abs(p[1]) + 1e-12
        w = -alpha * np.log(grid / xmin) - rate * (grid - xmin) + np.log(grid)
        top = w.max()
        norm = top + math.log(np.trapezoid(np.exp(w - top), np.log(grid)))
        return -alpha * np.log(x / xmin) - rate * (x - xmin) - norm

    first = _power(x, xmin)[0]["alpha"]
    p = _nelder_mead(lambda p: -each(p).sum(), [first, 1 / x.mean()])
    alpha, rate = float(abs(p[0])), float(abs(p[1]) + 1e-12)
    w = -alpha * np.log(grid / xmin) - rate * (grid - xmin) + np.log(grid)
    w, at = np.exp(w - w.max()), np.log(grid)
    below = np.concatenate([[0.0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(at))])
    return {"alpha": alpha, "lambda": rate}, each(p), np.interp(np.log(x), at, below / below[-1])


DISTRIBUTIONS = {"power_law": _power, "lognormal": _lognormal, "exponential": _exponential, "truncated_power_law": _truncated}
COMPARED = (("power_law", "lognormal"), ("power_law", "exponential"), ("lognormal", "exponential"), ("power_law", "truncated_power_law"))


#: Pairs of which the first is a special case of the second.
NESTED = {("power_law", "truncated_power_law")}


def gap(x: np.ndarray, below: np.ndarray) -> float:
    """The greatest distance of a fitted distribution from the share of sorted lengths below each of them."""
    return float(np.abs(below - np.searchsorted(x, x) / len(x)).max())


def compare(first: np.ndarray, second: np.ndarray, nested: bool = False) -> tuple[float, float]:
    """Normalised log likelihood ratio R and its two-sided p (Vuong); of nested pairs, the p of twice the ratio as chi-square
    with one degree of freedom (Wilks)."""
    d = first - second
    spread = math.sqrt(((d - d.mean()) ** 2).mean())
    if not spread:
        return 0.0, 1.0
    r = d.sum() / (spread * math.sqrt(len(d)))
    return r, math.erfc(math.sqrt(abs(d.sum()))) if nested else math.erfc(abs(r) / math.sqrt(2))


def describe(x: np.ndarray, xmin: float) -> dict[str, float]:
    """All fits above xmin and their comparisons, as one flat row."""
    x = np.sort(x[x >= xmin])
    nan = float("nan")
    out: dict[str, float] = {}
    each: dict[str, np.ndarray] = {}
    for name, fit in DISTRIBUTIONS.items():
        keys = {"power_law": ["alpha"], "lognormal": ["mu", "sigma"], "exponential": ["lambda"], "truncated_power_law": ["alpha", "lambda"]}[name]
        try:
            if len(x) < 3 or x[-1] <= xmin:
                raise ValueError("too few lengths")
            values, each[name], below = fit(x, xmin)
            d = gap(x, below)
        except (ValueError, FloatingPointError, OverflowError):
            values, d = dict.fromkeys(keys, nan), nan
        out |= {f"{name}_{k}": float(values[k]) for k in keys}
        out[f"{name}_loglikelihood"] = float(each[name].sum()) if name in each else nan
        out[f"{name}_d"] = d
    out["truncated_power_law_exponent"] = 1 - out["truncated_power_law_alpha"]
    for a, b in COMPARED:
        r, p = compare(each[a], each[b], (a, b) in NESTED) if a in each and b in each else (nan, nan)
        out |= {f"{a}_vs_{b}_r": r, f"{a}_vs_{b}_p": p}
    return out


def describe_fits(lines: DataFrame, fits: DataFrame, by: str = "network") -> DataFrame:
    """One row for each group with the power law of ``fits`` and all others above the same xmin, compared.

    The optimiser needs the lengths above xmin of a group together: 8 bytes each, in the task of that group alone.
    """
    names = list(describe(np.array([1.0, 2.0, 3.0]), 1.0))
    above = usable(lines).join(fits.select(by, "xmin"), by).where(F.col("length") >= F.col("xmin")).select(by, "xmin", "length")
    kind = lines.schema[by].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{by: group[by].iloc[0]} | describe(group["length"].to_numpy(), float(group["xmin"].iloc[0]))])

    fitted_all = above.groupBy(by).applyInPandas(one, f"`{by}` {kind}, " + ", ".join(f"{n} double" for n in names))
    return fits.join(fitted_all, by, "left").join(cut_off_share(lines, fits.select(by, "xmin"), [by]), by, "left")


# Several networks at once


def multi_scale_fit(lines: DataFrame, areas: DataFrame, cut_offs: DataFrame | None = None, by: Sequence[str] = ("network",)) -> DataFrame:
    """One straight line through the area-normalised distributions of all networks, each above its cut-off (by, xmin)."""
    distribution = ccm(lines, by, areas)
    if cut_offs is not None:
        distribution = distribution.join(cut_offs.select(*by, "xmin"), list(by)).where(F.col("length") >= F.col("xmin"))
    return loglog_fit(distribution)


def optimised_cut_offs(lines: DataFrame, areas: DataFrame, quantiles: Iterable[float] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), by: Sequence[str] = ("network",)) -> DataFrame:
    """(q, slope, intercept, score, n): the joint fit for each quantile of each network's own lengths as its cut-off, best first.

    The search is exhaustive over a grid of common quantiles, so that it takes one pass: each length meets the grid's
    cut-offs of its own network, and the sums of the fit are formed by quantile.
    """
    qs = list(quantiles)
    distribution = ccm(lines, by, areas)
    cuts = distribution.groupBy(*by).agg(F.percentile("length", F.array(*map(F.lit, qs))).alias("cuts"))
    rows = distribution.join(cuts, list(by)).select("length", "ccm", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), "cuts")).alias("c"))
    return loglog_fit(rows.where(F.col("length") >= F.col("c.cuts")).select(F.col("c.q").alias("q"), "length", "ccm"), ["q"]).where("n >= 2").orderBy("score", "q")


#: Networks whose cut-offs are searched together: nine rows of sums for each reach the driver.
MOST_NETWORKS = 100_000


def own_cut_offs(lines: DataFrame, areas: DataFrame, quantiles: Iterable[float] = tuple(q / 20 for q in range(19)), by: Sequence[str] = ("network",), least: int = 2) -> DataFrame:
    """(by, q, xmin, slope, intercept, score, n): for each network a cut-off of its own, the quantile q of its distinct lengths,
    such that the joint straight line has the best score; the line's columns are the same in all rows.

    The cluster forms the sums of each network above each quantile, of which at least ``least`` lengths must be left.
    The search takes the networks in turn, keeps the best quantile of each while the others stay, and ends when none
    changes; it starts from every common quantile, and the best end counts, so that it is no worse than a common quantile
    that all networks can use. Networks without any usable quantile have no row.
    """
    qs, by = [float(q) for q in quantiles], list(by)
    distribution = ccm(lines, by, areas)
    cuts = distribution.groupBy(*by).agg(F.percentile("length", F.array(*map(F.lit, qs))).alias("cuts"))
    rows = distribution.join(cuts, by).select(*by, F.log("length").alias("x"), F.log("ccm").alias("y"), "length", F.posexplode("cuts").alias("k", "xmin")).where(F.col("length") >= F.col("xmin"))
    x, y = F.col("x"), F.col("y")
    sums = rows.groupBy(*by, "k", "xmin").agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate((x, y, x * x, x * y, y * y))]).where(F.col("n") >= least)
    bound = MOST_NETWORKS * len(qs)
    table = sums.orderBy(*by, "k").limit(bound + 1).toPandas()
    if len(table) > bound:
        raise ValueError(f"cut-offs of more than {MOST_NETWORKS} networks can't be searched together")
    kinds = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, q double, xmin double, slope double, intercept double, score double, n long"
    if table.empty:
        return lines.sparkSession.createDataFrame([], schema)
    keys = table[by].drop_duplicates().reset_index(drop=True)
    at = table.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    stats = np.full((len(keys), len(qs), 6), np.nan)
    stats[at, table["k"].to_numpy()] = table[["n", "s0", "s1", "s2", "s3", "s4"]].to_numpy(float)
    xmin = np.full((len(keys), len(qs)), np.nan)
    xmin[at, table["k"].to_numpy()] = table["xmin"].to_numpy(float)
    best, chosen = math.inf, None
    for start in range(len(qs)):
        picked, score = _descend(stats, start)
        if chosen is None or score < best:
            best, chosen = score, picked
    slope, intercept, score, n = (float(v) for v in line_of_sums(stats[np.arange(len(keys)), chosen].sum(0)))
    done = [(*[v.item() if hasattr(v, "item") else v for v in keys.iloc[i]], qs[k], float(xmin[i, k]), slope, intercept, score, int(n)) for i, k in enumerate(chosen)]
    return lines.sparkSession.createDataFrame(done, schema)


def line_of_sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """slope, intercept, score and n of sums (..., [n, x, y, xx, xy, yy]); the score is infinite where no line is defined."""
    n, x, y, xx, xy, yy = np.moveaxis(s, -1, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy, c = xx - x * x / n, yy - y * y / n, xy - x * y / n
        slope = c / vx
        score = np.abs(1 - c * c / (vx * vy))
    return slope, (y - slope * x) / n, np.where(np.isfinite(score), score, math.inf), n


def _descend(stats: np.ndarray, start: int) -> tuple[np.ndarray, float]:
    """The quantile of each network where no single change improves the joint score, from a common one (or the nearest below
    that a network has)."""
    there = ~np.isnan(stats[..., 0])
    picked = np.array([np.flatnonzero(t)[max(np.searchsorted(np.flatnonzero(t), start, "right") - 1, 0)] for t in there])
    total = stats[np.arange(len(stats)), picked].sum(0)
    score, changed = float(line_of_sums(total)[2]), True
    while changed:
        changed = False
        for i in range(len(stats)):
            rest = total - stats[i, picked[i]]
            scores = line_of_sums(rest + stats[i])[2]
            k = int(np.argmin(scores))
            if scores[k] < score - 1e-12:
                picked[i], total, score, changed = k, rest + stats[i, k], float(scores[k]), True
    return picked, score
