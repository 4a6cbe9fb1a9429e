"""Summaries: histograms, quantiles, weights, regressions, correlations, circular and kernel statistics, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.ordering import numbered


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, weight: str | None = None, log: bool = False) -> DataFrame:
    """bin (from 0) and the count or weight in it; edges linear or logarithmic, the last bin closed on the right."""
    x, a, b = (F.log(col), math.log(lo), math.log(hi)) if log else (F.col(col), lo, hi)
    inside = df.where(F.col(col).between(lo, hi))
    bin_ = F.least(F.floor((x - a) * bins / (b - a)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(bin_.alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, wx: float, wy: float) -> DataFrame:
    """Counts by cell of widths wx and wy."""
    return df.groupBy(F.floor(F.col(x) / wx).alias("bx"), F.floor(F.col(y) / wy).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def group_quantiles(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Box table: n and exact quartiles."""
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(col).alias("n"), q.alias("q"))
    return out.select(*by, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))])


def with_individual_weight(df: DataFrame, key: str = "id") -> DataFrame:
    """w: one over the rows of the individual."""
    return df.join(df.groupBy(key).agg((1 / F.count(F.lit(1))).alias("w")), key)


def weighted_share(df: DataFrame, condition: Column, w: str = "w") -> DataFrame:
    """Share of the weight where a condition holds."""
    return df.agg(F.try_divide(F.sum(F.when(condition, F.col(w)).otherwise(0.0)), F.sum(w)).alias("share"))


def weighted_median(df: DataFrame, by: list[str], v: str, w: str) -> DataFrame:
    """First value whose cumulative weight reaches half (D13, H8): equal values are summed first."""
    sums = df.groupBy(*by, v).agg(F.sum(w).alias("_w"))
    run = Window.partitionBy(*by).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.withColumns({"_c": F.sum("_w").over(run), "_t": F.sum("_w").over(Window.partitionBy(*by))})
    return rows.where(F.col("_c") >= F.col("_t") / 2).groupBy(*by).agg(F.min(v).alias("median"))


def poisson_draw(n: pd.Series, u: pd.Series) -> pd.Series:
    """Poisson draws of means n from uniforms u, by inversion within twelve deviations of the mean; the sum of n draws of mean 1."""
    out = pd.Series(0.0, index=n.index)
    for mean, at in n.groupby(n).groups.items():
        spread = 12 * math.sqrt(mean) + 30
        k = np.arange(max(0, int(mean - spread)), int(mean + spread))
        log_p = k[0] * math.log(mean) - mean - math.lgamma(k[0] + 1) + np.concatenate([[0.0], np.cumsum(math.log(mean) - np.log(k[1:]))])
        out[at] = k[0] + np.searchsorted(np.cumsum(np.exp(log_p)), u[at].to_numpy())
    return out


def boot_weighted_median(df: DataFrame, v: str, w: str, reps: int = 1000, seed: int = 1) -> DataFrame:
    """Mean, 5 % and 95 % of the weighted median over Poisson resamples, by hashes of the row and the replicate.

    Rows of one value and weight are counted first, so rows times replicates is bounded by distinct pairs times replicates."""
    rows = df.groupBy(v, F.col(w).alias("_w")).agg(F.count(F.lit(1)).alias("_n")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col(v), F.col("_w")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    drawn = rows.withColumn("_d", F.pandas_udf(poisson_draw, "double")("_n", u) * F.col("_w")).where("_d > 0")
    medians = weighted_median(drawn, ["rep"], v, "_d")
    return medians.agg(F.avg("median").alias("mean"), F.percentile("median", F.lit(0.05)).alias("q05"), F.percentile("median", F.lit(0.95)).alias("q95"))


def skill_metrics(paired: DataFrame) -> DataFrame:
    """Model skill by transect, slice and model, and by slice and model over all transects (null transect).

    paired: transect, slice, model, obs_u, obs_v, mod_u, mod_v."""
    du, dv = F.col("mod_u") - F.col("obs_u"), F.col("mod_v") - F.col("obs_v")
    rows = paired.withColumns({"_du": du, "_dv": dv, "_e": F.hypot(du, dv)})
    rows = rows.groupingSets([["transect", "slice", "model"], ["slice", "model"]], "transect", "slice", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("_e") ** 2)).alias("rmse"), F.avg("_e").alias("mae"), F.avg("_du").alias("bias_u"), F.avg("_dv").alias("bias_v"),
        F.stddev_pop("_du").alias("urmse_u"), F.stddev_pop("_dv").alias("urmse_v"), F.stddev_pop("obs_u").alias("obs_sd"), F.stddev_pop("mod_u").alias("mod_sd"),
    )
    total = F.sqrt(F.col("urmse_u") ** 2 + F.col("urmse_v") ** 2)
    return rows.withColumns({"urmse": total, "signed_urmse": F.when(F.col("mod_sd") < F.col("obs_sd"), -total).otherwise(total)})


def _fits(df: DataFrame, y: str, models: list[list[str]]) -> DataFrame:
    """One row with, for each model, a struct of n, intercept, coefficients, r2, aic and bic. A model reads the rows that have
    all its columns; all models share one pass for means and one for sums about them. The normal equations are solved as an
    expression (Cramer)."""
    whole = [F.lit(True) for _ in models]
    for m, xs in enumerate(models):
        for c in (*xs, y):
            whole[m] = whole[m] & F.col(c).isNotNull()
    means = df.agg(*[F.avg(F.when(whole[m], F.col(c))).alias(f"_m{m}_{i}") for m, xs in enumerate(models) for i, c in enumerate((*xs, y))])
    rows = df.crossJoin(F.broadcast(means))  # one row of means
    sums, parts = [], []
    for m, xs in enumerate(models):
        k, c = len(xs), [F.when(whole[m], F.col(v)) - F.col(f"_m{m}_{i}") for i, v in enumerate((*xs, y))]
        sums.append(F.count_if(whole[m]).alias(f"_n{m}"))
        sums += [F.first(f"_m{m}_{i}").alias(f"_m{m}_{i}") for i in range(k + 1)]
        sums += [F.sum(c[i] * c[j]).alias(f"_s{m}_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
        parts.append(_solved(m, xs))
    return rows.agg(*sums).select(*[p.alias(f"_fit{m}") for m, p in enumerate(parts)])


def _solved(m: int, xs: list[str]) -> Column:
    k, n = len(xs), F.col(f"_n{m}")

    def s(i: int, j: int) -> Column:
        return F.col(f"_s{m}_{min(i, j)}_{max(i, j)}")

    def det(a: list[list[Column]]) -> Column:
        if len(a) == 1:
            return a[0][0]
        total = F.lit(0.0)
        for j in range(len(a)):
            total = total + (1 if j % 2 == 0 else -1) * a[0][j] * det([r[:j] + r[j + 1 :] for r in a[1:]])
        return total

    a, b = [[s(i, j) for j in range(k)] for i in range(k)], [s(i, k) for i in range(k)]
    whole = det(a)
    beta = [F.try_divide(det([[b[i] if j == c else a[i][j] for j in range(k)] for i in range(k)]), whole) for c in range(k)]
    fitted, centre = F.lit(0.0), F.col(f"_m{m}_{k}")
    for c in range(k):
        fitted, centre = fitted + beta[c] * b[c], centre - beta[c] * F.col(f"_m{m}_{c}")
    rss = F.greatest(F.lit(0.0), s(k, k) - fitted)
    like = -n / 2 * (F.log(2 * F.pi()) + F.log(F.try_divide(rss, n)) + 1)
    out = [n.alias("n"), centre.alias("intercept"), *[x.alias(f"b_{c}") for x, c in zip(beta, xs, strict=True)], (1 - F.try_divide(rss, s(k, k))).alias("r2")]
    return F.struct(*out, (2 * (k + 1) - 2 * like).alias("aic"), (F.log(n) * (k + 1) - 2 * like).alias("bic"))


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least squares of y on one to three regressors: n, intercept, a coefficient for each, r2, aic, bic (D23). Rows with a null
    in any of the columns take no part."""
    return _fits(df, y, [xs]).select("_fit0.*")


def compare_models(df: DataFrame, y: str, models: list[list[str]]) -> DataFrame:
    """Models by BIC, the best first, each over the rows that have its columns: two passes for all."""
    fits = _fits(df, y, models)
    each = [F.struct(F.lit(" + ".join(xs)).alias("model"), *[F.col(f"_fit{m}.{c}").alias(c) for c in ("n", "r2", "aic", "bic")]) for m, xs in enumerate(models)]
    return fits.select(F.inline(F.array(*each))).orderBy("bic")


def detrend(df: DataFrame, x: str, y: str, out: str = "residual") -> DataFrame:
    """Residual of the line of y on x."""
    line = df.agg(F.regr_slope(y, x).alias("_b"), F.avg(y).alias("_my"), F.avg(x).alias("_mx"))
    return df.crossJoin(F.broadcast(line)).withColumn(out, F.col(y) - F.col("_my") - F.col("_b") * (F.col(x) - F.col("_mx"))).drop("_b", "_my", "_mx")  # one row


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rank of each value, the mean rank on ties, from the distinct values' counts; nulls have none."""
    n = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    ranks = numbered(n, [col], "_k", "_n").select(F.col(col), (F.col("_k") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, col, "left")


def correlations(df: DataFrame, ys: list[str], xs: list[str], method: str = "pearson") -> DataFrame:
    """y, x, r for each pair of columns."""
    rows, of = df, {c: c for c in {*ys, *xs}}
    if method == "spearman":
        for c in sorted({*ys, *xs}):
            rows = average_ranks(rows, c, f"_rank_{c}")
            of[c] = f"_rank_{c}"
    wide = rows.agg(*[F.corr(of[y], of[x]).alias(f"{y}|{x}") for y in ys for x in xs])
    pairs = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.col(f"`{y}|{x}`").alias("r")) for y in ys for x in xs])
    return wide.select(F.inline(pairs))


def circular_stats(df: DataFrame, angle: str, by: list[str]) -> DataFrame:
    """n, mean direction, resultant length, deviation and Rayleigh p of angles."""
    out = df.groupBy(*by).agg(F.count(angle).alias("n"), F.sum(F.sin(angle)).alias("_s"), F.sum(F.cos(angle)).alias("_c"))
    r = F.hypot("_s", "_c") / F.col("n")
    out = out.withColumns({"mean": F.atan2("_s", "_c"), "r": F.least(F.lit(1.0), r)})
    z = F.col("n") * F.col("r") ** 2
    p = F.exp(F.sqrt(1 + 4 * F.col("n") + 4 * (F.col("n") ** 2 - F.col("n") * z)) - (1 + 2 * F.col("n")))
    return out.withColumns({"std": F.sqrt(-2 * F.log("r")), "p": F.least(F.lit(1.0), p)}).drop("_s", "_c")


def diel_permutation(df: DataFrame, key: str, v: str, theta: str, reps: int = 999, seed: int = 1, block: int = 65_536, chunk: int = 1_000) -> DataFrame:
    """Mean vector of value times direction against shuffles of values among rows, and its p (D27): observed, p. Rows with a null in
    either are left out; without rows there is no result.

    Rows are dealt over as few blocks of at most `block` rows as hold them, by their place in the order of key, and values are
    shuffled within their block: among all rows, where one block holds them. Such shuffles make a group, so the test stays exact. A
    task holds one block and makes `chunk` shuffles, each from a generator keyed by seed, block and shuffle; only sums leave it."""
    whole = df.select(F.col(key).alias("_key"), F.col(v).cast("double").alias("_v"), F.col(theta).cast("double").alias("_th")).dropna(subset=["_v", "_th"])
    rows = numbered(whole, ["_key", "_v", "_th"], "_i")
    blocks = max(1, -(-rows.count() // block))
    held = rows.groupBy(F.pmod("_i", F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("_i", "_v", "_th"))).alias("_r"))
    held = held.select("block", F.col("_r._v").alias("values"), F.col("_r._th").alias("angles"))
    work = held.withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(reps), F.lit(chunk)))).repartition("block", "from")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, values, angles, first in zip(batch["block"], batch["values"], batch["angles"], batch["from"], strict=True):
                own, to = np.asarray(values, float), np.exp(1j * np.asarray(angles, float))
                of = range(first, min(first + chunk, reps + 1))
                z = np.array([(np.random.default_rng([seed, b, r]).permutation(own) if r else own) @ to for r in of])
                yield pd.DataFrame({"rep": np.array(of), "n": len(own), "re": z.real, "im": z.imag})

    by_rep = work.mapInPandas(sums, "rep int, n long, re double, im double").groupBy("rep").agg(F.sum("n").alias("n"), F.sum("re").alias("re"), F.sum("im").alias("im"))
    size = by_rep.select("rep", F.hypot(F.col("re") / F.col("n"), F.col("im") / F.col("n")).alias("m"))
    own = F.max(F.when(F.col("rep") == 0, F.col("m")))
    both = size.crossJoin(F.broadcast(size.agg(own.alias("observed")).where("observed is not null")))  # one row
    below = F.count_if((F.col("rep") > 0) & (F.col("m") < F.col("observed")))
    return both.groupBy("observed").agg((1 - below / (1 + reps)).alias("p"))


def kde(df: DataFrame, v: str, w: str, lo: float, hi: float, points: int, bandwidth: float, mirror: bool = False) -> DataFrame:
    """Gaussian density on a grid; values are summed to bins of a tenth of the bandwidth first, so the work is grid by bins."""
    q = bandwidth / 10
    bins = df.groupBy((F.bround(F.col(v) / q) * q).alias("_v")).agg(F.sum(w).alias("_w"))
    if mirror:
        bins = bins.union(bins.select(-F.col("_v"), "_w"))
    total = df.agg(F.sum(w).alias("_t"))
    grid = bins.select("_v", "_w", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.lit(lo) + F.col("i") * ((hi - lo) / (points - 1))
    out = grid.groupBy("i").agg(F.sum(F.col("_w") * F.exp(-0.5 * ((at - F.col("_v")) / bandwidth) ** 2)).alias("_d"))
    scale = bandwidth * math.sqrt(2 * math.pi)
    return out.crossJoin(F.broadcast(total)).select("i", (F.lit(lo) + F.col("i") * ((hi - lo) / (points - 1))).alias("at"), (F.col("_d") / F.col("_t") / scale).alias("density"))


def kde_circular(df: DataFrame, angle: str, w: str, points: int, kappa: float = 2.5) -> DataFrame:
    """Von Mises density of angles on a grid around the circle."""
    bins = df.groupBy((F.bround(F.col(angle) * 200) / 200).alias("_v")).agg(F.sum(w).alias("_w"))
    total = df.agg(F.sum(w).alias("_t"))
    bessel = sum((kappa / 2) ** (2 * k) / math.factorial(k) ** 2 for k in range(40))
    at = F.col("i") * (2 * math.pi / points) - math.pi
    out = bins.select("_v", "_w", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).groupBy("i").agg(F.sum(F.col("_w") * F.exp(kappa * F.cos(at - F.col("_v")))).alias("_d"))
    return out.crossJoin(F.broadcast(total)).select("i", at.alias("at"), (F.col("_d") / F.col("_t") / (2 * math.pi * bessel)).alias("density"))


def segment_clusters(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """k-means on standardised columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df)
    rows = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True).fit(rows).transform(rows)
    return KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster").fit(rows).transform(rows).drop("_raw", "_z")


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """Rows by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def cumulative(df: DataFrame, t: str, day_s: float = 86400.0) -> DataFrame:
    """Cumulative count and share in order of t (F5): days are numbered apart and the counts of the days before are added."""
    rows = df.withColumn("_d", F.floor(F.col(t) / day_s))
    days = rows.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_d")  # one row a day
    days = days.select("_d", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    k = F.row_number().over(Window.partitionBy("_d").orderBy(t, "seq"))
    return rows.withColumn("_k", k).join(days, "_d").withColumns({"n": F.col("_k") + F.col("_b"), "share": (F.col("_k") + F.col("_b")) / F.col("_all")}).drop("_d", "_k", "_b", "_all")


def running_median(df: DataFrame, key: str, order: str, v: str, n: int = 5, out: str = "median") -> DataFrame:
    """Median of n values around each, zeros beyond the ends."""
    h = n // 2
    w = Window.partitionBy(key).orderBy(order, "seq").rowsBetween(-h, h)
    values = F.collect_list(v).over(w)
    padded = F.array_sort(F.concat(values, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(values))))
    return df.withColumn(out, F.element_at(padded, h + 1))


def smooth_series(df: DataFrame, key: str, order: str, v: str, weights: list[float], out: str = "smooth") -> DataFrame:
    """Weighted moving average around each value, by the weights that reach inside the series."""
    h = len(weights) // 2
    w = Window.partitionBy(key).orderBy(order, "seq")
    total, mass = F.lit(0.0), F.lit(0.0)
    for i, x in enumerate(weights):
        at = F.lead(v, i - h).over(w) if i >= h else F.lag(v, h - i).over(w)
        total, mass = total + F.coalesce(at * x, F.lit(0.0)), mass + F.when(at.isNotNull(), x).otherwise(0.0)
    return df.withColumn(out, F.try_divide(total, mass))


def best_lag(a: DataFrame, b: DataFrame, width: float, lags: list[int]) -> DataFrame:
    """Lag in bins at which the binned means of two series correlate best (H7)."""
    x = a.groupBy(F.floor(F.col("t") / width).alias("bin")).agg(F.avg("value").alias("va"))
    y = b.groupBy(F.floor(F.col("t") / width).alias("_b")).agg(F.avg("value").alias("vb"))
    met = x.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("_b", F.col("bin") + F.col("lag")).join(y, "_b")
    return met.groupBy("lag").agg(F.corr("va", "vb").alias("r"), F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_last("r"), "lag").limit(1)
