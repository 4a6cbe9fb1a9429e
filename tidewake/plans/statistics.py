"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import stats as S
from tidewake.operators import tracks as T
from tidewake.plans.registry import query
from tidewake.plans.roles import DET, POS, SEG, detections, paired, positions, r6, table

IW = f"WITH {POS}, iw AS (SELECT pos.*, w FROM pos JOIN (SELECT id, 1.0 / count(*) AS w FROM pos GROUP BY id) n USING (id))"
PAIR = "WITH pr AS (SELECT l_returnflag AS transect, l_linestatus AS slice, l_linenumber AS model, l_extendedprice * (1 - l_discount) AS obs_u, l_extendedprice * (1 - l_tax) AS mod_u, l_quantity * 100 AS obs_v, l_quantity * 98 + 40 AS mod_v FROM lineitem), e AS (SELECT *, mod_u - obs_u AS du, mod_v - obs_v AS dv FROM pr)"


def _line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


@query(f"WITH {DET} SELECT 'linear' AS kind, CAST(least(floor((sensor - 0.01) * 20 / 489.99), 19) AS INT) AS bin, count(*) AS n FROM det WHERE sensor BETWEEN 0.01 AND 490.0 GROUP BY 2 UNION ALL SELECT 'log', CAST(least(floor((ln(sensor) - ln(1.0)) * 10 / (ln(256.0) - ln(1.0))), 9) AS INT), count(*) FROM det WHERE sensor BETWEEN 1 AND 256 GROUP BY 2")
def d9_histogram(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    a, b = S.histogram(det, "sensor", 0.01, 490.0, 20), S.histogram(det, "sensor", 1.0, 256.0, 10, log=True)
    return a.select(F.lit("linear").alias("kind"), "bin", "n").union(b.select(F.lit("log"), "bin", "n"))


@query(f"WITH {DET} SELECT CAST(floor(sensor / 50) AS BIGINT) AS bx, CAST(floor(k / 20) AS BIGINT) AS by, count(*) AS n FROM det GROUP BY 1, 2")
def d9_histogram_2d(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram_2d(detections(spark, d), "sensor", "k", 50.0, 20.0)


@query(f"WITH {DET} SELECT rx, count(sensor) AS n, round(quantile_cont(sensor, 0.25), 6) AS q25, round(quantile_cont(sensor, 0.5), 6) AS q50, round(quantile_cont(sensor, 0.75), 6) AS q75 FROM det GROUP BY rx")
def d10_group_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.group_quantiles(detections(spark, d), ["rx"], "sensor"), "q25", "q50", "q75")


@query(IW + " SELECT round(sum(CASE WHEN x > 50 THEN w ELSE 0 END) / sum(w), 9) AS share FROM iw")
def d12_weighted_share(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.weighted_share(S.with_individual_weight(positions(spark, d)), F.col("x") > 50), "share", digits=9)


@query(IW + ", s AS (SELECT num_rx, x, sum(w) AS w FROM iw GROUP BY 1, 2), c AS (SELECT num_rx, x, sum(w) OVER (PARTITION BY num_rx ORDER BY x ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY num_rx) AS t FROM s) SELECT num_rx, min(x) AS median FROM c WHERE c >= t / 2 GROUP BY 1")
def h8_weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return S.weighted_median(S.with_individual_weight(positions(spark, d)), ["num_rx"], "x", "w")


@query()
def d13_boot_weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return S.boot_weighted_median(S.with_individual_weight(positions(spark, d)), "y", "w", 1000)


@query(PAIR + """ SELECT transect, slice, model, count(*) AS n, round(sqrt(avg(du * du + dv * dv)), 4) AS rmse, round(avg(sqrt(du * du + dv * dv)), 4) AS mae, round(avg(du), 4) AS bias_u, round(avg(dv), 4) AS bias_v,
round(stddev_pop(du), 4) AS urmse_u, round(stddev_pop(dv), 4) AS urmse_v, round(stddev_pop(obs_u), 3) AS obs_sd, round(stddev_pop(mod_u), 3) AS mod_sd, round(sqrt(var_pop(du) + var_pop(dv)), 4) AS urmse,
round(CASE WHEN stddev_pop(mod_u) < stddev_pop(obs_u) THEN -1 ELSE 1 END * sqrt(var_pop(du) + var_pop(dv)), 4) AS signed_urmse FROM e GROUP BY GROUPING SETS ((transect, slice, model), (slice, model))""")
def d22_skill_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = S.skill_metrics(paired(spark, d))
    return r6(r6(out, "rmse", "mae", "bias_u", "bias_v", "urmse_u", "urmse_v", "urmse", "signed_urmse", digits=4), "obs_sd", "mod_sd", digits=3)


@query("SELECT count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 5) AS b_quantity, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def d23_ols(spark: SparkSession, d: str) -> DataFrame:
    out = S.ols(_line(spark, d), "price", ["quantity"]).select("n", "intercept", "b_quantity", "r2")
    return r6(r6(r6(out, "intercept", digits=3), "b_quantity", digits=5), "r2", digits=8)


_BIC = "count(*) * (ln(2 * pi()) + ln(regr_syy(l_extendedprice, {x}) * (1 - regr_r2(l_extendedprice, {x})) / count(*)) + 1)"


@query(" UNION ALL ".join(f"SELECT '{n}' AS model, count(*) AS n, round(regr_r2(l_extendedprice, {x}), 8) AS r2, round(4 + {_BIC.format(x=x)}, 2) AS aic, round(2 * ln(count(*)) + {_BIC.format(x=x)}, 2) AS bic FROM lineitem" for n, x in (("quantity", "l_quantity"), ("discount", "l_discount"), ("tax", "l_tax"))))
def d23_f6_compare_models(spark: SparkSession, d: str) -> DataFrame:
    out = S.compare_models(_line(spark, d), "price", [["quantity"], ["discount"], ["tax"]])
    return r6(r6(out, "r2", digits=8), "aic", "bic", digits=2)


@query(f"WITH {DET}, f AS (SELECT regr_slope(sensor, k) AS b, avg(sensor) AS my, avg(k) AS mx FROM det) SELECT seq, round(sensor - my - b * (k - mx), 6) AS residual FROM det, f")
def d24_detrend(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.detrend(detections(spark, d), "k", "sensor").select("seq", "residual"), "residual")


@query("SELECT 'price' AS y, x, round(r, 7) AS r FROM (SELECT corr(l_extendedprice, l_quantity) AS quantity, corr(l_extendedprice, l_discount) AS discount, corr(l_extendedprice, l_tax) AS tax FROM lineitem) UNPIVOT (r FOR x IN (quantity, discount, tax))")
def d25_pearson(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.correlations(_line(spark, d), ["price"], ["quantity", "discount", "tax"]), "r", digits=7)


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS a, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS b FROM lineitem) SELECT 'price' AS y, 'quantity' AS x, round(corr(a, b), 7) AS r FROM r")
def d25_spearman(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.correlations(_line(spark, d), ["price"], ["quantity"], "spearman"), "r", digits=7)


@query(f"WITH {SEG}, c AS (SELECT id, count(head) AS n, sum(sin(head)) AS s, sum(cos(head)) AS c FROM seg GROUP BY id), r AS (SELECT *, sqrt(s * s + c * c) / n AS r FROM c) SELECT id, n, round(atan2(s, c), 5) AS mean, round(r, 7) AS r, round(sqrt(-2 * ln(r)), 6) AS std, round(least(1.0, exp(sqrt(1 + 4 * n + 4 * (n * n - n * n * r * r)) - (1 + 2 * n))), 6) AS p FROM r")
def d26_circular_stats(spark: SparkSession, d: str) -> DataFrame:
    out = S.circular_stats(T.make_segments(positions(spark, d)), "head", ["id"])
    return r6(r6(r6(out, "mean", digits=5), "r", digits=7), "std", "p")


@query()
def d27_diel_permutation(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).groupBy("id").agg(F.avg("x").alias("v"), F.min("tnum").alias("t"))
    rows = rows.withColumn("theta", F.pmod("t", F.lit(86400.0)) / 86400 * 2 * F.pi())
    return S.diel_permutation(rows, "id", "v", "theta", 9999)


@query(IW + ', b AS (SELECT round_even(x / 0.5, 0) * 0.5 AS v, sum(w) AS w FROM iw GROUP BY 1), t AS (SELECT sum(w) AS t FROM iw), g AS (SELECT i, i * 500.0 / 50 AS p FROM range(0, 51) r(i)) SELECT CAST(i AS INT) AS i, round(any_value(p), 6) AS "at", round(sum(w * exp(-0.5 * ((p - v) / 5.0) ** 2)) / any_value(t) / (5.0 * sqrt(2 * pi())), 9) AS density FROM b, g, t GROUP BY i')
def d28_kde(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(S.kde(S.with_individual_weight(positions(spark, d)), "x", "w", 0.0, 500.0, 51, 5.0), "at"), "density", digits=9)


@query(f'WITH {SEG}, b AS (SELECT round_even(head * 200, 0) / 200 AS v, count(*) AS w FROM seg GROUP BY 1), g AS (SELECT i, i * (2 * pi() / 36) - pi() AS p FROM range(0, 36) r(i)) SELECT CAST(i AS INT) AS i, round(any_value(p), 6) AS "at", round(sum(w * exp(2.5 * cos(p - v))) / (SELECT sum(w) FROM b) / (2 * pi() * 3.2898391440501) , 6) AS density FROM b, g GROUP BY i')
def d28_kde_circular(spark: SparkSession, d: str) -> DataFrame:
    rows = T.make_segments(positions(spark, d)).withColumn("w", F.lit(1.0))
    return r6(S.kde_circular(rows, "head", "w", 36), "at", "density")


@query()
def d43_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Segments by heading, speed and time; those without a speed have no cluster."""
    rows = T.make_segments(positions(spark, d)).where("speed is not null").select("id", "seq", "head", "speed", "t1")
    return S.segment_clusters(rows, ["head", "speed", "t1"], 4).select("id", "seq", "cluster")


@query(f"WITH {DET} SELECT rx, CAST(floor((t - 86400 * floor(t / 86400)) / 3600) AS BIGINT) AS hour, count(*) AS n FROM det GROUP BY 1, 2")
def d44_counts_by(spark: SparkSession, d: str) -> DataFrame:
    return S.counts_by(detections(spark, d).withColumn("hour", F.floor(F.pmod("t", F.lit(86400.0)) / 3600)), "rx", "hour")


@query(f"WITH {DET} SELECT seq, row_number() OVER (ORDER BY t, seq) AS n, round(row_number() OVER (ORDER BY t, seq) / count(*) OVER (), 9) AS share FROM det")
def f5_cumulative(spark: SparkSession, d: str) -> DataFrame:
    out = S.cumulative(detections(spark, d), "t").select("seq", F.col("n").cast("long").alias("n"), "share")
    return r6(out, "share", digits=9)


@query(f"WITH {POS}, w AS (SELECT id, seq, list(x) OVER (PARTITION BY id ORDER BY tnum, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM pos) SELECT id, seq, list_sort(list_concat(l, list_resize([]::DOUBLE[], 5 - len(l), 0.0)))[3] AS median FROM w")
def e18_running_median(spark: SparkSession, d: str) -> DataFrame:
    return S.running_median(positions(spark, d), "id", "tnum", "x", 5).select("id", "seq", "median")


@query(f"WITH {POS}, l AS (SELECT id, seq, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM pos WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)) SELECT id, seq, round((coalesce(a * 0.25, 0) + x * 0.5 + coalesce(b * 0.25, 0)) / (0.5 + CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END), 6) AS smooth FROM l")
def e19_smooth_series(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.smooth_series(positions(spark, d), "id", "tnum", "x", [0.25, 0.5, 0.25]).select("id", "seq", "smooth"), "smooth")


@query(f"WITH {DET}, a AS (SELECT floor(t / 21600) AS bin, avg(sensor) AS va FROM det WHERE rx = 'click' GROUP BY 1), b AS (SELECT floor(t / 21600) AS bin, avg(sensor) AS vb FROM det WHERE rx = 'view' GROUP BY 1), c AS (SELECT CAST(l AS INT) AS lag, corr(va, vb) AS r, count(*) AS n FROM a, range(-3, 4) x(l), b WHERE b.bin = a.bin + l GROUP BY 1) SELECT lag, round(r, 8) AS r, n FROM c ORDER BY c.r DESC, lag LIMIT 1")
def h7_best_lag(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).withColumnRenamed("sensor", "value")
    return r6(S.best_lag(det.where("rx = 'click'"), det.where("rx = 'view'"), 21600.0, list(range(-3, 4))), "r", digits=8)
