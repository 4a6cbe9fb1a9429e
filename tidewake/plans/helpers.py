"""Queries of the sequential helpers and of synchronisation; without SQL unless the rule has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.operators import detections as D
from tidewake.operators import helpers as H
from tidewake.operators import matching as M
from tidewake.operators import sync as Y
from tidewake.operators import timejoin as J
from tidewake.operators import tracks as T
from tidewake.plans.registry import query
from tidewake.plans.roles import DET, POS, RX, detections, positions, r6, receivers
from tidewake.session import kept


@query(f"WITH {POS} SELECT id, count(*) AS n, round(max(x) - min(x), 6) AS span FROM pos GROUP BY id")
def h1_apply_per_track(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def spread(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(p["id"].iloc[0], len(p), p["x"].max() - p["x"].min())], columns=["id", "n", "span"])

    return r6(H.apply_per_track(positions(spark, d), spread, "id long, n long, span double"), "span")


@query(f"""WITH {POS}, v AS (SELECT id, seq, tnum, CASE WHEN lead(tnum) OVER w > tnum THEN (lead(x) OVER w - x) / (lead(tnum) OVER w - tnum) END AS u, CASE WHEN lead(tnum) OVER w > tnum THEN (lead(y) OVER w - y) / (lead(tnum) OVER w - tnum) END AS v FROM pos WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)),
c AS (SELECT *, coalesce(sqrt((u - lag(u) OVER w) ** 2 + (v - lag(v) OVER w) ** 2), 0) AS dv FROM v WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)), f AS (SELECT *, coalesce(dv > 0.005 AND dv > lag(dv) OVER (PARTITION BY id ORDER BY tnum, seq), false) AS up FROM c)
SELECT id, seq, up AND NOT coalesce(lead(up) OVER (PARTITION BY id ORDER BY tnum, seq), false) AS "cross" FROM f""")
def e24_flag_cross(spark: SparkSession, d: str) -> DataFrame:
    return H.flag_cross(positions(spark, d), 0.005)


@query()
def e25_flag_iterative(spark: SparkSession, d: str) -> DataFrame:
    return H.flag_iterative(positions(spark, d), 0.005)


@query()
def e26_flag_greedy(spark: SparkSession, d: str) -> DataFrame:
    return H.flag_greedy(positions(spark, d).withColumn("bed", F.col("x") / 100), 0.02, 2.5)


@query(f"""WITH {POS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tnum, seq) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, min(tnum) OVER (PARTITION BY id) AS t0 FROM pos),
l AS (SELECT id, i, x, y, avg(tnum - t0) OVER f AS mt, avg(x) OVER f AS mx, avg(y) OVER f AS my, regr_slope(x, tnum - t0) OVER f AS gx, regr_slope(y, tnum - t0) OVER f AS gy FROM r WHERE i < n - 1 WINDOW f AS (PARTITION BY id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)),
k AS (SELECT id, t0, n, unnest(range(0, CAST(floor((max(tnum) - t0) / 21600) AS BIGINT) + 1)) AS k FROM r WHERE n >= 3 GROUP BY id, t0, n), h AS (SELECT id, tnum, max(i) AS i FROM r GROUP BY id, tnum),
c AS (SELECT k.id, k, t0, k * 21600 AS w, least(h.i, n - 2) AS c FROM (SELECT *, t0 + k * 21600 AS t FROM k) k ASOF JOIN h ON k.id = h.id AND h.tnum <= k.t),
s AS (SELECT *, k + least(1, min(c - k) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS i FROM c)
SELECT id, t0 + w AS t, round(coalesce(mx + gx * (w - mt), x), 6) AS x, round(coalesce(my + gy * (w - mt), y), 6) AS y FROM s JOIN l USING (id, i)""")
def e14_smooth_fill(spark: SparkSession, d: str) -> DataFrame:
    return r6(H.smooth_fill(positions(spark, d), 3, 21600.0), "x", "y")


@query()
def e29_change_points_filled(spark: SparkSession, d: str) -> DataFrame:
    pos = positions(spark, d)
    return r6(H.change_points_filled(H.smooth_fill(pos, 3, 21600.0), pos), "p")


@query()
def e37_pacf(spark: SparkSession, d: str) -> DataFrame:
    steps = positions(spark, d).withColumn("step", F.row_number().over(Window.partitionBy("id").orderBy("tnum", "seq")))
    return r6(H.pacf(steps, "x", 10), "pacf")


@query()
def e17_running_weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).withColumn("w", 1.0 / F.col("num_rx"))
    return r6(H.running_weighted_quantile(rows, "x", "y", "w", 51, 0.5), "quantile")


@query(f"""WITH {DET}, r AS (SELECT *, t - k * 600 AS tt FROM det), b AS (SELECT *, CASE WHEN coalesce(tt < lag(tt) OVER (PARTITION BY rx ORDER BY seq), false) THEN 1 ELSE 0 END AS brk FROM r),
f AS (SELECT rx, min(seq) AS cut FROM r WHERE tt >= 1705000000 GROUP BY rx), g AS (SELECT rx, min(seq) AS first FROM r GROUP BY rx), c AS (SELECT b.*, CASE WHEN (brk = 1 OR seq = cut) AND seq <> first THEN 1 ELSE 0 END AS cutf FROM b LEFT JOIN f USING (rx) JOIN g USING (rx))
SELECT seq, rx, CAST(1 + sum(cutf) OVER (PARTITION BY rx ORDER BY seq ROWS UNBOUNDED PRECEDING) AS INT) AS segment FROM c""")
def e3_split_by_reset_table(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).withColumn("t", F.col("t") - F.col("k") * 600)
    resets = det.select("rx").distinct().select("rx", F.lit(1704990000.0).alias("pre"), F.lit(1705000000.0).alias("post"))
    return H.split_by_reset_table(det, resets)


@query()
def c14_fit_clock_pair(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    match = D.match_candidates(det, 3600.0).withColumn("chunk", F.floor(F.col("t_a") / 864000))
    return r6(H.fit_clock_pair(match, 1.005, 1200.0, 7200.0), "slope", "shift", "t_mean", "rms", digits=4)


def _fit_sql(max_res: float, max_shift: float, limit: float) -> str:
    """The rounds of fit_lines, each a line of the candidates near the line before."""
    res = "c.t_b - l.b_mean - l.slope * (c.t_a - l.a_mean)"
    out = [f"""c AS (SELECT a.rx AS rx_a, b.rx AS rx_b, CAST(floor(a.t / 864000) AS BIGINT) AS chunk, a.t AS t_a, b.t AS t_b FROM det a JOIN det b ON a.tag = b.tag AND a.rx < b.rx AND abs(a.t - b.t) < 3600),
e AS (SELECT rx_a, rx_b, chunk, min(t_a) AS a0, max(t_a) - min(t_a) AS span FROM c GROUP BY ALL),
g AS (SELECT *, 1 + coalesce(CASE WHEN span > 0 THEN k * {2 * max_res} / span END, 0) AS s FROM (SELECT *, unnest(range(-CAST(ceil({limit - 1} * span / {2 * max_res}) AS BIGINT), CAST(ceil({limit - 1} * span / {2 * max_res}) AS BIGINT) + 1)) AS k FROM e)),
v AS (SELECT rx_a, rx_b, chunk, a0, k, s, CAST(floor((t_b - a0 - s * (t_a - a0)) / {max_res}) AS BIGINT) + o AS step FROM c JOIN g USING (rx_a, rx_b, chunk), range(2) r(o)),
l0 AS (SELECT rx_a, rx_b, chunk, s AS slope, a0 AS a_mean, a0 + step * {max_res} AS b_mean FROM (SELECT *, row_number() OVER (PARTITION BY rx_a, rx_b, chunk ORDER BY n DESC, abs(k), k, step) AS place FROM (SELECT rx_a, rx_b, chunk, a0, k, s, step, count(*) AS n FROM v GROUP BY ALL)) WHERE place = 1)"""]
    near = M.distances(max_res)
    for k, d in enumerate(near):
        out.append(f"""l{k + 1} AS (SELECT rx_a, rx_b, chunk, greatest(1 / {limit}::DOUBLE, least({limit}::DOUBLE, coalesce(CASE WHEN var_pop(t_a) > 0 THEN covar_pop(t_b, t_a) / var_pop(t_a) END, 1))) AS slope, avg(t_a) AS a_mean, avg(t_b) AS b_mean
FROM c JOIN l{k} l USING (rx_a, rx_b, chunk) WHERE abs({res}) < {d} GROUP BY 1, 2, 3)""")
    return ", ".join(out) + f""" SELECT rx_a, rx_b, chunk, round(slope, 6) AS slope, round(a_mean, 2) AS a_mean, round(b_mean, 2) AS b_mean, count(*) AS n, round(sqrt(avg(({res}) ** 2)), 2) AS rms
FROM c JOIN l{len(near)} l USING (rx_a, rx_b, chunk) WHERE abs({res}) < {max_res} GROUP BY rx_a, rx_b, chunk, slope, a_mean, b_mean HAVING count(*) >= 2 AND abs(b_mean - a_mean) < {max_shift}"""


@query(f"WITH {DET}, " + _fit_sql(1200.0, 7200.0, 1.005))
def c14_fit_lines(spark: SparkSession, d: str) -> DataFrame:
    match = D.match_candidates(detections(spark, d), 3600.0).withColumn("chunk", F.floor(F.col("t_a") / 864000))
    lines = M.fit_lines(match, ["rx_a", "rx_b", "chunk"], 1.005, 1200.0, 7200.0)
    return r6(r6(lines, "slope"), "a_mean", "b_mean", "rms", digits=2)


@query()
def c14_c15_matched_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of two receivers, the second's clock 100 s behind, matched and merged: each hit is in one row of the result, and
    matched hits of a tag keep their order (held against a plain search in the tests)."""
    det = detections(spark, d).where("rx in ('click', 'view')").withColumn("t", F.col("t") - F.when(F.col("rx") == "view", 100.0).otherwise(0.0))
    lines = kept(M.fit_lines(D.match_candidates(det, 3600.0), ["rx_a", "rx_b"], 1.005, 1200.0, 7200.0), "lines")
    match = M.match_records(det, lines, F.lit(1500.0), None, 1200.0, slice_s=864000.0)
    line = lines.select("slope", (F.col("b_mean") - F.col("slope") * F.col("a_mean")).alias("shift")).first()  # one pair, one line
    merged = D.merge_matched(det.where("rx = 'click'"), det.where("rx = 'view'"), match.select("seq_a", "seq_b"), *(line or (1.0, 0.0)))
    return r6(merged, "t", "t_a", "t_b", digits=3)


def _toa(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Arrivals at all receivers of a call from each event's place (value, k) at its time, at 1460 m/s."""
    rx = receivers(spark)
    calls = detections(spark, d).select(F.col("seq").alias("ping_id"), F.col("sensor").alias("cx"), F.col("k").alias("cy"), (F.col("t") % 1000).alias("t0"))
    heard = calls.crossJoin(F.broadcast(rx))  # five receivers
    toa = F.col("t0") + F.hypot(F.col("cx") - F.col("rx_x"), F.col("cy") - F.col("rx_y")) / 1460
    return heard.select("ping_id", "rx", toa.alias("toa"), "cx", "cy"), rx


@query(f"WITH {DET} SELECT seq AS ping_id, round(sensor, 2) AS x, round(k, 2) AS y, 5 AS n_rx FROM det")
def h2_solve_pings(spark: SparkSession, d: str) -> DataFrame:
    toa, rx = _toa(spark, d)
    fixes = Y.solve_pings(toa.select("ping_id", "rx", "toa"), rx).withColumn("_k", F.row_number().over(Window.partitionBy("ping_id").orderBy("rms", "solution"))).where("_k = 1")
    return r6(fixes.select("ping_id", "x", "y", "n_rx"), "x", "y", digits=2)


@query(f"WITH {DET} SELECT seq AS ping_id, CAST(1 AS BIGINT) AS solutions FROM det WHERE sensor / 100 <= 2")
def h3_filter_fixes(spark: SparkSession, d: str) -> DataFrame:
    fixes = detections(spark, d).select(F.col("seq").alias("ping_id"), (F.col("sensor") / 100).alias("bed"))
    return Y.filter_fixes(fixes).select("ping_id", "solutions")


def _beacon_pings(spark: SparkSession, d: str) -> DataFrame:
    """Beacon calls by each event's receiver at its time, heard by all others with clock offsets that drift by the hour."""
    rx = receivers(spark)
    calls = detections(spark, d).select(F.col("seq").alias("ping_id"), F.col("rx").alias("tx"), (F.col("t") - 1704067200).alias("t0"))
    own = rx.select(F.col("rx").alias("tx"), F.col("rx_x").alias("bx"), F.col("rx_y").alias("by"))
    heard = calls.join(F.broadcast(own), "tx").crossJoin(F.broadcast(rx))  # five receivers
    offset = F.when(F.col("rx") == "click", 0.0).otherwise(F.length("rx") * 0.1 + F.length("rx") * F.floor(F.col("t0") / 86400) * 0.01)
    return heard.select("ping_id", "tx", "rx", (F.col("t0") + F.hypot(F.col("bx") - F.col("rx_x"), F.col("by") - F.col("rx_y")) / 1460 - F.length("rx") * F.when(F.col("rx") == "click", 0.0).otherwise(0.1)).alias("t"), offset.alias("offset"))


@query()
def h4_solve_clock(spark: SparkSession, d: str) -> DataFrame:
    """Constant offsets of a tenth of a second for each letter of a receiver's name are recovered."""
    pings = _beacon_pings(spark, d)
    lo, hi = pings.agg(F.min("t"), F.max("t")).first()
    eq = Y.clock_equations(pings, D.rx_distances(receivers(spark)))
    days = int((hi - lo + 20) // 86400) + 1  # intervals of a day over all pings
    return r6(Y.solve_clock(eq, lo - 10.0, 86400.0, "click", days).select("rx", "idx", "off"), "off", digits=3)


_PLANTED = "(0.1::DOUBLE * length(rx) + 0.02::DOUBLE * ((7 * idx + length(rx)) % 5))"


@query(f"""WITH {DET}, {RX}, d AS (SELECT CAST(max(floor((t - 1704067200) / 86400)) AS BIGINT) AS days FROM det WHERE (t - 1704067200) % 86400 BETWEEN 10 AND 86390),
b AS (SELECT rx, unnest(range(0, days + 2)) AS idx, days FROM rx, d) SELECT rx, idx, round(CASE WHEN rx = 'click' THEN 0 ELSE {_PLANTED} END, 4) AS off, round((1::DOUBLE / 1460) * (1 + 0.002::DOUBLE * (least(idx, days) % 3)) * 1e6, 1) AS micros FROM b""")
def h4_solve_clock_drift(spark: SparkSession, d: str) -> DataFrame:
    """Offsets that turn at each day's end and speeds of sound that change from day to day, put on the arrivals of each event's
    call, are recovered, with every 50th arrival half a second off. Calls about midnight are left out, as their arrivals have two speeds."""
    rx = receivers(spark)
    own = rx.select(F.col("rx").alias("tx"), F.col("rx_x").alias("bx"), F.col("rx_y").alias("by"))
    t0 = F.col("t") - 1704067200
    calls = detections(spark, d).select(F.col("seq").alias("ping_id"), F.col("rx").alias("tx"), t0.alias("t0")).where(F.pmod(t0, F.lit(86400.0)).between(10, 86390))
    heard = calls.join(F.broadcast(own), "tx").crossJoin(F.broadcast(rx.select("rx", "rx_x", "rx_y")))  # five receivers
    day = F.floor(F.col("t0") / 86400)
    inv = (1 + 0.002 * (day % 3)) / 1460
    true = F.col("t0") + F.hypot(F.col("bx") - F.col("rx_x"), F.col("by") - F.col("rx_y")) * inv
    turn = lambda i: F.when(F.col("rx") == "click", 0.0).otherwise(0.1 * F.length("rx") + 0.02 * ((7 * i + F.length("rx")) % 5))
    slope = (turn(day + 1) - turn(day)) / 86400
    read = (true - turn(day) + slope * day * 86400) / (1 + slope)  # the reading whose correction is the true time
    odd = F.when((F.col("ping_id") % 50 == 0) & (F.length("rx") == 4 + F.col("ping_id") / 50 % 2), 0.5).otherwise(0.0)
    pings = heard.select("ping_id", "tx", "rx", (read + odd).alias("t"))
    days = int(pings.agg(F.max("t")).first()[0] // 86400) + 1
    eq = Y.clock_equations(pings, D.rx_distances(rx))
    out = Y.solve_clock(eq, 0.0, 86400.0, "click", days, max_drops=10_000, max_share=0.05)
    return r6(r6(out.select("rx", "idx", "off", (F.col("inv_c") * 1e6).alias("micros")), "off", digits=4), "micros", digits=1)


@query(f"""WITH {DET}, {RX}, heard AS (SELECT det.seq AS ping_id, r.rx, sqrt((b.rx_x - r.rx_x) ** 2 + (b.rx_y - r.rx_y) ** 2) AS dist, t - 1704067200 AS t0 FROM det JOIN rx b ON b.rx = det.rx CROSS JOIN rx r),
a AS (SELECT *, t0 + dist / 1460 - length(rx) * CASE WHEN rx = 'click' THEN 0 ELSE 0.1 END AS t FROM heard), e AS (SELECT *, t - dist * (1.0::DOUBLE / 1460) AS emitted FROM a), m AS (SELECT *, emitted - avg(emitted) OVER (PARTITION BY ping_id) AS error FROM e)
SELECT rx, CAST(floor(t / 86400) AS BIGINT) AS idx, count(*) AS pings, round(sqrt(avg(error * error)), 6) AS rms FROM m GROUP BY 1, 2""")
def h5_evaluate_sync(spark: SparkSession, d: str) -> DataFrame:
    pings = _beacon_pings(spark, d)
    return r6(Y.evaluate_sync(pings, D.rx_distances(receivers(spark)), 1 / 1460), "rms")


def _leg(name: str, a: str, b: str) -> str:
    """SQL of arrivals at b with the nearest emission of a within ten hours."""
    return f"""{name} AS (SELECT tag, t, CASE WHEN n IS NULL OR t - p <= n - t THEN p ELSE n END AS src FROM (SELECT y.*, z.t AS n FROM (SELECT x.tag, x.t, q.t AS p FROM (SELECT * FROM det WHERE rx = '{b}') x ASOF LEFT JOIN (SELECT * FROM det WHERE rx = '{a}') q ON x.tag = q.tag AND x.t >= q.t) y
ASOF LEFT JOIN (SELECT * FROM det WHERE rx = '{a}') z ON y.tag = z.tag AND y.t <= z.t)), {name}n AS (SELECT *, t - src AS dt, src / 86400 AS day FROM {name} WHERE abs(t - src) <= 36000)"""


def _rms(leg: str, sign: str) -> str:
    return f"(SELECT tag, shift, drift, sqrt(avg((dt {sign} (shift + drift * day)) ** 2)) AS rms FROM {leg}n, grid GROUP BY 1, 2, 3)"


@query(f"""WITH {DET}, {_leg('ab', 'click', 'view')}, {_leg('ba', 'view', 'click')}, grid AS (SELECT 600.0::DOUBLE * i AS shift, 0.1::DOUBLE * j AS drift FROM range(-10, 11) a(i), range(-10, 11) b(j)),
c AS (SELECT tag, shift, drift, p.rms + q.rms AS cost FROM {_rms('ab', '-')} p JOIN {_rms('ba', '+')} q USING (tag, shift, drift))
SELECT tag, round(cost, 3) AS cost, shift, drift FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY cost, shift, drift) AS n FROM c) WHERE n = 1""")
def h6_search_shift_drift(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    legs = []
    for a, b in (("click", "view"), ("view", "click")):
        src = det.where(F.col("rx") == a).select("tag", "t", F.col("t").alias("value"))
        legs.append(J.nearest_join(det.where(F.col("rx") == b).select("tag", "t"), src, ["tag"], 36000.0).where("near_v is not null").select("tag", "t", F.col("near_v").alias("src")))
    return r6(Y.search_shift_drift(*legs, [600.0 * k for k in range(-10, 11)], [0.1 * k for k in range(-10, 11)], ["tag"]), "cost", digits=3)
