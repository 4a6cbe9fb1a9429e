"""Queries over tracks (events as positions)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import exprs as X
from tidewake.operators import cleaning as C
from tidewake.operators import tracks as T
from tidewake.plans.registry import query
from tidewake.plans.roles import POS, SEG, positions, r6
from tidewake.session import shared_folder
from tidewake.sources import readers as R

WATER = "sin(tnum / 3600) AS water_u, cos(tnum / 3600) AS water_v"
VEL = f"""WITH {POS}, wp AS (SELECT *, {WATER}, lead(tnum) OVER w - tnum AS dt, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM pos WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)),
g AS (SELECT *, dx / dt AS gu, dy / dt AS gv, atan2(water_v, water_u) AS wh FROM wp),
vel AS (SELECT *, gu - water_u AS su, gv - water_v AS sv FROM g),
rel AS (SELECT *, su * cos(wh) + sv * sin(wh) AS urel, sv * cos(wh) - su * sin(wh) AS vrel FROM vel)"""
DV = f"WITH {SEG}, dv AS (SELECT *, sqrt((lag(u) OVER w - u) ** 2 + (lag(v) OVER w - v) ** 2) AS dvel, lag(head) OVER w - head AS dh FROM seg WINDOW w AS (PARTITION BY id ORDER BY t1, seq))"
STATS = f"WITH {SEG}, m AS (SELECT id, sum(speed * dt) / sum(dt) AS mean_speed, sum(dt) AS seconds, count(*) AS n FROM seg GROUP BY id), stats AS (SELECT m.*, s.std_speed FROM m JOIN (SELECT seg.id, sqrt(sum((speed - mean_speed) ** 2 * dt) / sum(dt)) AS std_speed FROM seg JOIN m USING (id) GROUP BY seg.id) s USING (id))"


def _water(spark: SparkSession, d: str) -> DataFrame:
    return T.calc_velocities(positions(spark, d).withColumns({"water_u": F.sin(F.col("tnum") / 3600), "water_v": F.cos(F.col("tnum") / 3600)}))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return T.make_segments(positions(spark, d))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat_ws("_", F.floor(F.col("x") / 10).cast("string"), F.floor(F.col("y") / 10).cast("string"))
    return positions(spark, d).withColumn("cell", cell)


CELL = POS + ", cells AS (SELECT *, CAST(floor(x / 10) AS BIGINT) || '_' || CAST(floor(y / 10) AS BIGINT) AS cell FROM pos)"


@query(STATS + " SELECT id, round(mean_speed, 9) AS mean_speed, round(std_speed, 9) AS std_speed, round(seconds, 3) AS seconds, n FROM stats ORDER BY stats.mean_speed DESC, id LIMIT 7")
def swim_speed_screening(spark: SparkSession, d: str) -> DataFrame:
    out = T.fastest(T.swim_stats(_segments(spark, d)), 7)
    return r6(r6(out, "mean_speed", "std_speed", digits=9), "seconds", digits=3)


@query(STATS + " SELECT id, round(mean_speed, 9) AS mean_speed, round(std_speed, 9) AS std_speed, n FROM stats")
def d11_swim_stats(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.swim_stats(_segments(spark, d)).select("id", "mean_speed", "std_speed", "n"), "mean_speed", "std_speed", digits=9)


@query(f"WITH {SEG} SELECT id, seq, round(xm, 6) AS xm, round(ym, 6) AS ym, round(tm, 4) AS tm, round(dt, 6) AS dt, round(u, 8) AS u, round(v, 8) AS v, round(speed, 8) AS speed, round(head, 6) AS head FROM seg")
def e4_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).select("id", "seq", "xm", "ym", "tm", "dt", "u", "v", "speed", "head")
    return r6(r6(r6(s, "xm", "ym", "dt", "head"), "u", "v", "speed", digits=8), "tm", digits=4)


@query(VEL + " SELECT id, seq, round(gu, 6) AS ground_u, round(gv, 6) AS ground_v, round(su, 6) AS swim_u, round(sv, 6) AS swim_v, round(urel, 6) AS swim_urel, round(vrel, 6) AS swim_vrel, round(sqrt(su * su + sv * sv), 6) AS swim_speed FROM rel")
def b9_e5_velocities(spark: SparkSession, d: str) -> DataFrame:
    c = ["ground_u", "ground_v", "swim_u", "swim_v", "swim_urel", "swim_vrel", "swim_speed"]
    return r6(_water(spark, d).select("id", "seq", *c), *c)


@query(f"WITH {SEG}, a AS (SELECT id, seq, head, head * 2 + 0.1 AS a, u, v FROM seg) SELECT id, seq, round((a + pi()) - 2 * pi() * floor((a + pi()) / (2 * pi())) - pi(), 6) AS wrapped, round((90 - degrees(atan2(v, u))) - 360 * floor((90 - degrees(atan2(v, u))) / 360), 4) AS dir, round((90 - degrees(head)) * pi() / 180, 6) AS math FROM a")
def b10_b11_angles(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    out = s.select("id", "seq", X.wrap_angle(F.col("head") * 2 + 0.1).alias("wrapped"), X.water_dir(F.col("u"), F.col("v")).alias("dir"), X.heading_to_math(F.degrees("head")).alias("math"))
    return r6(r6(out, "wrapped", "math"), "dir", digits=4)


@query(f"WITH {POS}, g AS (SELECT * FROM pos WHERE num_rx >= 2 AND sqrt(x_sd ** 2 + y_sd ** 2) <= 10), e AS (SELECT id, min(tnum) AS a, max(tnum) AS b FROM g WHERE num_rx > 2 GROUP BY id) SELECT g.id, seq FROM g JOIN e USING (id) WHERE tnum BETWEEN a AND b")
def b19_trim_weak(spark: SparkSession, d: str) -> DataFrame:
    return C.trim_weak(positions(spark, d)).select("id", "seq")


@query(f"WITH {POS} SELECT id, seq FROM pos WHERE id IN (SELECT id FROM pos GROUP BY id HAVING max(tnum) - min(tnum) < 2500000 AND count(*) >= 5)")
def b20_screen_tracks(spark: SparkSession, d: str) -> DataFrame:
    return C.screen_tracks(positions(spark, d), 2500000.0, 5).select("id", "seq")


@query(f"WITH {POS} SELECT seq, x - y AS depth, round(1 - least(1.0, (x - (y + 5)) / greatest(0.01, x - y)), 6) AS rel_height, x > y AS wet FROM pos")
def b24_vertical_position(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).select("seq", F.col("x").alias("level"), F.col("y").alias("bed"), (F.col("y") + 5).alias("z"))
    return r6(C.vertical_position(rows).select("seq", "depth", "rel_height", "wet"), "rel_height")


@query(f"WITH {POS} SELECT seq, round(x + (y - x_sd), 6) AS v_bt FROM pos")
def b25_velocity_ref(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).select("seq", F.col("x").alias("v"), F.col("y").alias("boat"), F.col("x_sd").alias("bottom"))
    return r6(C.change_velocity_ref(rows).select("seq", "v_bt"), "v_bt")


@query(f"WITH {POS} SELECT seq, 0 AS beam, x AS bx, y AS by, -x_sd AS z FROM pos UNION ALL SELECT seq, k, round(x + tan(radians(25)) * (x_sd + k - 0.41) * cos(y / 50 + pi() * (k - 1) * 0.5), 6), round(y + tan(radians(25)) * (x_sd + k - 0.41) * sin(y / 50 + pi() * (k - 1) * 0.5), 6), -(x_sd + k) FROM pos, (VALUES (1), (2), (3), (4)) AS b(k)")
def b18_expand_beams(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).select(F.col("seq").alias("rec"), "x", "y", (F.col("y") / 50).alias("phi"), F.col("x_sd").alias("depth_v"), *[(F.col("x_sd") + k).alias(f"depth_{k}") for k in range(1, 5)])
    return r6(C.expand_beams(rows).withColumnRenamed("rec", "seq"), "bx", "by")


@query(f"WITH {POS} SELECT seq FROM pos WHERE y <> 0")
def b22_drop_no_fix(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_no_fix(positions(spark, d), "y").select("seq")


@query("SELECT c_custkey AS id, upper(substring(c_name, 1, 8)) AS grp FROM customer")
def b26_release_group(spark: SparkSession, d: str) -> DataFrame:
    from tidewake.plans.roles import table

    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.release_group(F.col("c_name")).alias("grp"))


@query(f"WITH {POS}, l AS (SELECT id, seq, x, y, lead(x) OVER w AS x_end, lead(y) OVER w AS y_end, lead(tnum) OVER w - tnum AS dt FROM pos WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)) SELECT id, seq, x_end, y_end, round(sqrt((x_end - x) ** 2 + (y_end - y) ** 2) / dt, 8) AS ground_speed FROM l")
def e6_groundspeed(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.with_groundspeed(positions(spark, d)).select("id", "seq", "x_end", "y_end", "ground_speed"), "ground_speed", digits=8)


@query(DV + " SELECT id, seq, round(dvel, 8) AS dvel, round(atan2(sin(dh), cos(dh)), 6) AS turn FROM dv")
def e7_e8_steps(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(T.turn_angle(T.delta_velocity(_segments(spark, d))).select("id", "seq", "dvel", "turn"), "dvel", digits=8), "turn")


@query(f"WITH {SEG}, s AS (SELECT id, seq, t1, head, head - lag(head) OVER (PARTITION BY id ORDER BY t1, seq) AS d FROM seg), w AS (SELECT *, CASE WHEN d IS NULL THEN head ELSE (d + pi()) - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi() END AS st FROM s) SELECT id, seq, round(sum(st) OVER (PARTITION BY id ORDER BY t1, seq ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM w")
def e9_unwrap(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.unwrap(_segments(spark, d)).select("id", "seq", "unwrapped"), "unwrapped")


@query(VEL + ", p AS (SELECT id, seq, tnum, coalesce((tnum - lag(tnum) OVER w) * lag(urel) OVER w, 0) AS du, coalesce((tnum - lag(tnum) OVER w) * lag(vrel) OVER w, 0) AS dv FROM rel WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)) SELECT id, seq, round(sum(du) OVER w, 3) AS path_u, round(sum(dv) OVER w, 3) AS path_v FROM p WINDOW w AS (PARTITION BY id ORDER BY tnum, seq ROWS UNBOUNDED PRECEDING)")
def e10_swim_path(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.swim_path(_water(spark, d)).select("id", "seq", "path_u", "path_v"), "path_u", "path_v", digits=3)


@query(f"""WITH {POS}, s AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, first_value(tnum) OVER w AS t0, max(tnum) OVER (PARTITION BY id) - min(tnum) OVER (PARTITION BY id) AS len FROM pos WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)),
b AS (SELECT floor((tnum - t0) / 36000) AS bin, (x - x0) ** 2 + (y - y0) ** 2 AS sd FROM s WHERE len > 360000 AND tnum - t0 <= 360000)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(quantile_cont(sd, 0.25), 4) AS q25, round(quantile_cont(sd, 0.5), 4) AS q50, round(quantile_cont(sd, 0.75), 4) AS q75 FROM b GROUP BY 1""")
def e11_msd_bins(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.msd_bins(positions(spark, d), 360000.0, 36000.0), "q25", "q50", "q75", digits=4)


@query(f"""WITH {POS}, b AS (SELECT *, tnum - min(tnum) OVER (PARTITION BY id) AS t, lead(tnum) OVER (PARTITION BY id ORDER BY tnum, seq) IS NULL AS last, row_number() OVER (PARTITION BY id ORDER BY tnum, seq) AS n FROM pos),
f AS (SELECT a.id, a.seq, regr_slope(b.x, b.t) AS us, regr_slope(b.y, b.t) AS vs FROM b a JOIN b ON a.id = b.id AND b.n BETWEEN a.n - 3 AND a.n + 4 WHERE NOT a.last GROUP BY 1, 2)
SELECT id, seq, round(us, 7) AS us, round(vs, 7) AS vs FROM f""")
def e12_smooth_velocity(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.smooth_velocity(positions(spark, d)).select("id", "seq", "us", "vs"), "us", "vs", digits=7)


@query(f"""WITH {POS}, b AS (SELECT *, tnum - min(tnum) OVER (PARTITION BY id) AS t, lead(tnum) OVER (PARTITION BY id ORDER BY tnum, seq) IS NULL AS last, row_number() OVER (PARTITION BY id ORDER BY tnum, seq) AS n FROM pos),
f AS (SELECT a.id, a.seq, a.x, a.y, a.t, avg(b.x) + coalesce(regr_slope(b.x, b.t), 0) * (a.t - avg(b.t)) AS xs, avg(b.y) + coalesce(regr_slope(b.y, b.t), 0) * (a.t - avg(b.t)) AS ys FROM b a JOIN b ON a.id = b.id AND b.n BETWEEN a.n - 3 AND a.n + 2 AND NOT b.last WHERE NOT a.last GROUP BY a.id, a.seq, a.x, a.y, a.t)
SELECT b.id, b.seq, round(xs, 5) AS xs, round(ys, 5) AS ys, round(sqrt((f.x - xs) ** 2 + (f.y - ys) ** 2), 5) AS noise FROM b LEFT JOIN f ON b.id = f.id AND b.seq = f.seq""")
def e13_smooth_position(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.smooth_position(positions(spark, d)).select("id", "seq", "xs", "ys", "noise"), "xs", "ys", "noise", digits=5)


@query(f"""WITH {POS}, s AS (SELECT *, coalesce(CAST(round_even((tnum - lag(tnum) OVER (PARTITION BY id ORDER BY tnum, seq)) / 3600, 0) AS BIGINT), 0) AS dd FROM pos), r AS (SELECT *, sum(dd) OVER (PARTITION BY id ORDER BY tnum, seq ROWS UNBOUNDED PRECEDING) AS step FROM s),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, step ORDER BY tnum, seq) AS n FROM r) WHERE n = 1), a AS (SELECT id, unnest(range(0, CAST(max(step) AS BIGINT) + 1)) AS step FROM r GROUP BY id),
g AS (SELECT a.id, a.step, x, y, k.step AS own, last_value(k.step IGNORE NULLS) OVER lo AS s0, last_value(x IGNORE NULLS) OVER lo AS x0, last_value(y IGNORE NULLS) OVER lo AS y0, first_value(k.step IGNORE NULLS) OVER hi AS s1, first_value(x IGNORE NULLS) OVER hi AS x1, first_value(y IGNORE NULLS) OVER hi AS y1
FROM a LEFT JOIN k ON a.id = k.id AND a.step = k.step WINDOW lo AS (PARTITION BY a.id ORDER BY a.step ROWS UNBOUNDED PRECEDING), hi AS (PARTITION BY a.id ORDER BY a.step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT id, CAST(step AS BIGINT) AS step, round(CASE WHEN own IS NULL THEN x0 + (x1 - x0) * (step - s0) / (s1 - s0) ELSE x END, 9) AS x, round(CASE WHEN own IS NULL THEN y0 + (y1 - y0) * (step - s0) / (s1 - s0) ELSE y END, 9) AS y FROM g""")
def e15_expand_regular(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.expand_regular(positions(spark, d), 3600.0, "linear", "first").select("id", "step", "x", "y"), "x", "y", digits=9)


@query(f"WITH {SEG}, r AS (SELECT id, seq, count(head) OVER w AS n, sum(sin(head)) OVER w AS s, sum(cos(head)) OVER w AS c FROM seg WINDOW w AS (PARTITION BY id ORDER BY t1, seq ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) SELECT id, seq, CASE WHEN n > 1 THEN round(atan2(s, c), 5) END AS circ_mean, CASE WHEN n > 1 THEN round(sqrt(-2 * ln(least(1.0, sqrt(s * s + c * c) / n))), 5) END AS circ_std FROM r")
def e16_rolling_circular(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.rolling_circular(_segments(spark, d)).select("id", "seq", "circ_mean", "circ_std"), "circ_mean", "circ_std", digits=5)


@query(f"""WITH {POS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tnum, seq) - 1 AS rn FROM pos), s AS (SELECT n.*, st, lead(tnum) OVER w - tnum AS gap, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM n, range(1, 6) AS q(st) WINDOW w AS (PARTITION BY id, st, rn % st ORDER BY rn)),
m AS (SELECT CAST(round_even(gap / 3600, 0) AS BIGINT) AS span, sqrt(dx * dx + dy * dy) / gap AS speed FROM s WHERE gap > 0) SELECT span, count(*) AS n, round(quantile_cont(speed, 0.5), 8) AS speed FROM m WHERE span <= 10 GROUP BY 1""")
def e20_multi_stride(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.multi_stride(positions(spark, d), 5, 3600.0), "speed", digits=8)


@query(f"WITH {SEG}, s AS (SELECT id, seq, lead(speed) OVER w - speed AS ds, lead(head) OVER w - head AS dh FROM seg WINDOW w AS (PARTITION BY id ORDER BY t1, seq)) SELECT id, seq, round(ds, 8) AS dspeed, round((dh + pi()) - 2 * pi() * floor((dh + pi()) / (2 * pi())) - pi(), 5) AS dhead FROM s WHERE ds IS NOT NULL")
def e21_speed_heading_steps(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(T.speed_heading_steps(_segments(spark, d)), "dspeed", digits=8), "dhead", digits=5)


@query(f"""WITH {POS}, dr AS (SELECT *, x < 10 AS dry FROM pos), f AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / (tnum - lag(tnum) OVER w) AS sp, sqrt((x - lag(x) OVER z) ** 2 + (y - lag(y) OVER z) ** 2) / (tnum - lag(tnum) OVER z) AS si, sqrt((x - lead(x) OVER z) ** 2 + (y - lead(y) OVER z) ** 2) / (lead(tnum) OVER z - tnum) AS so
FROM dr WINDOW w AS (PARTITION BY id ORDER BY tnum, seq), z AS (PARTITION BY id, dry ORDER BY tnum, seq)) SELECT id, seq, dry, coalesce(sp > 0.01, false) AS tek, NOT dry AND coalesce(si > 0.005 AND so > 0.005, false) AS consecutive, dry OR coalesce(sp > 0.01, false) OR (NOT dry AND coalesce(si > 0.005 AND so > 0.005, false)) AS flagged FROM f""")
def e22_e27_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).withColumn("depth", F.col("x"))
    flags = ["dry", "tek", "consecutive"]
    return T.combine_flags(T.flag_simple(rows, "depth", 10.0, 0.01, 0.005), flags).select("id", "seq", *flags, "flagged")


@query(f"""WITH {POS}, n AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY id) AS c, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS aft, sqrt((lag(x) OVER w - x) ** 2 + (lag(y) OVER w - y) ** 2) AS bef FROM pos WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)),
u AS (SELECT *, coalesce(max(CASE WHEN x < 5 THEN n END) OVER (PARTITION BY id), 0) AS lu FROM n), v AS (SELECT *, min(CASE WHEN x > 250 AND n > lu THEN n END) OVER (PARTITION BY id) AS fd FROM u)
SELECT id, seq, n <= lu OR coalesce(n >= fd, false) OR (n = 1 AND coalesce(aft > 25, false)) OR (n = c AND coalesce(bef > 25, false)) AS region FROM v""")
def e23_flag_region(spark: SparkSession, d: str) -> DataFrame:
    return T.flag_region(positions(spark, d), F.col("x") < 5, F.col("x") > 250).select("id", "seq", "region")


@query(DV + " SELECT id, seq, coalesce(atan2(sin(dh), cos(dh)) > pi() / 3, false) AS by_turn, coalesce(atan2(sin(dh), cos(dh)) / dt > pi() / 3 / 36000, false) AS by_rate, coalesce(dvel > 0.005, false) AS by_dvel FROM dv")
def e28_change_points(spark: SparkSession, d: str) -> DataFrame:
    import math

    return T.change_points(_segments(spark, d), math.pi / 3, math.pi / 3 / 36000, 0.005).select("id", "seq", "by_turn", "by_rate", "by_dvel")


@query(f"""WITH {POS}, p AS (SELECT *, seq % 3 AS period FROM pos WHERE tnum < 1704067200 + (seq % 3 + 1) * 864000), s AS (SELECT id, period, min(tnum) AS a, max(tnum) AS b FROM p GROUP BY 1, 2),
l AS (SELECT id, period, max(b) OVER (PARTITION BY id ORDER BY a, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) SELECT p.id, seq FROM p JOIN l USING (id, period) WHERE m IS NULL OR tnum > m""")
def e31_merge_periods(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).withColumn("period", F.col("seq") % 3).where(F.col("tnum") < 1704067200 + (F.col("period") + 1) * 864000)
    return T.merge_periods(rows).select("id", "seq")


GATES = "gates AS (SELECT id, max(CASE WHEN x > 100 AND tnum < 1704900000 THEN tnum END) AS top_last, min(CASE WHEN y > 90 AND tnum > 1705500000 THEN tnum END) AS low_first FROM pos GROUP BY id)"


@query(f"WITH {POS}, {GATES}, e AS (SELECT p.id, greatest(min(tnum), any_value(top_last)) AS a, least(max(tnum), any_value(low_first)) AS b FROM pos p LEFT JOIN gates g ON g.id = p.id GROUP BY p.id) SELECT pos.id, seq FROM pos JOIN e USING (id) WHERE tnum BETWEEN a AND b")
def e32_trim_to_gates(spark: SparkSession, d: str) -> DataFrame:
    pos = positions(spark, d)
    gates = pos.groupBy("id").agg(F.max(F.when(F.expr("x > 100 and tnum < 1704900000"), F.col("tnum"))).alias("top_last"), F.min(F.when(F.expr("y > 90 and tnum > 1705500000"), F.col("tnum"))).alias("low_first"))
    return T.trim_to_gates(pos, gates).select("id", "seq")


@query(f"""WITH {POS}, ex AS (SELECT id, min(CASE WHEN x > 150 THEN tnum END) - 1800 AS entry, min(CASE WHEN x > 200 THEN tnum END) AS ea, min(CASE WHEN y > 97 THEN tnum END) AS eb FROM pos GROUP BY id), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tnum, seq) AS n FROM pos) WHERE n = 1), lo AS (SELECT ex.id, entry, p.tnum AS t0, p.x AS x0, p.y AS y0 FROM ex ASOF LEFT JOIN pos p ON ex.id = p.id AND entry >= p.tnum), lh AS (SELECT lo.*, n.tnum AS t1, n.x AS x1, n.y AS y1 FROM lo ASOF LEFT JOIN pos n ON lo.id = n.id AND entry <= n.tnum),
entered AS (SELECT id, CASE WHEN t0 IS NULL THEN x1 WHEN t1 > t0 THEN x0 + (x1 - x0) * ((entry - t0) / (t1 - t0)) ELSE x0 END AS ax, CASE WHEN t0 IS NULL THEN y1 WHEN t1 > t0 THEN y0 + (y1 - y0) * ((entry - t0) / (t1 - t0)) ELSE y0 END AS ay FROM lh)
SELECT f.id, CASE WHEN ea IS NULL AND eb IS NULL THEN 'no_exit' WHEN eb IS NULL OR ea < eb THEN 'a' ELSE 'b' END AS route, round(coalesce(ex.entry, tnum), 4) AS entry_time, round(least(ea, eb), 4) AS exit_time, round(coalesce(ax, x), 5) AS x, round(coalesce(ay, y), 5) AS y FROM f LEFT JOIN ex USING (id) LEFT JOIN entered USING (id)""")
def e33_route_table(spark: SparkSession, d: str) -> DataFrame:
    pos = positions(spark, d)
    at = {"entry": "x > 150", "exit_a": "x > 200", "exit_b": "y > 97"}
    exits = pos.groupBy("id").agg(*[F.min(F.when(F.expr(c), F.col("tnum"))).alias(n) for n, c in at.items()])
    exits = exits.withColumn("entry", F.col("entry") - 1800)  # a gate half an hour before
    return r6(r6(T.route_table(pos, exits), "entry_time", "exit_time", digits=4), "x", "y", digits=5)


@query(f"WITH {POS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tnum DESC, seq DESC) AS n FROM pos) WHERE n = 1) SELECT id, CASE WHEN x > 30 AND y < 50 THEN 'branch' WHEN y >= 50 THEN 'main' ELSE 'none' END AS route FROM l")
def e34_route_from_end(spark: SparkSession, d: str) -> DataFrame:
    return T.route_from_end(positions(spark, d), 30.0, 50.0)


@query(f"WITH {POS} SELECT id, round(max(tnum) - min(tnum), 4) AS transit, round(min(tnum) + (max(tnum) - min(tnum)) / 2, 4) AS t FROM pos GROUP BY id")
def e35_transit_times(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.transit_times(positions(spark, d)), "transit", "t", digits=4)


@query(f"WITH {POS}, t AS (SELECT id, max(tnum) - min(tnum) AS transit, min(tnum) + (max(tnum) - min(tnum)) / 2 AS t FROM pos GROUP BY id), h AS (SELECT transit, floor(((t - 25200) - 86400 * floor((t - 25200) / 86400)) / 3600) AS hour FROM t) SELECT hour > 7 AND hour < 19 AS day, CAST(floor(transit / 86400) AS BIGINT) AS bin, count(*) AS n FROM h GROUP BY 1, 2")
def e35_transit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.transit_histogram(T.transit_times(positions(spark, d)), 86400.0)


STEP = "st AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY tnum, seq) AS step, x, atan2(y - 50, x - 30) AS a FROM pos)"


@query(f"WITH {POS}, {STEP}, m AS (SELECT id, avg(x) AS m FROM st GROUP BY id), dd AS (SELECT st.id, step, x - m AS d FROM st JOIN m USING (id)), v AS (SELECT id, avg(d * d) AS var FROM dd GROUP BY id) SELECT a.id, CAST(b.step - a.step AS INT) AS lag, round(avg(a.d * b.d) / any_value(var), 6) AS r, count(*) AS n FROM dd a JOIN dd b ON a.id = b.id AND b.step - a.step BETWEEN 0 AND 10 JOIN v ON v.id = a.id GROUP BY 1, 2")
def e36_autocorr(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    st = positions(spark, d).withColumn("step", F.row_number().over(Window.partitionBy("id").orderBy("tnum", "seq")))
    return r6(T.autocorr(st, "x", 10), "r")


@query(f"WITH {POS}, {STEP} SELECT s.id, CAST(b.step - s.step AS INT) AS lag, round(sqrt(avg(cos(s.a - b.a)) ** 2 + avg(sin(s.a - b.a)) ** 2), 6) AS r, count(*) AS n FROM st s JOIN st b ON s.id = b.id AND b.step - s.step BETWEEN 0 AND 10 GROUP BY 1, 2")
def e36_circular_autocorr(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    st = positions(spark, d).withColumn("step", F.row_number().over(Window.partitionBy("id").orderBy("tnum", "seq")))
    return r6(T.circular_autocorr(st.withColumn("a", F.atan2(F.col("y") - 50, F.col("x") - 30)), "a", 10), "r")


@query(f"WITH {POS}, l AS (SELECT id, seq, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy, coalesce(tnum - lag(tnum) OVER w, 1) AS dt FROM pos WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)) SELECT id, seq, round(dx / dt, 8) AS u_back, round(dy / dt, 8) AS v_back FROM l")
def e42_velocity_backward(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.velocity_backward(positions(spark, d)).select("id", "seq", "u_back", "v_back"), "u_back", "v_back", digits=8)


@query(VEL + " SELECT id, round(avg(urel), 6) AS mean_swim_urel, round(avg(abs(urel)), 6) AS mean_abs_swim_urel, round(avg(abs(vrel)), 6) AS mean_abs_swim_vrel FROM rel GROUP BY id")
def d14_track_means(spark: SparkSession, d: str) -> DataFrame:
    out = T.track_means(_water(spark, d), ["swim_urel"], ["swim_urel", "swim_vrel"])
    return r6(out, "mean_swim_urel", "mean_abs_swim_urel", "mean_abs_swim_vrel")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    pos = positions(spark, d).withColumns({"depth": F.col("x_sd"), "z": F.col("y_sd")})
    return T.track_quality(pos, _segments(spark, d), 36000.0)


METRICS = DV + """, q AS (SELECT id, count(*) AS ndetects, max(tnum) - min(tnum) AS t_elapsed, min(tnum) AS t0, max(x_sd) AS max_depth, avg(x_sd) AS avg_depth, avg(1 - least(1.0, y_sd / greatest(0.01, x_sd))) AS avg_ht, avg(y_sd) AS avg_z FROM pos GROUP BY id), sd AS (SELECT id, stddev_pop(speed) AS vel_sd, avg(dvel) AS dvel_mag, stddev_pop(dvel) AS dvel_sd FROM dv GROUP BY id),
metrics AS (SELECT q.*, t_elapsed / 36000 - ndetects AS non_detects, ndetects / (t_elapsed / 36000) AS frac_detects, vel_sd, dvel_mag, dvel_sd, floor(((t0 - 25200) - 86400 * floor((t0 - 25200) / 86400)) / 3600) AS hour FROM q LEFT JOIN sd USING (id))"""


@query(METRICS + " SELECT id, ndetects, round(t_elapsed, 4) AS t_elapsed, round(non_detects, 5) AS non_detects, round(frac_detects, 6) AS frac_detects, round(vel_sd, 8) AS vel_sd, round(dvel_mag, 8) AS dvel_mag, round(dvel_sd, 8) AS dvel_sd, hour > 7 AND hour < 19 AS daytime_entry, round(max_depth, 6) AS max_depth, round(avg_depth, 6) AS avg_depth, round(avg_ht, 6) AS avg_ht, round(avg_z, 6) AS avg_z FROM metrics")
def d15_track_quality(spark: SparkSession, d: str) -> DataFrame:
    out = r6(_metrics(spark, d).drop("pos_error"), "vel_sd", "dvel_mag", "dvel_sd", digits=8)
    return r6(r6(r6(out, "t_elapsed", digits=4), "non_detects", digits=5), "frac_detects", "max_depth", "avg_depth", "avg_ht", "avg_z")


@query(METRICS + " SELECT id, concat_ws(' ', CASE WHEN ndetects < 60 THEN 'invalid' END, CASE WHEN frac_detects < 0.95 THEN 'nondetects' END, CASE WHEN vel_sd > 0.02 THEN 'vel_sd' END) AS quality, ndetects < 60 OR t_elapsed > 720 * 3600.0 AS excluded FROM metrics")
def d16_classify_tracks(spark: SparkSession, d: str) -> DataFrame:
    return T.classify_tracks(_metrics(spark, d), 0.95, 0.02, 60, 720.0).select("id", "quality", "excluded")


@query(METRICS + " SELECT id, concat_ws(',', CASE WHEN t_elapsed / 3600 > 4 THEN 'hours:red' WHEN t_elapsed / 3600 > 1 THEN 'hours:yellow' END, CASE WHEN frac_detects < 0.2 THEN 'heard:red' WHEN frac_detects < 0.4 THEN 'heard:yellow' END, CASE WHEN vel_sd > 0.8 THEN 'speed:red' WHEN vel_sd > 0.6 THEN 'speed:yellow' END) AS labels FROM metrics")
def d47_metric_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.metric_labels(_metrics(spark, d).withColumn("pos_error", F.lit(0.0)))


@query(f"""WITH {SEG}, n AS (SELECT *, CAST(round_even(dt / 3600, 0) - 1 AS INT) AS n FROM seg WHERE dt > 3601), u AS (SELECT *, unnest(range(1, n)) AS i FROM n WHERE n >= 2 AND n < 120)
SELECT id, seq, CAST(i AS INT) AS i, round(x1 + (x2 - x1) * (i / n), 6) AS x, round(y1 + (y2 - y1) * (i / n), 6) AS y FROM u""")
def d20_missed_positions(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.missed_positions(_segments(spark, d), 3600.0).select("id", "seq", "i", "x", "y"), "x", "y")


@query(f"WITH {CELL} SELECT cell, count(*) AS n, count(*) / 100.0 AS density FROM cells GROUP BY cell")
def d17_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return T.cell_counts(cells, cells.select("cell").distinct().withColumn("area", F.lit(100.0)))


@query(f"WITH {CELL} SELECT cell, round(sum(x_sd) / count(x_sd), 6) AS mean, count(x_sd) AS n FROM cells GROUP BY cell")
def d18_cell_means(spark: SparkSession, d: str) -> DataFrame:
    return r6(T.cell_means(_cells(spark, d), "x_sd"), "mean")


@query(f"WITH {CELL} SELECT cell, count(DISTINCT id) AS individuals FROM cells GROUP BY cell")
def d19_cell_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return T.cell_occupancy(_cells(spark, d))


@query(f"WITH {CELL}, n AS (SELECT cell, count(*) AS n FROM cells GROUP BY cell) SELECT cell, n, row_number() OVER (ORDER BY n DESC, cell) AS rank FROM n")
def f4_rank_cells(spark: SparkSession, d: str) -> DataFrame:
    return T.rank_cells(T.cell_counts(_cells(spark, d)), "n").select("cell", "n", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POS} SELECT id, count(*) AS n FROM pos GROUP BY id ORDER BY n DESC, id LIMIT 1")
def f3_longest_track(spark: SparkSession, d: str) -> DataFrame:
    return T.longest_track(positions(spark, d))


@query(f"WITH {POS} SELECT id, tnum, seq, x, y FROM pos")
def a7_collection_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return T.from_collection(T.track_collection(positions(spark, d)))


@query(f"WITH {POS}, n AS (SELECT id, count(*) AS n FROM pos GROUP BY id) SELECT id, n, tnum, seq, x, y FROM pos JOIN n USING (id)")
def a7_collection_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Tracks with a derived column, written as a collection, read back, and laid out again."""
    at = f"{shared_folder(spark)}/a7-{uuid.uuid4().hex}"
    nested = T.track_collection(positions(spark, d))
    R.write_collection(nested.withColumn("n", F.size("track").cast("long")), at)
    back = R.read_collection(spark, at)
    return T.from_collection(back).join(back.select("id", "n"), "id")


@query(f"WITH {POS} SELECT id, 'LINESTRING (' || string_agg(CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR), ', ' ORDER BY tnum, seq) || ')' AS wkt FROM pos GROUP BY id HAVING count(*) >= 2")
def a13_tracks_to_wkt(spark: SparkSession, d: str) -> DataFrame:
    return T.tracks_to_wkt(positions(spark, d))


@query(METRICS + ", far AS (SELECT id, max(x) AS far FROM pos GROUP BY id HAVING count(*) > 5) SELECT id, ndetects, round(vel_sd, 8) AS vel_sd, far FROM metrics JOIN far USING (id)")
def c26_add_track_columns(spark: SparkSession, d: str) -> DataFrame:
    far = positions(spark, d).groupBy("id").agg(F.max("x").alias("far"), F.count(F.lit(1)).alias("n")).where("n > 5").drop("n")
    return r6(T.add_track_columns(_metrics(spark, d).select("id", "ndetects", "vel_sd"), far), "vel_sd", digits=8)
