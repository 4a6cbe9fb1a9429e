"""Queries of joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import timejoin as J
from tidewake.operators import tracks as T
from tidewake.plans.registry import query
from tidewake.plans.roles import DET, HOURLY, POS, detections, hourly, positions, r6

AB = f"WITH {DET}, a AS (SELECT tag, t, seq FROM det WHERE rx = 'click'), b AS (SELECT tag, t, sensor AS value FROM det WHERE rx = 'view')"
AROUND = AB + """, ar AS (SELECT a.*, p.t AS t0, p.value AS v0 FROM a ASOF LEFT JOIN b p ON a.tag = p.tag AND a.t >= p.t), arz AS (SELECT ar.*, n.t AS t1, n.value AS v1 FROM ar ASOF LEFT JOIN b n ON ar.tag = n.tag AND ar.t <= n.t)"""
GLOBAL = f"WITH {DET}, {HOURLY}, a AS (SELECT seq, t FROM det WHERE rx = 'click'), ar AS (SELECT a.*, p.t AS t0, p.value AS v0 FROM a ASOF LEFT JOIN hourly p ON a.t >= p.t), arz AS (SELECT ar.*, n.t AS t1, n.value AS v1 FROM ar ASOF LEFT JOIN hourly n ON ar.t <= n.t)"
INTERP = "CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) ELSE v0 END"


def _a(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).where("rx = 'click'").select("tag", "t", "seq")


def _b(spark: SparkSession, d: str, rx: str = "view") -> DataFrame:
    return detections(spark, d).where(F.col("rx") == rx).select("tag", "t", F.col("sensor").alias("value"))


@query(AROUND + ", n AS (SELECT *, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN t0 ELSE t1 END AS nt, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN v0 ELSE v1 END AS nv FROM arz) SELECT tag, seq, CASE WHEN abs(t - nt) <= 36000 THEN round(nt, 6) END AS near_t, CASE WHEN abs(t - nt) <= 36000 THEN nv END AS near_v FROM n")
def c5_nearest_join(spark: SparkSession, d: str) -> DataFrame:
    return r6(J.nearest_join(_a(spark, d), _b(spark, d), ["tag"], 36000.0).select("tag", "seq", "near_t", "near_v"), "near_t")


@query(AROUND.replace("SELECT tag, t, sensor AS value FROM det WHERE rx = 'view'", "SELECT tag, t + 100 + 2 * t / 86400 / 1000 AS t, t AS value FROM det WHERE rx = 'view'") + ", n AS (SELECT *, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN t0 ELSE t1 END AS nt, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN v0 ELSE v1 END AS nv FROM arz) SELECT tag, seq, round(nv, 4) AS src, round(nt, 4) AS src_adj, CASE WHEN abs(t - nt) <= 36000 THEN round(t - nt, 4) END AS travel, coalesce(abs(t - nt) < 3600, false) AS is_good FROM n")
def c5_source_times(spark: SparkSession, d: str) -> DataFrame:
    out = J.source_times(_a(spark, d), _b(spark, d), ["tag"], 100.0, 2 / 1000, 36000.0, 3600.0)
    return r6(out.select("tag", "seq", "src", "src_adj", "travel", "is_good"), "src", "src_adj", "travel", digits=4)


@query(AROUND + f" SELECT tag, seq, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE {INTERP} END, 5) AS value_at FROM arz")
def c6_interp_hold(spark: SparkSession, d: str) -> DataFrame:
    return r6(J.interp_join(_a(spark, d), _b(spark, d), ["tag"], "hold").select("tag", "seq", "value_at"), "value_at", digits=5)


@query(GLOBAL + f" SELECT seq, round(CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN {INTERP} END, 5) AS value_at FROM arz")
def c6_interp_one_series(spark: SparkSession, d: str) -> DataFrame:
    out = J.interp_join(_a(spark, d).select("seq", "t"), hourly(spark, d), None, "null")
    return r6(out.select("seq", "value_at"), "value_at", digits=5)


@query(GLOBAL + " SELECT seq, t1 AS next_step, t0 AS last_step, CASE WHEN t1 > t0 THEN round((t - t0) / (t1 - t0), 6) WHEN t1 = t0 THEN 0 END AS alpha FROM arz")
def c7_snap_join(spark: SparkSession, d: str) -> DataFrame:
    steps = hourly(spark, d).withColumn("value", F.col("t"))
    rows = J.snap_join(_a(spark, d).select("seq", "t"), steps, None, "next", "next_step")
    return r6(J.snap_join(rows, steps, None, "alpha", "last_step").select("seq", "next_step", "last_step", "alpha"), "alpha")


@query(f"""WITH {DET}, o AS (SELECT rx.rx, i AS idx, sin(i) + length(rx.rx) AS off FROM (SELECT DISTINCT rx FROM det) rx, range(0, 31) AS r(i)), x AS (SELECT *, (t - 1704067200) / 86400 AS q FROM det), y AS (SELECT *, CAST(ceil(q) - 1 AS BIGINT) AS idx FROM x)
SELECT seq, y.idx, round((1 - (q - y.idx)) * a.off + (q - y.idx) * b.off, 6) AS "offset", round(t + (1 - (q - y.idx)) * a.off + (q - y.idx) * b.off, 4) AS eposync FROM y LEFT JOIN o a ON a.rx = y.rx AND a.idx = y.idx LEFT JOIN o b ON b.rx = y.rx AND b.idx = y.idx + 1""")
def c8_apply_clock_offsets(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    off = det.select("rx").distinct().select("rx", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("idx")).withColumn("off", F.sin("idx") + F.length("rx"))
    return r6(r6(J.apply_clock_offsets(det, off, 1704067200.0, 86400.0).select("seq", "idx", "offset", "eposync"), "offset"), "eposync", digits=4)


@query(f"WITH {DET} SELECT DISTINCT floor(t / 60) * 60 AS t FROM det WHERE rx IN ('click', 'view')")
def g2_union_times(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).withColumn("t", F.floor(F.col("t") / 60) * 60.0)
    return J.union_times(det.where("rx = 'click'"), det.where("rx = 'view'"))


def _asof(points: str, leg: str, name: str, edge: str) -> str:
    """SQL of the interpolated value of a leg at the points, by tag."""
    if edge == "hold":
        value = f"CASE WHEN z.t0 IS NULL THEN n.value WHEN n.t IS NULL THEN z.v0 WHEN n.t > z.t0 THEN z.v0 + (n.value - z.v0) * ((z.t - z.t0) / (n.t - z.t0)) ELSE z.v0 END"
    else:
        value = "CASE WHEN n.t > z.t0 THEN z.v0 + (n.value - z.v0) * ((z.t - z.t0) / (n.t - z.t0)) WHEN n.t = z.t0 THEN z.v0 END"
    return f"(SELECT z.tag, z.t, {value} AS v FROM (SELECT x.*, p.t AS t0, p.value AS v0 FROM {points} x ASOF LEFT JOIN {leg} p ON x.tag = p.tag AND x.t >= p.t) z ASOF LEFT JOIN {leg} n ON z.tag = n.tag AND z.t <= n.t) AS {name}"


LEGS = f"WITH {DET}, l1 AS (SELECT tag, t, sensor AS value FROM det WHERE rx = 'click'), l2 AS (SELECT tag, t, sensor AS value FROM det WHERE rx = 'view'), l3 AS (SELECT tag, t, sensor AS value FROM det WHERE rx = 'error'), "


@query(LEGS + f"pts AS (SELECT tag, t FROM l1 UNION SELECT tag, t FROM l2) SELECT tag, round(t, 6) AS t, round((ab.v + ba.v) / 2, 5) AS travel, round((ab.v - ba.v) / 2, 5) AS skew, EXISTS (SELECT 1 FROM l1 WHERE l1.tag = ab.tag AND l1.t = ab.t) AS src_is_a FROM {_asof('pts', 'l1', 'ab', 'hold')} JOIN {_asof('pts', 'l2', 'ba', 'hold')} USING (tag, t)")
def e40_two_way_clock(spark: SparkSession, d: str) -> DataFrame:
    out = J.two_way_clock(_b(spark, d, "click"), _b(spark, d, "view"), ["tag"])
    return r6(r6(out.select("tag", "t", "travel", "skew", "src_is_a"), "t"), "travel", "skew", digits=5)


def _gap(points: str, leg: str, name: str) -> str:
    """SQL of the distance in time to the nearest sample of a leg, by tag."""
    return f"(SELECT z.tag, z.t, least(z.t - z.t0, n.t - z.t) AS v FROM (SELECT x.*, p.t AS t0 FROM {points} x ASOF LEFT JOIN {leg} p ON x.tag = p.tag AND x.t >= p.t) z ASOF LEFT JOIN {leg} n ON z.tag = n.tag AND z.t <= n.t) AS {name}"


def _closure() -> str:
    """SQL of the sums around a triangle of three receivers' legs."""
    out, columns = "", ("skew", "travel", "stale")
    for i, (a, b) in enumerate((("l1", "l2"), ("l2", "l3"), ("l3", "l1"))):
        out += f"pts{i} AS (SELECT tag, t FROM {a} UNION SELECT tag, t FROM {b}), leg{i} AS (SELECT tag, t, (ab.v + ba.v) / 2 AS travel, (ab.v - ba.v) / 2 AS skew, ga.v + gb.v AS stale FROM {_asof(f'pts{i}', a, 'ab', 'hold')} JOIN {_asof(f'pts{i}', b, 'ba', 'hold')} USING (tag, t) JOIN {_gap(f'pts{i}', a, 'ga')} USING (tag, t) JOIN {_gap(f'pts{i}', b, 'gb')} USING (tag, t)), "
        out += "".join(f"{c}{i} AS (SELECT tag, t, {c} AS value FROM leg{i}), " for c in columns)
    out += "pts AS (SELECT tag, t FROM leg0 UNION SELECT tag, t FROM leg1 UNION SELECT tag, t FROM leg2)"
    joins = " JOIN ".join(f"{_asof('pts', f'{c}{i}', f'{c[0:2]}{i}', 'null')}" + ("" if c == "skew" and i == 0 else " USING (tag, t)") for c in columns for i in range(3))
    return f"{out}, net AS (SELECT tag, t, sk0.v + sk1.v + sk2.v AS skew, tr0.v + tr1.v + tr2.v AS travel, st0.v + st1.v + st2.v AS stale FROM {joins})"


@query(LEGS + _closure() + " SELECT tag, round(t, 6) AS t, round(skew, 5) AS net_skew, round(travel, 5) AS net_travel, round(stale, 3) AS net_stale, stale < 250000 AS low_stale FROM net")
def e41_triangle_closure(spark: SparkSession, d: str) -> DataFrame:
    rx, legs = ("click", "view", "error"), []
    for a, b in zip(rx, rx[1:] + rx[:1], strict=True):
        one, two = _b(spark, d, a), _b(spark, d, b)
        legs.append(J.staleness(J.two_way_clock(one, two, ["tag"]), [one, two], ["tag"]))
    out = J.triangle_closure(legs, ["tag"], max_stale=250_000.0)
    return r6(r6(r6(out, "t"), "net_skew", "net_travel", digits=5), "net_stale", digits=3)


@query(LEGS + "pts AS (SELECT tag, t, seq FROM det WHERE rx = 'signup'), g AS (SELECT p.seq, 1 AS leg, min(abs(p.t - l.t)) AS gap FROM pts p LEFT JOIN l1 l USING (tag) GROUP BY 1 UNION ALL SELECT p.seq, 2, min(abs(p.t - l.t)) FROM pts p LEFT JOIN l2 l USING (tag) GROUP BY 1) SELECT seq, round(CASE WHEN count(gap) = 2 THEN sum(gap) END, 4) AS stale FROM g GROUP BY seq")
def e39_staleness(spark: SparkSession, d: str) -> DataFrame:
    points = detections(spark, d).where("rx = 'signup'").select("tag", "t", "seq")
    return r6(J.staleness(points, [_b(spark, d, "click"), _b(spark, d, "view")], ["tag"]).select("seq", "stale"), "stale", digits=4)


@query(f"""WITH {POS}, e AS (SELECT id, min(tnum) AS a, max(tnum) AS b FROM pos GROUP BY id), m AS (SELECT id AS tag, unnest(range(0, CAST(floor((b - a) / 86400) AS BIGINT) + 1)) AS mark, a FROM e), pts AS (SELECT tag, mark, a + mark * 86400.0 AS t FROM m), lx AS (SELECT id AS tag, tnum AS t, x AS value FROM pos), ly AS (SELECT id AS tag, tnum AS t, y AS value FROM pos)
SELECT tag AS id, CAST(mark AS INT) AS mark, round(px.v, 5) AS x, round(py.v, 5) AS y FROM pts JOIN {_asof('pts', 'lx', 'px', 'hold')} USING (tag, t) JOIN {_asof('pts', 'ly', 'py', 'hold')} USING (tag, t)""")
def e43_marks(spark: SparkSession, d: str) -> DataFrame:
    return r6(J.marks(positions(spark, d), 86400.0).select("id", "mark", "x", "y"), "x", "y", digits=5)


@query(GLOBAL.replace("a AS (SELECT seq, t FROM det WHERE rx = 'click')", "a AS (SELECT tag AS seq, min(t) + (max(t) - min(t)) / 2 AS t FROM det GROUP BY tag)") + f" SELECT seq AS id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE {INTERP} END, 5) AS flow FROM arz")
def e35_transit_flow(spark: SparkSession, d: str) -> DataFrame:
    mid = T.transit_times(positions(spark, d)).select("id", "t")
    return r6(J.interp_join(mid, hourly(spark, d), None, "hold", "flow").select("id", "flow"), "flow", digits=5)
