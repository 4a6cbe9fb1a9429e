"""Queries of places, surveys and gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import geo as G
from tidewake.operators import survey as V
from tidewake.operators import tracks as T
from tidewake.operators import workloads as W
from tidewake.plans.registry import query
from tidewake.plans.roles import DET, GAUGE, HOURLY, POS, SEG, detections, gauge, hourly, positions, r6, table

REGION = [(10.0, 5.0), (200.0, 0.0), (260.0, 60.0), (120.0, 95.0), (30.0, 80.0)]
EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(REGION, REGION[1:] + REGION[:1], strict=True)) + ") AS e(ax, ay, bx, by_))"
IN = f"WITH {POS}, {EDGES}, inn AS (SELECT seq, count(*) FILTER ((ay > y) <> (by_ > y) AND x < ax + (y - ay) * (bx - ax) / nullif(by_ - ay, 0)) % 2 = 1 AS inside FROM pos, edges GROUP BY seq)"
GATE_ROWS = [("top", 20.0, -1.0, 60.0, 100.0), ("low", 300.0, -1.0, 80.0, 100.0), ("levee_1", 0.0, 50.0, 500.0, 51.0)]
GATES = "gates AS (SELECT * FROM (VALUES " + ", ".join(f"('{g[0]}', {g[1]}, {g[2]}, {g[3]}, {g[4]})" for g in GATE_ROWS) + ") AS g(gate, gx1, gy1, gx2, gy2))"
CROSS = f"""WITH {SEG}, {GATES}, m AS (SELECT seg.*, gates.*, (x2 - x1) * (gy2 - gy1) - (y2 - y1) * (gx2 - gx1) AS cr FROM seg, gates WHERE gate NOT LIKE '%levee%'),
c AS (SELECT *, ((gx1 - x1) * (gy2 - gy1) - (gy1 - y1) * (gx2 - gx1)) / nullif(cr, 0) AS a, ((gx1 - x1) * (y2 - y1) - (gy1 - y1) * (x2 - x1)) / nullif(cr, 0) AS b FROM m),
crossings AS (SELECT id, seq, gate, t1 + a * (t2 - t1) AS tnum, x1 + a * (x2 - x1) AS x, y1 + a * (y2 - y1) AS y, cr > 0 AS l2r, b FROM c WHERE a > 0 AND a < 1 AND b > 0 AND b < 1),
summary AS (SELECT id, gate, min(tnum) FILTER (l2r) AS first, max(tnum) FILTER (l2r) AS last, count(*) FILTER (NOT l2r) AS reverse FROM crossings GROUP BY 1, 2)"""
PROF = "prof AS (SELECT l_orderkey AS sample, l_linenumber AS layer, l_linenumber - 1 + 0.0 AS z_top, l_linenumber + 0.0 AS z_bot, l_discount - 0.04 AS u, l_tax - 0.03 AS v, l_returnflag AS transect, l_quantity AS dx, l_extendedprice / 1000 AS x FROM lineitem)"


def _gates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GATE_ROWS, "gate string, gx1 double, gy1 double, gx2 double, gy2 double")


def _crossings(spark: SparkSession, d: str) -> DataFrame:
    return G.gate_crossings(T.make_segments(positions(spark, d)), _gates(spark))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), n.alias("layer"), (n - 1.0).alias("z_top"), (n + 0.0).alias("z_bot"), (F.col("l_discount") - 0.04).alias("u"), (F.col("l_tax") - 0.03).alias("v"), F.col("l_returnflag").alias("transect"), F.col("l_quantity").alias("dx"), (F.col("l_extendedprice") / 1000).alias("x"))


@query(IN + " SELECT seq, inside FROM inn")
def c17_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d).select("seq", G.inside(F.col("x"), F.col("y"), REGION).alias("inside"))


@query(IN + ", l AS (SELECT pos.* FROM pos JOIN inn USING (seq) WHERE inside) SELECT id, seq FROM l WHERE id IN (SELECT id FROM l GROUP BY id HAVING count(*) >= 3)")
def c18_clip_to_region(spark: SparkSession, d: str) -> DataFrame:
    return G.clip_to_region(positions(spark, d), REGION, 3).select("id", "seq")


@query(CROSS + " SELECT id, gate, round(tnum, 3) AS tnum, round(x, 5) AS x, round(y, 5) AS y, l2r FROM crossings")
def c19_gate_crossings(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(_crossings(spark, d), "tnum", digits=3), "x", "y", digits=5)


@query(CROSS + " SELECT id, seq, gate, round(b, 7) AS fraction FROM crossings")
def c20_crossing_fraction(spark: SparkSession, d: str) -> DataFrame:
    lines = _gates(spark).where("gate not like '%levee%'")
    return r6(G.crossing_fraction(T.make_segments(positions(spark, d)), lines), "fraction", digits=7)


@query(CROSS + " SELECT id, gate, round(first, 3) AS first, round(last, 3) AS last, reverse FROM summary")
def d21_gate_summary(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.gate_summary(_crossings(spark, d)), "first", "last", digits=3)


@query(CROSS + " SELECT gate, count(first) AS crossed, count(*) FILTER (first < last) AS recrossed, count(*) FILTER (first IS NULL) AS uncrossed FROM summary GROUP BY gate")
def d21_gate_totals(spark: SparkSession, d: str) -> DataFrame:
    return G.gate_totals(G.gate_summary(_crossings(spark, d)))


@query(f"WITH {POS} SELECT seq AS pid, CASE WHEN x < 400 AND y < 100 THEN CAST(floor(x / 40) * 10 + floor(y / 10) AS BIGINT) ELSE -1 END AS cell FROM pos")
def c16_assign_cell(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(100).select(F.col("id").alias("cell"), (F.floor(F.col("id") / 10) * 40.0).alias("a"), (F.col("id") % 10 * 10.0).alias("b"))
    corners = F.array(*[F.struct((F.col("a") + dx).alias("x"), (F.col("b") + dy).alias("y")) for dx, dy in ((0.0, 0.0), (40.0, 0.0), (40.0, 10.0), (0.0, 10.0))])
    points = positions(spark, d).select(F.col("seq").alias("pid"), "x", "y")
    return G.assign_cell(points, grid.select("cell", corners.alias("poly")), 25.0).select("pid", "cell")


def _mesh(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A lattice of nodes 50 apart, two triangles to a square, and a linear field by step."""
    sq = spark.range(24).select(F.col("id"), (F.col("id") % 8 * 50.0).alias("a"), (F.floor(F.col("id") / 8) * 50.0).alias("b"))
    node = lambda dx, dy: ((F.floor(F.col("b") / 50) + dy) * 9 + F.floor(F.col("a") / 50) + dx).cast("long")
    out = []
    for k, corners in enumerate([((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1))]):
        out.append(F.struct((F.col("id") * 2 + k).alias("tri"), *[node(*c).alias(f"n{i}") for i, c in enumerate(corners, 1)], *[(F.col("a") + 50.0 * c[0]).alias(f"x{i}") for i, c in enumerate(corners, 1)], *[(F.col("b") + 50.0 * c[1]).alias(f"y{i}") for i, c in enumerate(corners, 1)]))
    nodes = spark.range(36).select(F.col("id").alias("node"), (F.col("id") % 9 * 50.0).alias("nx"), (F.floor(F.col("id") / 9) * 50.0).alias("ny"))
    hydro = nodes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("step", "node", (F.col("nx") * 0.01 + F.col("step")).alias("u"), (F.col("ny") * 0.02 - F.col("nx") * 0.005).alias("v"))
    return sq.select(F.inline(F.array(*out))), hydro


@query(f"WITH {POS} SELECT seq AS pid, CASE WHEN x <= 400 THEN round(x * 0.01 + seq % 4, 6) ELSE 0 END AS u, CASE WHEN x <= 400 THEN round(y * 0.02 - x * 0.005, 6) ELSE 0 END AS v FROM pos")
def c21_sample_field(spark: SparkSession, d: str) -> DataFrame:
    points = positions(spark, d).select(F.col("seq").alias("pid"), (F.col("seq") % 4).cast("int").alias("step"), "x", "y")
    return r6(G.sample_field(points, *_mesh(spark), 50.0).select("pid", "u", "v"), "u", "v")


@query(f"WITH {POS} SELECT seq AS pid, CAST(-0.005 AS DOUBLE) AS vorticity FROM pos WHERE x > 3 AND x < 397 AND y > 3 AND y < 147")
def c22_sample_vorticity(spark: SparkSession, d: str) -> DataFrame:
    points = positions(spark, d).where("x > 3 and x < 397 and y > 3 and y < 147").select(F.col("seq").alias("pid"), (F.col("seq") % 4).cast("int").alias("step"), "x", "y")
    return r6(G.sample_vorticity(points, *_mesh(spark), 50.0), "vorticity")


@query(f"""WITH {POS}, o AS (SELECT CAST(floor(x / 10) AS BIGINT) AS cell, avg(y) AS obs FROM pos GROUP BY 1), m AS (SELECT num_rx AS model, CAST(floor(x / 10) AS BIGINT) AS cell, avg(y) AS mod FROM pos GROUP BY 1, 2), v AS (SELECT cell FROM m GROUP BY cell HAVING count(mod) = 4)
SELECT cell, model, round(obs, 6) AS obs, round(mod, 6) AS mod FROM o JOIN m USING (cell) WHERE cell IN (SELECT cell FROM v)""")
def c23_pair_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).withColumn("cell", F.floor(F.col("x") / 10))
    obs = rows.groupBy("cell").agg(F.avg("y").alias("obs"))
    mods = rows.groupBy(F.col("num_rx").alias("model"), "cell").agg(F.avg("y").alias("mod"))
    return r6(V.pair_fields(obs, mods, 4), "obs", "mod")


@query("SELECT label, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders, (VALUES ('1-UR'), ('2'), ('5-L')) AS l(label) WHERE starts_with(o_orderpriority, label) GROUP BY label")
def c24_flows_by_label(spark: SparkSession, d: str) -> DataFrame:
    flows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("filename"), F.col("o_totalprice").alias("flow"))
    return r6(V.flows_by_label(flows, spark.createDataFrame([("1-UR",), ("2",), ("5-L",)], "label string")), "mean", "sd", "median", digits=4)


@query(f"WITH {POS} SELECT seq, CASE WHEN x < 490 THEN CAST(least(floor(x / 98), 3) AS BIGINT) WHEN x < 490.2 THEN 4 END AS layer FROM pos WHERE x < 490.2")
def c25_layer_of(spark: SparkSession, d: str) -> DataFrame:
    levels = spark.createDataFrame([(0, k, k * 98.0, (k + 1) * 98.0) for k in range(5)] + [(0, 5, 490.0, 490.2)], "step int, layer long, z_lo double, z_hi double")
    levels = levels.withColumn("z_hi", F.when(F.col("layer") == 3, 490.0).otherwise(F.col("z_hi"))).where("layer <> 4")
    levels = levels.withColumn("layer", F.when(F.col("layer") == 5, 5).otherwise(F.col("layer")))
    particles = positions(spark, d).select("seq", F.lit(0).alias("step"), F.col("x").alias("z"))
    return G.layer_of(particles, levels).select("seq", "layer")


@query(f"""WITH {POS}, c AS (SELECT CAST(floor(x / 50) AS BIGINT) AS cell, x, y, num_rx + x_sd AS z FROM pos), m AS (SELECT cell, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c GROUP BY cell HAVING count(*) >= 10),
s AS (SELECT cell, n, sum((x - mx) ** 2) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) ** 2) AS yy, sum((x - mx) * (z - mz)) AS xz, sum((y - my) * (z - mz)) AS yz, sum((z - mz) ** 2) AS zz FROM c JOIN m USING (cell) GROUP BY 1, 2)
SELECT cell, n, round(sqrt((zz - (xz * yy - yz * xy) / (xx * yy - xy * xy) * xz - (yz * xx - xz * xy) / (xx * yy - xy * xy) * yz) / n), 6) AS roughness FROM s""")
def d29_cell_roughness(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).select(F.floor(F.col("x") / 50).alias("cell"), "x", "y", (F.col("num_rx") + F.col("x_sd")).alias("z"))
    return r6(G.cell_roughness(rows), "roughness")


@query("WITH s AS (SELECT o_orderkey AS edge, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS sign, o_orderpriority AS section FROM orders) SELECT section, year(l_shipdate) AS time, round(sum(sign * l_quantity), 4) AS flow FROM lineitem JOIN s ON edge = l_orderkey GROUP BY 1, 2")
def d30_section_flow(spark: SparkSession, d: str) -> DataFrame:
    flux = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("time"), F.col("l_orderkey").alias("edge"), F.col("l_linenumber").alias("layer"), F.col("l_quantity").alias("q"))
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("sign"), F.col("o_orderpriority").alias("section"))
    return r6(V.section_flow(flux, edges), "flow", digits=4)


@query(f"WITH {POS}, h AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY tnum) AS i, count(*) OVER (PARTITION BY id) AS n FROM pos), w AS (SELECT id, x, CASE WHEN n = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * (i - 1) / (n - 1)) END AS w FROM h) SELECT id, CASE WHEN sum(w) <> 0 THEN round(sum(w * x) / sum(w), 5) END AS total FROM w GROUP BY id")
def d31_hann_total(spark: SparkSession, d: str) -> DataFrame:
    pos = positions(spark, d)
    return r6(V.hann_total(pos, "id", "tnum", "x"), "total", digits=5)


def _rate(rx: str, name: str) -> str:
    return f"{name} AS (SELECT floor(t / 86400) * 86400 AS t, avg(sensor) AS value FROM det WHERE rx = '{rx}' GROUP BY 1)"


def _daily(spark: SparkSession, d: str, rx: str) -> DataFrame:
    return detections(spark, d).where(F.col("rx") == rx).groupBy((F.floor(F.col("t") / 86400) * 86400.0).alias("t")).agg(F.avg("sensor").alias("value"))


def _interp(points: str, series: str, out: str) -> str:
    return f"(SELECT z.*, CASE WHEN z.t0 IS NULL THEN n.value WHEN n.t IS NULL THEN z.v0 WHEN n.t > z.t0 THEN z.v0 + (n.value - z.v0) * ((z.t - z.t0) / (n.t - z.t0)) ELSE z.v0 END AS {out} FROM (SELECT x.*, p.t AS t0, p.value AS v0 FROM {points} x ASOF LEFT JOIN {series} p ON x.t >= p.t) z ASOF LEFT JOIN {series} n ON z.t <= n.t)"


@query(f"WITH {DET}, {HOURLY}, {_rate('click', 'a')}, {_rate('error', 'b')}, ia AS (SELECT t, ia FROM {_interp('hourly', 'a', 'ia')}), ib AS (SELECT t, ib FROM {_interp('hourly', 'b', 'ib')}) SELECT hourly.t, round(ia, 5) AS branch_a, round(ib, 5) AS branch_b, round(ia + ib, 5) AS downstream FROM hourly JOIN ia USING (t) JOIN ib USING (t)")
def d32_flow_balance(spark: SparkSession, d: str) -> DataFrame:
    out = V.flow_balance(hourly(spark, d), _daily(spark, d, "click"), _daily(spark, d, "error"))
    return r6(out.select("t", "branch_a", "branch_b", "downstream"), "branch_a", "branch_b", "downstream", digits=5)


@query(f"WITH {PROF} SELECT sample, round(sum(u * (z_bot - z_top)) / sum(z_bot - z_top), 7) AS u, round(sum(v * (z_bot - z_top)) / sum(z_bot - z_top), 7) AS v FROM prof GROUP BY sample")
def d33_depth_average(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.depth_average(_profiles(spark, d), ["sample"]), "u", "v", digits=7)


@query(f"WITH {PROF}, o AS (SELECT *, greatest(0.0, least(z_bot, 2.5) - z_top) AS dz FROM prof) SELECT sample, CASE WHEN sum(dz) > 0 THEN round(sum(u * dz) / sum(dz), 7) END AS u, CASE WHEN sum(dz) > 0 THEN round(sum(v * dz) / sum(dz), 7) END AS v FROM o GROUP BY sample")
def d33_top_average(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.depth_average(_profiles(spark, d), ["sample"], 2.5), "u", "v", digits=7)


@query(f"WITH {PROF}, q AS (SELECT sample, layer, max(u) AS u FROM prof GROUP BY 1, 2) SELECT sample, min_by(u, layer) AS surface FROM q WHERE u > 0 GROUP BY sample")
def d33_surface_value(spark: SparkSession, d: str) -> DataFrame:
    rows = _profiles(spark, d).groupBy("sample", "layer").agg(F.max("u").alias("u")).withColumn("u", F.when(F.col("u") > 0, F.col("u")))
    return V.surface_value(rows, ["sample"])


@query(f"WITH {PROF}, m AS (SELECT transect, atan2(sum(v), sum(u)) AS a FROM prof GROUP BY transect) SELECT transect, layer, round(sum(u * cos(a) + v * sin(a)), 4) AS stream, round(sum(v * cos(a) - u * sin(a)), 4) AS lateral FROM prof JOIN m USING (transect) GROUP BY 1, 2")
def d34_rozovski(spark: SparkSession, d: str) -> DataFrame:
    out = V.rozovski(_profiles(spark, d), ["transect"]).groupBy("transect", "layer").agg(F.sum("stream").alias("stream"), F.sum("lateral").alias("lateral"))
    return r6(out, "stream", "lateral", digits=4)


@query(f"WITH {PROF} SELECT transect, round(sum(u * (z_bot - z_top) * dx), 3) AS flow, round(sum((z_bot - z_top) * dx), 3) AS area, round(sum(u * (z_bot - z_top) * dx) / sum((z_bot - z_top) * dx), 8) AS mean_velocity FROM prof GROUP BY transect")
def d35_transect_flow(spark: SparkSession, d: str) -> DataFrame:
    out = V.transect_flow(_profiles(spark, d).withColumnRenamed("u", "un"))
    return r6(r6(out, "flow", "area", digits=3), "mean_velocity", digits=8)


@query(f"""WITH prof AS (SELECT l_returnflag AS transect, l_linestatus AS run, l_orderkey AS sample, l_extendedprice / 1000 AS x, l_quantity AS dx, l_linenumber AS layer, l_discount - 0.04 AS u, 0.5 + l_discount AS dz FROM lineitem),
places AS (SELECT transect, run, sample, avg(x) AS x, avg(dx) AS y FROM prof GROUP BY 1, 2, 3), st AS (SELECT transect, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM places WINDOW w AS (PARTITION BY transect, run ORDER BY sample)),
b AS (SELECT * FROM (SELECT transect, quantile_cont(d, 0.5) AS db FROM st GROUP BY 1) JOIN (SELECT transect, quantile_cont(dz, 0.1) AS zb FROM prof GROUP BY 1) USING (transect)), m AS (SELECT transect AS section, avg(x) AS mx, avg(dx) AS my, 0.5 * atan2(2 * covar_pop(x, dx), var_pop(x) - var_pop(dx)) AS a FROM prof GROUP BY 1)
SELECT section, CAST(floor(((x - mx) * cos(a) + (dx - my) * sin(a)) / db) AS BIGINT) AS dbin, CAST(floor(layer / zb) AS BIGINT) AS zbin, round(avg(u), 6) AS u, count(*) AS n FROM prof JOIN m ON section = transect JOIN b USING (transect) GROUP BY 1, 2, 3""")
def d36_average_transects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("transect"), F.col("l_orderkey").alias("sample"), (F.col("l_extendedprice") / 1000).alias("x"),
        F.col("l_quantity").alias("y"), F.col("l_linenumber").alias("z"), (F.col("l_discount") - 0.04).alias("u"), (0.5 + F.col("l_discount")).alias("dz"))
    return r6(V.average_transects(rows), "u")


TARGETS = "tg AS (SELECT i AS target, 20.0 + 20 * (i % 10) AS tx, 15.0 + 15 * (i // 10) AS ty FROM range(0, 50) r(i)), met AS (SELECT target, seq AS sid, x - tx AS ds, y - ty AS dn, x_sd AS z FROM tg, pos), w AS (SELECT *, (5 + sqrt(ds ** 2 + (50 * dn) ** 2)) ** -2 AS w FROM met), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sqrt(ds * ds + dn * dn), sid) AS r FROM w) WHERE r <= 8)"


def _met(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.range(50).select(F.col("id").alias("target"), (20.0 + 20 * (F.col("id") % 10)).alias("x"), (15.0 + 15 * F.floor(F.col("id") / 10)).alias("y"))
    samples = positions(spark, d).select(F.col("seq").alias("sid"), "x", "y", F.col("x_sd").alias("z"))
    return G.near_samples(targets, samples, 20.0, 8)


@query(f"WITH {POS}, {TARGETS} SELECT target, round(sum(w * z) / sum(w), 6) AS z FROM k GROUP BY target")
def d37_idw(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.idw(_met(spark, d)), "z")


@query(f"""WITH {POS}, {TARGETS}, m AS (SELECT target, sum(w * ds) / sum(w) AS ms, sum(w * dn) / sum(w) AS mn, sum(w * z) / sum(w) AS mz FROM k GROUP BY target),
s AS (SELECT target, ms, mn, mz, sum(w * (ds - ms) ** 2) AS ss, sum(w * (ds - ms) * (dn - mn)) AS sn, sum(w * (dn - mn) ** 2) AS nn, sum(w * (ds - ms) * (z - mz)) AS sz, sum(w * (dn - mn) * (z - mz)) AS nz FROM k JOIN m USING (target) GROUP BY 1, 2, 3, 4)
SELECT target, round(mz - coalesce((sz * nn - nz * sn) / nullif(ss * nn - sn * sn, 0), 0) * ms - coalesce((nz * ss - sz * sn) / nullif(ss * nn - sn * sn, 0), 0) * mn, 3) AS z FROM s""")
def d38_idw_plane(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.idw_plane(_met(spark, d), 8), "z", digits=3)


@query(f"WITH {POS} SELECT round_even(x / 25, 0) AS i, round_even(y / 25, 0) AS j, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(x_sd), 6) AS z, count(*) AS n FROM pos GROUP BY 1, 2")
def d39_thin_points(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.thin_points(positions(spark, d).withColumn("z", F.col("x_sd")), 25.0), "x", "y", "z")


@query(IN + ", a AS (SELECT pos.*, inside FROM pos JOIN inn USING (seq)), p AS (SELECT greatest(min(tnum) FILTER (num_rx = 1), min(tnum) FILTER (num_rx = 2)) AS s, least(max(tnum) FILTER (num_rx = 1), max(tnum) FILTER (num_rx = 2)) AS e FROM pos) SELECT CASE WHEN num_rx = 1 THEN 'a' ELSE 'b' END AS solution, round(avg(CAST(inside AS INT)), 8) AS share, count(*) AS n FROM a, p WHERE num_rx <= 2 AND tnum BETWEEN s AND e GROUP BY 1")
def d46_domain_share(spark: SparkSession, d: str) -> DataFrame:
    pos = positions(spark, d)
    return r6(G.domain_share(pos.where("num_rx = 1"), pos.where("num_rx = 2"), REGION), "share", digits=8)


@query(f"WITH {DET}, {POS}, {_rate('view', 'u')}, {_rate('click', 'b')}, s AS (SELECT u.t, least(1.0, b.value / u.value) AS value FROM u JOIN b USING (t)), tr AS (SELECT id, min(tnum) + (max(tnum) - min(tnum)) / 2 AS t FROM pos GROUP BY id) SELECT id, round(split, 6) AS split FROM {_interp('tr', 's', 'split')}")
def d45_flow_split(spark: SparkSession, d: str) -> DataFrame:
    tracks = T.transit_times(positions(spark, d)).select("id", "t")
    return r6(V.flow_split(_daily(spark, d, "view"), _daily(spark, d, "click"), tracks).select("id", "split"), "split")


@query(f"WITH {DET}, {GAUGE}, sv AS (SELECT o_orderpriority || o_orderstatus AS survey, avg(epoch_us(o_orderdate) / 1e6) AS t, sum(o_totalprice) AS flow FROM orders GROUP BY 1) SELECT round(avg(flow / g), 4) AS mean_ratio, count(*) AS n FROM {_interp('sv', 'gauge', 'g')}")
def d48_flow_ratio(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.select(F.concat("o_orderpriority", "o_orderstatus").alias("survey"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("t"), F.col("o_totalprice").alias("flow"))
    return r6(V.flow_ratio(rows, gauge(spark, d)), "mean_ratio", digits=4)


@query(f"WITH {POS} SELECT seq, round((x - 10) * 0.6 + (y - 5) * 0.8, 6) AS along FROM pos")
def e47_along_line(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.along_line(positions(spark, d), 10.0, 5.0, 0.6, 0.8).select("seq", "along"), "along")


@query("SELECT l_orderkey AS sample, l_linenumber AS line, c.layer, c.beam, c.quantity, c.value FROM lineitem, LATERAL (VALUES (0, NULL, 'Ve', l_discount), (1, NULL, 'Ve', l_tax), (0, 1, 'snr', l_quantity), (1, 2, 'snr', l_quantity / 2)) AS c(layer, beam, quantity, value)")
def a10_melt_adcp(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("Cell1 Ve (m/s)"), F.col("l_tax").alias("Cell2 Ve (m/s)"), F.col("l_quantity").alias("Cell1 SNR2 (db)"), (F.col("l_quantity") / 2).alias("Cell2 SNR3 (db)"))
    return V.melt_adcp(rows, ["sample", "line"])


@query(f"WITH {DET}, g AS (SELECT t, lead(t) OVER (ORDER BY t) - t AS gap FROM det WHERE rx = 'view') SELECT round(min(t), 4) AS lo, round(max(t), 4) AS hi, round(max(gap), 4) AS gap, min(t) <= 1704100000 AND max(t) >= 1706500000 AND max(gap) < 9000 AS covers FROM g")
def a9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.coverage(detections(spark, d).where("rx = 'view'"), 1704100000.0, 1706500000.0, 9000.0), "lo", "hi", "gap", digits=4)


SCREENED = CROSS.replace(POS, POS.replace("pos AS", "raw AS", 1) + """, g AS (SELECT * FROM raw WHERE num_rx >= 2 AND sqrt(x_sd ** 2 + y_sd ** 2) <= 30), ge AS (SELECT id, min(tnum) AS a, max(tnum) AS b FROM g WHERE num_rx > 2 GROUP BY id),
tw AS (SELECT g.* FROM g JOIN ge USING (id) WHERE tnum BETWEEN a AND b), pos AS (SELECT * FROM tw WHERE id IN (SELECT id FROM tw GROUP BY id HAVING max(tnum) - min(tnum) < 2588000 AND count(*) >= 5))""", 1)


@query(SCREENED + """, ends AS (SELECT id, max(last) FILTER (gate = 'top') AS entered, min(first) FILTER (gate = 'low') AS left_, CAST(sum(reverse) AS BIGINT) AS reversals FROM summary GROUP BY id),
sp AS (SELECT id, min(tnum) AS lo, max(tnum) AS hi FROM pos GROUP BY id), kept AS (SELECT pos.*, entered, left_, reversals FROM pos JOIN sp USING (id) LEFT JOIN ends USING (id) WHERE tnum BETWEEN greatest(entered, lo) AND least(left_, hi) AND id % 7 <> 3),
vel AS (SELECT *, lead(tnum) OVER w - tnum AS dt, sqrt(((lead(x) OVER w - x) / (lead(tnum) OVER w - tnum) - sin(tnum / 3600)) ** 2 + ((lead(y) OVER w - y) / (lead(tnum) OVER w - tnum) - cos(tnum / 3600)) ** 2) AS speed FROM kept WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)),
ms AS (SELECT id, sum(speed * dt) / sum(dt) AS mean_speed, sum(dt) AS seconds, count(*) AS n FROM vel WHERE speed IS NOT NULL GROUP BY id), sds AS (SELECT id, sqrt(sum((speed - mean_speed) ** 2 * dt) / sum(dt)) AS std_speed FROM vel JOIN ms USING (id) WHERE speed IS NOT NULL GROUP BY id),
q AS (SELECT id, sqrt(avg(x_sd ** 2 + y_sd ** 2)) AS rms_error, any_value(entered) AS entered, any_value(left_) AS left_, coalesce(any_value(reversals), 0) AS reversals FROM kept GROUP BY id)
SELECT id, round(rms_error, 6) AS rms_error, round(entered, 3) AS entered, round(left_, 3) AS "left", reversals, round(mean_speed, 7) AS mean_speed, round(seconds, 3) AS seconds, n, round(std_speed, 7) AS std_speed FROM q LEFT JOIN ms USING (id) LEFT JOIN sds USING (id)""")
def workload_screened_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Workload 2 over all events: positions of periods of ten days to screened tracks, a row each."""
    pos = positions(spark, d).withColumns({"period": F.floor(F.col("tnum") / 864000), "water_u": F.sin(F.col("tnum") / 3600), "water_v": F.cos(F.col("tnum") / 3600)})
    predators = pos.select("id").distinct().where("id % 7 = 3")
    out = W.swim_metrics(W.screened_tracks(pos, _gates(spark), predators, "top", "low", 30.0, 2588000.0, 5))
    return r6(r6(r6(out, "rms_error"), "entered", "left", "seconds", digits=3), "mean_speed", "std_speed", digits=7)
