"""Places: polygons, gates, cells, triangles, sections and surfaces. Geometry is small and travels as array literals or tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import shared_folder


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Point in polygon by crossing parity; a fold over the edges, no UDF (C17)."""
    edges = [(a[0], a[1], b[0], b[1]) for a, b in zip(polygon, polygon[1:] + polygon[:1], strict=True)]
    table = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges])

    def crosses(e: Column) -> Column:
        straddles = (e[1] > y) != (e[3] > y)
        at = e[0] + F.try_divide((y - e[1]) * (e[2] - e[0]), e[3] - e[1])
        return straddles & F.coalesce(x < at, F.lit(False))

    return F.aggregate(table, F.lit(False), lambda odd, e: odd != crosses(e))


def clip_to_region(pos: DataFrame, polygon: list[tuple[float, float]], min_remaining: int = 10) -> DataFrame:
    """Positions inside; tracks with fewer than min_remaining left go."""
    left = pos.where(inside(F.col("x"), F.col("y"), polygon))
    n = left.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_remaining)
    return left.join(n.select("id"), "id", "left_semi")


#: Lines up to which they are broadcast, some 1 MB.
LINES_BROADCAST = 10_000


def _met(seg: DataFrame, lines: DataFrame, both: bool = True) -> DataFrame:
    """Segments with the lines whose box (with both false: whose x-range) they touch. Few lines are broadcast; of many, those of a
    stretch of x meet the segments there, a pair in the first stretch that both reach."""
    touch = (F.least("x1", "x2") <= F.greatest("gx1", "gx2")) & (F.greatest("x1", "x2") >= F.least("gx1", "gx2"))
    if both:
        touch = touch & (F.least("y1", "y2") <= F.greatest("gy1", "gy2")) & (F.greatest("y1", "y2") >= F.least("gy1", "gy2"))
    if lines.limit(LINES_BROADCAST + 1).count() <= LINES_BROADCAST:
        return seg.join(F.broadcast(lines), touch)
    width = max(1e-9, 2 * (lines.agg(F.avg(F.abs(F.col("gx2") - F.col("gx1")))).first()[0] or 0.0), 2 * (seg.agg(F.avg(F.abs(F.col("x2") - F.col("x1")))).first()[0] or 0.0))
    of = lambda a, b: F.sequence(F.floor(F.least(a, b) / width), F.floor(F.greatest(a, b) / width))
    a = seg.withColumn("_s", of("x1", "x2")).withColumn("_at", F.explode("_s")).withColumn("_s", F.element_at("_s", 1))
    b = lines.withColumn("_l", of("gx1", "gx2")).withColumn("_at", F.explode("_l")).withColumn("_l", F.element_at("_l", 1))
    return a.join(b, "_at").where(touch & (F.col("_at") == F.greatest("_s", "_l"))).drop("_at", "_s", "_l")


def gate_crossings(seg: DataFrame, gates: DataFrame) -> DataFrame:
    """id, gate, tnum, x, y, l2r where a segment properly crosses a gate edge (C19). gates: gate, gx1, gy1, gx2, gy2; tens of rows."""
    g = gates.where(~F.col("gate").like("%levee%"))
    met = _met(seg, g)
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("gx2") - F.col("gx1"), F.col("gy2") - F.col("gy1")
    cross = dx * ey - dy * ex
    along = F.try_divide((F.col("gx1") - F.col("x1")) * ey - (F.col("gy1") - F.col("y1")) * ex, cross)
    across = F.try_divide((F.col("gx1") - F.col("x1")) * dy - (F.col("gy1") - F.col("y1")) * dx, cross)
    met = met.withColumns({"_a": along, "_c": across, "l2r": cross > 0}).where("_a > 0 and _a < 1 and _c > 0 and _c < 1")
    return met.select("id", "gate", (F.col("t1") + F.col("_a") * (F.col("t2") - F.col("t1"))).alias("tnum"), (F.col("x1") + F.col("_a") * dx).alias("x"), (F.col("y1") + F.col("_a") * dy).alias("y"), "l2r")


def gate_summary(crossings: DataFrame) -> DataFrame:
    """Per track and gate: first and last crossing left to right, and crossings back."""
    t = F.when(F.col("l2r"), F.col("tnum"))
    return crossings.groupBy("id", "gate").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count_if(~F.col("l2r")).alias("reverse"))


def gate_totals(summary: DataFrame) -> DataFrame:
    """Per gate: tracks that crossed, crossed again, and only came back."""
    return summary.groupBy("gate").agg(F.count_if(F.col("first").isNotNull()).alias("crossed"), F.count_if(F.col("first") < F.col("last")).alias("recrossed"), F.count_if(F.col("first").isNull()).alias("uncrossed"))


def crossing_fraction(seg: DataFrame, lines: DataFrame, as_written: bool = False) -> DataFrame:
    """Place along a transect line, 0 to 1, where a track crosses it (C20). as_written tests only the line's x-range."""
    met = _met(seg, lines, not as_written)
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("gx2") - F.col("gx1"), F.col("gy2") - F.col("gy1")
    cross = dx * ey - dy * ex
    along = F.try_divide((F.col("gx1") - F.col("x1")) * ey - (F.col("gy1") - F.col("y1")) * ex, cross)
    share = F.try_divide((F.col("gx1") - F.col("x1")) * dy - (F.col("gy1") - F.col("y1")) * dx, cross)
    rows = met.withColumns({"_a": along, "fraction": share}).where("_a >= 0 and _a <= 1")
    x = F.col("x1") + F.col("_a") * dx
    ok = x.between(F.least("gx1", "gx2"), F.greatest("gx1", "gx2")) if as_written else F.col("fraction").between(0, 1)
    return rows.where(ok).select("id", "seq", F.col("gate"), "fraction")


def assign_cell(points: DataFrame, cells: DataFrame, bucket: float) -> DataFrame:
    """cell of each point, -1 outside all (C16): cells' boxes are spread over lattice buckets, points meet those of theirs.

    cells: cell, poly (array of x, y structs). points: pid, x, y. The smallest cell wins on shared edges."""
    lo = {c: F.array_min(F.col(f"poly.{c}")) for c in "xy"}
    hi = {c: F.array_max(F.col(f"poly.{c}")) for c in "xy"}
    spread = cells
    for c in "xy":
        spread = spread.withColumn(f"_b{c}", F.explode(F.sequence(F.floor(lo[c] / bucket), F.floor(hi[c] / bucket))))
    own = points.withColumns({"_bx": F.floor(F.col("x") / bucket), "_by": F.floor(F.col("y") / bucket)})
    met = own.join(spread, ["_bx", "_by"], "left")
    nxt = F.concat(F.slice("poly", F.lit(2), F.size("poly") - 1), F.slice("poly", 1, 1))
    edges = F.zip_with("poly", nxt, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    x, y = F.col("x"), F.col("y")
    hit = F.aggregate(edges, F.lit(False), lambda odd, e: odd != (((e["ay"] > y) != (e["by"] > y)) & F.coalesce(x < e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"]), F.lit(False))))
    return met.groupBy(*points.columns).agg(F.coalesce(F.min(F.when(hit, F.col("cell"))), F.lit(-1)).alias("cell"))


def sample_field(points: DataFrame, triangles: DataFrame, hydro: DataFrame, bucket: float) -> DataFrame:
    """u, v at each point, linear in the triangle that holds it at the point's step, 0 outside.

    points: pid, step, x, y; triangles: tri, and n1..n3, x1..x3, y1..y3; hydro: step, node, u, v."""
    box = {c: (F.least(*[f"{c}{i}" for i in (1, 2, 3)]), F.greatest(*[f"{c}{i}" for i in (1, 2, 3)])) for c in "xy"}
    spread = triangles
    for c in "xy":
        spread = spread.withColumn(f"_b{c}", F.explode(F.sequence(F.floor(box[c][0] / bucket), F.floor(box[c][1] / bucket))))
    own = points.withColumns({"_bx": F.floor(F.col("x") / bucket), "_by": F.floor(F.col("y") / bucket)})
    det = (F.col("y2") - F.col("y3")) * (F.col("x1") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("y1") - F.col("y3"))
    w1 = ((F.col("y2") - F.col("y3")) * (F.col("x") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("y") - F.col("y3"))) / det
    w2 = ((F.col("y3") - F.col("y1")) * (F.col("x") - F.col("x3")) + (F.col("x1") - F.col("x3")) * (F.col("y") - F.col("y3"))) / det
    met = own.join(spread, ["_bx", "_by"]).withColumns({"w1": w1, "w2": w2}).withColumn("w3", 1 - F.col("w1") - F.col("w2")).where("w1 >= -1e-9 and w2 >= -1e-9 and w3 >= -1e-9")
    one = met.groupBy("pid", "step").agg(F.min_by(F.struct("n1", "n2", "n3", "w1", "w2", "w3"), "tri").alias("t"))
    nodes = one.select("pid", "step", F.explode(F.array(*[F.struct(F.col(f"t.n{i}").alias("node"), F.col(f"t.w{i}").alias("w")) for i in (1, 2, 3)])).alias("c")).select("pid", "step", "c.node", "c.w")
    val = nodes.join(hydro, ["step", "node"]).groupBy("pid", "step").agg(F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v"))
    return points.join(val, ["pid", "step"], "left").withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in "uv"})


def sample_vorticity(points: DataFrame, triangles: DataFrame, hydro: DataFrame, bucket: float, eps: float = 2.0) -> DataFrame:
    """Vorticity by central differences of four samples around each point."""
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx * eps).alias("dx"), F.lit(dy * eps).alias("dy")) for k, (dx, dy) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])])
    near = points.select("pid", "step", F.explode(shifts).alias("s"), "x", "y")
    near = near.select(F.struct("pid", "s.k").alias("pid"), "step", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    got = sample_field(near, triangles, hydro, bucket)

    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("pid.k") == k, F.col(c)))

    return got.groupBy(F.col("pid.pid").alias("pid")).agg(((at(0, "v") - at(1, "v")) / (2 * eps) - (at(2, "u") - at(3, "u")) / (2 * eps)).alias("vorticity"))


def layer_of(particles: DataFrame, levels: DataFrame, min_top: float = 0.25) -> DataFrame:
    """Layer that holds each particle's z; a top layer thinner than min_top belongs to the next (C25). levels: step, layer, z_lo, z_hi."""
    top = levels.groupBy("step").agg(F.max_by(F.struct("layer", "z_lo", "z_hi"), "z_hi").alias("top"))
    thin = F.col("top.z_hi") - F.col("top.z_lo") < min_top
    met = particles.join(levels, "step").where((F.col("z") >= F.col("z_lo")) & (F.col("z") < F.col("z_hi"))).join(top, "step")
    return met.select(*particles.columns, F.when(thin & (F.col("layer") == F.col("top.layer")), F.col("layer") - 1).otherwise(F.col("layer")).alias("layer"))


def cell_roughness(points: DataFrame, min_n: int = 10) -> DataFrame:
    """RMS residual of the plane through each cell's points, by sums about the cell's mean (D29). points: cell, x, y, z."""
    mean = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"]).where(F.col("n") >= min_n)
    d = {c: F.col(c) - F.col(f"m{c}") for c in "xyz"}
    s = points.join(mean, "cell").groupBy("cell", "n").agg(*[F.sum(d[a] * d[b]).alias(a + b) for a, b in ("xx", "xy", "yy", "xz", "yz", "zz")])
    det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    a = F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det)
    b = F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)
    rss = F.greatest(F.lit(0.0), F.col("zz") - a * F.col("xz") - b * F.col("yz"))
    return s.select("cell", "n", F.sqrt(rss / F.col("n")).alias("roughness"))


def idw(met: DataFrame) -> DataFrame:
    """Anisotropic inverse-distance value at targets (D37). met: target, ds, dn, z for each target and sample near it."""
    w = F.pow(5 + F.hypot("ds", F.col("dn") * 50), F.lit(-2))
    return met.groupBy("target").agg((F.sum(w * F.col("z")) / F.sum(w)).alias("z"))


def idw_plane(met: DataFrame, k: int) -> DataFrame:
    """Value at the target of the weighted plane through its k nearest samples (D38). met: target, sid, ds, dn, z."""
    near = Window.partitionBy("target").orderBy(F.hypot("ds", "dn"), "sid")
    rows = met.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= k).withColumn("w", F.pow(5 + F.hypot("ds", F.col("dn") * 50), F.lit(-2)))
    mean = rows.groupBy("target").agg(F.sum("w").alias("sw"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m{c}") for c in ("ds", "dn", "z")])
    d = {c: F.col(c) - F.col(f"m{c}") for c in ("ds", "dn", "z")}
    pairs = [("ds", "ds"), ("ds", "dn"), ("dn", "dn"), ("ds", "z"), ("dn", "z")]
    s = rows.join(mean, "target").groupBy("target", "mds", "mdn", "mz").agg(*[F.sum(F.col("w") * d[a] * d[b]).alias(f"s_{a}_{b}") for a, b in pairs])
    det = F.col("s_ds_ds") * F.col("s_dn_dn") - F.col("s_ds_dn") ** 2
    a = F.try_divide(F.col("s_ds_z") * F.col("s_dn_dn") - F.col("s_dn_z") * F.col("s_ds_dn"), det)
    b = F.try_divide(F.col("s_dn_z") * F.col("s_ds_ds") - F.col("s_ds_z") * F.col("s_ds_dn"), det)
    return s.select("target", (F.col("mz") - F.coalesce(a, F.lit(0.0)) * F.col("mds") - F.coalesce(b, F.lit(0.0)) * F.col("mdn")).alias("z"))


def _in_buckets(targets: DataFrame, samples: DataFrame, bucket: float) -> DataFrame:
    """Samples in the lattice buckets of a target and around it, with offsets ds, dn."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    t = targets.select("target", F.col("x").alias("tx"), F.col("y").alias("ty"), F.floor(F.col("x") / bucket).alias("_x"), F.floor(F.col("y") / bucket).alias("_y"))
    t = t.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"_bx": F.col("_x") + F.col("_i"), "_by": F.col("_y") + F.col("_j")})
    s = samples.withColumns({"_bx": F.floor(F.col("x") / bucket), "_by": F.floor(F.col("y") / bucket)})
    return t.join(s, ["_bx", "_by"]).select("target", "sid", (F.col("x") - F.col("tx")).alias("ds"), (F.col("y") - F.col("ty")).alias("dn"), "z")


def near_samples(targets: DataFrame, samples: DataFrame, bucket: float, k: int) -> DataFrame:
    """The k nearest samples of each target (all, if fewer; ties to the smaller sid): target, sid, ds, dn, z, in the shared folder.

    Buckets are joined with their neighbours; a target whose kth sample is farther than a bucket, or that has fewer, looks again in
    buckets of twice the size, until a bucket spans the whole field. targets: target, x, y; samples: sid, x, y, z."""
    spark = targets.sparkSession
    at = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    span = [df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first() for df in (samples, targets)]
    sides = [max(r[i + 1] for r in span if r[0] is not None) - min(r[i] for r in span if r[0] is not None) for i in (0, 2)] if any(r[0] is not None for r in span) else [0.0]
    open_, n = targets.select("target", "x", "y"), 0
    nearest = Window.partitionBy("target").orderBy(F.hypot("ds", "dn"), "sid")
    while True:
        last = bucket > max(sides)
        found = _in_buckets(open_, samples, bucket).withColumn("_k", F.row_number().over(nearest)).where(F.col("_k") <= k)
        kth = F.max(F.when(F.col("_k") == k, F.hypot("ds", "dn"))).over(Window.partitionBy("target"))
        found = found.withColumn("_done", F.lit(True) if last else F.coalesce(kth <= bucket, F.lit(False)))
        found.drop("_k").write.parquet(f"{at}/round={n}")
        done = spark.read.parquet(f"{at}/round={n}").where("_done")
        if last:
            break
        open_ = open_.join(done.select("target").distinct(), "target", "left_anti")
        if open_.isEmpty():
            break
        bucket, n = bucket * 2, n + 1
    return spark.read.parquet(at).where("_done").select("target", "sid", "ds", "dn", "z")


def thin_points(df: DataFrame, q: float) -> DataFrame:
    """Points averaged on a coarse lattice."""
    return df.groupBy(F.bround(F.col("x") / q).alias("i"), F.bround(F.col("y") / q).alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))


def along_line(samples: DataFrame, x0: float, y0: float, ux: float, uy: float) -> DataFrame:
    """Distance along a section line."""
    return samples.withColumn("along", (F.col("x") - x0) * ux + (F.col("y") - y0) * uy)


def domain_share(a: DataFrame, b: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Share of positions of two solutions inside a domain, over their common period."""
    from tidewake.operators.detections import common_period

    period = common_period(a, b, "tnum")
    rows = a.select("tnum", "x", "y", F.lit("a").alias("solution")).union(b.select("tnum", "x", "y", F.lit("b").alias("solution")))
    rows = rows.crossJoin(F.broadcast(period)).where(F.col("tnum").between(F.col("start"), F.col("stop")))  # one row
    return rows.groupBy("solution").agg(F.avg(inside(F.col("x"), F.col("y"), polygon).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))
