"""Joins in time: nearest, interpolated and stepwise values of a series at given times, and clock solutions.

Points and series are put in one sorted sequence and each point looks back and ahead for the last sample; nothing is
crossed. With ``by`` the sequence is split by key. Without one, it is split into time slices: the samples just before and
after each slice are added to it, so no task sorts more than a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sequence(points: DataFrame, series: DataFrame, by: list[str], slice_s: float) -> tuple[DataFrame, list[str]]:
    """Points and samples together, with the keys that split them."""
    p = points.select(*by, F.col("t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"), F.struct(*points.columns).alias("_row"))
    s = series.select(*by, F.col("t"), F.lit(0).alias("_side"), F.col("value").cast("double").alias("_v"))
    if by:
        return p.unionByName(s, allowMissingColumns=True), by
    cut = F.floor(F.col("t") / slice_s)
    p, s = p.withColumn("_cut", cut), s.withColumn("_cut", cut)
    # The last sample before each slice that has points, and the first after it, by a summary with one row a slice.
    ends = s.groupBy("_cut").agg(F.min(F.struct("t", "_v")).alias("lo"), F.max(F.struct("t", "_v")).alias("hi"))
    slices = p.select("_cut").distinct().join(ends, "_cut", "full_outer")
    w = Window.orderBy("_cut")  # one row a slice
    edge = slices.select("_cut", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("a"), F.last("lo", True).over(Window.orderBy(F.desc("_cut")).rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
    more = edge.select("_cut", F.explode(F.array_compact(F.array("a", "b"))).alias("e")).select("_cut", F.col("e.t").alias("t"), F.lit(0).alias("_side"), F.col("e._v").alias("_v"))
    return p.unionByName(s, allowMissingColumns=True).unionByName(more, allowMissingColumns=True), ["_cut"]


def around(points: DataFrame, series: DataFrame, by: list[str] | None = None, slice_s: float = 86400.0) -> DataFrame:
    """points with t0, v0 (last sample at or before) and t1, v1 (first at or after). points: t; series: t, value; both: by."""
    rows, keys = _sequence(points, series, by or [], slice_s)
    w = Window.partitionBy(*keys).orderBy("t", "_side")
    sample = F.when(F.col("_side") == 0, F.struct("t", F.col("_v").alias("v")))
    back = F.last(sample, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last(sample, True).over(Window.partitionBy(*keys).orderBy(F.desc("t"), "_side").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.select("*", back.alias("_a"), ahead.alias("_z")).where("_side = 1")
    return out.select("_row.*", F.col("_a.t").alias("t0"), F.col("_a.v").alias("v0"), F.col("_z.t").alias("t1"), F.col("_z.v").alias("v1"))


def nearest_join(points: DataFrame, series: DataFrame, by: list[str] | None = None, tol: float | None = None) -> DataFrame:
    """near_t and near_v of the sample nearest in time, the earlier on ties; null beyond tol."""
    a = around(points, series, by)
    first = F.col("t1").isNull() | (F.col("t") - F.col("t0") <= F.col("t1") - F.col("t"))
    first = F.coalesce(first, F.lit(False))
    near_t, near_v = F.when(first, F.col("t0")).otherwise(F.col("t1")), F.when(first, F.col("v0")).otherwise(F.col("v1"))
    ok = F.lit(True) if tol is None else F.abs(F.col("t") - near_t) <= tol
    return a.withColumns({"near_t": F.when(ok, near_t), "near_v": F.when(ok, near_v)}).drop("t0", "v0", "t1", "v1")


def source_times(arrivals: DataFrame, emissions: DataFrame, by: list[str], shift: float = 0.0, drift_per_day: float = 0.0, far: float = 1000.0, good: float = 5.0) -> DataFrame:
    """Nearest emission of each arrival after setting the emitter's clock: src (as it was), src_adj, travel, is_good."""
    adjusted = emissions.select(*by, (F.col("t") + shift + drift_per_day * F.col("t") / 86400).alias("t"), F.col("t").alias("value"))
    out = nearest_join(arrivals, adjusted, by)
    travel = F.col("t") - F.col("near_t")
    return out.withColumns({"src": F.col("near_v"), "src_adj": F.col("near_t"), "travel": F.when(F.abs(travel) <= far, travel), "is_good": F.coalesce(F.abs(travel) < good, F.lit(False))}).drop("near_t", "near_v")


def _between(edge: str) -> Column:
    inside = F.when(F.col("t1") > F.col("t0"), F.col("v0") + (F.col("v1") - F.col("v0")) * ((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))).otherwise(F.col("v0"))
    both = F.when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), inside)
    return F.coalesce(both, F.col("v0"), F.col("v1")) if edge == "hold" else both


def interp_join(points: DataFrame, series: DataFrame, by: list[str] | None = None, edge: str = "hold", out: str = "value_at") -> DataFrame:
    """Linear value of the series at each point; beyond its ends the end value (hold) or null."""
    return around(points, series, by).withColumn(out, _between(edge)).drop("t0", "v0", "t1", "v1")


def snap_join(points: DataFrame, steps: DataFrame, by: list[str] | None = None, side: str = "next", out: str = "step") -> DataFrame:
    """First step at or after each point (next), or the step before and the fraction of the way to the next (alpha)."""
    a = around(points, steps, by)
    if side == "next":
        return a.withColumn(out, F.col("v1")).drop("t0", "v0", "t1", "v1")
    alpha = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    return a.withColumns({out: F.col("v0"), "alpha": F.when(F.col("t1").isNotNull() & F.col("t0").isNotNull(), alpha)}).drop("t0", "v0", "t1", "v1")


def apply_clock_offsets(det: DataFrame, offsets: DataFrame, start: float, width: float) -> DataFrame:
    """idx (intervals end at their break), offset (linear between breaks) and eposync of detections.

    offsets: rx, idx, off at break idx of equal width from start."""
    at = (F.col("t") - start) / width
    rows = det.withColumn("idx", (F.ceil(at) - 1).cast("long")).withColumn("_alpha", at - F.col("idx"))
    a = offsets.select("rx", F.col("idx").cast("long").alias("idx"), F.col("off").alias("_a"))
    b = offsets.select("rx", (F.col("idx") - 1).cast("long").alias("idx"), F.col("off").alias("_b"))
    rows = rows.join(a, ["rx", "idx"], "left").join(b, ["rx", "idx"], "left")
    rows = rows.withColumn("offset", (1 - F.col("_alpha")) * F.col("_a") + F.col("_alpha") * F.col("_b"))
    return rows.withColumn("eposync", F.col("t") + F.col("offset")).drop("_a", "_b", "_alpha")


def union_times(*series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct times of all series."""
    out = series[0].select(*(by or []), "t")
    for s in series[1:]:
        out = out.union(s.select(*(by or []), "t"))
    return out.distinct()


def two_way_clock(ab: DataFrame, ba: DataFrame, by: list[str] | None = None) -> DataFrame:
    """travel and skew at the times of either direction, and whether ab has a sample at that time."""
    keys = [*(by or []), "t"]
    flagged = ab.select(*keys, F.lit(True).alias("src_is_a")).union(ba.select(*keys, F.lit(False)))
    times = flagged.groupBy(*keys).agg(F.max("src_is_a").alias("src_is_a"))
    both = interp_join(interp_join(times, ab, by, "hold", "ab"), ba, by, "hold", "ba")
    return both.withColumns({"travel": (F.col("ab") + F.col("ba")) / 2, "skew": (F.col("ab") - F.col("ba")) / 2})


def staleness(points: DataFrame, legs: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """Sum over legs of the distance in time to the nearest sample."""
    out, total = points, F.lit(0.0)
    for i, leg in enumerate(legs):
        out = nearest_join(out, leg, by).withColumn(f"_gap{i}", F.abs(F.col("t") - F.col("near_t"))).drop("near_t", "near_v")
        total = total + F.col(f"_gap{i}")
    return out.withColumn("stale", total).select(*points.columns, "stale")


def triangle_closure(legs: list[DataFrame], by: list[str] | None = None, columns: tuple[str, ...] = ("skew", "travel", "stale"), max_stale: float = 250.0) -> DataFrame:
    """Sums of three legs' columns at the union of their times, null outside any (E41): by, t, net_<column>, and low_stale where
    the net staleness is under a limit in seconds. legs: by, t, columns."""
    out = union_times(*legs, by=by)
    for c in columns:
        total = F.lit(0.0)
        for i, leg in enumerate(legs):
            out = interp_join(out, leg.select(*(by or []), "t", F.col(c).alias("value")), by, "null", f"_{c}{i}")
            total = total + F.col(f"_{c}{i}")
        out = out.withColumn(f"net_{c}", total)
    net = out.select(*(by or []), "t", *[f"net_{c}" for c in columns])
    return net.withColumn("low_stale", F.col("net_stale") < max_stale) if "stale" in columns else net


def marks(pos: DataFrame, every: float = 120.0) -> DataFrame:
    """Position of each track at every so many seconds of it."""
    ends = pos.groupBy("id").agg(F.min("tnum").alias("a"), F.max("tnum").alias("b"))
    steps = F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) / every))
    at = ends.select("id", F.posexplode(steps).alias("mark", "_k"), "a").select("id", "mark", (F.col("a") + F.col("mark") * every).alias("t"))
    for c in ("x", "y"):
        at = interp_join(at, pos.select("id", F.col("tnum").alias("t"), F.col(c).alias("value")), ["id"], "hold", c)
    return at
