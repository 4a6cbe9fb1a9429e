"""Tracks: segments, velocities, smoothing, outliers, routes and quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.exprs import heading, is_daytime, local_second, rotate, wrap_angle
from tidewake.operators.ordering import numbered
from tidewake.operators.timejoin import interp_join


def _w(order: str = "tnum", key: str = "id") -> Window:
    return Window.partitionBy(key).orderBy(order, "seq")


def merge_periods(pos: DataFrame, period: str = "period") -> DataFrame:
    """Tracks of a tag from several periods in order of start: of each only rows later than all before it."""
    of = pos.groupBy("id", period).agg(F.min("tnum").alias("_start"), F.max("tnum").alias("_end"))
    before = Window.partitionBy("id").orderBy("_start", period).rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("_last", F.max("_end").over(before)).select("id", period, "_last")
    return pos.join(of, ["id", period]).where(F.col("_last").isNull() | (F.col("tnum") > F.col("_last"))).drop("_last")


def make_segments(pos: DataFrame) -> DataFrame:
    """Segments between consecutive positions: ends, middles, dt, dist, u, v, speed, head; null speed unless dt > 0."""
    w = _w()
    rows = pos.select("id", "seq", F.col("x").alias("x1"), F.lead("x").over(w).alias("x2"), F.col("y").alias("y1"), F.lead("y").over(w).alias("y2"), F.col("tnum").alias("t1"), F.lead("tnum").over(w).alias("t2")).where("t2 is not null")
    dx, dy, dt = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("t2") - F.col("t1")
    step = F.when(dt > 0, dt)
    return rows.withColumns(
        {
            "xm": (F.col("x1") + F.col("x2")) / 2, "ym": (F.col("y1") + F.col("y2")) / 2, "tm": F.col("t1") + dt / 2, "dt": dt, "dist": F.sqrt(dx * dx + dy * dy),
            "u": dx / step, "v": dy / step, "speed": F.sqrt(dx * dx + dy * dy) / step, "head": heading(dx, dy),
        }
    )


def with_groundspeed(pos: DataFrame) -> DataFrame:
    """Speed over ground to the next position and its place, null on the last."""
    w = _w()
    dt = F.lead("tnum").over(w) - F.col("tnum")
    d = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))
    return pos.withColumns({"ground_speed": d / F.when(dt > 0, dt), "x_end": F.lead("x").over(w), "y_end": F.lead("y").over(w)})


def calc_velocities(pos: DataFrame) -> DataFrame:
    """Ground and swim velocity, headings, and both turned to the water's heading (E5). pos has water_u, water_v."""
    w = _w()
    dt = F.lead("tnum").over(w) - F.col("tnum")
    step = F.when(dt > 0, dt)
    gu, gv = (F.lead("x").over(w) - F.col("x")) / step, (F.lead("y").over(w) - F.col("y")) / step
    rows = pos.withColumns({"ground_u": gu, "ground_v": gv})
    rows = rows.withColumns({"swim_u": F.col("ground_u") - F.col("water_u"), "swim_v": F.col("ground_v") - F.col("water_v"), "water_hdg": F.atan2("water_v", "water_u")})
    rows = rows.withColumns({"ground_hdg": F.atan2("ground_v", "ground_u"), "swim_hdg": F.atan2("swim_v", "swim_u"), "swim_speed": F.hypot("swim_u", "swim_v")})
    urel, vrel = rotate(F.col("water_hdg"), F.col("swim_u"), F.col("swim_v"))
    gurel, gvrel = rotate(F.col("water_hdg"), F.col("ground_u"), F.col("ground_v"))
    return rows.withColumns({"swim_hdg_rel": wrap_angle(F.col("swim_hdg") - F.col("water_hdg")), "swim_urel": urel, "swim_vrel": vrel, "ground_urel": gurel, "ground_vrel": gvrel})


def delta_velocity(seg: DataFrame) -> DataFrame:
    """Change of velocity from the segment before."""
    w = _w("t1")
    return seg.withColumn("dvel", F.hypot(F.lag("u").over(w) - F.col("u"), F.lag("v").over(w) - F.col("v")))


def turn_angle(seg: DataFrame) -> DataFrame:
    """Turn at the start of each segment but the first: heading before less heading after, wrapped."""
    d = F.lag("head").over(_w("t1")) - F.col("head")
    return seg.withColumn("turn", F.atan2(F.sin(d), F.cos(d)))


def unwrap(seg: DataFrame, angle: str = "head", out: str = "unwrapped") -> DataFrame:
    """First angle and the running sum of wrapped steps."""
    w = _w("t1")
    step = F.coalesce(wrap_angle(F.col(angle) - F.lag(angle).over(w)), F.col(angle))
    return seg.withColumn("_step", step).withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def swim_path(pos: DataFrame) -> DataFrame:
    """Path by swimming alone: running sums of dt times relative velocity, from 0."""
    w = _w()
    dt = F.col("tnum") - F.lag("tnum").over(w)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = pos.withColumns({"_du": F.coalesce(dt * F.lag("swim_urel").over(w), F.lit(0.0)), "_dv": F.coalesce(dt * F.lag("swim_vrel").over(w), F.lit(0.0))})
    return rows.withColumns({"path_u": F.sum("_du").over(run), "path_v": F.sum("_dv").over(run)}).drop("_du", "_dv")


def msd_bins(pos: DataFrame, least_s: float = 600.0, width: float = 20.0) -> DataFrame:
    """Squared displacement from the start, by time bin, of tracks longer than least_s, up to it: box table."""
    w = Window.partitionBy("id")
    start = F.min(F.struct("tnum", "seq", "x", "y")).over(w)
    rows = pos.withColumns({"_s": start, "_len": F.max("tnum").over(w) - F.min("tnum").over(w)}).where(F.col("_len") > least_s)
    into = F.col("tnum") - F.col("_s.tnum")
    rows = rows.where(into <= least_s).select(F.floor(into / width).alias("bin"), ((F.col("x") - F.col("_s.x")) ** 2 + (F.col("y") - F.col("_s.y")) ** 2).alias("sd"))
    q = F.percentile("sd", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).select("bin", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))])


def _fit(value: str, t: str, w: Window, at: Column) -> Column:
    """Value at a time of the line through the frame's points; their mean where all have one time."""
    n, st, sv, stt, stv = F.count(value).over(w), F.sum(t).over(w), F.sum(value).over(w), F.sum(F.col(t) * F.col(t)).over(w), F.sum(F.col(t) * F.col(value)).over(w)
    det = n * stt - st * st
    slope = F.when(det > 1e-9, (n * stv - st * sv) / F.when(det > 1e-9, det))
    return F.coalesce(sv / n + slope * (at - st / n), sv / n)


def smooth_position(pos: DataFrame, n: int = 3) -> DataFrame:
    """Each position on the line through rows i-n to i+n-1, and the residual's size; the last row of a track is null."""
    w = _w()
    base = F.min("tnum").over(Window.partitionBy("id"))
    rows = pos.withColumns({"_t": F.col("tnum") - base, "_last": F.lead("tnum").over(w).isNull()})
    rows = rows.withColumns({"_tt": F.when(~F.col("_last"), F.col("_t")), "_x": F.when(~F.col("_last"), F.col("x")), "_y": F.when(~F.col("_last"), F.col("y"))})
    frame = w.rowsBetween(-n, n - 1)
    rows = rows.withColumns({"xs": F.when(~F.col("_last"), _fit("_x", "_tt", frame, F.col("_t"))), "ys": F.when(~F.col("_last"), _fit("_y", "_tt", frame, F.col("_t")))})
    return rows.withColumn("noise", F.hypot(F.col("x") - F.col("xs"), F.col("y") - F.col("ys"))).drop("_t", "_last", "_tt", "_x", "_y")


def smooth_velocity(pos: DataFrame, n: int = 4) -> DataFrame:
    """Slopes of x and y over the n positions up to each segment's start and the n after it, fewer at the ends."""
    w = _w()
    base = F.min("tnum").over(Window.partitionBy("id"))
    rows = pos.withColumn("_t", F.col("tnum") - base)
    frame = w.rowsBetween(1 - n, n)
    out = {"_last": F.lead("tnum").over(w).isNull()}
    for c, name in (("x", "us"), ("y", "vs")):
        k, st, sv = F.count(F.lit(1)).over(frame), F.sum("_t").over(frame), F.sum(c).over(frame)
        det = k * F.sum(F.col("_t") * F.col("_t")).over(frame) - st * st
        out[name] = (k * F.sum(F.col("_t") * F.col(c)).over(frame) - st * sv) / F.when(det > 1e-9, det)
    return rows.withColumns(out).where("not _last").drop("_t", "_last")


def expand_regular(pos: DataFrame, dt: float = 5.0, fill: str = "null", repeats: str = "error") -> DataFrame:
    """id, step, tnum, x, y with a row for every step of about dt; steps without a position are null, or with fill "linear" on the
    line between their neighbours (E15). Two positions in one step are an error, or with repeats "first" the first of them counts."""
    w = _w()
    step = F.bround((F.col("tnum") - F.lag("tnum").over(w)) / dt)
    if repeats == "error":
        step = F.when(step <= 0, F.raise_error(F.lit("two positions of a track are less than half a step apart"))).otherwise(step)
    rows = pos.withColumn("_d", F.coalesce(step, F.lit(0.0)).cast("long")).withColumn("step", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("id", "step").agg(F.min(F.struct("tnum", "seq", "x", "y")).alias("p"))
    # Every position makes the steps up to the next one, on the line to it.
    after = F.lead(F.struct("step", "p.*")).over(Window.partitionBy("id").orderBy("step"))
    out = rows.select("id", F.col("step").alias("_from"), "p", after.alias("_b")).withColumn("step", F.explode(F.sequence("_from", F.greatest(F.col("_from"), F.coalesce(F.col("_b.step") - 1, "_from")))))
    done, whole = F.col("step") - F.col("_from"), F.col("_b.step") - F.col("_from")
    between = lambda c: F.col(f"p.{c}") + F.try_divide((F.col(f"_b.{c}") - F.col(f"p.{c}")) * done, whole) if fill == "linear" else F.lit(None)
    return out.select("id", "step", *[F.when(done == 0, F.col(f"p.{c}")).otherwise(between(c)).alias(c) for c in ("tnum", "x", "y")])


def rolling_circular(seg: DataFrame, w: int = 10) -> DataFrame:
    """Circular mean and deviation of headings over rows i-w/2 to i+w/2-1, where there is more than one."""
    frame = _w("t1").rowsBetween(-(w // 2), w - w // 2 - 1)
    n, s, c = F.count("head").over(frame), F.sum(F.sin("head")).over(frame), F.sum(F.cos("head")).over(frame)
    r = F.least(F.lit(1.0), F.sqrt(s * s + c * c) / n)
    return seg.withColumns({"circ_mean": F.when(n > 1, F.atan2(s, c)), "circ_std": F.when((n > 1) & (r > 0), F.sqrt(-2 * F.log(r)))})


def multi_stride(pos: DataFrame, strides: int = 5, dt: float = 5.0, most: int = 10) -> DataFrame:
    """Median speed of every s-th row from each offset, by steps of dt spanned."""
    rows = pos.withColumn("_n", F.row_number().over(_w()) - 1).withColumn("stride", F.explode(F.sequence(F.lit(1), F.lit(strides))))
    w = Window.partitionBy("id", "stride", F.pmod("_n", "stride")).orderBy("_n")
    gap = F.lead("tnum").over(w) - F.col("tnum")
    rows = rows.select("stride", gap.alias("gap"), (F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")) / F.when(gap > 0, gap)).alias("speed"))
    rows = rows.where("speed is not null").withColumn("span", F.bround(F.col("gap") / dt).cast("long")).where(F.col("span") <= most)
    return rows.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.percentile("speed", F.lit(0.5)).alias("speed"))


def speed_heading_steps(seg: DataFrame) -> DataFrame:
    """Change of speed and of heading to the next segment."""
    w = _w("t1")
    out = seg.select("id", "seq", (F.lead("speed").over(w) - F.col("speed")).alias("dspeed"), wrap_angle(F.lead("head").over(w) - F.col("head")).alias("dhead"))
    return out.where("dspeed is not null and dhead is not null")


def flag_simple(pos: DataFrame, depth: str, min_depth: float, tek: float, consecutive: float) -> DataFrame:
    """Flags: dry (no or little depth), tek (fast arrival), consecutive (fast both ways among wet rows)."""
    dry = F.col(depth).isNull() | (F.col(depth) < min_depth)

    def speed(w: Window, of) -> Column:
        dt = F.abs(F.col("tnum") - of("tnum").over(w))
        return F.hypot(F.col("x") - of("x").over(w), F.col("y") - of("y").over(w)) / F.when(dt > 0, dt)

    rows = pos.withColumns({"dry": dry, "tek": F.coalesce(speed(_w(), F.lag) > tek, F.lit(False))})
    wet = Window.partitionBy("id", "dry").orderBy("tnum", "seq")
    both = (speed(wet, F.lag) > consecutive) & (speed(wet, F.lead) > consecutive)
    return rows.withColumn("consecutive", ~F.col("dry") & F.coalesce(both, F.lit(False)))


def flag_region(pos: DataFrame, upstream: Column, downstream: Column, max_end: float = 25.0) -> DataFrame:
    """Flags all rows up to the last upstream, all from the first later one downstream, and long first or last segments."""
    w, whole = _w(), Window.partitionBy("id")
    rows = pos.withColumns({"_n": F.row_number().over(w), "_up": upstream, "_down": downstream})
    rows = rows.withColumn("_last_up", F.coalesce(F.max(F.when(F.col("_up"), F.col("_n"))).over(whole), F.lit(0)))
    rows = rows.withColumn("_first_down", F.min(F.when(F.col("_down") & (F.col("_n") > F.col("_last_up")), F.col("_n"))).over(whole))
    after, before = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")), F.hypot(F.lag("x").over(w) - F.col("x"), F.lag("y").over(w) - F.col("y"))
    n = F.max("_n").over(whole)
    rows = rows.withColumns({"_end": ((F.col("_n") == 1) & F.coalesce(after > max_end, F.lit(False))) | ((F.col("_n") == n) & F.coalesce(before > max_end, F.lit(False)))})
    flag = (F.col("_n") <= F.col("_last_up")) | F.coalesce(F.col("_n") >= F.col("_first_down"), F.lit(False)) | F.col("_end")
    return rows.withColumn("region", flag).drop("_n", "_up", "_down", "_last_up", "_first_down", "_end")


def combine_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """flagged where any flag is set."""
    return df.withColumn("flagged", F.greatest(*[F.col(c).cast("int") for c in flags]) > 0)


def change_points(seg: DataFrame, turn: float = math.pi / 3, rate: float = math.pi / 15, dvel: float = 0.75, both_ways: bool = False) -> DataFrame:
    """Flags by turn, turn rate and change of velocity; turns to one side unless both_ways."""
    rows = delta_velocity(turn_angle(seg))
    t = F.abs("turn") if both_ways else F.col("turn")
    per_s = t / F.when(F.col("dt") > 0, F.col("dt"))
    return rows.withColumns({"by_turn": F.coalesce(t > turn, F.lit(False)), "by_rate": F.coalesce(per_s > rate, F.lit(False)), "by_dvel": F.coalesce(F.col("dvel") > dvel, F.lit(False))})


def trim_to_gates(pos: DataFrame, summary: DataFrame) -> DataFrame:
    """From the last top crossing (or start) to the first lower crossing (or end) (E32). summary: id, top_last, low_first."""
    ends = pos.groupBy("id").agg(F.min("tnum").alias("_a"), F.max("tnum").alias("_b")).join(summary, "id", "left")
    ends = ends.select("id", F.greatest("top_last", "_a").alias("_a"), F.least("low_first", "_b").alias("_b"))
    return pos.join(ends, "id").where(F.col("tnum").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def route_table(pos: DataFrame, exits: DataFrame) -> DataFrame:
    """Route by the exit gate crossed first (b if both at once), exit time, entry time and the place then (E33): on the line between the
    positions around the entry, or the first position where there is no entry. exits: id, entry, exit_a, exit_b."""
    at = exits.where("entry is not null").select("id", F.col("entry").alias("t"))
    for c in ("x", "y"):
        at = interp_join(at, pos.select("id", F.col("tnum").alias("t"), F.col(c).alias("value")), ["id"], "hold", f"_{c}")
    first = pos.groupBy("id").agg(F.min(F.struct("tnum", "seq", "x", "y")).alias("f"))
    rows = first.join(exits, "id", "left").join(at.select("id", "_x", "_y"), "id", "left")
    route = F.when(F.col("exit_a").isNull() & F.col("exit_b").isNull(), "no_exit").when(F.col("exit_b").isNull() | (F.col("exit_a") < F.col("exit_b")), "a").otherwise("b")
    return rows.select("id", route.alias("route"), F.coalesce("entry", "f.tnum").alias("entry_time"), F.least("exit_a", "exit_b").alias("exit_time"), F.coalesce("_x", "f.x").alias("x"), F.coalesce("_y", "f.y").alias("y"))


def route_from_end(pos: DataFrame, x0: float, y0: float) -> DataFrame:
    """Route by where the last position lies from a corner."""
    last = pos.groupBy("id").agg(F.max(F.struct("tnum", "seq", "x", "y")).alias("e"))
    return last.select("id", F.when((F.col("e.x") > x0) & (F.col("e.y") < y0), "branch").when(F.col("e.y") >= y0, "main").otherwise("none").alias("route"))


def transit_times(pos: DataFrame) -> DataFrame:
    """Duration and middle time of each track."""
    out = pos.groupBy("id").agg(F.min("tnum").alias("t0"), F.max("tnum").alias("t1"))
    return out.select("id", (F.col("t1") - F.col("t0")).alias("transit"), (F.col("t0") + (F.col("t1") - F.col("t0")) / 2).alias("t"))


def transit_histogram(transits: DataFrame, width: float, offset_h: int = 7) -> DataFrame:
    """Transits by bin of duration, those whose middle is by day (strictly between hours 7 and 19) apart from those by night (E35): day, bin, n."""
    day = is_daytime(F.floor(local_second(F.col("t"), offset_h) / 3600))
    return transits.groupBy(day.alias("day"), F.floor(F.col("transit") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def autocorr(steps: DataFrame, v: str, max_lag: int) -> DataFrame:
    """Autocorrelation of a series by (id, step), for lags up to max_lag and length - 1, skipping nulls."""
    m = Window.partitionBy("id")
    rows = steps.withColumn("_d", F.col(v) - F.avg(v).over(m)).withColumn("_var", F.avg(F.col("_d") ** 2).over(m))
    a = rows.where("_d is not null").select("id", "step", "_d", "_var", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    b = rows.where("_d is not null").select("id", (F.col("step")).alias("_to"), F.col("_d").alias("_e"))
    met = a.withColumn("_to", F.col("step") + F.col("lag")).join(b, ["id", "_to"])
    return met.groupBy("id", "lag").agg((F.avg(F.col("_d") * F.col("_e")) / F.first(F.when(F.col("_var") > 0, F.col("_var")))).alias("r"), F.count(F.lit(1)).alias("n"))


def circular_autocorr(steps: DataFrame, a: str, max_lag: int) -> DataFrame:
    """Resultant length of the differences of angles at each lag."""
    x = steps.where(F.col(a).isNotNull()).select("id", "step", F.col(a).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    y = steps.where(F.col(a).isNotNull()).select("id", F.col("step").alias("_to"), F.col(a).alias("_b"))
    d = F.col("_a") - F.col("_b")
    return x.withColumn("_to", F.col("step") + F.col("lag")).join(y, ["id", "_to"]).groupBy("id", "lag").agg(F.hypot(F.avg(F.cos(d)), F.avg(F.sin(d))).alias("r"), F.count(F.lit(1)).alias("n"))


def velocity_backward(pos: DataFrame) -> DataFrame:
    """Velocity of the interval before each row; the first 0."""
    w = _w()
    dt = F.coalesce(F.col("tnum") - F.lag("tnum").over(w), F.lit(1.0))
    return pos.withColumns({c: F.coalesce(F.col(a) - F.lag(a).over(w), F.lit(0.0)) / F.when(dt > 0, dt) for c, a in (("u_back", "x"), ("v_back", "y"))})


def swim_stats(seg: DataFrame) -> DataFrame:
    """Time-weighted mean and deviation of speed by track (D11), from first and second moments about the track's mean."""
    good = seg.where("speed is not null")
    mean = good.groupBy("id").agg((F.sum(F.col("speed") * F.col("dt")) / F.sum("dt")).alias("mean_speed"), F.sum("dt").alias("seconds"), F.count(F.lit(1)).alias("n"))
    spread = good.join(mean, "id").groupBy("id").agg(F.sqrt(F.sum((F.col("speed") - F.col("mean_speed")) ** 2 * F.col("dt")) / F.sum("dt")).alias("std_speed"))
    return mean.join(spread, "id")


def fastest(stats: DataFrame, k: int = 7) -> DataFrame:
    """The k tracks of highest mean speed (F2)."""
    return stats.orderBy(F.desc("mean_speed"), "id").limit(k)


def longest_track(pos: DataFrame) -> DataFrame:
    """The track with most positions."""
    return pos.groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1)


def track_means(seg: DataFrame, columns: list[str], absolute: list[str]) -> DataFrame:
    """Null-skipping means by track, of values and of absolute values."""
    return seg.groupBy("id").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.avg(F.abs(c)).alias(f"mean_abs_{c}") for c in absolute])


def track_quality(pos: DataFrame, seg: DataFrame, dt_signal: float = 5.0) -> DataFrame:
    """Detections, missed ones, share heard, speed and its change, position error, elapsed time and daytime entry (D15); where pos has
    depth (of the water) and z (below the surface) also the largest and mean depth, mean z and mean height as a share of the depth."""
    ratio = F.least(F.lit(1.0), F.col("z") / F.greatest(F.lit(0.01), "depth")) if {"z", "depth"} <= set(pos.columns) else None
    deep = [] if ratio is None else [F.max("depth").alias("max_depth"), F.avg("depth").alias("avg_depth"), F.avg(1 - ratio).alias("avg_ht"), F.avg("z").alias("avg_z")]
    p = smooth_position(pos).groupBy("id").agg(*deep, F.count(F.lit(1)).alias("ndetects"), (F.max("tnum") - F.min("tnum")).alias("t_elapsed"), F.avg("noise").alias("pos_error"), F.min("tnum").alias("_t0"))
    missed = F.col("t_elapsed") / dt_signal - F.col("ndetects")
    p = p.withColumns({"non_detects": missed, "frac_detects": F.try_divide(F.col("ndetects"), F.col("t_elapsed") / dt_signal)})
    s = delta_velocity(seg).groupBy("id").agg(F.stddev_pop("speed").alias("vel_sd"), F.avg("dvel").alias("dvel_mag"), F.stddev_pop("dvel").alias("dvel_sd"))
    hour = F.floor(F.pmod(F.col("_t0") - 7 * 3600, F.lit(86400.0)) / 3600)
    return p.join(s, "id", "left").withColumn("daytime_entry", (hour > 7) & (hour < 19)).drop("_t0")


def classify_tracks(metrics: DataFrame, min_frac: float = 0.1, max_sd: float = 0.6, min_n: int = 20, max_h: float = 0.5) -> DataFrame:
    """Quality text and exclusion."""
    text = F.concat_ws(" ", F.when(F.col("ndetects") < min_n, "invalid"), F.when(F.col("frac_detects") < min_frac, "nondetects"), F.when(F.col("vel_sd") > max_sd, "vel_sd"))
    return metrics.withColumns({"quality": text, "excluded": (F.col("ndetects") < min_n) | (F.col("t_elapsed") > max_h * 3600)})


def metric_labels(metrics: DataFrame) -> DataFrame:
    """Traffic lights of hours, share heard, variability and position error."""
    hours = F.col("t_elapsed") / 3600
    def light(name: str, red: Column, yellow: Column) -> Column:
        return F.when(red, f"{name}:red").when(yellow, f"{name}:yellow")
    labels = F.array_compact(F.array(
        light("hours", hours > 4, hours > 1), light("heard", F.col("frac_detects") < 0.2, F.col("frac_detects") < 0.4),
        light("speed", F.col("vel_sd") > 0.8, F.col("vel_sd") > 0.6), light("error", F.col("pos_error") > 4, F.col("pos_error") > 2)))
    return metrics.select("id", F.array_join(labels, ",").alias("labels"))


def missed_positions(seg: DataFrame, dt: float, most: int = 120) -> DataFrame:
    """Places where detections are missing, evenly along gaps longer than dt + 1."""
    n = (F.bround(F.col("dt") / dt) - 1).cast("int")
    rows = seg.where(F.col("dt") > dt + 1).withColumn("n", n).where((F.col("n") >= 2) & (F.col("n") < most))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    share = F.col("i") / F.col("n")
    return rows.select("id", "seq", "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * share).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * share).alias("y"))


def cell_counts(points: DataFrame, area: DataFrame | None = None) -> DataFrame:
    """Points a cell, and by its area if given (D17). points: cell; area: cell, area."""
    n = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return n if area is None else n.join(area, "cell").select("cell", "n", F.try_divide("n", "area").alias("density"))


def cell_means(seg: DataFrame, v: str = "speed") -> DataFrame:
    """Mean of a value by cell."""
    return seg.groupBy("cell").agg((F.sum(v) / F.count(v)).alias("mean"), F.count(v).alias("n"))


def cell_occupancy(points: DataFrame) -> DataFrame:
    """Distinct individuals a cell."""
    return points.groupBy("cell").agg(F.count_distinct("id").alias("individuals"))


def rank_cells(cells: DataFrame, by: str = "n") -> DataFrame:
    """Rank of cells by a value, the cell as tie-break, without one task for all (F4). cells: cell and the value; cells without a
    value come last."""
    return numbered(cells, [F.desc(by), F.col("cell")], "_k").withColumn("rank", F.col("_k") + 1).drop("_k")


def track_collection(pos: DataFrame) -> DataFrame:
    """A row for each track with its positions nested in time order."""
    return pos.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tnum", "seq", "x", "y"))).alias("track"))


def from_collection(nested: DataFrame) -> DataFrame:
    """Positions of a collection; null tracks have none."""
    return nested.select("id", F.inline("track"))


def tracks_to_wkt(pos: DataFrame) -> DataFrame:
    """Line of each track with two positions or more."""
    nested = track_collection(pos).where(F.size("track") >= 2)
    points = F.transform("track", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return nested.select("id", F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")")).alias("wkt"))


def add_track_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Derived columns of tracks side by side, by id; tracks that both have."""
    return a.join(b.select("id", *[c for c in b.columns if c not in a.columns]), "id")
