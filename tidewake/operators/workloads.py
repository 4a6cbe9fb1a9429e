"""Chains of operators as a study runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import cleaning as C
from tidewake.operators import detections as D
from tidewake.operators import geo as G
from tidewake.operators import tracks as T


def clean_detections(lines: DataFrame, rx: DataFrame, lo: float, hi: float, limits: dict[str, tuple[float, float]], min_gap: float = 1.0) -> DataFrame:
    """Parsed receiver lines to clean detections with places (workload 1): rx, seq, segment, tag, t, the sensors, rx_x, rx_y, beacon.

    Exact times (B1) from lo to hi (B2), sensors beyond their limits null (B3), each receiver's record cut to where its first sensor
    has values (B4), its beacon the most frequent tag (D2), segments at clock sets and steps back of time in the order of lines (E2),
    multipath within segments dropped (E1), receivers' places (C1). lines: rx, line_no, type, time, t_usec (part of a second), tag
    (hexadecimal), the sensors; rx: rx, rx_x, rx_y."""
    sync = F.col("type") == "SYNC"
    t = F.when(~sync, F.unix_seconds("time") + F.col("t_usec"))
    rows = lines.where(F.col("type").isin("DET", "SYNC")).select("rx", F.col("line_no").alias("seq"), sync.alias("_sync"), F.conv("tag", 16, 10).cast("long").alias("tag"), t.alias("t"), *[F.when(~sync, F.col(c)).alias(c) for c in limits])
    rows = C.null_out_of_range(rows.where(F.col("_sync") | F.col("t").between(lo, hi)), limits)
    rows = C.trim_to_valid(rows, "rx", "seq", next(iter(limits)))
    beacon = D.infer_beacon(rows.where("not _sync")).select("rx", "beacon")
    split = D.split_on_resets(rows, F.col("_sync")).drop("_sync", "rx_segment")
    left = D.remove_multipath(split, ("rx", "segment"), min_gap)
    return D.with_rx_location(left, rx).join(beacon, "rx", "left")


def screened_tracks(pos: DataFrame, gates: DataFrame, predators: DataFrame, top: str, low: str, max_sd: float = 10.0, max_s: float = 3600.0, min_n: int = 10) -> DataFrame:
    """Raw positions to swimming tracks (workload 2): periods merged (E31), weak positions and short tracks dropped (B19, B20), tracks cut
    to the stretch between two gates (C19, D21, E32), swim velocity against the water (E5), predators left out (C4).

    pos: id, seq, period, tnum, x, y, x_sd, y_sd, num_rx, water_u, water_v; gates as for gate_crossings: tens; predators: id."""
    merged = T.merge_periods(pos)
    good = C.screen_tracks(C.trim_weak(merged, max_sd), max_s, min_n)
    crossed = G.gate_summary(G.gate_crossings(T.make_segments(good), gates))
    ends = crossed.groupBy("id").agg(F.max(F.when(F.col("gate") == top, F.col("last"))).alias("top_last"), F.min(F.when(F.col("gate") == low, F.col("first"))).alias("low_first"), F.sum("reverse").alias("reversals"))
    swum = T.calc_velocities(T.trim_to_gates(good, ends.select("id", "top_last", "low_first")))
    return swum.join(ends, "id", "left").join(predators.select("id"), "id", "left_anti")


def swim_metrics(swum: DataFrame) -> DataFrame:
    """A row for each screened track: time-weighted swim speed (D11), RMS position error, gates and turns back."""
    dt = F.lead("tnum").over(Window.partitionBy("id").orderBy("tnum", "seq")) - F.col("tnum")
    stats = T.swim_stats(swum.select("id", F.col("swim_speed").alias("speed"), dt.alias("dt")))
    error = swum.groupBy("id").agg(F.sqrt(F.avg(F.col("x_sd") ** 2 + F.col("y_sd") ** 2)).alias("rms_error"), F.first("top_last").alias("entered"), F.first("low_first").alias("left"), F.coalesce(F.first("reversals"), F.lit(0)).alias("reversals"))
    return error.join(stats, "id", "left")
