"""Row filters and repairs of detections and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_bad_times(df: DataFrame, t: str, lo, hi) -> DataFrame:
    """Rows with lo <= t <= hi (B2)."""
    return df.where(F.col(t).between(lo, hi))


def null_out_of_range(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Sensor values outside their limits become null, rows stay."""
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in limits.items()})


def trim_to_valid(df: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """From each key's first to its last row with a value of col, in the order given."""
    seen = df.where(F.col(col).isNotNull()).groupBy(key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    return df.join(seen, key).where(F.col(order).between(F.col("_lo"), F.col("_hi"))).select(df.columns)


def clip_time(df: DataFrame, t: str, t0, t1) -> DataFrame:
    """Rows with t0 <= t < t1."""
    return df.where((F.col(t) >= t0) & (F.col(t) < t1))


def minmax(df: DataFrame, col: str, out: str, by: str | None = None) -> DataFrame:
    """col scaled to 0..1 over all rows or within by."""
    return _scaled(df, col, out, by, (F.min(col), F.max(col)), lambda x, a, b: F.try_divide(x - a, b - a))


def demean(df: DataFrame, col: str, out: str, by: str | None = None) -> DataFrame:
    """col less its mean."""
    return _scaled(df, col, out, by, (F.avg(col), F.avg(col)), lambda x, a, b: x - a)


def zscore(df: DataFrame, col: str, out: str, by: str | None = None) -> DataFrame:
    """col less its mean, by its sample deviation."""
    return _scaled(df, col, out, by, (F.avg(col), F.stddev_samp(col)), lambda x, a, b: F.try_divide(x - a, b))


def _scaled(df: DataFrame, col: str, out: str, by: str | None, two: tuple[Column, Column], f) -> DataFrame:
    """Statistics by key are joined back; overall ones are a single row."""
    a, b = two
    if by:
        stats = df.groupBy(by).agg(a.alias("_a"), b.alias("_b"))
        joined = df.join(stats, by)
    else:
        joined = df.crossJoin(F.broadcast(df.agg(a.alias("_a"), b.alias("_b"))))  # one row
    return joined.select(*df.columns, f(F.col(col), F.col("_a"), F.col("_b")).alias(out))


def trim_weak(pos: DataFrame, max_sd: float = 10.0) -> DataFrame:
    """Positions of two receivers or more and small error, from a track's first to its last of more than two."""
    good = pos.where((F.col("num_rx") >= 2) & (F.sqrt(F.col("x_sd") ** 2 + F.col("y_sd") ** 2) <= max_sd))
    ends = good.where("num_rx > 2").groupBy("id").agg(F.min("tnum").alias("_lo"), F.max("tnum").alias("_hi"))
    return good.join(ends, "id").where(F.col("tnum").between(F.col("_lo"), F.col("_hi"))).select(pos.columns)


def screen_tracks(pos: DataFrame, max_s: float = 3600.0, min_n: int = 10) -> DataFrame:
    """Tracks that last less than max_s and have min_n positions or more."""
    ok = pos.groupBy("id").agg(F.count(F.lit(1)).alias("n"), (F.max("tnum") - F.min("tnum")).alias("s")).where((F.col("s") < max_s) & (F.col("n") >= min_n))
    return pos.join(ok.select("id"), "id", "left_semi")


def fish_like(counts: DataFrame, pattern: str = "^[^F][^F]..$", least: int = 10) -> DataFrame:
    """Tags that look like fish and are heard more than least times; counts: tag, n."""
    return counts.where(F.col("tag").rlike(pattern) & (F.col("n") > least))


def drop_no_fix(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Rows with a position: longitude 0 means none."""
    return df.where(F.col(lon) != 0)


def drop_short(df: DataFrame, key: str, t: str, lo, hi, min_s: float = 3600.0, exclude: tuple = ()) -> DataFrame:
    """Keys whose record overlaps the study range by more than min_s and that are not excluded."""
    span = F.least(F.max(t), F.lit(hi)) - F.greatest(F.min(t), F.lit(lo))
    ok = df.groupBy(key).agg(span.alias("_s")).where(F.col("_s") > min_s)
    out = df.join(ok.select(key), key, "left_semi")
    return out.where(~F.col(key).isin(*exclude)) if exclude else out


def expand_beams(df: DataFrame, mhz: int = 1, tilt_deg: float = 25.0, blank: float = 0.41) -> DataFrame:
    """Five soundings from a record (rec, x, y, phi, depth_v, depth_1..4): the vertical beam and four slant ones."""
    turn = 0.25 if mhz == 3 else 0.0  # in units of pi
    beams = [F.struct(F.lit(0).alias("beam"), F.col("x").alias("bx"), F.col("y").alias("by"), (-F.col("depth_v")).alias("z"))]
    for k in range(1, 5):
        r = F.tan(F.radians(F.lit(tilt_deg))) * (F.col(f"depth_{k}") - blank)
        a = F.col("phi") + F.pi() * ((k - 1) * 0.5 + turn)
        beams.append(F.struct(F.lit(k).alias("beam"), (F.col("x") + r * F.cos(a)).alias("bx"), (F.col("y") + r * F.sin(a)).alias("by"), (-F.col(f"depth_{k}")).alias("z")))
    return df.select("rec", F.inline(F.array(*beams)))


def vertical_position(df: DataFrame) -> DataFrame:
    """depth, height (above the bed), wet and rel_height from z (height of the sensor), level and bed."""
    depth = F.col("level") - F.col("bed")
    below = F.col("level") - F.col("z")
    return df.withColumns({"depth": depth, "height": F.col("z") - F.col("bed"), "wet": F.col("level") > F.col("bed"), "rel_height": 1 - F.least(F.lit(1.0), below / F.greatest(F.lit(0.01), depth))})


def change_velocity_ref(df: DataFrame) -> DataFrame:
    """Bottom-track velocity from GPS-referenced: plus boat less bottom (B25). Columns v, boat, bottom; adds v_bt."""
    return df.withColumn("v_bt", F.col("v") + (F.col("boat") - F.col("bottom")))


def split_epoch(df: DataFrame, t: str = "t") -> DataFrame:
    """epo (whole seconds) and frac of a time in seconds."""
    return df.withColumns({"epo": F.floor(t), "frac": F.col(t) - F.floor(t)})


def pings_to_long(wide: DataFrame, key: str | list[str], receivers: list[str]) -> DataFrame:
    """A row for each receiver that heard a ping."""
    return wide.unpivot(key, receivers, "rx", "toa").where("toa is not null")


