"""Boat surveys, gauges and sections: depth averages, rotation, discharge, flow balance and comparison with models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.exprs import rotate
from tidewake.operators.ordering import numbered, parts_of, quantile_by, small
from tidewake.operators.timejoin import interp_join
from tidewake.session import kept


def pair_fields(obs: DataFrame, mods: DataFrame, n_models: int) -> DataFrame:
    """Observed and modelled cells that are valid in all models (C23). obs: cell, obs; mods: model, cell, mod."""
    met = obs.where("obs is not null").join(mods, "cell").withColumn("_v", F.count("mod").over(Window.partitionBy("cell")))
    return met.where(F.col("_v") == n_models).drop("_v")


def flows_by_label(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean, population deviation and median of flows whose file name starts with a label."""
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.length("filename")), lambda n: F.substring(F.col("filename"), F.lit(1), n))).alias("label")
    met = flows.select("*", starts).join(labels, "label")
    return met.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("flow").alias("mean"), F.stddev_pop("flow").alias("sd"), F.percentile("flow", F.lit(0.5)).alias("median"))


def section_flow(edge_flux: DataFrame, section_edges: DataFrame) -> DataFrame:
    """Flow through sections: signed sums over edges and layers, skipping nulls (D30). edge_flux: time, edge, layer, q; section_edges: section, edge, sign."""
    return edge_flux.join(section_edges, "edge").groupBy("section", "time").agg(F.sum(F.col("sign") * F.col("q")).alias("flow"))


def hann_total(series: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """Mean of a series under a normalised Hann window."""
    w = Window.partitionBy(key)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    weight = F.when(n == 1, 1.0).otherwise(0.5 - 0.5 * F.cos(2 * F.pi() * (i - 1) / F.when(n > 1, n - 1)))
    return series.withColumn("_w", weight).groupBy(key).agg(F.try_divide(F.sum(F.col("_w") * F.col(v)), F.sum("_w")).alias("total"))


def flow_balance(upstream: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Two downstream gauges at the upstream one's times, and their sum."""
    rows = interp_join(upstream, a, None, "hold", "branch_a")
    rows = interp_join(rows, b, None, "hold", "branch_b")
    return rows.withColumn("downstream", F.col("branch_a") + F.col("branch_b"))


def depth_average(profiles: DataFrame, by: list[str], top: float | None = None) -> DataFrame:
    """Mean velocity over the column or its top slice, by overlap of bins (D33). profiles: z_top, z_bot (depths), u, v."""
    dz = F.col("z_bot") - F.col("z_top") if top is None else F.greatest(F.lit(0.0), F.least(F.col("z_bot"), F.lit(top)) - F.col("z_top"))
    rows = profiles.withColumn("_dz", dz).where("u is not null and v is not null")
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("u") * F.col("_dz")), F.sum("_dz")).alias("u"), F.try_divide(F.sum(F.col("v") * F.col("_dz")), F.sum("_dz")).alias("v"))


def surface_value(profiles: DataFrame, by: list[str], v: str = "u") -> DataFrame:
    """First valid bin from the surface."""
    return profiles.where(F.col(v).isNotNull()).groupBy(*by).agg(F.min_by(v, "layer").alias("surface"))


def rozovski(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Each profile turned to its depth-mean direction: stream and lateral."""
    mean = depth_average(profiles, by).select(*by, F.atan2("v", "u").alias("_dir"))
    stream, lateral = rotate(F.col("_dir"), F.col("u"), F.col("v"))
    return profiles.join(mean, by).withColumns({"stream": stream, "lateral": lateral}).drop("_dir")


def transect_flow(profiles: DataFrame) -> DataFrame:
    """Discharge, area and mean velocity of transects (D35). profiles: transect, un (across), z_top, z_bot, dx."""
    a = (F.col("z_bot") - F.col("z_top")) * F.col("dx")
    return profiles.groupBy("transect").agg(F.sum(F.col("un") * a).alias("flow"), F.sum(a).alias("area")).withColumn("mean_velocity", F.try_divide("flow", "area"))


def sample_spacing(profiles: DataFrame) -> DataFrame:
    """Bins for a section from its own transects (D36): section, dbin (median distance of neighbouring samples), zbin (tenth percentile
    of bin heights). profiles: section, transect, sample, x, y, dz. Samples are numbered in their order and meet their neighbours by
    number, so a section may have any number of them."""
    parts, key = parts_of(profiles), ["section", "transect", "sample"]
    at = profiles.select(*key, "x", "y").repartition(parts, *key).groupBy(*key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    at = kept(numbered(at, key, "_i", parts=parts), "samples")
    next_ = at.select((F.col("_i") - 1).alias("_i"), F.col("section").alias("_s"), F.col("transect").alias("_t"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    step = at.repartition(parts, "_i").join(next_.repartition(parts, "_i"), "_i").where(F.col("section").eqNullSafe(F.col("_s")) & F.col("transect").eqNullSafe(F.col("_t")))
    d = quantile_by(step.select("section", F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")).alias("_d")), "section", "_d", 0.5, "dbin", parts)
    return d.join(quantile_by(profiles.select("section", F.abs("dz").alias("_z")), "section", "_z", 0.1, "zbin"), "section")


def average_transects(profiles: DataFrame, dbin: float | None = None, zbin: float | None = None) -> DataFrame:
    """Repeat transects on their principal line, averaged in bins of distance and depth (D36). profiles: section, x, y, z, u, and where the
    bins are not given also transect, sample, dz, from which sample_spacing takes them."""
    if dbin is None or zbin is None:
        own = sample_spacing(profiles).select("section", F.lit(dbin).alias("_dbin") if dbin else F.col("dbin").alias("_dbin"), F.lit(zbin).alias("_zbin") if zbin else F.col("zbin").alias("_zbin"))
        rows = profiles.join(small(kept(own, "spacing")), "section")
    else:
        rows = profiles.withColumns({"_dbin": F.lit(dbin), "_zbin": F.lit(zbin)})
    mean = profiles.groupBy("section").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"), F.covar_pop("x", "y").alias("_xy"))
    mean = mean.select("section", "_mx", "_my", (0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))).alias("_a"))
    d = (F.col("x") - F.col("_mx")) * F.cos("_a") + (F.col("y") - F.col("_my")) * F.sin("_a")
    rows = rows.join(small(kept(mean, "lines")), "section")
    return rows.groupBy("section", F.floor(F.try_divide(d, "_dbin")).alias("dbin"), F.floor(F.try_divide("z", "_zbin")).alias("zbin")).agg(F.avg("u").alias("u"), F.count(F.lit(1)).alias("n"))


def flow_split(upstream: DataFrame, branch: DataFrame, tracks: DataFrame) -> DataFrame:
    """Share of flow that takes the branch, at most 1, at tracks' middle times (D45). Gauges: t, value; tracks: id, t."""
    split = upstream.select("t", F.col("value").alias("up")).join(branch.select("t", F.col("value").alias("br")), "t")
    split = split.select("t", F.least(F.lit(1.0), F.try_divide("br", "up")).alias("value"))
    return interp_join(tracks, split, None, "hold", "split")


def flow_ratio(transects: DataFrame, gauge: DataFrame) -> DataFrame:
    """Survey flow (sections that split the river summed) over gauge flow at its time, and the mean ratio (D48). transects: survey, t, flow."""
    of = transects.groupBy("survey").agg(F.avg("t").alias("t"), F.sum("flow").alias("flow"))
    rows = interp_join(of, gauge, None, "hold", "gauge").withColumn("ratio", F.try_divide("flow", "gauge"))
    return rows.agg(F.avg("ratio").alias("mean_ratio"), F.count("ratio").alias("n"))


def melt_adcp(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide cell columns (``Cell3 Ve (m/s)``, ``Cell3 SNR2 (db)``) to rows of sample, layer, beam (from 0; null without), quantity, value (A10)."""
    wide = [c for c in df.columns if c.startswith("Cell")]
    long = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in wide]).unpivot(keys, [F.col(f"`{c}`") for c in wide], "name", "value")
    name = F.col("name")
    beam = F.regexp_extract(name, r"SNR(\d+)", 1)
    return long.select(*keys, (F.regexp_extract(name, r"^Cell(\d+)", 1).cast("int") - 1).alias("layer"), F.when(beam != "", beam.try_cast("int") - 1).alias("beam"), F.when(beam != "", F.lit("snr")).otherwise(F.regexp_extract(name, r"^Cell\d+ (\w+)", 1)).alias("quantity"), "value")


def coverage(series: DataFrame, start: float, stop: float, max_gap: float) -> DataFrame:
    """lo, hi, largest gap and whether a gauge series covers a range without larger gaps (A9). Days are joined, not sorted in one task."""
    day = F.floor(F.col("t") / 86400)
    w = Window.partitionBy("_d").orderBy("t")
    rows = series.withColumn("_d", day).withColumn("_g", F.lead("t").over(w) - F.col("t"))
    days = rows.groupBy("_d").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max("_g").alias("g"))
    days = days.withColumn("_h", F.lead("lo").over(Window.orderBy("_d")) - F.col("hi"))  # one row a day
    out = days.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.greatest("g", "_h")).alias("gap"))
    return out.withColumn("covers", (F.col("lo") <= start) & (F.col("hi") >= stop) & (F.col("gap") < max_gap))


