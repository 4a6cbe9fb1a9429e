"""Clock synchronisation and positions from arrival times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import kept


def closed_form(places: np.ndarray, toa: np.ndarray, c: float) -> np.ndarray:
    """Solutions (x, y, emission time) of the arrival times of many pings at as many receivers each: ping, solution, value;
    nan where there is none. places: ping, receiver, (x, y); toa: ping, receiver.

    Differences of the squared range equations are linear in place and emission time given the first receiver's range, whose
    own equation is a quadratic in that range. At a receiver's place the range is 0, and rounding may put it below, or the
    discriminant: both are taken as 0 within what rounding can do."""
    first, n = toa.argmin(1), toa.shape[1]
    rest = np.arange(n - 1) + (np.arange(n - 1) >= first[:, None])
    p0, t0 = places[np.arange(len(toa)), first], toa[np.arange(len(toa)), first]
    dp = np.take_along_axis(places, rest[:, :, None], 1) - p0[:, None]
    dr = c * (np.take_along_axis(toa, rest, 1) - t0[:, None])
    inv = np.linalg.pinv(dp)
    g = (inv @ (0.5 * ((dp**2).sum(2) - dr**2))[:, :, None])[:, :, 0]
    h = -(inv @ dr[:, :, None])[:, :, 0]  # place less p0 = g + h r
    a, b, k = (h * h).sum(1) - 1, 2 * (g * h).sum(1), (g * g).sum(1)
    with np.errstate(all="ignore"):
        near = 1e-6 + 64 * c * np.spacing(np.abs(toa).max(1))  # metres
        d2 = b * b - 4 * a * k
        d = np.sqrt(np.where((d2 < 0) & (-d2 <= 1e-9 * (b * b + np.abs(4 * a * k)) + (2 * a * near) ** 2), 0.0, d2))
        q = -(b + np.where(b < 0, -d, d)) / 2  # no difference of like numbers
        two = np.stack([q / a, np.where(q == 0, 0.0, k / q)], 1)
        one = np.stack([np.where(np.abs(b) > 1e-12, -k / b, np.nan), np.full(len(b), np.nan)], 1)
        r = np.where(np.abs(a)[:, None] < 1e-12, one, two)
        r = np.sort(np.where((r < 0) & (r >= -near[:, None]), 0.0, r), 1)
        r[r[:, 0] == r[:, 1], 1] = np.nan
        r[~(r >= 0)] = np.nan
    xy = (p0 + g)[:, None] + h[:, None] * r[:, :, None]
    return np.concatenate([xy, (t0[:, None] - r / c)[:, :, None]], 2)


def solve_pings(pings: DataFrame, rx: DataFrame, c: float = 1460.0) -> DataFrame:
    """Positions of pings heard by three receivers or more (H2): ping_id, x, y, t, solution, n_rx, rms (seconds).

    pings: ping_id, rx, toa. Pings are gathered with their receivers' places; those of a batch that as many receivers heard
    are solved at once by numpy."""
    rows = pings.join(rx.select("rx", "rx_x", "rx_y"), "rx")
    heard = rows.groupBy("ping_id").agg(F.sort_array(F.collect_list(F.struct("rx", "rx_x", "rx_y", "toa"))).alias("h"))  # an array has tens of receivers
    nested = heard.where(F.size("h") >= 3).select("ping_id", F.size("h").alias("n_rx"), F.transform("h", lambda x: x["rx_x"]).alias("xs"), F.transform("h", lambda x: x["rx_y"]).alias("ys"), F.transform("h", lambda x: x["toa"]).alias("toa"))

    def run(batches):
        for b in batches:
            for n, own in b.groupby("n_rx"):
                places = np.stack([np.stack(own["xs"].to_list()), np.stack(own["ys"].to_list())], 2).astype(float)
                toa = np.stack(own["toa"].to_list()).astype(float)
                found = closed_form(places, toa, c)
                # Of two roots of which one fits, that one is the first solution.
                at, which = np.nonzero(~np.isnan(found[:, :, 0]))
                x, y, t = found[at, which].T
                number = np.where((which == 1) & ~np.isnan(found[at, 0, 0]), 2, 1)
                res = toa[at] - t[:, None] - np.hypot(places[at, :, 0] - x[:, None], places[at, :, 1] - y[:, None]) / c
                yield pd.DataFrame({"ping_id": own["ping_id"].to_numpy()[at], "x": x, "y": y, "t": t, "solution": number, "n_rx": n, "rms": np.sqrt((res**2).mean(1))})

    kind = dict(pings.dtypes)["ping_id"]
    return nested.mapInPandas(run, f"ping_id {kind}, x double, y double, t double, solution int, n_rx int, rms double")


def filter_fixes(fixes: DataFrame, max_bed: float = 2.0) -> DataFrame:
    """Fixes over a known bed no higher than max_bed, with the solutions left for their ping (H3). fixes: ping_id, bed."""
    good = fixes.where(F.col("bed").isNotNull() & (F.col("bed") <= max_bed))
    return good.withColumn("solutions", F.count(F.lit(1)).over(Window.partitionBy("ping_id")))


def clock_equations(pings: DataFrame, distances: DataFrame) -> DataFrame:
    """One row for the first receiver of a ping and each other: a, b, ta, tb, ddist (distance from the beacon to b less to a).

    pings: ping_id, tx (the beacon's owner), rx, t; distances: rx_a, rx_b, dist."""
    first = pings.groupBy("ping_id").agg(F.min(F.struct("t", "rx")).alias("f"))
    rows = pings.join(first, "ping_id").where(F.col("rx") != F.col("f.rx"))
    da, db = distances.select(F.col("rx_a").alias("tx"), F.col("rx_b").alias("a"), F.col("dist").alias("dist_a")), distances.select(F.col("rx_a").alias("tx"), F.col("rx_b").alias("b"), F.col("dist").alias("dist_b"))
    rows = rows.select("ping_id", "tx", F.col("f.rx").alias("a"), F.col("f.t").alias("ta"), F.col("rx").alias("b"), F.col("t").alias("tb"))
    return rows.join(da, ["tx", "a"]).join(db, ["tx", "b"]).withColumn("ddist", F.col("dist_b") - F.col("dist_a"))


#: Scale of the inverse speeds among the unknowns, so that they are of the size of the offsets.
SLOWNESS = 1 / 1460
#: Rounds of dropping bad equations. Each halves the largest residual at least.
ROUNDS = 40


def banded_solution(size: int, band: int, u: np.ndarray, v: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solution of a symmetric positive system whose entries (u <= v, value s) lie within a band, by Cholesky elimination along it.

    A trace of a ridge gives unknowns without a say the least values. Memory is size times band, work that times band."""
    low = np.zeros((size, band + 1))  # low[j, d]: entry (j + d, j)
    low[u, v - u] = s
    low[:, 0] += 1e-13 * max(1e-300, low[:, 0].max())
    for j in range(size):
        low[j] /= np.sqrt(low[j, 0])
        column = low[j, 1:]
        for d in range(1, min(band, size - 1 - j) + 1):
            if column[d - 1]:
                low[j + d, : band + 1 - d] -= column[d - 1] * column[d - 1 :]
    x = y.astype(float).copy()
    for j in range(size):
        x[j] /= low[j, 0]
        n = min(band, size - 1 - j)
        x[j + 1 : j + 1 + n] -= low[j, 1 : n + 1] * x[j]
    for j in range(size - 1, -1, -1):
        n = min(band, size - 1 - j)
        x[j] = (x[j] - low[j, 1 : n + 1] @ x[j + 1 : j + 1 + n]) / low[j, 0]
    return x


def _clock_terms(equations: DataFrame, names: list[str], start: float, width: float, keeper: str, n_intervals: int, window: int, step: int) -> DataFrame:
    """win, lo, n, terms (unknown u with its factor c) and y of each equation in each window that has its interval. Unknowns are
    numbered by break: the receivers' offsets there, then the inverse speed of the interval that follows."""
    idx = F.floor((F.col("ta") - start) / width).cast("long")
    first, last = F.greatest(F.lit(0), F.ceil((idx - window + 1) / step)), F.greatest(F.lit(0), F.floor(idx / step))
    rows = equations.withColumn("idx", idx).where((F.col("idx") >= 0) & (F.col("idx") < n_intervals)).withColumn("win", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("lo", F.col("win") * step).withColumn("n", F.least(F.lit(window), n_intervals - F.col("lo")))
    block = len(names) + 1
    number = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names)), strict=True) for x in pair]) if names else F.create_map(F.lit(keeper), F.lit(0))

    def offset(rx: str, t: str, sign: float) -> list[Column]:
        at = F.least(F.greatest((F.col(t) - start) / width - F.col("lo"), F.lit(0.0)), F.col("n") - 1e-9)
        u, share = (F.floor(at) * block + F.try_element_at(number, F.col(rx))).cast("int"), at - F.floor(at)
        told = F.col(rx) != keeper
        return [F.when(told, F.struct(u.alias("u"), (sign * (1 - share)).alias("c"))), F.when(told, F.struct((u + block).alias("u"), (sign * share).alias("c")))]

    speed = F.struct(((F.col("idx") - F.col("lo")) * block + len(names)).cast("int").alias("u"), (-SLOWNESS * F.col("ddist")).alias("c"))
    terms = F.array_compact(F.array(*offset("b", "tb", 1.0), *offset("a", "ta", -1.0), speed))
    return rows.select("win", "lo", "n", terms.alias("terms"), (F.col("ta") - F.col("tb")).alias("y"))


def _clock_solutions(rows: DataFrame, block: int) -> DataFrame:
    """win and x, the unknowns' values; null where no equation has one. Sums of products meet by window and pair of unknowns."""
    products = F.flatten(F.transform("terms", lambda a: F.transform(F.filter("terms", lambda b: b["u"] >= a["u"]), lambda b: F.struct(a["u"].alias("u"), b["u"].alias("v"), (a["c"] * b["c"]).alias("s")))))
    sides = F.transform("terms", lambda a: F.struct(a["u"].alias("u"), F.lit(-1).alias("v"), (a["c"] * F.col("y")).alias("s")))
    cells = rows.select("win", "n", F.inline(F.concat(products, sides))).groupBy("win", "n", "u", "v").agg(F.sum("s").alias("s"))

    def solved(g: pd.DataFrame) -> pd.DataFrame:
        size = (int(g["n"].iloc[0]) + 1) * block
        m, r = g[g["v"] >= 0], g[g["v"] < 0]
        y = np.zeros(size)
        y[r["u"].to_numpy()] = r["s"].to_numpy()
        u, v = m["u"].to_numpy(), m["v"].to_numpy()
        x = banded_solution(size, int((v - u).max()), u, v, m["s"].to_numpy(), y)
        told = np.zeros(size, bool)
        told[u] = told[v] = True
        return pd.DataFrame({"win": [g["win"].iloc[0]], "x": [[float(c) if k else None for c, k in zip(x, told, strict=True)]]})

    return cells.groupBy("win").applyInPandas(solved, "win long, x array<double>")


def solve_clock(equations: DataFrame, start: float, width: float, keeper: str, n_intervals: int, window: int = 6, overlap: int = 2, target: float = 1e-3, max_drops: int = 200, max_share: float = 0.0) -> DataFrame:
    """Offsets at breaks and inverse sound speed by interval from windows of intervals (H4): rx, idx, off, inv_c, rms.

    Each equation says that b's time less a's, both corrected, is ddist by the interval's inverse speed; offsets are linear between
    breaks and the keeper's is 0. Spark sums the equations' products by window and pair of unknowns, so a task solves a banded
    system of the window's breaks and receivers, however many pings there are. In rounds, every window whose RMS is not below
    target loses the equations within half of its largest residual, at most max_drops in all, or max_share of the window's
    equations where that is more (bad arrivals grow in number with the pings), else it has no solution. Of windows
    that share a break, the one whose edge is not near it counts. A break that no equation reaches has offset 0. Equations with a
    null take no part."""
    whole = equations.where("a is not null and b is not null and ta is not null and tb is not null and ddist is not null").select("a", "ta", "b", "tb", "ddist")
    names = [r[0] for r in whole.select(F.explode(F.array("a", "b")).alias("r")).where(F.col("r") != keeper).distinct().orderBy("r").collect()]  # the receivers of an array: tens
    step, block, spark = window - overlap, len(names) + 1, equations.sparkSession
    active = kept(_clock_terms(whole, names, start, width, keeper, n_intervals, window, step).withColumn("dropped", F.lit(0).cast("long")), "clock-rows")
    done = None
    for _ in range(ROUNDS):
        if active.isEmpty():
            break
        fitted = F.aggregate("terms", F.lit(0.0), lambda total, e: total + e["c"] * F.coalesce(F.element_at("x", e["u"] + 1), F.lit(0.0)))
        solved = kept(_clock_solutions(active, block), "clock-solutions")
        rows = active.join(solved, "win").withColumn("_res", F.abs(fitted - F.col("y"))).drop("x")
        rms = F.sqrt(F.avg(F.col("_res") ** 2)).alias("rms")
        state = kept(rows.groupBy("win", "lo", "n").agg(rms, F.max("_res").alias("_worst"), F.count(F.lit(1)).alias("_rows")), "clock-state")
        good = solved.join(state.where(F.col("rms") < target), "win").select("win", "lo", "n", "x", "rms")
        done = good if done is None else done.unionByName(good)
        left = rows.join(state.where(F.col("rms") >= target).select("win", "_worst", "_rows"), "win").where(F.col("_res") * 2 < F.col("_worst"))
        n = F.count(F.lit(1)).over(Window.partitionBy("win"))
        left = left.withColumn("_left", n).withColumn("dropped", F.col("dropped") + F.col("_rows") - F.col("_left"))
        most = F.greatest(F.lit(max_drops), max_share * (F.col("dropped") + F.col("_left")))
        active = kept(left.where((F.col("dropped") <= most) & (F.col("_left") >= 2)).select("win", "lo", "n", "terms", "y", "dropped"), "clock-rows")
    schema = f"rx {dict(whole.dtypes)['a']}, idx long, off double, inv_c double, rms double"
    if done is None:
        return spark.createDataFrame([], schema)
    trim, at = (overlap + 1) // 2, F.col("i")
    edge = ~(((F.col("lo") == 0) | (at >= trim)) & ((F.col("lo") + F.col("n") == n_intervals) | (at <= F.col("n") - trim)))
    breaks = done.select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("i"))
    value = lambda k: F.element_at("x", (at * block + k + 1).cast("int"))
    heard = lambda k: F.exists(F.sequence(F.lit(0), F.col("n").cast("int")), lambda i: F.element_at("x", i * block + k + 1).isNotNull())
    receivers = F.array(F.struct(F.lit(keeper).alias("rx"), F.lit(0.0).alias("off")), *[F.struct(F.lit(r).alias("rx"), F.when(heard(k), F.coalesce(value(k), F.lit(0.0))).alias("off")) for k, r in enumerate(names)])
    speed = F.element_at("x", (F.least(at, F.col("n") - 1) * block + len(names) + 1).cast("int")) * SLOWNESS
    rows = breaks.select((F.col("lo") + at).cast("long").alias("idx"), speed.alias("inv_c"), "rms", edge.alias("edge"), F.inline(receivers)).where("off is not null")
    pick = Window.partitionBy("rx", "idx").orderBy("edge", "rms", F.col("inv_c").isNull())
    return rows.withColumn("_k", F.row_number().over(pick)).where("_k = 1").select("rx", "idx", "off", "inv_c", "rms")


def evaluate_sync(pings: DataFrame, distances: DataFrame, inv_c: DataFrame | float, start: float = 0.0, width: float = 86400.0) -> DataFrame:
    """Emission times seen by each receiver of a ping against their mean: rms, pings by receiver and interval (H5). pings: ping_id, tx, rx,
    t (corrected). inv_c: one inverse speed, or idx, inv_c by interval of equal width from start (those of solve_clock: tens)."""
    pings = pings.withColumn("idx", F.floor((F.col("t") - start) / width).cast("long"))
    if isinstance(inv_c, DataFrame):
        pings = pings.join(inv_c.groupBy(F.col("idx").cast("long").alias("idx")).agg(F.avg("inv_c").alias("_inv")), "idx")
    else:
        pings = pings.withColumn("_inv", F.lit(inv_c))
    d = distances.select(F.col("rx_a").alias("tx"), F.col("rx_b").alias("rx"), "dist")
    rows = pings.join(d, ["tx", "rx"]).withColumn("emitted", F.col("t") - F.col("dist") * F.col("_inv"))
    rows = rows.withColumn("error", F.col("emitted") - F.avg("emitted").over(Window.partitionBy("ping_id")))
    return rows.groupBy("rx", "idx").agg(F.count(F.lit(1)).alias("pings"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rms"))


def search_shift_drift(ab: DataFrame, ba: DataFrame, shifts: list[float], drifts: list[float], by: list[str], grain: float = 60.0) -> DataFrame:
    """Shift and drift of the emitter's clock with least RMS travel both ways (H6). ab, ba: by, t (arrival), src (nearest emission).

    Travel is linear in shift and drift, so the grid is scored on sums of each pair's differences, not on the rows."""
    def sums(df: DataFrame, name: str) -> DataFrame:
        d, s = F.col("t") - F.col("src"), F.col("src") / 86400
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n{name}"), F.avg(d).alias(f"d{name}"), F.avg(d * d).alias(f"dd{name}"), F.avg(s).alias(f"s{name}"), F.avg(s * s).alias(f"ss{name}"), F.avg(d * s).alias(f"ds{name}"))

    both = sums(ab, "1").join(sums(ba, "2"), by)

    def rms(k: str, sign: int, shift: Column, drift: Column) -> Column:
        a, b = shift * sign, drift * sign
        return F.sqrt(F.greatest(F.lit(0.0), F.col(f"dd{k}") + a * a + b * b * F.col(f"ss{k}") - 2 * a * F.col(f"d{k}") - 2 * b * F.col(f"ds{k}") + 2 * a * b * F.col(f"s{k}")))

    def scored(shift: Column, drift: Column) -> Column:
        return F.struct((rms("1", 1, shift, drift) + rms("2", -1, shift, drift)).alias("cost"), shift.alias("shift"), drift.alias("drift"))

    # The grid is scored within each group's row: a row a grid point would be sorted and held by the hundred million.
    lines = F.transform(F.array(*map(F.lit, shifts)), lambda shift: F.array_min(F.transform(F.array(*map(F.lit, drifts)), lambda drift: scored(shift, drift))))
    return both.withColumn("m", F.array_min(lines)).select(*by, "m.cost", "m.shift", "m.drift")
