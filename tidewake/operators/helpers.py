"""Work that is sequential within a track, receiver or window: small numpy helpers under applyInPandas.

Groups are bounded by what they stand for (a track of an hour, a receiver's file, a window of clock intervals).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.ordering import numbered


def apply_per_track(pos: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function on each track, rows in time order (H1)."""
    return pos.groupBy("id").applyInPandas(lambda p: fn(p.sort_values(["tnum", "seq"])), schema)


def _dv(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Change of velocity at each point; 0 at the ends."""
    out = np.zeros(len(t))
    if len(t) > 2:
        dt = np.diff(t)
        dt = np.where(dt > 0, dt, np.nan)
        u, v = np.diff(x) / dt, np.diff(y) / dt
        out[1:-1] = np.nan_to_num(np.hypot(np.diff(u), np.diff(v)))
    return out


def _cross(dv: np.ndarray, limit: float) -> np.ndarray:
    """Larger than the limit and than the one before, unless the next one is so too."""
    up = np.append((dv > limit) & (dv > np.append(np.inf, dv[:-1])), False)
    return up[:-1] & ~up[1:]


def flag_cross(pos: DataFrame, limit: float) -> DataFrame:
    """Local maxima of the change of velocity (E24): id, seq, cross."""
    w = Window.partitionBy("id").orderBy("tnum", "seq")
    dt = F.lead("tnum").over(w) - F.col("tnum")
    step = F.when(dt > 0, dt)
    rows = pos.withColumns({"_u": (F.lead("x").over(w) - F.col("x")) / step, "_v": (F.lead("y").over(w) - F.col("y")) / step})
    turn = F.hypot(F.col("_u") - F.lag("_u").over(w), F.col("_v") - F.lag("_v").over(w))
    rows = rows.withColumn("_dv", F.coalesce(turn, F.lit(0.0)))
    rows = rows.withColumn("_up", F.coalesce((F.col("_dv") > limit) & (F.col("_dv") > F.lag("_dv").over(w)), F.lit(False)))
    return rows.select("id", "seq", (F.col("_up") & ~F.coalesce(F.lead("_up").over(w), F.lit(False))).alias("cross"))


def flag_iterative(pos: DataFrame, limit: float, rounds: int = 5) -> DataFrame:
    """The same rule on what is left, up to so many rounds (E25): id, seq, round (0: kept)."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        when = np.zeros(len(p), int)
        t, x, y = p["tnum"].to_numpy(), p["x"].to_numpy(), p["y"].to_numpy()
        for r in range(1, rounds + 1):
            left = np.flatnonzero(when == 0)
            hit = left[_cross(_dv(t[left], x[left], y[left]), limit)]
            if not len(hit):
                break
            when[hit] = r
        return pd.DataFrame({"id": p["id"], "seq": p["seq"], "round": when})

    return apply_per_track(pos, run, "id long, seq long, round int")


def flag_greedy(pos: DataFrame, limit: float = 2.0, max_bed: float = 2.5) -> DataFrame:
    """Land first (bed above max_bed), then the worst change of velocity again and again, the first of equals (E26): id, seq, removed.

    What is left is a chain; a removal changes its two neighbours alone, so the worst is the top of a heap whose outdated entries
    are passed over: n log n for a track."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        gone = (p["bed"].to_numpy() > max_bed) if "bed" in p else np.zeros(len(p), bool)
        left = np.flatnonzero(~gone)
        t, x, y = (p[c].to_numpy(float)[left] for c in ("tnum", "x", "y"))
        before, after = np.arange(len(left)) - 1, np.append(np.arange(1, len(left)), -1)
        now = _dv(t, x, y)
        heap = [(-v, i) for i, v in enumerate(now)]
        heapq.heapify(heap)
        t, x, y, now = t.tolist(), x.tolist(), y.tolist(), now.tolist()

        def change(i: int) -> float:
            a, b = before[i], after[i]
            if a < 0 or b < 0 or t[i] <= t[a] or t[b] <= t[i]:
                return 0.0
            d, e = t[i] - t[a], t[b] - t[i]
            v = math.hypot((x[b] - x[i]) / e - (x[i] - x[a]) / d, (y[b] - y[i]) / e - (y[i] - y[a]) / d)
            return 0.0 if math.isnan(v) else v

        while heap:
            worst, i = heapq.heappop(heap)
            if gone[left[i]] or -worst != now[i]:
                continue
            if -worst < limit:
                break
            gone[left[i]] = True
            a, b = before[i], after[i]
            if a >= 0:
                after[a] = b
            if b >= 0:
                before[b] = a
            for k in (a, b):
                if k >= 0:
                    now[k] = change(k)
                    heapq.heappush(heap, (-now[k], k))
        return pd.DataFrame({"id": p["id"], "seq": p["seq"], "removed": gone})

    return apply_per_track(pos, run, "id long, seq long, removed boolean")


def smooth_fill(pos: DataFrame, n: int = 3, dt: float = 5.0) -> DataFrame:
    """Track filled every dt seconds, its last time included, from the local line, whose index steps on at most once a time (E14): id, t, x, y.

    With c(j) the last row heard by time j, or the last but one of the track, the index at time k is the least of c(j) + k - j over the
    times up to k, and k + 1: a running minimum. Lines are regressions in a window of 2 n rows, the track's last row left out. Where
    the window has one time only, the row's own place stands; tracks of fewer than three rows have no row; nulls of x or y are passed over."""
    track = Window.partitionBy("id")
    order = track.orderBy("tnum", "seq")
    rows = pos.select("id", "seq", "tnum", "x", "y", (F.row_number().over(order) - 1).alias("_i"), F.count(F.lit(1)).over(track).alias("_n"), F.min("tnum").over(track).alias("_t0"))
    rows = rows.where("_n >= 3").withColumn("_t", F.col("tnum") - F.col("_t0"))
    near = F.ceil(F.col("_t") / dt)
    at = lambda k: F.col("_t0") + k * F.lit(float(dt))
    first = F.when(at(near) < F.col("tnum"), near + 1).when(at(near - 1) >= F.col("tnum"), near - 1).otherwise(near)
    rows = rows.withColumn("_k", F.greatest(first, F.lit(0)))
    until = F.coalesce(F.lead("_k").over(order) - 1, F.when(at(F.col("_k")) <= F.col("tnum"), F.col("_k")))
    times = rows.select("id", "_t0", F.least("_i", F.col("_n") - 2).alias("_c"), "_k", until.alias("_to")).where("_to >= _k")
    times = times.select("id", "_t0", "_c", F.explode(F.sequence("_k", "_to")).alias("_k"))
    least = F.min(F.col("_c") - F.col("_k")).over(track.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    times = times.select("id", at(F.col("_k")).alias("t"), (at(F.col("_k")) - F.col("_t0")).alias("_w"), (F.least(least, F.lit(1)) + F.col("_k")).cast("int").alias("_i"))
    frame = track.orderBy("_i").rowsBetween(-n, n - 1)
    lines = rows.where("_i < _n - 1").select("id", "_i", *[g(c, "_t").over(frame).alias(f"_{name}_{c}") for c in ("x", "y") for name, g in (("b", F.regr_slope), ("at", F.regr_avgx), ("mean", F.regr_avgy))], "x", "y")
    met = times.join(lines, ["id", "_i"])
    on_line = [F.coalesce(F.col(f"_mean_{c}") + F.col(f"_b_{c}") * (F.col("_w") - F.col(f"_at_{c}")), F.col(c)).alias(c) for c in ("x", "y")]
    return met.select(F.col("id").alias("id"), "t", *on_line)  # a column of its own, so that pos may be joined


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    def one(tv: float, n: float) -> float:
        if not n > 0 or math.isnan(tv):
            return math.nan
        x, a, b = n / (n + tv * tv), n / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
        if x >= 1:
            return 1.0
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            x, a, b = 1 - x, b, a
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > 1e-300 else 1e300
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + top * d)
                c = 1 + top / c
                h *= d * c
            if abs(d * c - 1) < 1e-13:
                break
        value = front * h / a
        return min(1.0, max(0.0, 1 - value if flip else value))

    return np.array([one(float(a), float(b)) for a, b in zip(np.atleast_1d(t), np.atleast_1d(df), strict=True)])


def change_points_filled(fill: DataFrame, raw: DataFrame, w: int = 12, p_max: float = 0.05) -> DataFrame:
    """Rows of a filled track where the circular mean heading turns (E29): id, t, p, is_change. fill: id, t, x, y (smooth_fill); raw: id, tnum.

    Means over w/2 headings, w/4 rows before and after, are compared by Student's t, one-sided, with a denominator of 0.05 pi at least;
    sample sizes are the heard positions of each side. Rows without a whole window have p 1. A change has the least p, the first on
    ties, of the rows from w/4 before to w/4 - 1 after."""
    half, quarter = w // 2, w // 4

    def run(f: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        f, heard = f.sort_values("t"), np.sort(r["tnum"].to_numpy())
        t, n = f["t"].to_numpy(), len(f)
        p = np.ones(n)
        mid = np.arange(half + 1, n - half - 1)
        if len(mid):
            head = np.arctan2(np.diff(f["y"].to_numpy()), np.diff(f["x"].to_numpy()))
            total = np.concatenate([[0], np.cumsum(np.exp(1j * head))])
            mean = lambda i: (total[np.minimum(n - 1, i + half // 2)] - total[i - half // 2]) / (np.minimum(n - 1, i + half // 2) - i + half // 2)
            a, b = mean(mid - quarter), mean(mid + quarter)
            n1 = np.searchsorted(heard, t[mid], "right") - np.searchsorted(heard, t[mid - quarter], "left")
            n2 = np.searchsorted(heard, t[mid + quarter + 1], "right") - np.searchsorted(heard, t[mid], "left")
            n1, n2 = np.maximum(1, n1), np.maximum(1, n2)
            var = [-2 * np.log(np.clip(np.abs(m), 1e-300, 1)) for m in (a, b)]
            d = np.abs(np.angle(a * np.conj(b))) / np.maximum(0.05 * math.pi, np.sqrt(var[0] / n1 + var[1] / n2))
            p[mid] = student_tail(d, np.maximum(1, np.minimum(n1, n2) - 1)) / 2
        change = np.zeros(n, bool)
        for i in mid[p[mid] < p_max]:
            change[i] = np.argmin(p[i - quarter : i + quarter]) == quarter
        return pd.DataFrame({"id": f["id"], "t": t, "p": p, "is_change": change})

    return fill.groupBy("id").cogroup(raw.groupBy("id")).applyInPandas(run, "id long, t double, p double, is_change boolean")


def pacf(steps: DataFrame, v: str, max_lag: int = 20) -> DataFrame:
    """Partial autocorrelation by Durbin-Levinson from a series' autocorrelations (E37): id, lag, pacf."""
    from tidewake.operators.tracks import autocorr

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values("lag")["r"].to_numpy()
        out, prev = [], np.zeros(0)
        for k in range(1, len(r)):
            down = 1 - prev @ r[1:k]
            a = (r[k] - prev @ r[1:k][::-1]) / down if abs(down) > 1e-12 else np.nan
            prev = np.append(prev - a * prev[::-1], a)
            out.append((g["id"].iloc[0], k, a))
        return pd.DataFrame(out, columns=["id", "lag", "pacf"])

    return autocorr(steps, v, max_lag).groupBy("id").applyInPandas(run, "id long, lag int, pacf double")


def running_weighted_quantile(df: DataFrame, order: str, v: str, w: str, n: int, q: float, chunk: int = 5_000) -> DataFrame:
    """Weighted quantile of the n rows around each along a sort key, clipped at the ends.

    Rows are numbered in the order of the key, whatever its skew; chunks of the numbering carry n/2 rows of their neighbours. df has seq."""
    rows = numbered(df.select(*dict.fromkeys(["seq", order, v, w])), [order, "seq"], "_i")
    half = n // 2 + 1
    # A row goes to every chunk that has a window over it, however wide the window is.
    rows = rows.withColumn("_c", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("_i") - half) / chunk), F.floor((F.col("_i") + half) / chunk))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_i")
        own = np.flatnonzero(g["_i"].to_numpy() // chunk == g["_c"].iloc[0])
        before, after = n // 2, n - n // 2 - 1
        # Beyond the ends stand values after all others, without weight.
        val = np.pad(g[v].to_numpy(float), (before, after), constant_values=np.inf)
        wt = np.pad(g[w].to_numpy(float), (before, after))
        out = np.empty(len(own))
        step = max(1, 2_000_000 // n)
        for at in range(0, len(own), step):
            place = own[at : at + step, None] + np.arange(n)
            o = np.argsort(val[place], axis=1, kind="stable")
            x, ww = np.take_along_axis(val[place], o, 1), np.take_along_axis(wt[place], o, 1)
            x = np.where(np.isinf(x), np.where(np.isinf(x), -np.inf, x).max(1, keepdims=True), x)
            s = np.cumsum(ww, axis=1)
            middle = (s - ww / 2) / s[:, -1:]
            k = np.clip((middle < q).sum(1), 1, n - 1)[:, None] if n > 1 else np.zeros((len(place), 1), int)
            lo, hi = (np.take_along_axis(middle, np.maximum(k - 1, 0), 1), np.take_along_axis(middle, k, 1))
            a, b = (np.take_along_axis(x, np.maximum(k - 1, 0), 1), np.take_along_axis(x, k, 1))
            share = np.clip(np.divide(q - lo, hi - lo, out=np.zeros_like(lo), where=hi > lo), 0, 1)
            out[at : at + step] = (a + (b - a) * share)[:, 0]
        return pd.DataFrame({"seq": g["seq"].to_numpy()[own], "quantile": out})

    return rows.select("seq", "_i", "_c", F.col(v).cast("double").alias(v), F.col(w).cast("double").alias(w)).groupBy("_c").applyInPandas(run, "seq long, quantile double")


def split_by_reset_table(det: DataFrame, resets: DataFrame) -> DataFrame:
    """Segments by a table of resets (E3). det: rx, seq, t; resets: rx, pre, post (the clock before and after).

    A backward step takes the next reset that steps back; the others open a segment at the first row at or after post."""
    from tidewake.operators import detections as D

    rows = D.with_before(det.select("rx", "seq", "t"), ["rx"])
    ends = rows.groupBy("rx").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.min("seq").alias("_first"))
    # Backward resets are seen in the record itself, others may lie outside it. Resets are tens of rows for a receiver.
    known = resets.select("rx", "pre", "post").join(ends, "rx").where("post >= pre and post <= _hi and pre >= _lo").select("rx", "post").distinct()
    cuts = rows.join(known, "rx").where("t >= post").groupBy("rx", "post").agg(F.min("seq").alias("seq")).select("rx", "seq").distinct().withColumn("_cut", F.lit(1))
    rows = rows.join(cuts, ["rx", "seq"], "left").join(ends.select("rx", "_first"), "rx")
    cut = F.when(F.col("seq") == F.col("_first"), 0).when(F.coalesce(F.col("t") < F.col("_before"), F.lit(False)), 1).otherwise(F.coalesce("_cut", F.lit(0)))
    rows = D.with_running_total(rows.withColumn("_flag", cut), ["rx"], "_flag", "_n")
    return rows.select("rx", "seq", (F.col("_n") + 1).cast("int").alias("segment"))


def fit_clock_pair(candidates: DataFrame, slope_limit: float = 1.005, max_res: float = 0.5, max_shift: float = 20.0) -> DataFrame:
    """Line t_b = slope t_a + shift over candidate matches of two records, the worst dropped until all fit (C14).

    candidates: rx_a, rx_b, chunk, t_a, t_b. Returns rx_a, rx_b, chunk, slope, shift (at the mean of t_a), t_mean, n, rms."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g["t_a"].to_numpy(), g["t_b"].to_numpy()
        d = b - a
        keep = np.abs(d - np.median(d)) < max_shift / 2
        while keep.sum() >= 2:
            ma, mb = a[keep].mean(), b[keep].mean()
            x = a[keep] - ma
            slope = (x @ (b[keep] - mb)) / (x @ x) if x @ x > 0 else 1.0
            slope = min(max(slope, 1 / slope_limit), slope_limit)
            res = (b - mb) - slope * (a - ma)
            worst = np.flatnonzero(keep)[np.argmax(np.abs(res[keep]))]
            if abs(res[worst]) < max_res:
                if abs(mb - ma) >= max_shift:
                    break
                return pd.DataFrame([(g["rx_a"].iloc[0], g["rx_b"].iloc[0], int(g["chunk"].iloc[0]), slope, mb - ma, ma, int(keep.sum()), float(np.sqrt(np.mean(res[keep] ** 2))))], columns=["rx_a", "rx_b", "chunk", "slope", "shift", "t_mean", "n", "rms"])
            keep[worst] = False
        return pd.DataFrame(columns=["rx_a", "rx_b", "chunk", "slope", "shift", "t_mean", "n", "rms"])

    return candidates.select("rx_a", "rx_b", "chunk", "t_a", "t_b").groupBy("rx_a", "rx_b", "chunk").applyInPandas(run, "rx_a string, rx_b string, chunk long, slope double, shift double, t_mean double, n long, rms double")
