"""Matching the hits of two receivers' records: lines between their clocks, and a one-to-one match in the order of time (C14).

Lines come from votes and sums on Spark, round by round over ever closer candidates. A tag's hits in both records are then one sequence
on the second clock, cut where no two hits across the cut could match. Cuts near the edges of slices of time make the groups
that tasks work on; a group's best scores for its first and last hit being matched or not are all that its neighbours need to
know, so the groups meet through one small row each, and no task holds more than a slice of a tag.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import kept

#: What a contradiction costs, in matches: two of them outweigh the match that they touch.
COST = 0.6


def fit_lines(candidates: DataFrame, by: list[str], slope_limit: float = 1.005, max_res: float = 0.5, max_shift: float = 20.0) -> DataFrame:
    """Line t_b = b_mean + slope (t_a - a_mean) for each group of candidates (by, t_a, t_b): slope, a_mean, b_mean, n, rms (C14).

    A vote finds where to begin: slopes that a group's length and max_res can tell apart, and shifts in steps of max_res; each
    candidate is for the two steps about it under every slope, the line with most votes wins (the slope nearest 1, the lesser slope,
    the lesser shift of equals). Rounds then fit a line to the candidates near the line before, within twice max_res and twice within
    max_res, its slope kept within the limit. A group has no line if fewer than two candidates are left, or their mean difference
    reaches max_shift. Candidates without a time take no part."""
    rows = candidates.select(*by, F.col("t_a").cast("double").alias("t_a"), F.col("t_b").cast("double").alias("t_b")).where("t_a is not null and t_b is not null")
    ends = rows.groupBy(*by).agg(F.min("t_a").alias("_a0"), (F.max("t_a") - F.min("t_a")).alias("_span"))
    most = F.ceil((slope_limit - 1) * F.col("_span") / (2 * max_res))
    grid = F.explode(F.sequence(-most, most)).alias("_k")
    voters = rows.join(ends, by).select("*", grid).withColumn("_slope", 1 + F.coalesce(F.try_divide(F.col("_k") * 2 * max_res, F.col("_span")), F.lit(0.0)))
    step = F.floor((F.col("t_b") - F.col("_a0") - F.col("_slope") * (F.col("t_a") - F.col("_a0"))) / max_res)
    votes = voters.select(*by, "_a0", "_k", "_slope", F.explode(F.array(step, step + 1)).alias("_step")).groupBy(*by, "_a0", "_k", "_slope", "_step").agg(F.count(F.lit(1)).alias("_votes"))
    won = votes.groupBy(*by).agg(F.max(F.struct("_votes", -F.abs("_k"), -F.col("_k"), -F.col("_step"), "_a0", "_slope", "_step")).alias("w"))
    lines = won.select(*by, F.col("w._slope").alias("slope"), F.col("w._a0").alias("a_mean"), (F.col("w._a0") + F.col("w._step") * max_res).alias("b_mean"))
    res = F.col("t_b") - F.col("b_mean") - F.col("slope") * (F.col("t_a") - F.col("a_mean"))
    for near in distances(max_res):
        near_rows = rows.join(lines, by).where(F.abs(res) < near)
        slope = F.coalesce(F.try_divide(F.covar_pop("t_a", "t_b"), F.var_pop("t_a")), F.lit(1.0))
        lines = near_rows.groupBy(*by).agg(F.greatest(F.lit(1 / slope_limit), F.least(F.lit(slope_limit), slope)).alias("slope"), F.avg("t_a").alias("a_mean"), F.avg("t_b").alias("b_mean"))
    last = rows.join(lines, by).where(F.abs(res) < max_res).groupBy(*by, "slope", "a_mean", "b_mean").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(res * res)).alias("rms"))
    return last.where((F.col("n") >= 2) & (F.abs(F.col("b_mean") - F.col("a_mean")) < max_shift))


def distances(max_res: float) -> list[float]:
    """The rounds' distances."""
    return [2 * max_res, max_res, max_res]


def best_chain(t: np.ndarray, side: np.ndarray, max_res: float, apart: float, cost: float = COST) -> dict[tuple[bool, bool], tuple[float, list[tuple[int, int]]]]:
    """By whether the first and the last hit are matched: the best score and its pairs of places.

    A pair has hits of both sides less than max_res apart and scores 1 less its distance over 100 max_res. Pairs keep the order of
    both sides. Two hits in succession closer than apart, one matched and one not, cost. A state is the hits that wait for a later
    partner, which are all of one side (else pairs would cross): one at most where a record has no echoes within max_res."""
    w = 0.01 / max_res
    states: dict[tuple, tuple[float, tuple | None]] = {((), None, None): (0.0, None)}  # (waiting, first matched, last matched)
    for k in range(len(t)):
        new: dict[tuple, tuple[float, tuple | None]] = {}

        def put(state: tuple, score: float, pairs: tuple | None) -> None:
            if state not in new or score > new[state][0]:  # noqa: B023
                new[state] = (score, pairs)  # noqa: B023

        close = k > 0 and t[k] - t[k - 1] < apart
        for (waiting, first, last), (score, pairs) in states.items():
            if waiting and t[k] - t[waiting[0]] >= max_res:
                continue  # a promised partner did not come
            for matched in (False, True):
                s = score - (cost if close and last != matched else 0.0)
                begun = matched if first is None else first
                if not matched:
                    put((waiting, begun, False), s, pairs)
                    continue
                if waiting and side[waiting[0]] != side[k]:
                    put((waiting[1:], begun, True), s + 1 - w * (t[k] - t[waiting[0]]), (waiting[0], k, pairs))
                else:
                    put(((*waiting, k), begun, True), s, pairs)
        states = new
    out: dict[tuple[bool, bool], tuple[float, list[tuple[int, int]]]] = {}
    for (waiting, first, last), (score, pairs) in states.items():
        if not waiting and (first, last) not in out or not waiting and score > out[first, last][0]:
            chain = []
            while pairs:
                chain.append(pairs[:2])
                pairs = pairs[2]
            out[first, last] = (score, chain[::-1])
    return out


#: Rows that a call of the matching takes, in whole groups.
ROWS_A_CALL = 20_000


def _runs(g: pd.DataFrame, columns: list[str]) -> list[tuple[int, int]]:
    """First place and the one past the last of each run of equal values in a sorted frame."""
    starts = np.ones(len(g), bool)
    starts[1:] = np.any([g[c].to_numpy()[1:] != g[c].to_numpy()[:-1] for c in columns], axis=0)
    at = np.flatnonzero(starts).tolist()
    return list(zip(at, [*at[1:], len(g)], strict=True))


def _on_one_clock(det: DataFrame, lines: DataFrame, chunk_s: float | None) -> DataFrame:
    """rx_a, rx_b, tag, side (0: a), seq, t on b's clock, for each pair of receivers that has a line."""
    own = det.where("tag is not null and t is not null").select("rx", "tag", "seq", F.col("t").cast("double").alias("t"))
    a = own.withColumnRenamed("rx", "rx_a")
    on = ["rx_a"]
    if chunk_s is not None:
        a, on = a.withColumn("chunk", F.floor(F.col("t") / chunk_s)), ["rx_a", "chunk"]
    a = a.join(lines, on).select("rx_a", "rx_b", "tag", F.lit(0).alias("side"), "seq", (F.col("b_mean") + F.col("slope") * (F.col("t") - F.col("a_mean"))).alias("t"))
    b = own.withColumnRenamed("rx", "rx_b").join(lines.select("rx_a", "rx_b").distinct(), "rx_b")
    return a.unionByName(b.select("rx_a", "rx_b", "tag", F.lit(1).alias("side"), "seq", "t"))


def match_records(det: DataFrame, lines: DataFrame, interval: Column, chunk_s: float | None = None, max_res: float = 0.5, share: float = 0.8, cost: float = COST, slice_s: float = 86400.0) -> DataFrame:
    """rx_a, rx_b, tag, seq_a, seq_b, res: for each two receivers with a line, the match of their hits (C14), as merge_matched takes it.

    A hit is in one pair at most, pairs of a tag keep its order in both records, and no other choice of pairs of the tag scores
    more: 1 a pair, less a little for its distance, less ``cost`` for every contradiction: two hits in succession closer than
    share of the tag's interval (seconds, over tag), of which only one is matched. det: rx, tag, seq, t; lines: of fit_lines by rx_a, rx_b
    and, with chunk_s, chunk (of t_a). Hits without tag or time match nothing."""
    key = ["rx_a", "rx_b", "tag"]
    rows = kept(_on_one_clock(det, kept(lines, "lines"), chunk_s), "one-clock").withColumn("_slice", F.floor(F.col("t") / slice_s))
    ends = rows.groupBy(*key, "_slice").agg(F.max("t").alias("_last"))
    ends = ends.withColumn("_edge", F.lag("_last").over(Window.partitionBy(*key).orderBy("_slice"))).drop("_last")  # one row a slice
    inside = F.lag("t").over(Window.partitionBy(*key, "_slice").orderBy("t", "side", "seq"))
    rows = rows.join(ends, [*key, "_slice"]).withColumn("_before", F.coalesce(inside, "_edge")).drop("_edge")
    # A group begins at a slice's first hit that nothing before it can match, and holds what follows up to the next group.
    free = F.col("_before").isNull() | (F.col("t") - F.col("_before") >= max_res)
    begins = rows.groupBy(*key, "_slice").agg(F.min(F.when(free, F.col("t"))).alias("_own"))
    earlier = F.last("_own", True).over(Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(begins.withColumn("_prior", earlier), [*key, "_slice"])
    rows = rows.withColumn("_group", F.when(F.col("t") >= F.col("_own"), F.col("_own")).otherwise(F.col("_prior"))).withColumn("_apart", share * interval)
    rows = kept(rows.select(*key, "_group", "_apart", "t", "side", "seq"), "match-groups")
    kinds = dict(rows.dtypes)
    of_key = ", ".join(f"{c} {kinds[c]}" for c in key)
    flags = list(itertools.product((False, True), repeat=2))

    def chains(g: pd.DataFrame) -> Iterator[tuple[int, int, dict, pd.DataFrame]]:
        g = g.sort_values([*key, "_group", "t", "side", "seq"], ignore_index=True)
        t, side, apart = g["t"].to_numpy(), g["side"].to_numpy(), g["_apart"].to_numpy(float)
        for i, j in _runs(g, [*key, "_group"]):
            yield i, j, best_chain(t[i:j], side[i:j], max_res, float(apart[i]), cost), g

    def scored(g: pd.DataFrame) -> pd.DataFrame:
        first, last, scores = [], [], []
        for i, j, best, g in chains(g):  # noqa: B020
            first.append(i)
            last.append(j - 1)
            scores.append([best[f][0] if f in best else -math.inf for f in flags])
        out = g.loc[first, [*key, "_group", "_apart"]]
        return out.assign(from_t=g["t"].to_numpy()[first], to_t=g["t"].to_numpy()[last], scores=scores)

    # Groups are small, so a call takes many of them.
    calls = F.lit(rows.count() // ROWS_A_CALL + 1)
    rows = rows.withColumn("_call", F.pmod(F.xxhash64(*key, "_group"), calls))
    summary = kept(rows.groupBy("_call").applyInPandas(scored, f"{of_key}, _group double, _apart double, from_t double, to_t double, scores array<double>"), "match-scores")

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        """The best flags of the groups' ends along each tag."""
        g = g.sort_values([*key, "_group"], ignore_index=True)
        ends, scores = np.zeros(len(g), int), [np.array(s, float) for s in g["scores"]]
        from_t, to_t, apart = (g[c].to_numpy() for c in ("from_t", "to_t", "_apart"))
        for start, stop in _runs(g, key):
            total, back = scores[start], []
            for i in range(start + 1, stop):
                close = from_t[i] - to_t[i - 1] < apart[i]
                step = total[None, :] - cost * parted if close else np.tile(total, (4, 1))
                back.append(step.argmax(1))
                total = step.max(1) + scores[i]
            at = int(total.argmax())
            ends[stop - 1] = at
            for k, b in enumerate(reversed(back)):
                at = int(b[at])
                ends[stop - 2 - k] = at
        return g[[*key, "_group"]].assign(ends=ends)

    parted = np.array([[float(flags[p][1] != f[0]) for p in range(4)] for f in flags])
    tags = summary.withColumn("_call", F.pmod(F.xxhash64(*key), F.lit(summary.count() // ROWS_A_CALL + 1)))
    chosen = tags.groupBy("_call").applyInPandas(joined, f"{of_key}, _group double, ends int")

    def matched(g: pd.DataFrame) -> pd.DataFrame:
        at, seq_a, seq_b, res = [], [], [], []
        for i, _, best, g in chains(g):  # noqa: B020
            t, side, seq = g["t"].array, g["side"].array, g["seq"].array
            for m, n in best[flags[int(g["ends"].array[i])]][1]:
                m, n = (m, n) if side[i + m] == 0 else (n, m)
                at.append(i)
                seq_a.append(seq[i + m])
                seq_b.append(seq[i + n])
                res.append(t[i + n] - t[i + m])
        return g.loc[at, key].assign(seq_a=seq_a, seq_b=seq_b, res=res)

    return rows.join(chosen, [*key, "_group"]).groupBy("_call").applyInPandas(matched, f"{of_key}, seq_a {kinds['seq']}, seq_b {kinds['seq']}, res double")
