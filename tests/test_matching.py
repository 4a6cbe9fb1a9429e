"""Matching of two records: every chain against a search of all, planted clocks, contradictions, and slices without effect."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import detections as D
from tidewake.operators import matching as M


def searched(t, side, max_res, apart, cost):
    """Best score by the ends' flags over all sets of pairs."""
    near = [(i, j) for i, j in itertools.combinations(range(len(t)), 2) if side[i] != side[j] and t[j] - t[i] < max_res]
    out = {}
    for k in range(len(near) + 1):
        for chosen in itertools.combinations(near, k):
            used = [x for c in chosen for x in c]
            by_a = [(i, j) if side[i] == 0 else (j, i) for i, j in chosen]
            if len(set(used)) < len(used) or any((a < c) != (b < d) for (a, b), (c, d) in itertools.combinations(by_a, 2)):
                continue
            on = [i in used for i in range(len(t))]
            score = sum(1 - 0.01 / max_res * (t[j] - t[i]) for i, j in chosen) - cost * sum(on[i] != on[i + 1] and t[i + 1] - t[i] < apart for i in range(len(t) - 1))
            out[on[0], on[-1]] = max(out.get((on[0], on[-1]), -1e9), score)
    return out


def test_chain_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        t, side = np.cumsum([rng.choice([0.05, 0.1, 0.2, 0.3, 0.6, 2]) for _ in range(n)]), np.array([rng.randint(0, 1) for _ in range(n)])
        found, best = M.best_chain(t, side, 0.5, 4.0, 0.6), searched(t, side, 0.5, 4.0, 0.6)
        assert found.keys() == best.keys()
        for k, (score, pairs) in found.items():
            assert score == pytest.approx(best[k])
            assert len({x for p in pairs for x in p}) == 2 * len(pairs)


def records(spark, seed=5, tags=6, span=4000.0, slope=1.0005, shift=3.0):
    """Hits of tags every 5 s or more at two receivers: some lost, some false, the second clock off by a line."""
    rng, rows, true, seq = random.Random(seed), [], set(), 0
    for tag in range(tags):
        t = rng.uniform(0, 5)
        while t < span:
            seq += 2
            heard = rng.random() < 0.8, rng.random() < 0.8
            if heard[0]:
                rows.append(("A", tag, seq, t + rng.uniform(0, 0.05)))
            if heard[1]:
                rows.append(("B", tag, seq + 1, slope * t + shift + rng.uniform(0, 0.05)))
            if all(heard):
                true.add((seq, seq + 1))
            t += 5 + 0.7 * tag + rng.uniform(-0.2, 0.2)
    false = [("B", rng.randrange(tags), 10**6 + i, rng.uniform(0, span)) for i in range(40)]
    return spark.createDataFrame(rows + false, "rx string, tag long, seq long, t double"), true


def test_planted_shift_drift_losses_and_false_hits(spark):
    det, true = records(spark)
    lines = M.fit_lines(D.match_candidates(det, 20.0), ["rx_a", "rx_b"])
    line = lines.first()
    assert line["slope"] == pytest.approx(1.0005, abs=5e-5) and line["b_mean"] - line["a_mean"] * 1.0005 == pytest.approx(3.0, abs=0.3)
    found = {}
    for width in (100.0, 1e9):  # the slices' width changes nothing
        match = M.match_records(det, lines, F.lit(5.0), slice_s=width).collect()
        found[width] = {(r["seq_a"], r["seq_b"]) for r in match}
        assert len(match) == len({r["seq_a"] for r in match}) == len({r["seq_b"] for r in match})
    assert found[100.0] == found[1e9]
    both = found[1e9] & true
    assert len(both) > 0.97 * len(true) and len(both) > 0.97 * len(found[1e9])


def test_contradictions_drop_a_match(spark):
    """A lone hit of each side matches; with strange hits of the tag before and behind it, within 0.8 of its interval, it does not."""
    line = spark.createDataFrame([("A", "B", 1.0, 0.0, 0.0)], "rx_a string, rx_b string, slope double, a_mean double, b_mean double")
    quiet = [("A", 1, 1, 100.0), ("B", 1, 2, 100.2), ("B", 1, 3, 104.5)]
    torn = [("A", 2, 4, 100.0), ("B", 2, 5, 100.2), ("B", 2, 6, 102.5), ("B", 2, 7, 98.0)]
    odd = [("A", None, 8, 1.0), ("B", 1, 9, None)]
    det = spark.createDataFrame(quiet + torn + odd, "rx string, tag long, seq long, t double")
    match = M.match_records(det, line, F.lit(5.0))
    assert [(r["tag"], r["seq_a"], r["seq_b"]) for r in match.collect()] == [(1, 1, 2)]
    assert M.match_records(det, line, F.lit(5.0), cost=0.0).count() == 2
    merged = D.merge_matched(det.where("rx = 'A' and tag = 1"), det.where("rx = 'B' and tag = 1"), match.select("seq_a", "seq_b"))
    assert merged.count() == 3


def test_no_rows(spark):
    det = spark.createDataFrame([], "rx string, tag long, seq long, t double")
    lines = M.fit_lines(D.match_candidates(det, 20.0), ["rx_a", "rx_b"])
    assert lines.count() == 0 and M.match_records(det, lines, F.lit(5.0)).count() == 0


def test_lines_of_few_or_far_candidates(spark):
    rows = [("p", 0.0, 0.0), ("q", 0.0, 30.0), ("q", 10.0, 40.0), ("r", 0.0, 1.0), ("r", 10.0, 11.0), ("r", None, 5.0)]
    lines = M.fit_lines(spark.createDataFrame(rows, "pair string, t_a double, t_b double"), ["pair"]).collect()
    assert [(r["pair"], r["n"]) for r in lines] == [("r", 2)]
