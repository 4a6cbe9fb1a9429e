"""The windowed clock solve: its banded elimination, planted offsets that turn, bad arrivals, and what a task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import sync as Y

PLACES = {"A": (0.0, 0.0), "B": (300.0, 20.0), "C": (150.0, 260.0), "D": (40.0, 180.0)}


def test_banded_solution():
    rng = np.random.default_rng(2)
    for size, band in ((1, 1), (7, 3), (60, 11)):
        low = np.tril(rng.normal(size=(size, size)))
        low[np.subtract.outer(np.arange(size), np.arange(size)) > band] = 0
        a = low @ low.T + 0.1 * np.eye(size)
        u, v = np.nonzero(np.triu(a))
        y = rng.normal(size=size)
        assert np.allclose(a @ Y.banded_solution(size, max(1, int((v - u).max())), u, v, a[u, v], y), y)


def equations(spark, pings, days=6, bad=0, seed=3):
    """Equations of calls at random times, clocks that turn each day, speeds by day."""
    rng = np.random.default_rng(seed)
    turn = {r: np.zeros(days + 1) if r == "A" else rng.uniform(-0.5, 0.5, days + 1) for r in PLACES}
    inv, rows = 1 / (1450 + 5 * np.arange(days)), []
    for k in range(pings):
        day, tx = k % days, "ABCD"[k % 4]
        t0 = 100 * (day + rng.uniform(0.02, 0.98))
        for r in PLACES:
            true = t0 + np.hypot(*np.subtract(PLACES[tx], PLACES[r])) * inv[day]
            slope = (turn[r][day + 1] - turn[r][day]) / 100
            rows.append((k, tx, r, float((true - turn[r][day] + slope * 100 * day) / (1 + slope)) + (0.3 if k < bad and r == "C" else 0.0)))
    distances = [(a, b, float(np.hypot(*np.subtract(PLACES[a], PLACES[b])))) for a in PLACES for b in PLACES]
    eq = Y.clock_equations(spark.createDataFrame(rows, "ping_id long, tx string, rx string, t double"), spark.createDataFrame(distances, "rx_a string, rx_b string, dist double"))
    return eq, turn, inv


def test_planted_offsets_speeds_and_bad_arrivals(spark):
    eq, turn, inv = equations(spark, 600, bad=12)
    nothing = spark.createDataFrame([("A", None, "B", 1.0, 2.0), (None, 1.0, "B", 1.0, 2.0)], "a string, ta double, b string, tb double, ddist double")
    got = {(r["rx"], r["idx"]): r for r in Y.solve_clock(eq.select("a", "ta", "b", "tb", "ddist").unionByName(nothing), 0.0, 100.0, "A", 6, window=4, overlap=2).collect()}
    assert len(got) == 4 * 7
    for (rx, i), r in got.items():
        assert r["off"] == pytest.approx(turn[rx][i], abs=2e-4) and r["rms"] < 1e-3
        assert r["inv_c"] == pytest.approx(inv[min(i, 5)], rel=2e-3)


def test_too_many_bad_arrivals_and_no_rows(spark):
    eq, _, _ = equations(spark, 200, bad=40)
    assert Y.solve_clock(eq, 0.0, 100.0, "A", 6, max_drops=3).count() == 0
    assert Y.solve_clock(eq.limit(0), 0.0, 100.0, "A", 6).count() == 0


def test_a_task_holds_a_window_whatever_the_pings(spark):
    sizes = []
    for pings in (300, 3000):
        terms = Y._clock_terms(equations(spark, pings)[0], ["B", "C", "D"], 0.0, 100.0, "A", 6, 6, 4)
        pairs = terms.select("win", F.explode("terms").alias("x"), "terms").select("win", "x.u", F.explode("terms.u").alias("v")).where("v >= u").distinct()
        sizes.append(pairs.count())
    assert sizes[1] <= 1.1 * sizes[0]
