"""Filled tracks against a plain loop; the permutation test against the same shuffles made in numpy, in one block and in several."""

import math

import numpy as np
import pytest

from tidewake.operators import helpers as H
from tidewake.operators import stats as S


def plain_fill(t, x, y, n, dt):
    out, i, k = [], 0, 0
    while t[0] + k * dt <= t[-1]:
        now = t[0] + k * dt
        if i < len(t) - 2 and t[i + 1] <= now:
            i += 1
        a, b = max(0, i - n), min(len(t) - 1, i + n)
        w = np.array(t[a:b]) - t[i]
        line = lambda c: np.polyval(np.polyfit(w, c[a:b], 1), now - t[i]) if b - a > 1 and np.ptp(w) > 0 else c[i]  # noqa: E731, B023
        out.append((now, line(x), line(y)))
        k += 1
    return out


def test_filled_tracks_as_a_loop_fills_them(spark):
    rng, rows, want = np.random.default_rng(3), [], []
    for tag in range(6):
        size = [3, 4, 9, 40, 80, 2][tag]
        t = 1.7e9 * (tag % 2) + np.cumsum(rng.choice([0.0, 1.0, 2.5, 5.0, 30.0], size))
        x, y = rng.normal(size=size), rng.normal(size=size)
        rows += [(tag, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, x, y, strict=True))]
        want += [(tag, *map(float, r)) for r in plain_fill(t, x, y, 3, 2.0)] if size > 2 else []
    rows += [(9, i, 7.0, float(i), 0.0) for i in range(4)]  # one time alone: its own place
    want.append((9, 7.0, 1.0, 0.0))
    pos = spark.createDataFrame(rows, "id long, seq long, tnum double, x double, y double")
    got = sorted(tuple(r) for r in H.smooth_fill(pos, 3, 2.0).collect())
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in sorted(want)], atol=1e-6)
    assert H.smooth_fill(pos.where("id < 0")).isEmpty()
    assert H.smooth_fill(pos.selectExpr("id", "seq", "tnum", "double(null) AS x", "y"), 3, 2.0).where("x is not null").isEmpty()


@pytest.mark.parametrize("block", [1000, 16])
def test_shuffles_as_numpy_makes_them(spark, block):
    rng = np.random.default_rng(6)
    theta, noise = rng.uniform(0, 2 * math.pi, 60), rng.normal(size=60)
    for v, low in ((2 * np.cos(theta) + noise, True), (noise, False)):
        rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, theta, strict=True))] + [(99, None, 1.0), (99, 1.0, None)]
        frame = spark.createDataFrame(rows, "id long, v double, theta double")
        got = S.diel_permutation(frame, "id", "v", "theta", 199, 5, block, 50).first()
        blocks = max(1, -(-60 // block))
        z = np.zeros(200, complex)
        for b in range(blocks):
            own, to = v[b::blocks], np.exp(1j * theta[b::blocks])
            z += [(np.random.default_rng([5, b, r]).permutation(own) if r else own) @ to for r in range(200)]
        m = np.abs(z) / 60
        assert abs(got["observed"] - m[0]) < 1e-12 and abs(got["p"] - (1 - np.sum(m[1:] < m[0]) / 200)) < 1e-12
        assert (got["p"] <= 0.01) == low
    assert S.diel_permutation(frame.where("id < 0"), "id", "v", "theta", 99).isEmpty()
