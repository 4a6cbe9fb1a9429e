"""Places in a global order on skewed keys, and the greedy removal against a plain one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import helpers as H
from tidewake.operators import stats as S
from tidewake.operators import tracks as T
from tidewake.operators.ordering import numbered


def skewed(n=20_000):
    """Nine tenths of the rows in a hundredth of the range, a third of all at one value, some nulls."""
    rng = random.Random(5)
    draw = lambda: 0.5 if rng.random() < 1 / 3 else rng.uniform(0, 1) if rng.random() < 0.9 else rng.uniform(0, 100)
    return [(i, None if i % 997 == 0 else draw(), rng.randint(0, 9)) for i in range(n)]


def test_places_and_balance(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "seq long, v double, w long").repartition(6)
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])))}
    got = numbered(df, ["v", "seq"], "place")
    assert {r["seq"]: r["place"] for r in got.collect()} == want
    sizes = [r["count"] for r in df.repartitionByRange(8, "v", "seq").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * np.median(sizes)
    total, before = {}, 0
    for r in sorted(rows, key=lambda r: want[r[0]]):
        total[r[0]], before = before, before + r[2]
    assert {r["seq"]: r["sum"] for r in numbered(df, ["v", "seq"], "sum", "w").collect()} == total
    assert numbered(df.limit(0), ["v"], "place").count() == 0


def test_ranks_quantiles_and_correlations_on_skewed_keys(spark):
    rows = [r for r in skewed(3000) if r[1] is not None]
    df = spark.createDataFrame(rows, "seq long, v double, w long")
    ranks = {r["cell"]: r["rank"] for r in T.rank_cells(df.select(F.col("seq").alias("cell"), F.col("v").alias("n"))).collect()}
    assert ranks == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["seq"]: r["quantile"] for r in H.running_weighted_quantile(df.withColumn("one", F.lit(1.0)).withColumn("y", F.col("seq").cast("double")), "v", "y", "one", 5, 0.5, chunk=100).collect()}
    for k in range(2, len(order) - 2):
        assert got[order[k][0]] == pytest.approx(np.median([r[0] for r in order[k - 2 : k + 3]]))
    r = S.correlations(df.withColumn("u", F.col("v") * F.col("v")), ["u"], ["v"], "spearman").first()["r"]
    assert r == pytest.approx(1.0)


def test_nulls_in_regressions_and_correlations(spark):
    rows = [(1.0, 2.0, 9.0), (2.0, 4.0, None), (3.0, 6.0, 1.0), (None, 100.0, 5.0), (4.0, None, 3.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    fit = S.ols(df, "y", ["x"]).first()
    assert (fit["n"], round(fit["intercept"], 9), round(fit["b_x"], 9), round(fit["r2"], 9)) == (3, 0.0, 2.0, 1.0)
    models = {r["model"]: r["n"] for r in S.compare_models(df, "y", [["x"], ["z"]]).collect()}
    assert models == {"x": 3, "z": 3}
    assert S.ols(df.limit(0), "y", ["x"]).first()["n"] == 0
    found = {r["x"]: r["r"] for r in S.correlations(df, ["y"], ["x", "z"], "spearman").collect()}
    assert found["x"] == pytest.approx(1.0) and found["z"] is not None


def test_many_lines_meet_as_few_do(spark, monkeypatch):
    from tidewake.operators import geo as G

    rng = random.Random(9)
    seg = spark.createDataFrame([(1, i, *[rng.uniform(0, 50) for _ in range(4)], float(i), i + 1.0) for i in range(60)], "id long, seq long, x1 double, y1 double, x2 double, y2 double, t1 double, t2 double")
    lines = spark.createDataFrame([(f"g{i}", *[rng.uniform(0, 50) for _ in range(4)]) for i in range(40)], "gate string, gx1 double, gy1 double, gx2 double, gy2 double")
    few = [sorted(map(tuple, f.collect())) for f in (G.gate_crossings(seg, lines), G.crossing_fraction(seg, lines), G.crossing_fraction(seg, lines, True))]
    monkeypatch.setattr(G, "LINES_BROADCAST", 3)
    many = [sorted(map(tuple, f.collect())) for f in (G.gate_crossings(seg, lines), G.crossing_fraction(seg, lines), G.crossing_fraction(seg, lines, True))]
    assert few == many and all(few)


def greedily(t, x, y, limit):
    left = list(range(len(t)))
    while left:
        k = np.array(left)
        dv = H._dv(np.array(t)[k], np.array(x)[k], np.array(y)[k])
        if dv.max() < limit:
            break
        del left[int(dv.argmax())]
    return {i for i in range(len(t)) if i not in left}


def test_greedy_removal_is_the_plain_one(spark):
    rng, rows, want = random.Random(3), [], {}
    for track in range(12):
        n = rng.choice([0, 1, 2, 3, 10, 60])
        t = np.cumsum([rng.choice([0.0, 1.0, 2.0]) for _ in range(n)])
        x, y = [float(rng.randint(0, 9)) for _ in range(n)], [float(rng.randint(0, 9)) for _ in range(n)]
        rows += [(track, i, float(t[i]), x[i], y[i]) for i in range(n)]
        want |= {(track, i): i in greedily(t, x, y, 2.0) for i in range(n)}
    pos = spark.createDataFrame(rows, "id long, seq long, tnum double, x double, y double")
    assert {(r["id"], r["seq"]): r["removed"] for r in H.flag_greedy(pos, 2.0).collect()} == want


def test_long_tracks_take_n_log_n(spark):
    n = 100_000
    pos = spark.range(n).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("tnum"), F.when(F.col("id") % 3 == 0, 50.0).otherwise(F.sin(F.col("id") / math.e)).alias("x"), F.lit(0.0).alias("y"))
    assert H.flag_greedy(pos, 5.0).where("removed").count() > n / 4
    steps = T.expand_regular(pos.withColumn("tnum", F.col("tnum") * 10), 5.0, "linear")
    assert steps.count() == 2 * n - 1 and steps.where("x is null").count() == 0
