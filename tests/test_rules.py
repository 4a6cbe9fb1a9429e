"""Small hand-made cases of rules that SQL does not check, and recovery of what was planted."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions import exprs as X
from tidewake.operators import detections as D
from tidewake.operators import geo as G
from tidewake.operators import helpers as H
from tidewake.operators import stats as S
from tidewake.operators import sync as Y
from tidewake.operators import timejoin as J
from tidewake.operators import tracks as T
from tidewake.sources import readers as R


def _pos(spark, points):
    return spark.createDataFrame([(1, i, float(t), float(x), float(y)) for i, (t, x, y) in enumerate(points)], "id long, seq long, tnum double, x double, y double")


def test_multipath_at_its_limits(spark):
    times = [0.0, 0.4, 1.0, 2.0, 3.1, 3.0, 4.2]
    det = spark.createDataFrame([("a", 1, i, t) for i, t in enumerate(times)], "rx string, tag long, seq long, t double")
    kept = [r["seq"] for r in D.remove_multipath(det, ("rx",), 1.0).orderBy("seq").collect()]
    assert kept == [0, 4, 6]  # a gap of exactly 1 s goes, and a step back


def test_pings_keep_the_arrival_nearest_the_mean(spark):
    rows = [("a", 0, 0.0), ("b", 1, 9.9), ("b", 2, 19.9), ("a", 3, 30.0)]
    det = spark.createDataFrame([(1, *r) for r in rows], "tag long, rx string, seq long, t double")
    got = {(r["ping"], r["rx"]): r["seq"] for r in D.build_pings(det, 10.0).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 3}


def test_nearest_and_interpolated(spark):
    points = spark.createDataFrame([(t,) for t in (-1.0, 0.0, 5.0, 10.0, 12.0)], "t double")
    series = spark.createDataFrame([(0.0, 1.0), (10.0, 3.0)], "t double, value double")
    near = {r["t"]: r["near_v"] for r in J.nearest_join(points, series, None, 2.0).collect()}
    assert near == {-1.0: 1.0, 0.0: 1.0, 5.0: None, 10.0: 3.0, 12.0: 3.0}
    null = {r["t"]: r["value_at"] for r in J.interp_join(points, series, None, "null").collect()}
    assert null == {-1.0: None, 0.0: 1.0, 5.0: 2.0, 10.0: 3.0, 12.0: None}
    empty = J.interp_join(points, series.where("false"), None, "hold").collect()
    assert len(empty) == 5 and all(r["value_at"] is None for r in empty)


def test_series_across_time_slices(spark):
    rng = np.random.default_rng(5)
    times, values = np.sort(rng.uniform(0, 1e6, 60)), rng.normal(size=60)
    at = rng.uniform(-1e5, 1.1e6, 300)
    series = spark.createDataFrame([(float(a), float(b)) for a, b in zip(times, values, strict=True)], "t double, value double")
    got = J.interp_join(spark.createDataFrame([(float(t),) for t in at], "t double"), series).toPandas().sort_values("t")
    assert np.allclose(got["value_at"], np.interp(got["t"], times, values))


def test_partitions_do_not_matter(spark, data):
    from tidewake.plans.roles import detections, positions

    for make in (lambda n: D.remove_multipath(detections(spark, data).repartition(n), ("rx",), 600.0).select("seq"), lambda n: T.make_segments(positions(spark, data).repartition(n)).select("seq", "speed")):
        assert {tuple(r) for r in make(1).collect()} == {tuple(r) for r in make(7).collect()} == {tuple(r) for r in make(64).collect()}


def test_square_path_turns_left(spark):
    seg = T.make_segments(_pos(spark, [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)]))
    turns = [r["turn"] for r in T.turn_angle(seg).orderBy("t1").collect()][1:]
    assert np.allclose(turns, -math.pi / 2)
    unwrapped = [r["unwrapped"] for r in T.unwrap(seg).orderBy("t1").collect()]
    assert np.allclose(unwrapped, [0, math.pi / 2, math.pi, 3 * math.pi / 2])


def test_one_position_and_equal_times(spark):
    assert T.make_segments(_pos(spark, [(0, 0, 0)])).count() == 0
    seg = T.make_segments(_pos(spark, [(0, 0, 0), (0, 1, 1)])).first()
    assert seg["speed"] is None and seg["dt"] == 0


@pytest.mark.parametrize("flag, column", [(lambda p: H.flag_iterative(p, 1.0), "round"), (lambda p: H.flag_greedy(p, 1.0), "removed"), (lambda p: H.flag_cross(p, 1.0), "cross")])
def test_a_planted_spike_is_found(spark, flag, column):
    path = [(i, i * 0.1, 0.0) for i in range(12)]
    path[6] = (6, 0.6, 50.0)
    hit = [r["seq"] for r in flag(_pos(spark, path)).collect() if r[column]]
    assert 6 in hit and len(hit) <= 2


def test_gates(spark):
    seg = T.make_segments(_pos(spark, [(0, -1, 0.5), (2, 1, 0.5), (4, -1, 0.6), (6, -1, 5)]))
    gates = spark.createDataFrame([("g", 0.0, 0.0, 0.0, 1.0), ("old levee 1", 0.0, 0.0, 0.0, 1.0)], "gate string, gx1 double, gy1 double, gx2 double, gy2 double")
    got = [(r["gate"], round(r["tnum"], 6), r["l2r"]) for r in G.gate_crossings(seg, gates).orderBy("tnum").collect()]
    assert got == [("g", 1.0, True), ("g", 3.0, False)]


def test_positions_from_arrivals(spark):
    rng = np.random.default_rng(3)
    places = rng.uniform(0, 100, (5, 2))
    rx = spark.createDataFrame([(f"r{i}", float(x), float(y)) for i, (x, y) in enumerate(places)], "rx string, rx_x double, rx_y double")
    truth = {k: rng.uniform(20, 80, 2) for k in range(20)}
    rows = [(k, f"r{i}", float(5 + np.hypot(*(places[i] - p)) / 1460)) for k, p in truth.items() for i in range(5)]
    fixes = Y.solve_pings(spark.createDataFrame(rows, "ping_id long, rx string, toa double"), rx).toPandas()
    for k, p in truth.items():
        own = fixes[fixes["ping_id"] == k]
        assert np.hypot(own["x"] - p[0], own["y"] - p[1]).min() < 1e-3
    few = spark.createDataFrame(rows[:2], "ping_id long, rx string, toa double")
    assert Y.solve_pings(few, rx).count() == 0


def test_clock_offsets_are_recovered(spark, data):
    from tidewake.plans.helpers import h4_solve_clock

    got = h4_solve_clock(spark, data).toPandas()
    inner = got[(got["idx"] > 0) & (got["idx"] < got["idx"].max() - 1)]
    want = inner["rx"].map(lambda r: 0.0 if r == "click" else 0.1 * len(r))
    assert len(inner) and np.abs(inner["off"] - want).max() < 0.02


def test_clock_pair_drops_bad_matches(spark):
    rows = [("a", "b", 0, float(t), t * 1.0001 + 3) for t in range(0, 1000, 10)] + [("a", "b", 0, 500.0, 512.0), ("a", "b", 0, 100.0, 90.0)]
    got = H.fit_clock_pair(spark.createDataFrame(rows, "rx_a string, rx_b string, chunk long, t_a double, t_b double")).first()
    assert abs(got["slope"] - 1.0001) < 1e-6 and got["n"] == 100 and got["rms"] < 1e-6


def test_contradictions_of_a_match(spark):
    a = spark.createDataFrame([(1, 7, 100.0), (2, 7, 130.0), (3, 7, 160.0), (4, 9, 500.0), (5, None, 1.0), (6, 9, None)], "seq long, tag int, t double")
    b = spark.createDataFrame([(1, 7, 110.0), (2, 7, 143.0), (3, 7, 171.0), (4, 9, 530.0), (5, None, 1.0)], "seq long, tag int, t double")
    match = spark.createDataFrame([(1, 1), (3, 3)], "seq_a long, seq_b long")
    for width in (10.0, 25.0, 86400.0):  # slices do not show
        got = D.contradictions(a, b, match, F.lit(30.0), shift=10.0, slice_seconds=width).collect()
        # Of tag 7 at 140 and 143 neither hit is matched; 143 lies 27 before the next. Tag 9's hits lie 20 apart.
        assert sorted(tuple(r) for r in got) == [(7, "a", 2, "b", 2, 3.0), (9, "a", 4, "b", 4, 20.0)]
        strict = D.contradictions(a, b, match, F.when(F.col("tag") == 7, 30.0).otherwise(20.0), shift=10.0, share=1.0, slice_seconds=width)
        assert sorted((r["tag"], r["seq_1"], r["seq_2"], r["gap"]) for r in strict.collect()) == [(7, 2, 2, 3.0), (7, 2, 3, 27.0)]
    assert D.contradictions(a.limit(0), b.limit(0), match, F.lit(30.0)).count() == 0


def test_student_tail():
    assert np.allclose(H.student_tail(np.array([0.0, 2.0, 12.706]), np.array([5.0, 10.0, 1.0])), [1.0, 0.07338803, 0.05], atol=1e-5)


def test_weighted_median_and_bootstrap(spark):
    rows = spark.createDataFrame([(float(i), 1.0) for i in range(101)], "v double, w double")
    assert S.weighted_median(rows.withColumn("g", F.lit(1)), ["g"], "v", "w").first()["median"] == 50
    boot = S.boot_weighted_median(rows, "v", "w", 300).first()
    assert 45 < boot["mean"] < 55 and boot["q05"] < 50 < boot["q95"]


def test_running_weighted_quantile_is_a_median(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(i), float(x), 1.0) for i, x in enumerate(v)], "seq long, o double, v double, w double")
    got = H.running_weighted_quantile(df, "o", "v", "w", 21, 0.5, chunk=50).toPandas().sort_values("seq")["quantile"].to_numpy()
    assert np.allclose(got[10:-10], [np.median(v[i - 10 : i + 11]) for i in range(10, 390)])


def test_ols_of_three(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = 1 + x @ [2.0, -1.0, 0.5] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = S.ols(df, "y", ["a", "b", "c"]).first()
    want = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert np.allclose([got["intercept"], got["b_a"], got["b_b"], got["b_c"]], want)


def test_checksum_and_angles(spark):
    row = spark.range(1).select(X.line_checksum(F.lit("AB")).alias("c"), X.line_checksum(F.lit("")).alias("e"), X.wrap_angle(F.lit(math.pi)).alias("w"), X.parse_dms(F.lit("-121°30'36.0\"")).alias("d")).first()
    assert row["c"] == "83" and row["e"] == "00" and abs(row["w"] + math.pi) < 1e-12 and abs(row["d"] + 121.51) < 1e-9


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "track-3C5E.csv").write_text(",x,y,tnum,x_sd,y_sd,num_rx\n0,1.5,2.5,10.0,0.1,0.2,3\n1,1.6,,12.0,0.1,0.2,3\n")
    rows = R.read_tracks(spark, str(tmp_path / "track-*.csv")).collect()
    assert [r["id"] for r in rows] == ["3C5E", "3C5E"] and rows[1]["y"] is None
    (tmp_path / "sections.txt").write_text("section 8B\n0.0 1.0 2.0 380 24 25 -9.4 9.4\n24 0.1 0.2 0.5\n25 0.3 0.4 0.5\nsection 9\n0.0 1.0 2.0 380 1 1 -9.4 9.4\n1 0.1 0.2 0.5\n")
    got = R.parse_sections(spark, str(tmp_path / "sections.txt")).collect()
    assert [(r["section"], r["k"]) for r in got] == [("8B", 24), ("8B", 25), ("9", 1)]
    (tmp_path / "rx.txt").write_text("\x00*5.0,RTMNOW\n*402311.1#31,TIME=2021-07-05 03:21:09\n*402311.2#32[0041],OK,#3C\nNODE:001,1\nxx\n")
    lines = R.parse_receiver_lines(R.read_lines(spark, str(tmp_path / "rx.txt"))).orderBy("line_no").collect()
    assert [r["type"] for r in lines][:5] == ["RTMNOW", "TIME", "OK", "NODE", "unknown"]
    (tmp_path / "a.det").write_text("1,2021,7,5,3,21,9,1625455269,250000,2B7D ,1,2,3,4,1,98214.6,17.2\n")
    det = R.read_detections(spark, str(tmp_path / "a.det"), spark.createDataFrame([("a.det", "S1")], "file string, station string")).first()
    assert det["station"] == "S1" and det["epoch"] == 1625455269


def test_a_gauge_must_cover_its_range(spark, tmp_path):
    start, end = datetime.datetime(2018, 3, 13), datetime.datetime(2018, 3, 14)
    lines = [f"{start + datetime.timedelta(hours=h):%m/%d/%Y %H:%M:%S},{h + 0.5}" for h in range(-40, 60, 2)]

    def read(rows):
        at = tmp_path / "gauge.csv"
        at.write_text("\n".join(["station", "flow", "time,value", *rows, "03/13/2018 12:15:00,NaN", "03/13/2018 12:20:00,Infinity"]) + "\n")
        return R.read_gauge(spark, str(at), start, end).orderBy("time").collect()

    rows = read(lines)
    assert len(rows) == 36 and rows[0]["time"] == start - datetime.timedelta(days=1) and rows[0]["value"] == -31.5
    for bad in (lines[:20] + lines[21:], lines[:30], lines[12:], []):  # a gap of four hours, an early end, a late start, nothing
        with pytest.raises(ValueError, match="does not cover"):
            read(bad)


def test_clock_resets_of_a_log(spark):
    log = [("01/02/2024 00:00:00", " RTC: 1.0 FPGA: 10.5 dt=-0.3"), ("01/02/2024 00:10:00", " nothing"), ("01/02/2024 00:20:00", " FPGA started!! Init FPGA clock using RTC=30.5"), ("01/02/2024 00:30:00", "x FPGA=31.0 -Before SYNC"), ("01/02/2024 00:30:01", "x FPGA=40.0 -After SYNC")]
    got = R.clock_resets(spark.createDataFrame([("f", i, *r) for i, r in enumerate(log)], "file string, line_no long, time string, message string")).orderBy("line_no").collect()
    assert [(r["fpga_pre"], r["fpga_post"], r["msg_pre"], r["msg_post"]) for r in got] == [(10.5, 30.5, log[0][1], log[2][1]), (31.0, 40.0, log[3][1], log[4][1])]


def test_regular_steps(spark):
    pos = _pos(spark, [(0, 0, 0), (5, 1, 2), (21, 4, 8)])
    got = [tuple(r) for r in T.expand_regular(pos, 5.0, "linear").orderBy("step").select("step", "x", "y").collect()]
    assert got == [(0, 0, 0), (1, 1, 2), (2, 2, 4), (3, 3, 6), (4, 4, 8)]
    assert [r["x"] for r in T.expand_regular(pos, 5.0).orderBy("step").collect()] == [0, 1, None, None, 4]
    with pytest.raises(Exception, match="half a step apart"):
        T.expand_regular(_pos(spark, [(0, 0, 0), (1, 1, 2)]), 5.0).collect()


def test_place_at_entry(spark):
    pos = _pos(spark, [(0, 0, 0), (10, 10, 20)])
    exits = lambda *r: spark.createDataFrame([(1, *r)], "id long, entry double, exit_a double, exit_b double")
    one = T.route_table(pos, exits(4.0, 9.0, 8.0)).first()
    assert (one["route"], one["x"], one["y"], one["exit_time"]) == ("b", 4.0, 8.0, 8.0)
    none = T.route_table(pos, exits(None, None, None)).first()
    assert (none["route"], none["x"], none["entry_time"]) == ("no_exit", 0.0, 0.0)


def test_a_filled_straight_track_stays_straight(spark):
    got = H.smooth_fill(_pos(spark, [(t, 2 * t, 1 - t) for t in (0, 5, 7, 20, 26)]), 3, 2.0).toPandas()
    assert len(got) == 14 and np.allclose(got["x"], 2 * got["t"]) and np.allclose(got["y"], 1 - got["t"])


def test_turns_of_a_filled_track(spark):
    rng = np.random.default_rng(4)
    head = np.where(np.arange(80) < 40, 0.0, 2.0) + rng.normal(0, 0.2, 80)
    x, y = np.concatenate([[0], np.cumsum(np.cos(head))]), np.concatenate([[0], np.cumsum(np.sin(head))])
    fill = spark.createDataFrame([(1, 5.0 * i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, t double, x double, y double")
    heard = [5.0 * i for i in range(81) if i % 3]
    raw = spark.createDataFrame([(1, t) for t in heard], "id long, tnum double")
    got = H.change_points_filled(fill, raw).toPandas().sort_values("t").reset_index(drop=True)
    head, want = np.arctan2(np.diff(y), np.diff(x)), np.ones(81)
    for i in range(7, 74):
        a, b = head[i - 6 : i], head[i : i + 6]
        (ma, va), (mb, vb) = [(math.atan2(np.sin(q).mean(), np.cos(q).mean()), -2 * math.log(math.hypot(np.sin(q).mean(), np.cos(q).mean()))) for q in (a, b)]
        n1, n2 = sum(5.0 * (i - 3) <= t <= 5.0 * i for t in heard), sum(5.0 * i <= t <= 5.0 * (i + 4) for t in heard)
        t = abs((ma - mb + math.pi) % (2 * math.pi) - math.pi) / max(0.05 * math.pi, math.sqrt(va / n1 + vb / n2))
        want[i] = H.student_tail(np.array([t]), np.array([max(1, min(n1, n2) - 1)]))[0] / 2
    assert np.allclose(got["p"], want)
    assert list(got.index[got["is_change"]]) == [i for i in range(7, 74) if want[i] < 0.05 and want[i] == want[i - 3 : i + 3].min()]
    assert any(38 <= i <= 42 for i in got.index[got["is_change"]])


def test_partial_autocorrelation(spark):
    v = [1.0, 3.0, 2.0, 5.0, 4.0, 6.0, 2.0, 7.0, 3.0, 1.0, 4.0, 4.0]
    got = H.pacf(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "id long, step long, v double"), "v", 5).orderBy("lag").toPandas()["pacf"]
    d = np.array(v) - np.mean(v)
    r = [1.0] + [float((d[:-k] * d[k:]).mean() / (d * d).mean()) for k in range(1, 6)]
    for k in range(1, 6):  # the last coefficient of the k equations of Yule and Walker
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(got[k - 1] - np.linalg.solve(m, r[1 : k + 1])[-1]) < 1e-9


def test_a_daily_signal_is_told_from_noise(spark):
    rng = np.random.default_rng(6)
    theta, noise = rng.uniform(0, 2 * math.pi, 60), rng.normal(size=60)
    rows = lambda v: spark.createDataFrame([(i, float(a), float(t)) for i, (a, t) in enumerate(zip(v, theta, strict=True))], "id long, v double, theta double")
    signal = S.diel_permutation(rows(3 * np.cos(theta) + noise), "id", "v", "theta", 199).first()
    assert signal["p"] <= 0.01 and abs(signal["observed"] - abs(np.mean((3 * np.cos(theta) + noise) * np.exp(1j * theta)))) < 1e-9
    assert S.diel_permutation(rows(noise), "id", "v", "theta", 199).first()["p"] > 0.01


def test_planted_clusters(spark):
    rng = np.random.default_rng(7)
    middles = [(0, 0, 0), (10, 0, 5), (0, 10, -5)]
    rows = [(i, *(float(c + e) for c, e in zip(middles[i % 3], rng.normal(0, 0.3, 3), strict=True))) for i in range(90)]
    got = S.segment_clusters(spark.createDataFrame(rows, "seq long, a double, b double, c double"), ["a", "b", "c"], 3).toPandas()
    assert len(got) == 90 and got.groupby(got["seq"] % 3)["cluster"].nunique().tolist() == [1, 1, 1] and got["cluster"].nunique() == 3


def test_poisson_draws():
    import pandas as pd

    u = pd.Series((np.arange(20_000) + 0.5) / 20_000)
    for n in (1, 7, 400, 1_000_000):
        got = S.poisson_draw(pd.Series([n] * len(u)), u)
        assert abs(got.mean() - n) < 0.01 * math.sqrt(n) and abs(got.var() / n - 1) < 0.02
    one = S.poisson_draw(pd.Series([1, 1, 1]), pd.Series([0.36, 0.37, 0.74]))
    assert one.tolist() == [0.0, 1.0, 2.0]


def test_shift_and_drift_are_recovered(spark):
    src = [86400.0 * k / 4 for k in range(40)]
    clock = lambda s: 1200.0 + 0.4 * s / 86400
    ab = spark.createDataFrame([(1, s + 30 + clock(s), s) for s in src], "tag long, t double, src double")
    ba = spark.createDataFrame([(1, s + 30 - clock(s), s) for s in src], "tag long, t double, src double")
    got = Y.search_shift_drift(ab, ba, [600.0 * k for k in range(-4, 5)], [0.1 * k for k in range(-6, 7)], ["tag"]).first()
    assert got["shift"] == 1200.0 and abs(got["drift"] - 0.4) < 1e-9 and abs(got["cost"] - 60) < 1e-3


def test_sync_quality_by_interval(spark):
    dist = spark.createDataFrame([("a", "b", 1460.0), ("a", "a", 0.0)], "rx_a string, rx_b string, dist double")
    pings = spark.createDataFrame([(1, "a", "a", 10.0), (1, "a", "b", 11.5), (2, "a", "a", 100.0), (2, "a", "b", 101.0)], "ping_id long, tx string, rx string, t double")
    speeds = spark.createDataFrame([(0, 1 / 1460), (1, 1 / 1460)], "idx long, inv_c double")
    for inv in (1 / 1460, speeds):
        got = {(r["rx"], r["idx"]): (r["pings"], round(r["rms"], 9)) for r in Y.evaluate_sync(pings, dist, inv, 0.0, 60.0).collect()}
        assert got == {("a", 0): (1, 0.25), ("b", 0): (1, 0.25), ("a", 1): (1, 0.0), ("b", 1): (1, 0.0)}


def test_nearest_samples_far_away(spark):
    rng = np.random.default_rng(8)
    at = np.r_[rng.uniform(0, 10, (60, 2)), [[500.0, 3.0], [900.0, 900.0]]]
    samples = spark.createDataFrame([(i, float(x), float(y), float(i)) for i, (x, y) in enumerate(at)], "sid long, x double, y double, z double")
    places = [(0, 5.0, 5.0), (1, 450.0, 0.0), (2, -300.0, 700.0)]
    for k in (3, 100):
        got = G.near_samples(spark.createDataFrame(places, "target long, x double, y double"), samples, 2.0, k).toPandas()
        for t, x, y in places:
            want = sorted(range(62), key=lambda i: (math.hypot(at[i][0] - x, at[i][1] - y), i))[:k]
            assert sorted(got[got["target"] == t]["sid"]) == sorted(want)
    assert G.near_samples(spark.createDataFrame(places, "target long, x double, y double"), samples.where("false"), 2.0, 3).count() == 0


def test_closure_around_a_triangle(spark):
    leg = lambda *rows: spark.createDataFrame([tuple(map(float, r)) for r in rows], "t double, skew double, travel double, stale double")
    got = J.triangle_closure([leg((0, 1, 10, 0), (10, 3, 10, 100)), leg((0, -1, 5, 0), (10, -1, 5, 0)), leg((5, 0, 1, 0), (10, -2, 1, 200))], max_stale=100.0)
    rows = {r["t"]: (r["net_skew"], r["net_travel"], r["low_stale"]) for r in got.collect()}
    assert rows == {0.0: (None, None, None), 5.0: (1.0, 16.0, True), 10.0: (0.0, 16.0, False)}


def test_sources_of_a_two_way_clock(spark):
    series = lambda *rows: spark.createDataFrame([tuple(map(float, r)) for r in rows], "t double, value double")
    got = {r["t"]: (r["travel"], r["skew"], r["src_is_a"]) for r in J.two_way_clock(series((0, 4), (10, 4)), series((0, 2), (5, 2))).collect()}
    assert got == {0.0: (3.0, 1.0, True), 5.0: (3.0, 1.0, False), 10.0: (3.0, 1.0, True)}


def test_empty_tables(spark, data):
    from tidewake.plans.roles import detections, positions

    det, pos = detections(spark, data).where("false"), positions(spark, data).where("false")
    for out in (D.remove_multipath(det), D.build_pings(det), D.tag_summary(det), T.make_segments(pos), T.smooth_position(pos), T.swim_stats(T.make_segments(pos)), T.expand_regular(pos), H.flag_greedy(pos), D.pair_similarity(det)):
        assert out.count() == 0


def test_a_wide_running_window_over_small_chunks(spark):
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=160), rng.uniform(0.5, 2, 160)
    df = spark.createDataFrame([(i, float(i), float(a), float(b)) for i, (a, b) in enumerate(zip(v, w, strict=True))], "seq long, o double, v double, w double")
    got = H.running_weighted_quantile(df, "o", "v", "w", 41, 0.3, chunk=5).toPandas().sort_values("seq")["quantile"].to_numpy()
    for i in range(160):
        a, b = max(0, i - 20), min(160, i + 21)
        o = np.argsort(v[a:b])
        s = np.cumsum(w[a:b][o])
        assert abs(got[i] - np.interp(0.3, (s - w[a:b][o] / 2) / s[-1], v[a:b][o])) < 1e-9


def test_slices_do_not_matter(spark, data):
    from tidewake.plans.roles import detections

    det = detections(spark, data)
    for make in (lambda n: D.remove_multipath(det, ("rx",), 600.0, n).select("seq"), lambda n: D.split_on_resets(det.withColumn("t", F.col("t") - F.col("k") * 600), F.col("sensor") > 200, n).select("seq", "segment")):
        assert {tuple(r) for r in make(7).collect()} == {tuple(r) for r in make(10**9).collect()}


def test_silences_over_several_batches(spark, tmp_path):
    from tidewake.streaming import jobs as S

    times = [0.0, 100.0, 20_000.0, 20_100.0, 20_200.0, 90_000.0]
    rx = spark.createDataFrame([("a", 7)], "rx string, sync_tag long")
    rows = [("a", 7, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), t + 1704067200.0, 1.0) for i, t in enumerate(times)]
    schema = "rx string, tag long, seq long, time timestamp, t double, sensor double"
    for files in (1, 3, 6):
        at = str(tmp_path / f"in{files}")
        for k in range(files):
            spark.createDataFrame(rows[k * 6 // files : (k + 1) * 6 // files], schema).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
        got = S.drained(S.stream_beacon_health(stream, rx, 10, 30.0), "silences").where("to_t is not null").orderBy("from_t").collect()
        assert [(r["from_t"] - 1704067200, r["to_t"] - 1704067200, r["missed"]) for r in got] == [(100.0, 20_000.0, 662), (20_200.0, 90_000.0, 2326)]
