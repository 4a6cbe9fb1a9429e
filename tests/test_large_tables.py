"""Rows that only large tables hold: tracks that go back the way they came, pings at a receiver's place, many bad arrivals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import rows
from tests.test_clock import equations
from tidewake.operators import sync as Y
from tidewake.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()

#: Three positions each, the third straight back over the first: on either side of pi by the last digit of the headings.
BACK = [((10.44, 83), (115.78, 99), (10.44, 83)), ((119.35, 0), (46.53, 99), (112.73, 9)), ((58.23, 29), (15.59, 44), (58.23, 29)), ((26.5, 25), (7.26, 63), (16.88, 44)), ((8.89, 86), (35.79, 92), (8.89, 86)),
    ((14.13, 90), (20.18, 30), (15.34, 78)), ((29.78, 69), (3.05, 46), (56.51, 92)), ((38.92, 14), (27.32, 8), (38.92, 14)), ((3.66, 53), (10.13, 55), (3.66, 53))]


@pytest.fixture(scope="module")
def turned_back(tmp_path_factory):
    """Events of tracks that turn straight back; the other tables are empty of meaning and not read."""
    folder = tmp_path_factory.mktemp("back")
    events = [(3 * i + j, pd.Timestamp("2024-01-02") + pd.Timedelta(hours=5 * j, minutes=i), i, "click", x, f'{{"k": {y}}}') for i, track in enumerate(BACK) for j, (x, y) in enumerate(track)]
    pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet", index=False)
    return str(folder)


def _sql(folder: str, name: str) -> pd.DataFrame:
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con.execute(SQL[name]).df()


@pytest.mark.parametrize("name", ["e21_speed_heading_steps", "e28_change_points", "e7_e8_steps", "e9_unwrap", "b10_b11_angles"])
def test_turned_back_as_sql(spark, turned_back, name):
    ours, theirs = QUERIES[name](spark, turned_back).toPandas(), _sql(turned_back, name)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["e28_change_points", "e7_e8_steps"])
def test_many_turned_back_as_sql(spark, tmp_path, name):
    """Tracks drawn at random, each straight back over its own line, all the way or a part or beyond."""
    rng, m = np.random.default_rng(12), 5_000
    way = np.stack([rng.integers(1, 400, m), rng.integers(0, 8, m)]) * rng.choice([-1, 1], (2, m))
    a = np.stack([rng.integers(3_000, 50_000, m), rng.integers(45, 55, m)])
    b = a + rng.integers(1, 7, m) * way
    c = np.where(rng.random(m) < 0.5, a, b - rng.integers(1, 7, m) * way)
    x, y = np.stack([a, b, c], 2)
    ts = pd.Timestamp("2024-01-02") + pd.to_timedelta(np.sort(rng.integers(0, 20 * 86_400_000_000, (m, 3)), 1).ravel(), "us")
    events = pd.DataFrame({"event_id": np.arange(3 * m), "ts": ts.astype("datetime64[us]"), "user_id": np.repeat(np.arange(m), 3), "event_type": "click", "value": x.ravel() / 100, "props": [f'{{"k": {k}}}' for k in y.ravel()]})
    events.to_parquet(tmp_path / "events.parquet", index=False)
    columns = ["id", "seq", "turn"] if name == "e7_e8_steps" else ["id", "seq", "by_turn", "by_rate"]
    ours, theirs = (df.sort_values("seq")[columns].reset_index(drop=True) for df in (QUERIES[name](spark, str(tmp_path)).toPandas(), _sql(str(tmp_path), name)))
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


def test_heading_keeps_nulls(spark):
    from tidewake.functions.exprs import heading

    got = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (float("nan"), 1.0), (0.0, 0.0)], "x double, y double").select(heading(F.col("x"), F.col("y")).alias("h")).collect()
    assert got[0][0] == math.pi / 4 and got[1][0] is None and math.isnan(got[2][0]) and got[3][0] == 0


def test_pings_at_a_receiver(spark):
    """A ping at the place of a receiver has range 0 there; rounding must not lose it."""
    places = {"a": (0.0, 0.0), "b": (120.0, 10.0), "c": (60.0, 90.0), "d": (10.0, 70.0), "e": (130.0, 80.0)}
    rng, pings, at = np.random.default_rng(3), [], {}
    for x, y in places.values():
        for t in rng.uniform(0, 1000, 200):
            at[len(at)] = (x, y)
            pings += [(len(at) - 1, rx, float(t + math.hypot(x - a, y - b) / 1460)) for rx, (a, b) in places.items()]
    rx = spark.createDataFrame([(k, *v) for k, v in places.items()], "rx string, rx_x double, rx_y double")
    found = Y.solve_pings(spark.createDataFrame(pings, "ping_id long, rx string, toa double"), rx).toPandas()
    best = found.sort_values("rms").drop_duplicates("ping_id").set_index("ping_id")
    assert len(best) == len(at)
    assert all(math.hypot(best["x"][i] - x, best["y"][i] - y) < 1e-3 for i, (x, y) in at.items())


def test_bad_arrivals_in_proportion(spark):
    """A share of bad arrivals is dropped however many that is."""
    eq, turn, _ = equations(spark, 600, bad=12)
    assert Y.solve_clock(eq, 0.0, 100.0, "A", 6, max_drops=3).count() < 4 * 7
    got = Y.solve_clock(eq, 0.0, 100.0, "A", 6, max_drops=3, max_share=0.05).collect()
    assert len(got) == 4 * 7 and all(abs(r["off"] - turn[r["rx"]][r["idx"]]) < 2e-4 for r in got)


def test_checksum_of_whole_lines(spark):
    """Bytes are summed line by line, not by an interpreted step a byte."""
    from tidewake.functions.exprs import line_checksum

    df = spark.createDataFrame([("AB",), ("",), (None,), ("Ünï\x00",), ("z" * 100_000,)], "line string").select("line", line_checksum(F.col("line")).alias("c"))
    assert "aggregate(" not in df._jdf.queryExecution().toString()
    assert all(c == f"{sum((x or '').encode()) % 256:02X}" for x, c in df.collect())


def test_sections_share_files(spark, data):
    """The query's files do not grow in number with the tags."""
    import glob

    from tidewake.session import shared_folder

    def written() -> set[str]:
        return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/a12-*/**/part-*", recursive=True))

    before = written()
    tags = QUERIES["a12_parse_sections"](spark, data).select("section").distinct().count()
    assert 0 < len(written() - before) < tags


def test_waiting_rows_in_blocks():
    """Rows wait in blocks, not one by one, and come back as they were, nulls too."""
    import pickle

    from tidewake.streaming import jobs as S

    waiting = "ms long, us long, seq long, t double, is_sync boolean"
    processor = S._InOrder(["rx"], waiting, "last double", lambda rows, carried: (rows, carried), "rx string", None)
    n = 2 * S.CHUNK + 1
    sent = pd.DataFrame({"ms": range(n), "us": range(n), "seq": range(n), "t": 0.5, "is_sync": [None] + [True] * (n - 1)})
    blocks = processor._blocks(sent)
    back = S._plain(pd.concat([pickle.loads(b) for (b,) in blocks], ignore_index=True))
    assert len(blocks) == 3 and str(back["ms"].dtype) == "int64" and back["seq"].tolist() == list(range(n))
    assert pd.isna(back["is_sync"][0]) and bool(back["is_sync"][1])


def test_multipath_keys_share_state(spark, tmp_path):
    """Many keys, also without a receiver or tag, over three batches: judged as by a plain loop, their state in few entries."""
    from tidewake.streaming import jobs as S

    rng, n = np.random.default_rng(4), 9_000
    tags = [None if k == 0 else 2**60 + k for k in rng.integers(0, 2_000, n).tolist()]
    sent = [(None if i % 50 == 0 else "ab"[i % 2], tag, i, t) for i, (tag, t) in enumerate(zip(tags, rng.uniform(0, 20, n).cumsum().tolist(), strict=True))]
    at = str(tmp_path / "m")
    for i in range(0, n, n // 3):
        spark.createDataFrame(sent[i : i + n // 3], "rx string, tag long, seq long, t double").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema("rx string, tag long, seq long, t double").option("maxFilesPerTrigger", 1).parquet(at)
    q = S.stream_multipath(stream, ("rx", "tag"), 9_000.0, None).writeStream.format("memory").queryName("shared_state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want, last = set(), {}
    for rx, tag, seq, t in sent:
        if (rx, tag) not in last or t - last[rx, tag] > 9_000.0:
            want.add((rx, tag, seq))
        last[rx, tag] = t
    assert {tuple(r) for r in spark.table("shared_state").select("rx", "tag", "seq").collect()} == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < len(last) / 4


def test_multipath_silence_by_key(spark, tmp_path):
    """A silent key's time goes though others of its group go on."""
    import time

    from tidewake.streaming import jobs as S

    at = str(tmp_path / "t")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a run that waits for silences never ends
    for i, (tag, t) in enumerate([(1, 0.0), (2, 0.0), (1, 0.5), (1, 0.7)]):
        spark.createDataFrame([("a", tag, i, t)], "rx string, tag long, seq long, t double").coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema("rx string, tag long, seq long, t double").parquet(at)
        q = S.stream_multipath(stream, ("rx", "tag"), 1.0, "2 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        time.sleep(2.5 if i == 0 else 0)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    out = sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert out == [0, 1, 2]


def test_arriving_batches_are_many_files(spark, data, monkeypatch):
    """No task writes or reads a whole batch, and the batches hold the same rows."""
    import glob

    from tests.compare import connection
    from tidewake.plans import streams
    from tidewake.session import shared_folder

    def written(name: str) -> set[str]:
        return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/{name}-*/part-*"))

    monkeypatch.setattr(streams, "ROWS_A_FILE", 50)
    for query, name in (("s7_stream_open_silences", "silences"), ("s2_stream_bin_mean_and_late", "tardy"), ("s5_stream_multipath", "arrivals")):
        before = written(name)
        assert rows(QUERIES[query](spark, data).toPandas()) == rows(connection(data).execute(SQL[query]).df())
        assert len(written(name) - before) > 5


def test_grid_is_scored_within_rows(spark):
    """H6 makes no row for each point of the grid, and finds the planted shift and drift."""
    legs = [spark.createDataFrame([(g, 86400.0 * k + sign * (30.0 * g + 0.5 * g * k) + 0.2, 86400.0 * k) for g in (1, 2) for k in range(9)], "g long, t double, src double") for sign in (1, -1)]
    got = Y.search_shift_drift(*legs, [30.0 * k for k in range(-3, 4)], [0.5 * k for k in range(-3, 4)], ["g"])
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert {(r["g"], r["shift"], r["drift"], round(r["cost"], 4)) for r in got.collect()} == {(1, 30.0, 0.5, 0.4), (2, 60.0, 1.0, 0.4)}


def test_spacing_of_sections_of_any_size(spark):
    """D36 takes its bins without a window or a percentile over a whole section; values as numpy has them, ties and nulls too."""
    from tidewake.operators import survey as V

    rng = np.random.default_rng(8)
    sent = [(s, t, k, float(x), float(y), float(z)) for s, n in (("a", 40), (None, 7), ("c", 2)) for t in ("p", "q") for k, (x, y, z) in enumerate(zip(rng.integers(0, 5, n), rng.uniform(0, 9, n), rng.choice([-1, 0.5, 2], n), strict=True))]
    df = spark.createDataFrame(sent, "section string, transect string, sample long, x double, y double, dz double")
    got = V.sample_spacing(df)
    assert not any(w in got._jdf.queryExecution().toString() for w in ("Window [lag", "percentile("))
    for r in V.sample_spacing(df).collect():
        own = [v for v in sent if v[0] == r["section"]]
        steps = [math.hypot(b[3] - a[3], b[4] - a[4]) for a, b in zip(own, own[1:], strict=False) if a[1] == b[1]]
        assert r["dbin"] == pytest.approx(np.quantile(steps, 0.5)) and r["zbin"] == pytest.approx(np.quantile([abs(v[5]) for v in own], 0.1))
    assert {r["section"] for r in got.collect()} >= {"a", "c"}


def test_groups_share_calls(spark, monkeypatch):
    """C14 takes many groups in a call, and how they are dealt over calls changes nothing."""
    from tidewake.operators import matching as M

    rng = np.random.default_rng(6)
    det = spark.createDataFrame([("ab"[i % 2], int(k), i, float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 40, 1_200), rng.uniform(0, 5_000, 1_200), strict=True))], "rx string, tag long, seq long, t double")
    lines = spark.createDataFrame([("a", "b", 1.0, 0.0, 0.0)], "rx_a string, rx_b string, slope double, a_mean double, b_mean double")
    found, called = [], []
    for size in (20_000, 50):
        monkeypatch.setattr(M, "ROWS_A_CALL", size)
        match = M.match_records(det, lines, F.lit(30.0), None, 20.0, slice_s=100.0)
        called.append("_call" in match._jdf.queryExecution().analyzed().toString())
        found.append(sorted(tuple(r) for r in match.collect()))
    assert found[0] == found[1] and len(found[0]) > 50 and all(called)


def test_tracks_are_listed_by_few_tasks(spark, tmp_path):
    from tidewake.sources import readers as R

    n = 8 * spark.sparkContext.defaultParallelism
    for i in range(n):
        (tmp_path / f"track-{i}.csv").write_text(f",x,y,tnum,x_sd,y_sd,num_rx\n0,{i}.5,2.5,10.0,0.1,0.2,3\n")
    before = spark.conf.get(R.LISTING)
    spark.sparkContext.setJobGroup("listing", "listing")
    rows = R.read_tracks(spark, f"{tmp_path}/track-*.csv")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("rest", "rest")
    assert tasks and max(tasks) < n and spark.conf.get(R.LISTING) == before
    assert {(r["id"], r["x"]) for r in rows.collect()} == {(str(i), i + 0.5) for i in range(n)}
