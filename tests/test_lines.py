"""Lines of files in several blocks keep their places: readers, sections, order of detections, logs that arrive as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import detections as D
from tidewake.sources import readers as R
from tidewake.streaming import jobs as S


@pytest.fixture()
def small_blocks(spark):
    """Files are read in blocks of 2 kB."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_over_blocks(spark, tmp_path, small_blocks):
    rng, want = random.Random(2), set()
    for folder, n in (("a", 3000), ("b", 1), ("c", 700), ("d", 0)):
        (tmp_path / folder).mkdir()
        lines = ["é" * rng.randint(0, 30) + str(i) if i % 7 else "" for i in range(n)]
        (tmp_path / folder / "same.log").write_text("".join(x + ("\r\n" if i % 2 else "\n") for i, x in enumerate(lines)))
        want |= {(folder, i, x) for i, x in enumerate(lines)}
    (tmp_path / "c" / "whole.log").write_text("no line end")
    want.add(("c", 0, "no line end"))
    rows = R.read_lines(spark, [str(tmp_path / f) for f in "abcd"])
    assert spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 5
    got = [(r["path"].split("/")[-2], r["line_no"], r["line"]) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want


def test_detections_keep_their_order_into_multipath(spark, tmp_path, small_blocks):
    rng, want = random.Random(4), []
    for name in ("a.det", "b.det"):
        t, rows = 1_500_000_000, []
        for i in range(800):
            t += rng.choice([-3, 0, 1, 2, 5])
            rows.append(f"{i},2017,7,14,2,40,0,{t},5,7A,1.0,2.0,1,2,1,0.5,12.5")
            want.append((name, i, t))
        (tmp_path / name).write_text("\n".join(rows[:400]) + "\n\n" + "\n".join(rows[400:]) + "\n")
    det = R.read_detections(spark, str(tmp_path), spark.createDataFrame([("a.det", "S1")], "file string, station string"))
    rows = det.orderBy("seq").select("file", "id", "epoch", "line_no", "station").collect()
    assert [tuple(r)[:3] for r in rows] == want and rows[0]["station"] == "S1" and rows[-1]["station"] is None
    assert [r["line_no"] for r in rows if r["file"] == "b.det"] == [*range(400), *range(401, 801)]
    kept = D.remove_multipath(det.select(F.col("file").alias("rx"), "id", "seq", F.col("epoch").cast("double").alias("t"))).collect()
    true = {(f, i) for k, (f, i, t) in enumerate(want) if k % 800 == 0 or t - want[k - 1][2] > 1}
    assert {(r["rx"], r["id"]) for r in kept} == true


def test_sections_over_blocks_and_slices(spark, tmp_path, small_blocks):
    rng, lines, want = random.Random(6), [], []
    for s in range(12):
        lines.append(f"section  S{s}")
        for c in range(rng.randint(0, 9)):
            low, top = 20, 20 + rng.randint(-1, 6)
            lines.append(f"{c}.5 647104.0 4185777.0 380 {low} {top} -9.5 1.25")
            for k in range(low, top + 1):
                lines.append(f" {k} -0.5 0.25   0.5")
                want.append(("x.txt", f"S{s}", c, c + 0.5, 647104.0, 4185777.0, -9.5, 1.25, k, -0.5, 0.25, 0.5))
        lines += [""] * rng.randint(0, 2)
    (tmp_path / "x.txt").write_text("\n".join(lines))
    for rows in (7, 1_000_000):
        assert sorted(tuple(r) for r in R.parse_sections(spark, str(tmp_path / "x.txt"), rows).collect()) == sorted(want)


def test_status_fields_beyond_the_hundredth(spark):
    body = "402311,001,2020-01-01 00:00:00,STS," + ",".join(f"F{i}={i}" for i in range(130))
    row = R.parse_receiver_lines(spark.createDataFrame([("f", 0, body)], "file string, line_no long, line string")).first()
    assert row["type"] == "STATUS" and row["status"]["F129"] == "129" and len(row["status"]) == 130


def test_logs_that_arrive_as_a_stream(spark, tmp_path, small_blocks):
    for name in ("p.log", "q.log", "r.log"):
        (tmp_path / name).write_text("".join(f"NODE:{name[0]}{i}\n" if i % 3 else f"strange {i}\n" for i in range(600)))
    for files in (1, 10):
        known, unknown = S.parse_files(spark, str(tmp_path), "test-logs", files)
        got = {(r["file"].split("/")[-1], r["line_no"]): r["rx_serial"] for r in known.collect()}
        assert got == {(f"{n}.log", i): f"{n}{i}" for n in "pqr" for i in range(600) if i % 3}
        assert sorted(r["line_no"] for r in unknown.collect()) == sorted(i for _ in "pqr" for i in range(0, 600, 3))
