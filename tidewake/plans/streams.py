"""Queries of sources and streams: lines built from events and parsed back, and streams run over the events table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import exprs as X
from tidewake.operators import detections as D
from tidewake.operators import workloads as W
from tidewake.plans.registry import query
from tidewake.plans.roles import DET, POS, RECEIVERS, RX, detections, positions, r6, receivers, table
from tidewake.session import kept, shared_folder
from tidewake.sources import readers as R
from tidewake.streaming import jobs as S


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as receiver lines: detections, statuses, clock sets, and some that are none."""
    e = detections(spark, d)
    stamp = F.date_format("time", "yyyy-MM-dd HH:mm:ss")
    det = F.format_string("402311,%03d,%s,%.6f,%04X,%d,-%d,%d,%d,%.1f", F.col("seq") % 1000, stamp, F.lit(0.5), F.col("tag"), F.lit(120), F.lit(9), F.lit(1), F.lit(99120), F.floor("sensor").cast("double"))
    sts = F.format_string("402311,%03d,%s,STS,FW=2.1.7,VDC=%d,WTEMP=%.1f", F.col("seq") % 1000, stamp, F.col("tag"), F.floor("sensor").cast("double"))
    sync = F.format_string("*402313.0#23[0020],%.6f,%d,OK", F.col("sensor") / 1000, F.col("seq") % 2)
    body = F.when(F.col("rx") == "error", sts).when(F.col("rx") == "signup", sync).when(F.col("rx") == "view", F.concat(F.lit("no such line "), "seq")).otherwise(det)
    return e.select("rx", F.col("rx").alias("file"), F.col("seq").alias("line_no"), F.concat(body, F.lit(",#"), X.line_checksum(body)).alias("line"))


@query(f"WITH {DET} SELECT seq AS line_no, CASE rx WHEN 'error' THEN 'STATUS' WHEN 'signup' THEN 'SYNC' WHEN 'view' THEN 'unknown' ELSE 'DET' END AS type, CASE WHEN rx = 'signup' THEN -1 ELSE 1 END AS checksum, CASE WHEN rx IN ('click', 'purchase') THEN printf('%04X', tag) END AS tag, CASE WHEN rx IN ('click', 'purchase', 'error') THEN floor(sensor) END AS temp, CASE WHEN rx = 'signup' THEN CAST(seq % 2 AS INT) END AS sync_status, CASE WHEN rx = 'error' THEN CAST(tag AS VARCHAR) END AS vdc FROM det")
def a2_a3_a4_receiver_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = R.parse_receiver_lines(_lines(spark, d))
    return rows.select("line_no", "type", "checksum", "tag", "temp", "sync_status", F.try_element_at("status", F.lit("VDC")).alias("vdc"))


@query(f"""WITH {DET}, l AS (SELECT rx AS file, seq AS line_no, t, CASE WHEN seq % 10 = 0 THEN 'start' ELSE 'status' END AS kind, floor(t) + 0.5 AS fpga, date_trunc('second', time) AS time,
CASE WHEN seq % 10 = 0 THEN ' FPGA started!! Init FPGA clock using RTC=' || CAST(floor(t) AS BIGINT) || '.500000' ELSE ' RTC: 1.0 FPGA: ' || CAST(floor(t) AS BIGINT) || '.500000 dt=-0.3' END AS message FROM det)
SELECT file, line_no, time_pre, time AS time_post, fpga_pre, fpga AS fpga_post, msg_pre, message AS msg_post FROM (SELECT *, lag(message) OVER (PARTITION BY file ORDER BY line_no) AS msg_pre, lag(time) OVER (PARTITION BY file ORDER BY line_no) AS time_pre, lag(fpga) OVER (PARTITION BY file ORDER BY line_no) AS fpga_pre FROM l) WHERE kind = 'start'""")
def a5_clock_resets(spark: SparkSession, d: str) -> DataFrame:
    e = detections(spark, d)
    clock = F.format_string("%d.500000", F.floor("t"))
    message = F.when(F.col("seq") % 10 == 0, F.concat(F.lit(" FPGA started!! Init FPGA clock using RTC="), clock)).otherwise(F.concat(F.lit(" RTC: 1.0 FPGA: "), clock, F.lit(" dt=-0.3")))
    return R.clock_resets(e.select(F.col("rx").alias("file"), F.col("seq").alias("line_no"), F.date_format("time", "MM/dd/yyyy HH:mm:ss").alias("time"), message.alias("message")))


@query(f"WITH {DET} SELECT seq AS id, CAST(floor(t) AS BIGINT) AS epoch, upper(printf('%X', tag)) AS tag, floor(sensor) AS pressure, floor(k) AS temp, 'S-' || rx AS station FROM det")
def a1_read_detections(spark: SparkSession, d: str) -> DataFrame:
    """Events written as detection files, a folder for each receiver, and read back with the station of each."""
    e, at = detections(spark, d), f"{shared_folder(spark)}/a1-{uuid.uuid4().hex}"
    part = lambda f: getattr(F, f)("time")
    rows = e.select("seq", *[part(f).alias(f) for f in ("year", "month", "day", "hour", "minute", "second")], F.floor("t").alias("epoch"), (F.unix_micros("time") % 1_000_000).alias("usec"), F.hex("tag").alias("tag"),
        F.lit(9.0).alias("q1"), F.lit(8.0).alias("q2"), F.lit(1).alias("n1"), F.lit(2).alias("n2"), F.lit(1).alias("one"), F.floor("sensor").cast("double").alias("pressure"), F.floor("k").cast("double").alias("temp"), "rx")
    out = None
    for rx in [r[0] for r in RECEIVERS]:
        rows.where(F.col("rx") == rx).drop("rx").write.csv(f"{at}/{rx}")
        own = R.read_detections(spark, f"{at}/{rx}").withColumn("station", F.lit(f"S-{rx}"))
        out = own if out is None else out.unionByName(own)
    return out.select("id", "epoch", "tag", "pressure", "temp", "station")


@query(f"""WITH {DET}, p AS (SELECT *, CASE WHEN t < 1704800000 THEN 0 WHEN t < 1705300000 THEN 1 ELSE 2 END AS period FROM det WHERE t >= 1704200000 AND t < 1705700000)
SELECT 'detections' AS part, period, count(*) AS n, round(sum(seq), 3) AS total FROM p GROUP BY 2 UNION ALL SELECT 'receivers', period, count(*), CAST(sum(length(rx)) AS DOUBLE) FROM (SELECT DISTINCT period, rx FROM p) GROUP BY 2
UNION ALL SELECT 'sound_speed', period, count(*), round(sum(1400 + k), 3) FROM p WHERE rx = 'view' GROUP BY 2""")
def a8_export_periods(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_folder(spark)}/a8-{uuid.uuid4().hex}"
    det = detections(spark, d)
    rx = receivers(spark).withColumn("size", F.length("rx").cast("double"))
    R.export_periods(det.select("seq", "rx", "t"), [1704200000.0, 1704800000.0, 1705300000.0, 1705700000.0], at, rx, det.where("rx = 'view'").select("t", (1400 + F.col("k")).alias("speed")))
    out = None
    for part, c in (("detections", "seq"), ("receivers", "size"), ("sound_speed", "speed")):
        own = spark.read.parquet(f"{at}/{part}").groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col(c).cast("double")), 3).alias("total")).select(F.lit(part).alias("part"), "period", "n", "total")
        out = own if out is None else out.union(own)
    return out


@query(f"WITH {POS} SELECT CAST(id AS VARCHAR) AS id, x, y, round(tnum, 6) AS tnum, x_sd, y_sd, CAST(num_rx AS INT) AS num_rx FROM pos")
def a6_read_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Positions written as track files, a tag in each name, and read back."""
    at = f"{shared_folder(spark)}/a6-{uuid.uuid4().hex}"
    pos = positions(spark, d).select(F.concat(F.lit("track-"), "id", F.lit(".csv")).alias("f"), "seq", "x", "y", "tnum", "x_sd", "y_sd", "num_rx")
    pos.repartition("f").sortWithinPartitions("f", "tnum").write.option("header", True).partitionBy("f").csv(at)
    return r6(R.read_tracks(spark, f"{at}/*"), "tnum")


@query(f"""WITH {DET}, g AS (SELECT date_trunc('day', time) + INTERVAL 20 HOUR AS time, round(avg(sensor), 4) AS value FROM det GROUP BY 1)
SELECT epoch(time) AS t, value FROM g WHERE time >= TIMESTAMP '2024-01-04' AND time < TIMESTAMP '2024-01-26'""")
def a9_read_gauge(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of all detections as a gauge file in local time, read for a range that they cover."""
    at = f"{shared_folder(spark)}/a9-{uuid.uuid4().hex}"
    days = detections(spark, d).groupBy(F.date_trunc("day", "time").alias("day")).agg(F.round(F.avg("sensor"), 4).alias("value"))
    lines = days.select(F.concat_ws(",", F.date_format(F.col("day") + F.expr("INTERVAL 12 HOUR"), "MM/dd/yyyy HH:mm:ss"), "value").alias("value"))
    lines.union(spark.createDataFrame([("station",), ("mean value",), ("time,value",)], "value string")).write.text(at)
    got = R.read_gauge(spark, at, datetime(2024, 1, 5), datetime(2024, 1, 25), 8, 25.0)
    return got.select(X.to_tnum(F.col("time")).alias("t"), "value")


@query(f"""WITH {DET}, c AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) - 1 AS col FROM det)
SELECT 'S' || tag AS section, CAST(col AS INT) AS "column", sensor AS dist, CAST(tag AS DOUBLE) AS x, k AS y, -1.5 - tag % 7 AS z_bed, 1.5::DOUBLE AS z_surf, CAST(l AS INT) AS k, k / 8 AS u, l * 0.25 AS v, 0.5::DOUBLE AS dz FROM c, range(20, 23) r(l) WHERE l <= 20 + seq % 3""")
def a12_parse_sections(spark: SparkSession, d: str) -> DataFrame:
    """Events written as section files of many sections, a section for each tag and a water column for each event, and read back."""
    at = f"{shared_folder(spark)}/a12-{uuid.uuid4().hex}"
    top = 20 + F.col("seq") % 3
    layers = F.transform(F.sequence(F.lit(20).cast("long"), top), lambda i: F.concat_ws(" ", i, F.col("k") / 8, i * 0.25, F.lit(0.5)))
    head = F.concat_ws(" ", "sensor", F.col("tag").cast("double"), "k", F.col("seq") % 400, F.lit(20), top, -1.5 - F.col("tag") % 7, F.lit(1.5))
    first = F.row_number().over(Window.partitionBy("tag").orderBy("seq")) == 1
    rows = detections(spark, d).withColumn("value", F.concat_ws("\n", F.when(first, F.concat(F.lit("section S"), "tag")), head, F.concat_ws("\n", layers)))
    rows.repartition("tag").sortWithinPartitions("tag", "seq").select("value").write.text(at)
    return R.parse_sections(spark, at).drop("file")


@query(f"WITH {DET} SELECT CASE rx WHEN 'error' THEN 'STATUS' WHEN 'signup' THEN 'SYNC' WHEN 'view' THEN 'unknown' ELSE 'DET' END AS type, count(*) AS n FROM det GROUP BY 1")
def s1_parse_stream(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as text files, which arrive as a stream; lines of no known type go to a side table."""
    at = f"{shared_folder(spark)}/s1-{uuid.uuid4().hex}"
    _lines(spark, d).select("line").write.text(at)
    lines = spark.readStream.text(at).select(F.col("_metadata.file_name").alias("file"), F.lit(0).alias("line_no"), F.col("value").alias("line"))
    known, unknown = S.parse_stream(lines)
    both = S.drained(known.select("type"), "s1k").union(S.drained(unknown.select("type"), "s1u"))
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY rx ORDER BY seq) - 1 AS line_no FROM det)"
_KIND = "CASE rx WHEN 'error' THEN 'STATUS' WHEN 'signup' THEN 'SYNC' WHEN 'view' THEN 'unknown' ELSE 'DET' END"


def _written_logs(spark: SparkSession, d: str, name: str) -> str:
    """The lines of each receiver as one file, rx=<receiver>/..., in the order of the events."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _lines(spark, d).select("rx", "line_no", "line").repartition("rx").sortWithinPartitions("rx", "line_no").select("rx", "line").write.partitionBy("rx").text(at)
    return at


@query(f"WITH {DET}, {_NUMBERED} SELECT rx, line_no, {_KIND} AS type, CASE WHEN rx IN ('click', 'purchase') THEN printf('%04X', tag) END AS tag FROM n")
def s1_parse_files_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Each receiver's log, arriving as a stream of files, line by line with its place in its file."""
    known, unknown = S.parse_files(spark, f"{_written_logs(spark, d, 's1f')}/*", "s1f")
    return known.unionByName(unknown).select(F.regexp_extract("file", "rx=([a-z]+)/", 1).alias("rx"), "line_no", "type", "tag")


@query(f"WITH {DET}, {_NUMBERED} SELECT rx, line_no, {_KIND} AS type FROM n")
def a2_read_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each receiver's log, read in blocks and numbered."""
    lines = R.read_lines(spark, f"{_written_logs(spark, d, 'a2')}/*")
    return R.parse_receiver_lines(lines.withColumn("file", F.regexp_extract("path", "rx=([a-z]+)/", 1))).select(F.col("file").alias("rx"), "line_no", "type")


@query(f"WITH {DET}, {_NUMBERED}, b AS (SELECT *, t - k * 100 AS tt FROM n) SELECT id, rx, line_no FROM (SELECT seq AS id, rx, line_no, floor(tt) - lag(floor(tt)) OVER (PARTITION BY rx ORDER BY seq) AS gap FROM b) WHERE gap IS NULL OR gap > 600")
def a1_e1_order_kept(spark: SparkSession, d: str) -> DataFrame:
    """Detection files whose times step back and forth, written and read; multipath is judged in the files' own order."""
    e, at = detections(spark, d), f"{shared_folder(spark)}/a1o-{uuid.uuid4().hex}"
    part = lambda f: getattr(F, f)("time")
    rows = e.select("rx", "seq", *[part(f).alias(f) for f in ("year", "month", "day", "hour", "minute", "second")], F.floor(F.col("t") - F.col("k") * 100).alias("epoch"), F.lit(0).alias("usec"), F.hex("tag").alias("tag"),
        F.lit(9.0).alias("q1"), F.lit(8.0).alias("q2"), F.lit(1).alias("n1"), F.lit(2).alias("n2"), F.lit(1).alias("one"), F.floor("sensor").cast("double").alias("pressure"), F.lit(0.0).alias("temp"))
    rows.repartition("rx").sortWithinPartitions("rx", "seq").write.partitionBy("rx").csv(at)
    det = None
    for rx in [r[0] for r in RECEIVERS]:
        own = R.read_detections(spark, f"{at}/rx={rx}").withColumn("rx", F.lit(rx))
        det = own if det is None else det.unionByName(own)
    left = D.remove_multipath(det.select("rx", "id", "line_no", "seq", F.col("epoch").cast("double").alias("t")), ("rx",), 600.0)
    return left.select("id", "rx", "line_no")


_BREAKS = [1704200000.0, 1704800000.0, 1705300000.0, 1705700000.0]


@query(f"""WITH {DET}, l AS (SELECT 'st' || seq % 3 AS st, row_number() OVER (PARTITION BY seq % 3 ORDER BY seq) - 1 AS seq, rx = 'signup' AS sync, rx, tag, CASE WHEN rx <> 'signup' THEN epoch(date_trunc('second', time)) + 0.5 END AS t, CASE WHEN rx <> 'signup' AND floor(sensor) BETWEEN 5 AND 120 THEN floor(sensor) END AS temp FROM det),
r AS (SELECT * FROM l WHERE sync OR (rx IN ('click', 'purchase') AND t BETWEEN 1704150000 AND 1706000000)), v AS (SELECT st, min(seq) AS lo, max(seq) AS hi FROM r WHERE temp IS NOT NULL GROUP BY st), c AS (SELECT r.* FROM r JOIN v USING (st) WHERE seq BETWEEN lo AND hi),
m AS (SELECT st, tag AS beacon FROM (SELECT st, tag, row_number() OVER (PARTITION BY st ORDER BY count(*) DESC, tag) AS k FROM c WHERE NOT sync GROUP BY st, tag) WHERE k = 1),
b AS (SELECT *, CASE WHEN sync OR coalesce(t < lag(t) OVER (PARTITION BY st ORDER BY seq), false) THEN 1 ELSE 0 END AS brk FROM c), s AS (SELECT *, sum(brk) OVER (PARTITION BY st ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM b),
g AS (SELECT *, dense_rank() OVER (PARTITION BY st ORDER BY run) AS segment FROM s WHERE NOT sync), e AS (SELECT *, t - lag(t) OVER (PARTITION BY st, segment ORDER BY seq) AS gap FROM g)
SELECT st AS rx, seq, segment, tag, t, temp, CAST(right(st, 1) AS DOUBLE) * 50 AS rx_x, CAST(right(st, 1) AS DOUBLE) + 7 AS rx_y, beacon, CASE WHEN t < 1704800000 THEN 0 WHEN t < 1705300000 THEN 1 ELSE 2 END AS period FROM e JOIN m USING (st) WHERE (gap IS NULL OR gap > 300) AND t >= 1704200000 AND t < 1705700000""")
def workload_clean_detections(spark: SparkSession, d: str) -> DataFrame:
    """Workload 1 over all events: logs of three stations, written and read line by line, to clean detections in periods, which are
    exported and read back."""
    at = f"{shared_folder(spark)}/w1-{uuid.uuid4().hex}"
    rows = _lines(spark, d).withColumn("st", F.concat(F.lit("st"), F.col("line_no") % 3))
    rows.repartition("st").sortWithinPartitions("st", "line_no").select("st", "line").write.partitionBy("st").text(f"{at}/logs")
    lines = R.parse_receiver_lines(R.read_lines(spark, f"{at}/logs/*").withColumn("file", F.regexp_extract("path", "st=(st[0-9])/", 1))).withColumnRenamed("file", "rx")
    places = spark.createDataFrame([(f"st{i}", 50.0 * i, 7.0 + i) for i in range(3)], "rx string, rx_x double, rx_y double")
    clean = W.clean_detections(lines, places, 1704150000.0, 1706000000.0, {"temp": (5, 120)}, 300.0)
    R.export_periods(clean, _BREAKS, f"{at}/periods", places)
    out = spark.read.parquet(f"{at}/periods/detections")
    return out.select("rx", "seq", F.col("segment").cast("long").alias("segment"), "tag", "t", "temp", "rx_x", "rx_y", "beacon", F.col("period").cast("int").alias("period"))


@query(f"WITH {DET} SELECT seq, CASE WHEN t >= 1705700000 OR t < 1704200000 THEN -1 WHEN t < 1704800000 THEN 0 WHEN t < 1705300000 THEN 1 ELSE 2 END AS period FROM det")
def a8_periods(spark: SparkSession, d: str) -> DataFrame:
    return R.with_period(detections(spark, d), [1704200000.0, 1704800000.0, 1705300000.0, 1705700000.0]).select("seq", F.col("period").cast("int").alias("period"))


@query(f"WITH {DET} SELECT seq, round((CASE WHEN tag % 2 = 0 THEN 1 ELSE -1 END) * (tag + ((seq % 60) + (seq % 50 + 0.5) / 60) / 60), 6) AS deg FROM det WHERE tag > 0")
def a11_parse_dms(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("tag") % 2 == 0, "").otherwise("-")
    text = F.format_string("%s%d°%d'%.1f\"", sign, F.col("tag"), F.col("seq") % 60, F.col("seq") % 50 + F.lit(0.5))
    return r6(detections(spark, d).where("tag > 0").select("seq", X.parse_dms(text).alias("deg")), "deg")


@query(f"WITH {DET} SELECT tag, round_even(min(t), 0) AS entry_time, strftime(make_timestamp(CAST(round_even(min(t), 0) AS BIGINT) * 1000000 - 28800000000), '%Y-%m-%d %H:%M:%S') AS entry_time_local FROM det GROUP BY tag")
def a14_export_releases(spark: SparkSession, d: str) -> DataFrame:
    return R.export_releases(detections(spark, d).groupBy("tag").agg(F.bround(F.min("t")).alias("entry_time")))


@query("SELECT c_nationkey % 10 AS k, CAST(max(c_nationkey % 10 + 37.5) AS DOUBLE) AS lat, CAST(max(-121.25 - c_nationkey % 10) AS DOUBLE) AS lon FROM customer GROUP BY 1")
def a15_gauge_stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_nationkey") % 10
    lines = table(spark, d, "customer").select(k.alias("file"), F.concat(F.lit("# Station Lat: "), (k + 37.5).cast("string"), F.lit(" Long: "), (-121.25 - k).cast("string")).alias("value"))
    return r6(R.gauge_stations(lines).withColumnRenamed("file", "k"), "lat", "lon", digits=4)


@query("SELECT 'flow' AS part, count(*) AS n, round(sum(o_totalprice * 0.028316846592), 2) AS total FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'rejected', count(*), NULL FROM orders WHERE o_orderkey % 10 = 0")
def a16_flow_table(spark: SparkSession, d: str) -> DataFrame:
    time = F.when(F.col("o_orderkey") % 10 == 0, "total").otherwise(F.date_format("o_orderdate", "d MMM yyyy HH:mm"))
    flows, rejected = R.read_flow_table(table(spark, d, "orders").select(F.concat_ws(",", time, F.format_string("%.2f", "o_totalprice")).alias("line")))
    a = flows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flow"), 2).alias("total"))
    return a.select(F.lit("flow").alias("part"), "n", "total").union(rejected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected"), "n", F.lit(None).cast("double")))


#: Rows that a file of an arriving batch holds at least, where a batch is more files than one.
ROWS_A_FILE = 250_000


def _arrived(spark: SparkSession, at: str, batches: list[DataFrame], last: DataFrame | None = None) -> DataFrame:
    """The rows of batches as a stream that brings them one after the other: all batches are written in as many files, so that no
    task writes or reads a whole batch and the files of a trigger are one batch's. last: a row that comes after them."""
    files = max(1, min(b.count() for b in batches) // ROWS_A_FILE)
    for b in batches:
        (b.repartition(files) if files > 1 else b.coalesce(1)).write.mode("append").parquet(at)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(at)
    return S.event_stream(spark, at, files_per_trigger=files)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events in three batches that arrive one after the other."""
    e, at = table(spark, d, "events"), f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    cuts = e.approxQuantile("event_id", [1 / 3, 2 / 3], 0.001)
    return _arrived(spark, at, [e.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)) for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True)])


LIMIT = f"WITH {DET}, m AS (SELECT max(time) AS m FROM det)"


@query(LIMIT + " SELECT time_bucket(INTERVAL 1 HOUR, time) AS start, round(avg(sensor), 6) AS sensor, count(*) AS n FROM det, m GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, any_value(time)) + INTERVAL 1 HOUR <= any_value(m) - INTERVAL 1 HOUR")
def s2_stream_bin_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.drained(S.stream_bin_mean(_stream(spark, d), "1 hour", "1 hour"), "s2"), "sensor")


@query(LIMIT + ", w AS (SELECT tag, time_bucket(INTERVAL 6 HOUR, time) - INTERVAL 6 HOUR * i AS start FROM det, range(0, 4) r(i)) SELECT tag, start, count(*) AS n FROM w, m WHERE start + INTERVAL 24 HOUR <= m - INTERVAL 1 HOUR GROUP BY 1, 2")
def s3_stream_presence(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.stream_presence(_stream(spark, d), "24 hours", "6 hours"), "s3")


@query(LIMIT + ", g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY tag ORDER BY time) <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS f FROM det), p AS (SELECT *, sum(f) OVER (PARTITION BY tag ORDER BY time ROWS UNBOUNDED PRECEDING) AS ping FROM g), s AS (SELECT tag, ping, min(time) AS first, max(time) AS last, count(*) AS n FROM p GROUP BY 1, 2) SELECT tag, first, last, n FROM s, m WHERE last + INTERVAL 1800 SECOND <= m - INTERVAL 60 SECOND")
def s4_stream_pings(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.stream_pings(_stream(spark, d), "1800 seconds"), "s4")


@query(f"WITH {DET} SELECT rx, tag, seq FROM (SELECT *, t - lag(t) OVER (PARTITION BY rx, tag ORDER BY seq) AS gap FROM det) WHERE gap IS NULL OR gap > 3600")
def s5_stream_multipath(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.stream_multipath(_stream(spark, d), ("rx", "tag"), 3600.0, None), "s5").select("rx", "tag", "seq")


@query(f"""WITH {DET}, r AS (SELECT *, sensor > 200 AS sync, t - tag * 600 AS tt FROM det), b AS (SELECT *, CASE WHEN sync OR coalesce(tt < lag(tt) OVER (PARTITION BY rx ORDER BY seq), false) THEN 1 ELSE 0 END AS brk FROM r), s AS (SELECT *, sum(brk) OVER (PARTITION BY rx ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT seq, rx, dense_rank() OVER (PARTITION BY rx ORDER BY run) AS segment FROM s WHERE NOT sync""")
def s6_stream_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d).withColumns({"t": F.col("t") - F.col("tag") * 600, "is_sync": F.col("sensor") > 200})
    return S.drained(S.stream_segments(rows), "s6").select("seq", "rx", F.col("segment").cast("long").alias("segment"))


def _arriving(spark: SparkSession, d: str, name: str, place: Callable[[int, int], Column], files: int) -> DataFrame:
    """The events in batches by place(lo, hi), from 0, of the first and last time in microseconds; at last a row of a receiver 'none',
    ten days on, which moves the watermark past all of them."""
    e, at = table(spark, d, "events"), f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min(us), F.max(us)).first()
    dealt = kept(e.withColumn("_place", place(lo, hi)), "dealt")
    last = e.orderBy(F.desc("ts")).limit(1)
    last = last.select(*[F.lit("none" if c == "event_type" else "-1").cast(k).alias(c) if c in ("event_type", "user_id") else (F.col("ts") + F.expr("INTERVAL 10 DAYS")).cast(k).alias(c) if c == "ts" else F.col(c) for c, k in e.dtypes])
    return _arrived(spark, at, [dealt.where(F.col("_place") == i).drop("_place") for i in range(files)], last)


def _us() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _shuffled(spark: SparkSession, d: str, files: int = 10) -> DataFrame:
    """The events in batches that each hold what reached a recorder in turn, up to two days after its time."""
    late = 2 * 86_400_000_000
    return _arriving(spark, d, "shuffled", lambda lo, hi: F.floor((_us() - lo + F.pmod(F.xxhash64("event_id"), F.lit(late))) / F.lit((hi - lo + late + 1) / files)), files)


def _tardy(spark: SparkSession, d: str) -> DataFrame:
    """The same in four batches, with a lateness that SQL can say: event_id * 7919 modulo two days, in seconds."""
    late = 172_800_000_000
    return _arriving(spark, d, "tardy", lambda lo, hi: F.floor((_us() - lo + F.col("event_id") * 7919 % 172_800 * 1_000_000) * 4 / F.lit(hi - lo + late)), 4)


_TARDY = """e AS (SELECT min(epoch_us(time)) AS lo, max(epoch_us(time)) AS hi FROM det), p AS (SELECT det.*, (epoch_us(time) - lo + seq * 7919 % 172800 * 1000000) * 4 // (hi - lo + 172800000000) AS place FROM det, e),
w AS (SELECT place, max(max(epoch_ms(time))) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000 AS wm FROM p GROUP BY place),
q AS (SELECT p.*, time_bucket(INTERVAL 1 HOUR, time) AS start, coalesce(epoch_ms(time) // 3600000 * 3600000 + 3600000 <= wm, false) AS late FROM p JOIN w USING (place))"""


@query(f"WITH {DET}, {_TARDY} SELECT false AS late, start, round(avg(sensor), 6) AS sensor, count(*) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS time FROM q WHERE NOT late GROUP BY start UNION ALL SELECT true, start, round(sensor, 6), NULL, seq, time FROM q WHERE late")
def s2_stream_bin_mean_and_late(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means with a watermark of a day over rows that arrive up to two days late, and each row that was too late."""
    return r6(S.drained(S.stream_bin_mean_and_late(_tardy(spark, d), "1 hour", "1 day"), "s2l", S.ROCKS), "sensor")


@query(f"WITH {DET} SELECT rx, tag, seq FROM (SELECT *, t - lag(t) OVER (PARTITION BY rx ORDER BY seq) AS gap FROM det) WHERE gap IS NULL OR gap > 600")
def s5_stream_multipath_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Rows that arrive up to two days late, over eleven files, are judged as the batch job judges them; state lives for a day of silence."""
    out = S.drained(S.stream_multipath_in_order(_shuffled(spark, d), ("rx",), 600.0, "3 days", "1 day"), "s5o", S.ROCKS)
    return out.where("rx <> 'none'").select("rx", "tag", "seq")


@query(f"""WITH {DET}, r AS (SELECT *, sensor > 200 AS sync, t - tag * 600 AS tt FROM det), b AS (SELECT *, CASE WHEN sync OR coalesce(tt < lag(tt) OVER (PARTITION BY rx ORDER BY seq), false) THEN 1 ELSE 0 END AS brk FROM r), s AS (SELECT *, sum(brk) OVER (PARTITION BY rx ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT seq, rx, dense_rank() OVER (PARTITION BY rx ORDER BY run) AS segment FROM s WHERE NOT sync""")
def s6_stream_segments_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Segments of receivers whose rows arrive up to two days late."""
    rows = _shuffled(spark, d).withColumns({"t": F.col("t") - F.col("tag") * 600, "is_sync": F.col("sensor") > 200})
    return S.drained(S.stream_segments_in_order(rows, "3 days"), "s6o", S.ROCKS).where("rx <> 'none'").select("seq", "rx", F.col("segment").cast("long").alias("segment"))


@query(f"WITH {DET}, {RX}, o AS (SELECT det.rx, t, lag(t) OVER (PARTITION BY det.rx ORDER BY t) AS f FROM det JOIN rx ON rx.rx = det.rx AND sync_tag = tag) SELECT rx, round(f, 4) AS from_t, round(t, 4) AS to_t, CAST(round((t - f) / 3600) AS INT) - 1 AS missed FROM o WHERE t - f > 36000")
def s7_stream_beacon_health(spark: SparkSession, d: str) -> DataFrame:
    out = S.drained(S.stream_beacon_health(_stream(spark, d), receivers(spark), 10, 3600.0), "s7")
    return r6(out.where("to_t is not null"), "from_t", "to_t", digits=4)


@query(f"""WITH {DET}, {RX}, p AS (SELECT *, seq * 3 // (SELECT max(seq) + 1 FROM det) AS b FROM det), w AS (SELECT b, max(max(t)) OVER (ORDER BY b) - 60 AS wm FROM p GROUP BY b),
o AS (SELECT p.rx, b, t, lag(t) OVER (PARTITION BY p.rx ORDER BY t) AS f FROM p JOIN rx ON rx.rx = p.rx AND sync_tag = tag), l AS (SELECT rx, b, max(t) AS last FROM o GROUP BY rx, b), n AS (SELECT *, lead(b) OVER (PARTITION BY rx ORDER BY b) AS nb FROM l)
SELECT rx, round(f, 4) AS from_t, round(t, 4) AS to_t, CAST(round((t - f) / 3600) AS INT) - 1 AS missed FROM o WHERE t - f > 36000
UNION ALL SELECT rx, round(last, 4), NULL, NULL FROM n WHERE nb IS NULL OR EXISTS (SELECT 1 FROM w WHERE w.b >= n.b AND w.b < nb - 1 AND wm > last + 36000)""")
def s7_stream_open_silences(spark: SparkSession, d: str) -> DataFrame:
    """Silences that end, and each that had not ended when the watermark passed its limit: the last one of every receiver at least."""
    top = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    rows = _arriving(spark, d, "silences", lambda lo, hi: F.floor(F.col("event_id") * 3 / F.lit(top + 1)), 3)
    return r6(S.drained(S.stream_beacon_health(rows, receivers(spark), 10, 3600.0), "s7o"), "from_t", "to_t", digits=4)


@query(f"WITH {DET}, {RX} SELECT seq, det.rx, rx_x, rx_y FROM det LEFT JOIN rx USING (rx)")
def s8_stream_enrich(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.stream_enrich(_stream(spark, d), receivers(spark)).select("seq", "rx", "rx_x", "rx_y"), "s8")


@query(f"WITH {DET} SELECT a.tag, a.seq AS seq_a, b.seq AS seq_b FROM det a JOIN det b ON a.tag = b.tag AND a.rx = 'click' AND b.rx = 'view' AND b.time BETWEEN a.time - INTERVAL 3600 SECOND AND a.time + INTERVAL 3600 SECOND")
def s8_stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d)
    return S.drained(S.stream_pairs(rows.where("rx = 'click'"), rows.where("rx = 'view'"), "3600 seconds"), "s8p")
