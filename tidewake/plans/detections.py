"""Queries over detections (events): cleaning, summaries, pings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import exprs as X
from tidewake.operators import cleaning as C
from tidewake.operators import detections as D
from tidewake.plans.registry import query
from tidewake.plans.roles import DET, RECEIVERS, RX, detections, r6, receivers, table

FISH = "fish AS (SELECT c_custkey AS tag FROM customer WHERE c_mktsegment = 'BUILDING')"
PING = f"""WITH {DET}, {RX}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY tag ORDER BY t, seq) <= 1800 THEN 0 ELSE 1 END AS fresh FROM det),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY tag ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS ping FROM g),
m AS (SELECT *, avg(t) OVER (PARTITION BY tag, ping) AS mean FROM p),
pings AS (SELECT tag, rx, seq, t, CAST(ping AS BIGINT) AS ping FROM (SELECT *, row_number() OVER (PARTITION BY tag, ping, rx ORDER BY abs(t - mean), t, seq) AS n FROM m) WHERE n = 1)"""


def _fish(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("tag"))


def _pings(spark: SparkSession, d: str) -> DataFrame:
    return D.build_pings(detections(spark, d), 1800.0)


@query("SELECT event_id AS seq, ts AS time, make_timestamp(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 + epoch_us(ts) % 1000000) AS rebuilt FROM events")
def b1_micros_time(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros("time")
    return detections(spark, d).select("seq", "time", X.micros_time(F.floor(micros / 1_000_000), micros % 1_000_000).alias("rebuilt"))


@query(f"WITH {DET} SELECT seq, tag, t FROM det WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def b2_drop_bad_times(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_bad_times(detections(spark, d), "time", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).select("seq", "tag", "t")


@query(f"WITH {DET} SELECT seq, CASE WHEN sensor BETWEEN 5 AND 120 THEN sensor END AS sensor, CASE WHEN k BETWEEN 10 AND 90 THEN k END AS k FROM det")
def b3_null_out_of_range(spark: SparkSession, d: str) -> DataFrame:
    return C.null_out_of_range(detections(spark, d), {"sensor": (5, 120), "k": (10, 90)}).select("seq", "sensor", "k")


@query(f"WITH {DET}, e AS (SELECT rx, min(seq) AS lo, max(seq) AS hi FROM det WHERE sensor > 200 GROUP BY rx) SELECT seq, det.rx FROM det JOIN e USING (rx) WHERE seq BETWEEN lo AND hi")
def b4_trim_to_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = detections(spark, d).withColumn("pressure", F.when(F.col("sensor") > 200, F.col("sensor")))
    return C.trim_to_valid(rows, "rx", "seq", "pressure").select("seq", "rx")


@query("SELECT event_id AS seq, upper(split_part(event_type || '.b', '.', 1)) AS rx, trim('  ' || event_type || ' ') AS tag, CAST(user_id AS BIGINT) AS num FROM events")
def b5_b6_names_and_hex(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return det.select("seq", X.rx_from_shot(F.concat("rx", F.lit(".b"))).alias("rx"), X.norm_tag(F.concat(F.lit("  "), "rx", F.lit(" "))).alias("tag"), X.tag_to_num(F.hex("tag")).alias("num"))


@query(f"WITH {DET} SELECT seq, round((epoch_us(time) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS tnum FROM det WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-11'")
def b7_b8_clip_and_tnum(spark: SparkSession, d: str) -> DataFrame:
    at = [F.lit(x).cast("timestamp") for x in ("2024-01-01", "2024-01-10", "2024-01-11")]
    rows = C.clip_time(detections(spark, d), "time", at[1], at[2])
    return rows.select("seq", F.round(X.to_tnum(F.col("time"), at[0]), 6).alias("tnum"))


@query(f"""WITH {DET}, s AS (SELECT seq, t, (t - 7 * 3600) - 86400 * floor((t - 7 * 3600) / 86400) AS sec FROM det)
SELECT seq, round(sec, 3) AS sec, 1.5 + 3 * floor(sec / 10800) AS centre, round(sec / 86400 * 2 * pi(), 6) AS angle, floor(sec / 3600) > 7 AND floor(sec / 3600) < 19 AS day, CAST(dayofyear(make_timestamp(CAST(floor(t - 25200) AS BIGINT) * 1000000)) AS INT) AS day_of_year FROM s""")
def b12_b13_diel(spark: SparkSession, d: str) -> DataFrame:
    sec = X.local_second(F.col("t"))
    return detections(spark, d).select("seq", F.round(sec, 3).alias("sec"), X.bin_centre_h(sec).alias("centre"), F.round(X.day_angle(sec), 6).alias("angle"), X.is_daytime(F.floor(sec / 3600)).alias("day"), X.local_day_of_year(F.col("t")).alias("day_of_year"))


@query(f"WITH {DET} SELECT seq, round_even(sensor / 30, 0) * 30 AS q30, round_even(k / 3, 0) * 3 AS q3, round_even(sensor / 40, 0) * 40 AS q40 FROM det")
def b14_quantise(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).select("seq", X.quantise(F.col("sensor"), 30).alias("q30"), X.quantise(F.col("k"), 3).alias("q3"), X.quantise(F.col("sensor"), 40).alias("q40"))


@query(f"""WITH {DET}, o AS (SELECT min(sensor) AS a, max(sensor) AS b FROM det), g AS (SELECT rx, avg(sensor) AS m, stddev_samp(sensor) AS s FROM det GROUP BY rx)
SELECT seq, round((sensor - a) / (b - a), 6) AS mm, round(sensor - m, 6) AS dm, round((sensor - m) / s, 6) AS z FROM det JOIN g USING (rx), o""")
def b15_scaling(spark: SparkSession, d: str) -> DataFrame:
    rows = C.minmax(detections(spark, d), "sensor", "mm")
    rows = C.zscore(C.demean(rows, "sensor", "dm", "rx"), "sensor", "z", "rx")
    return r6(rows.select("seq", "mm", "dm", "z"), "mm", "dm", "z")


@query(f"""WITH {DET} SELECT seq, round(sensor * 0.3048, 6) AS m, round(sensor * 0.028316846592, 6) AS cms, round(sensor * 5.0 / 9 - 160.0 / 9, 6) AS c,
round(1402.388 + k * (5.03830 + k * (-5.81090e-2 + k * (3.3432e-4 + k * (-1.47797e-6 + k * 3.1419e-9)))), 6) AS ss FROM det""")
def b16_b17_units_sound(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sensor")
    rows = detections(spark, d).select("seq", X.to_si(s, "ft").alias("m"), X.to_si(s, "cfs").alias("cms"), X.to_si(s, "degF").alias("c"), X.sound_speed(F.col("k")).alias("ss"))
    return r6(rows, "m", "cms", "c", "ss")


@query(f"WITH {DET}, n AS (SELECT tag, count(*) AS n FROM det GROUP BY tag) SELECT tag, n FROM n WHERE regexp_matches(CAST(tag AS VARCHAR), '^[^1][0-9]$') AND n > 60")
def b21_fish_like(spark: SparkSession, d: str) -> DataFrame:
    n = detections(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return C.fish_like(n.withColumn("tag", F.col("tag").cast("string")), "^[^1][0-9]$", 60).withColumn("tag", F.col("tag").cast("long"))


@query(f"""WITH {DET}, s AS (SELECT tag, least(max(t), 1705000000.0) - greatest(min(t), 1704200000.0) AS s FROM det GROUP BY tag HAVING s > 750000)
SELECT seq, tag FROM det WHERE tag IN (SELECT tag FROM s) AND tag NOT IN (3, 5)""")
def b23_drop_short(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_short(detections(spark, d), "tag", "t", 1704200000.0, 1705000000.0, 750000.0, (3, 5)).select("seq", "tag")


@query(f"WITH {DET} SELECT seq, CAST(floor(t) AS BIGINT) AS epo, round(t - floor(t), 6) AS frac FROM det")
def b27_split_epoch(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.split_epoch(detections(spark, d)).select("seq", "epo", "frac"), "frac")


@query(PING + " SELECT tag || '-' || ping AS ping_id, rx, round(t, 6) AS toa FROM pings")
def b27_pings_to_long(spark: SparkSession, d: str) -> DataFrame:
    """Pings as a column for each receiver, and back to rows."""
    rx = [r[0] for r in RECEIVERS]
    wide = _pings(spark, d).groupBy(F.concat_ws("-", "tag", "ping").alias("ping_id")).pivot("rx", rx).agg(F.min("t"))
    return r6(C.pings_to_long(wide, "ping_id", rx), "toa")


@query(f"WITH {DET}, {RX} SELECT seq, det.rx, rx_x, rx_y FROM det LEFT JOIN rx USING (rx)")
def c1_rx_location(spark: SparkSession, d: str) -> DataFrame:
    return D.with_rx_location(detections(spark, d), receivers(spark)).select("seq", "rx", "rx_x", "rx_y")


@query(f"WITH {DET}, {RX} SELECT seq, tag, rx.rx AS owner FROM det JOIN rx ON tag = sync_tag")
def c2_sync_detections(spark: SparkSession, d: str) -> DataFrame:
    return D.sync_detections(detections(spark, d), receivers(spark)).select("seq", "tag", "owner")


@query(f"""WITH {DET}, tags AS (SELECT DISTINCT tag FROM det), o AS (SELECT o_custkey AS tag, min(o_orderdate) AS date FROM orders GROUP BY 1)
SELECT tag, date, CASE WHEN date < TIMESTAMP '1996-01-01' THEN 'upper' ELSE 'lower' END AS release FROM tags LEFT JOIN o USING (tag)""")
def c3_with_release(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("tag")).agg(F.min("o_orderdate").alias("date"))
    return D.with_release(detections(spark, d).select("tag").distinct(), first, "date", F.lit("1996-01-01").cast("timestamp"))


@query(f"WITH {DET}, {FISH} SELECT 'kept' AS part, count(*) AS n FROM det WHERE tag IN (SELECT tag FROM fish) UNION ALL SELECT 'dropped', count(*) FROM det WHERE tag NOT IN (SELECT tag FROM fish)")
def c4_keep_drop_tags(spark: SparkSession, d: str) -> DataFrame:
    det, fish = detections(spark, d), _fish(spark, d)
    kept, dropped = D.keep_tags(det, fish), D.drop_tags(det, fish)
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("part"), "n").union(dropped.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dropped"), "n"))


@query(f"WITH {DET}, {RX}, solved AS (SELECT rx, avg(sensor) AS yx, avg(k) AS yy FROM det WHERE rx IN ('click', 'view') GROUP BY rx) SELECT rx.rx, round(coalesce(yx, rx_x), 6) AS rx_x, round(coalesce(yy, rx_y), 6) AS rx_y FROM rx LEFT JOIN solved USING (rx)")
def c9_override(spark: SparkSession, d: str) -> DataFrame:
    solved = detections(spark, d).where("rx IN ('click', 'view')").groupBy("rx").agg(F.avg("sensor").alias("solved_x"), F.avg("k").alias("solved_y"))
    return r6(D.override(receivers(spark), solved).select("rx", "rx_x", "rx_y"), "rx_x", "rx_y")


@query(f"""{PING}, own AS (SELECT ping, tag, p.rx AS tx, t AS t0 FROM pings p JOIN rx ON rx.rx = p.rx AND rx.sync_tag = p.tag)
SELECT tx, p.rx, count(*) AS n, round(avg(t - t0), 4) AS transit, round(stddev_pop(t - t0), 4) AS transit_sd FROM pings p JOIN own USING (ping, tag) WHERE p.rx <> tx GROUP BY 1, 2""")
def c10_pair_transits(spark: SparkSession, d: str) -> DataFrame:
    pings = _pings(spark, d).withColumn("ping_id", F.struct("tag", "ping"))
    return r6(D.pair_transits(pings, receivers(spark)), "transit", "transit_sd", digits=4)


@query(f"WITH {RX}, {DET}, u AS (SELECT DISTINCT rx FROM det), r AS (SELECT * FROM rx JOIN u USING (rx)) SELECT a.rx AS rx_a, b.rx AS rx_b, round(sqrt((a.rx_x - b.rx_x) ** 2 + (a.rx_y - b.rx_y) ** 2), 6) AS dist FROM r a, r b")
def c11_rx_distances(spark: SparkSession, d: str) -> DataFrame:
    heard = receivers(spark).join(detections(spark, d).select("rx").distinct(), "rx")
    return r6(D.rx_distances(heard), "dist")


@query(f"""WITH {DET}, n AS (SELECT rx, tag, count(*) AS n FROM det GROUP BY 1, 2)
SELECT a.rx AS rec_a, b.rx AS rec_b, CAST(sum(least(a.n, b.n)) AS BIGINT) AS similarity FROM n a JOIN n b ON a.tag = b.tag AND a.rx < b.rx GROUP BY 1, 2""")
def c12_pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    return D.pair_similarity(detections(spark, d), 600.0)


@query(f"WITH {DET} SELECT a.tag, a.seq AS seq_a, b.seq AS seq_b, a.rx AS rx_a, b.rx AS rx_b FROM det a JOIN det b ON a.tag = b.tag AND a.rx < b.rx AND abs(a.t - b.t) < 600")
def c13_match_candidates(spark: SparkSession, d: str) -> DataFrame:
    return D.match_candidates(detections(spark, d), 600.0).select("tag", "seq_a", "seq_b", "rx_a", "rx_b")


def _two_records(det: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two receivers' records and one match for a hit at most."""
    a, b = det.where("rx = 'click'"), det.where("rx = 'view'")
    pairs = D.match_candidates(a.unionByName(b), 1800.0).groupBy("seq_a").agg(F.min("seq_b").alias("seq_b"))
    return a, b, pairs.groupBy("seq_b").agg(F.min("seq_a").alias("seq_a"))


@query(f"""WITH {DET}, m AS (SELECT a.seq AS seq_a, min(b.seq) AS seq_b FROM det a JOIN det b ON a.tag = b.tag AND a.rx = 'click' AND b.rx = 'view' AND abs(a.t - b.t) < 1800 GROUP BY 1),
o AS (SELECT seq_b, min(seq_a) AS seq_a FROM m GROUP BY 1), a AS (SELECT * FROM det WHERE rx = 'click'), b AS (SELECT * FROM det WHERE rx = 'view'), l AS (SELECT a.*, o.seq_b FROM a LEFT JOIN o ON a.seq = o.seq_a)
SELECT coalesce(l.tag, b.tag) AS tag, round(least(l.t * 1.00000001::DOUBLE + 90, b.t), 6) AS t, l.seq AS seq_a, b.seq AS seq_b FROM l FULL JOIN b ON l.seq_b = b.seq""")
def c15_merge_matched(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    a, b, match = _two_records(det)
    return r6(D.merge_matched(a, b, match, 1.00000001, 90.0).select("tag", "t", "seq_a", "seq_b"), "t")


@query(f"""WITH {DET}, m AS (SELECT a.seq AS seq_a, min(b.seq) AS seq_b FROM det a JOIN det b ON a.tag = b.tag AND a.rx = 'click' AND b.rx = 'view' AND abs(a.t - b.t) < 1800 GROUP BY 1),
o AS (SELECT seq_b, min(seq_a) AS seq_a FROM m GROUP BY 1),
h AS (SELECT tag, t * 1.00000001::DOUBLE + 90 AS t, 'a' AS side, seq, seq IN (SELECT seq_a FROM o) AS matched FROM det WHERE rx = 'click'
  UNION ALL SELECT tag, t, 'b', seq, seq IN (SELECT seq_b FROM o) FROM det WHERE rx = 'view'),
n AS (SELECT *, lag(t) OVER w AS t_1, lag(side) OVER w AS side_1, lag(seq) OVER w AS seq_1, lag(matched) OVER w AS matched_1 FROM h WINDOW w AS (PARTITION BY tag ORDER BY t, side, seq))
SELECT tag, side_1, seq_1, side AS side_2, seq AS seq_2, round(t - t_1, 3) AS gap FROM n WHERE t - t_1 < 0.8 * CASE WHEN tag <= 5 THEN 7200.0::DOUBLE ELSE 3600.0::DOUBLE END AND NOT (matched AND matched_1)""")
def c14_contradictions(spark: SparkSession, d: str) -> DataFrame:
    a, b, match = _two_records(detections(spark, d))
    interval = F.when(F.col("tag") <= 5, 7200.0).otherwise(3600.0)  # of beacons and of other tags
    return r6(D.contradictions(a, b, match, interval, 1.00000001, 90.0), "gap", digits=3)


@query(f"WITH {DET} SELECT rx, round(avg(sensor), 6) AS x, round(avg(k), 6) AS y, round(avg(-k / 10), 6) AS z FROM det GROUP BY rx")
def d1_rx_locations(spark: SparkSession, d: str) -> DataFrame:
    shots = detections(spark, d).select("rx", F.col("sensor").alias("x"), F.col("k").alias("y"), (-F.col("k") / 10).alias("z"))
    return r6(D.rx_locations(shots), "x", "y", "z")


@query(f"WITH {DET}, n AS (SELECT rx, tag, count(*) AS n FROM det GROUP BY 1, 2) SELECT rx, tag AS beacon, n FROM (SELECT *, row_number() OVER (PARTITION BY rx ORDER BY n DESC, tag) AS r FROM n) WHERE r = 1")
def d2_infer_beacon(spark: SparkSession, d: str) -> DataFrame:
    return D.infer_beacon(detections(spark, d))


@query(f"WITH {DET} SELECT tag, count(*) AS n, round(min(t), 6) AS first, round(max(t), 6) AS last, round(max(t) - min(t), 6) AS duration, round(min(t) + (max(t) - min(t)) / 2, 4) AS mid FROM det GROUP BY tag")
def d3_tag_summary(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(D.tag_summary(detections(spark, d)), "first", "last", "duration"), "mid", digits=4)


@query(f"WITH {DET} SELECT tag, " + ", ".join(f"count(*) FILTER (rx = '{r[0]}') AS {r[0]}" for r in RECEIVERS) + " FROM det GROUP BY tag")
def d4_tag_rx_matrix(spark: SparkSession, d: str) -> DataFrame:
    return D.tag_rx_matrix(detections(spark, d), [r[0] for r in RECEIVERS])


@query(f"""WITH {DET}, {RX}, {FISH}, r AS (SELECT tag, tag IN (SELECT sync_tag FROM rx) AS beacon, tag IN (SELECT tag FROM fish) AS fish FROM det)
SELECT count(*) AS total, count(*) FILTER (NOT beacon) AS not_beacon, count(*) FILTER (NOT beacon AND fish) AS known_fish, count(DISTINCT CASE WHEN NOT beacon AND fish THEN tag END) AS fish_tags FROM r""")
def d5_funnel(spark: SparkSession, d: str) -> DataFrame:
    return D.funnel(detections(spark, d), receivers(spark), _fish(spark, d))


@query(f"WITH {DET} SELECT tag, round(t, 6) AS t, rx FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY t, seq) AS n FROM det) WHERE n = 1")
def d6_first_detection(spark: SparkSession, d: str) -> DataFrame:
    return r6(D.first_detection(detections(spark, d)), "t")


@query(f"WITH {DET} SELECT CAST(floor(t / 3600) AS BIGINT) AS bin, round(avg(t), 3) AS t, round(avg(sensor), 6) AS sensor FROM det GROUP BY 1")
def d7_bin_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(D.bin_mean(detections(spark, d), 3600.0), "t", digits=3), "sensor")


@query(f"WITH {DET} SELECT date_trunc('day', time) AS day, count(*) AS n FROM det GROUP BY 1")
def d8_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.daily_counts(detections(spark, d))


@query(f"WITH {DET} SELECT seq, tag, rx FROM (SELECT *, t - lag(t) OVER (PARTITION BY rx, tag ORDER BY seq) AS gap FROM det) WHERE gap IS NULL OR gap > 3600")
def e1_remove_multipath(spark: SparkSession, d: str) -> DataFrame:
    return D.remove_multipath(detections(spark, d), ("rx", "tag"), 3600.0).select("seq", "tag", "rx")


@query(f"WITH {DET} SELECT seq, rx FROM (SELECT *, t - lag(t) OVER (PARTITION BY rx ORDER BY seq) AS gap FROM det) WHERE gap IS NULL OR gap > 600")
def e1_remove_multipath_rx(spark: SparkSession, d: str) -> DataFrame:
    return D.remove_multipath(detections(spark, d), ("rx",), 600.0).select("seq", "rx")


@query(f"""WITH {DET}, r AS (SELECT *, sensor > 200 AS sync, epoch_us(time) / 1e6 - k * 600 AS tt FROM det),
b AS (SELECT *, CASE WHEN sync OR coalesce(tt < lag(tt) OVER (PARTITION BY rx ORDER BY seq), false) THEN 1 ELSE 0 END AS brk FROM r),
s AS (SELECT *, sum(brk) OVER (PARTITION BY rx ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT seq, rx, dense_rank() OVER (PARTITION BY rx ORDER BY run) AS segment, rx || '.' || dense_rank() OVER (PARTITION BY rx ORDER BY run) AS rx_segment FROM s WHERE NOT sync""")
def e2_split_on_resets(spark: SparkSession, d: str) -> DataFrame:
    rows = detections(spark, d).withColumn("t", F.col("t") - F.col("k") * 600)
    return D.split_on_resets(rows, F.col("sensor") > 200).select("seq", "rx", F.col("segment").cast("long").alias("segment"), "rx_segment")


@query(f"WITH {DET} SELECT tag, round(f, 6) AS from_t, round(g, 6) AS to_t, round(g - f, 6) AS gap FROM (SELECT tag, t AS f, lead(t) OVER (PARTITION BY tag ORDER BY t) AS g FROM det) WHERE g - f > 100000")
def e30_gaps(spark: SparkSession, d: str) -> DataFrame:
    return r6(D.gaps(detections(spark, d), "tag", limit=100000.0), "from_t", "to_t", "gap")


@query(f"WITH {DET} SELECT seq, tag, row_number() OVER (PARTITION BY tag ORDER BY t, seq) = 1 AS is_start FROM det")
def e38_start_event(spark: SparkSession, d: str) -> DataFrame:
    return D.start_event(detections(spark, d)).select("seq", "tag", "is_start")


@query(PING + " SELECT tag, rx, seq, ping FROM pings")
def e44_build_pings(spark: SparkSession, d: str) -> DataFrame:
    return _pings(spark, d).select("tag", "rx", "seq", "ping")


@query(PING + """, o AS (SELECT p.*, rx.rx AS owner FROM pings p LEFT JOIN rx ON rx.sync_tag = p.tag), masks AS (SELECT tag, ping, count(*) AS n_rx, bool_or(coalesce(rx = owner, false)) AS self_heard, max(owner) IS NOT NULL AS beacon FROM o GROUP BY 1, 2)
SELECT tag, ping, n_rx, self_heard, beacon, max(n_rx) OVER (PARTITION BY tag) >= 3 AS good_tag, n_rx > 1 AS multi, n_rx > 2 AS triple FROM masks""")
def e45_ping_masks(spark: SparkSession, d: str) -> DataFrame:
    return D.ping_masks(_pings(spark, d), receivers(spark))


@query(f"""WITH {DET}, c AS (SELECT seq, t, floor((t - 1704067200) / 14400) AS own, (t - 1704067200) - 14400 * floor((t - 1704067200) / 14400) AS into_ FROM det)
SELECT seq, CAST(own AS BIGINT) AS chunk FROM c UNION ALL SELECT seq, CAST(own - 1 AS BIGINT) FROM c WHERE into_ < 3600 UNION ALL SELECT seq, CAST(own + 1 AS BIGINT) FROM c WHERE into_ >= 10800""")
def e46_padded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.padded_chunks(detections(spark, d), 14400.0, 3600.0, 1704067200.0).select("seq", "chunk")


@query(PING + " SELECT a.rx AS rx_a, b.rx AS rx_b, round(avg(b.t - a.t), 4) AS \"offset\", round(max(abs(b.t - a.t)), 4) AS largest, count(*) AS n FROM pings a JOIN pings b ON a.tag = b.tag AND a.ping = b.ping AND a.rx < b.rx GROUP BY 1, 2")
def d40_pair_offsets(spark: SparkSession, d: str) -> DataFrame:
    return r6(D.pair_offsets(_pings(spark, d)), "offset", "largest", digits=4)


def _rounds(n: int) -> str:
    """SQL of n alternations of ping means and receiver means."""
    out, adj = "a0 AS (SELECT rx, tag, ping, t, t AS adj FROM pings)", "a0"
    for i in range(1, n + 1):
        out += f", s{i} AS (SELECT rx, avg(res) AS s FROM (SELECT rx, adj - avg(adj) OVER (PARTITION BY tag, ping) AS res FROM {adj}) GROUP BY rx), a{i} AS (SELECT rx, tag, ping, t, adj - s AS adj FROM {adj} JOIN s{i} USING (rx))"
        adj = f"a{i}"
    return out


@query(f'{PING}, {_rounds(5)} SELECT rx, round(avg(t - adj), 3) AS "offset" FROM a5 GROUP BY rx')
def d41_remove_mean_offsets(spark: SparkSession, d: str) -> DataFrame:
    return r6(D.remove_mean_offsets(_pings(spark, d)), "offset", digits=3)


@query(PING + """, own AS (SELECT ping, tag, p.rx AS tx, t AS t0 FROM pings p JOIN rx ON rx.rx = p.rx AND rx.sync_tag = p.tag),
tr AS (SELECT tx, p.rx, avg(t - t0) AS transit FROM pings p JOIN own USING (ping, tag) WHERE p.rx <> tx GROUP BY 1, 2)
SELECT a.tx AS rx_a, a.rx AS rx_b, round((a.transit + b.transit) / 2, 4) AS transit, round(sqrt((x.rx_x - y.rx_x) ** 2 + (x.rx_y - y.rx_y) ** 2), 6) AS dist,
round(sqrt((x.rx_x - y.rx_x) ** 2 + (x.rx_y - y.rx_y) ** 2) / ((a.transit + b.transit) / 2), 6) AS speed
FROM tr a JOIN tr b ON a.tx = b.rx AND a.rx = b.tx AND a.tx < a.rx JOIN rx x ON x.rx = a.tx JOIN rx y ON y.rx = a.rx""")
def d42_measured_sound_speed(spark: SparkSession, d: str) -> DataFrame:
    pings = _pings(spark, d).withColumn("ping_id", F.struct("tag", "ping"))
    out = D.measured_sound_speed(D.pair_transits(pings, receivers(spark)), D.rx_distances(receivers(spark)))
    return r6(r6(out.select("rx_a", "rx_b", "transit", "dist", "speed"), "transit", digits=4), "dist", "speed")


@query(f"WITH {DET} SELECT tag, count(*) AS n FROM det GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def f1_top_tags(spark: SparkSession, d: str) -> DataFrame:
    return D.top_tags(detections(spark, d), 10)


@query(f"WITH {DET} SELECT seq, t, k, NULL AS sensor FROM det WHERE rx = 'click' UNION ALL SELECT seq, t, NULL, sensor FROM det WHERE rx = 'view'")
def g1_stack(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return D.stack(det.where("rx = 'click'").select("seq", "t", "k"), det.where("rx = 'view'").select("seq", "t", "sensor"))


@query(f"WITH {DET} SELECT tag, 'both' AS part FROM (SELECT tag FROM det WHERE rx = 'click' AND sensor > 100 INTERSECT SELECT tag FROM det WHERE rx = 'view' AND sensor > 100) UNION ALL SELECT tag, 'first' FROM (SELECT tag FROM det WHERE rx = 'click' AND sensor > 100 EXCEPT SELECT tag FROM det WHERE rx = 'view' AND sensor > 100)")
def g3_g4_tag_sets(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).where("sensor > 100")
    a, b = det.where("rx = 'click'"), det.where("rx = 'view'")
    return D.common_tags(a, b).withColumn("part", F.lit("both")).union(D.tags_except(a, b).withColumn("part", F.lit("first")))


@query(f"WITH {DET}, o AS (SELECT rx, tag % 7 AS sync_tag FROM det) SELECT sync_tag, count(DISTINCT rx) AS stations FROM o GROUP BY 1 HAVING count(DISTINCT rx) > 1")
def g5_shared_beacons(spark: SparkSession, d: str) -> DataFrame:
    return D.shared_beacons(detections(spark, d).select("rx", (F.col("tag") % 7).alias("sync_tag")))


@query(f"WITH {DET} SELECT round(greatest(min(t) FILTER (rx = 'click'), min(t) FILTER (rx = 'view')), 6) AS start, round(least(max(t) FILTER (rx = 'click'), max(t) FILTER (rx = 'view')), 6) AS stop FROM det")
def g6_common_period(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return r6(D.common_period(det.where("rx = 'click'"), det.where("rx = 'view'")), "start", "stop")
