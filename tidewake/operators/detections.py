"""Detections: multipath, resets, joins to receivers, summaries, pings and pairs of receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the input order (seq) in one slice: what one task sorts, however many rows a receiver has.
SLICE_ROWS = 1_000_000


def with_before(det: DataFrame, keys: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """_before: t of the row before in the key, in input order; _slice. Slices of the order are sorted apart, and each begins
    with the last row of the slice before it that has the key, from a summary with one row a slice and key."""
    rows = det.withColumn("_slice", F.floor(F.col("seq") / slice_rows))
    last = rows.groupBy(*keys, "_slice").agg(F.max(F.struct("seq", "t"))["t"].alias("_t"))
    names = [f"_key{i}" for i in range(len(keys))]
    earlier = last.withColumn("_edge", F.lag("_t").over(Window.partitionBy(*keys).orderBy("_slice"))).where("_edge is not null")
    earlier = earlier.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_slice").alias("_of"), "_edge")
    same = F.col("_slice") == F.col("_of")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    inside = F.lag("t").over(Window.partitionBy(*keys, "_slice").orderBy("seq"))
    return rows.join(earlier, same, "left").withColumn("_before", F.coalesce(inside, "_edge")).drop(*names, "_of", "_edge")


def with_running_total(rows: DataFrame, keys: list[str], flag: str, out: str) -> DataFrame:
    """Running total of flag in the key's input order, in slices (rows: _slice of with_before) whose totals are added up."""
    names = [f"_key{i}" for i in range(len(keys))]
    of = rows.groupBy(*keys, "_slice").agg(F.sum(flag).alias("_sum"))
    of = of.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    of = of.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_slice").alias("_of"), "_base")
    same = F.col("_slice") == F.col("_of")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    inside = F.sum(flag).over(Window.partitionBy(*keys, "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(of, same).withColumn(out, inside + F.col("_base")).drop(*names, "_of", "_base")


def remove_multipath(det: DataFrame, keys: tuple[str, ...] = ("rx",), min_gap: float = 1.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows more than min_gap after the row before them in their key, in input order (seq); the first of a key stays."""
    rows = with_before(det, list(keys), slice_rows)
    return rows.where(F.col("_before").isNull() | (F.col("t") - F.col("_before") > min_gap)).drop("_before", "_slice")


def split_on_resets(det: DataFrame, is_sync: Column | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """segment (from 1) and rx_segment: a new one at a clock set, or where time steps back; empty ones vanish."""
    rows = with_before(det, ["rx"], slice_rows)
    back = F.coalesce(F.col("t") < F.col("_before"), F.lit(False))
    rows = with_running_total(rows.withColumn("_break", (back if is_sync is None else back | is_sync).cast("int")), ["rx"], "_break", "_run")
    if is_sync is not None:
        rows = rows.where(~is_sync)
    # A receiver has as many runs as its clock has steps.
    runs = rows.groupBy("rx", "_run").agg(F.lit(1).alias("_one")).withColumn("segment", F.row_number().over(Window.partitionBy("rx").orderBy("_run")))
    runs = runs.select(F.col("rx").alias("_key0"), F.col("_run").alias("_of"), "segment")
    rows = rows.join(runs, F.col("rx").eqNullSafe(F.col("_key0")) & (F.col("_run") == F.col("_of")))
    return rows.withColumn("rx_segment", F.concat_ws(".", "rx", F.col("segment").cast("string"))).drop("_break", "_run", "_before", "_slice", "_key0", "_of")


def with_rx_location(det: DataFrame, rx: DataFrame) -> DataFrame:
    """Receiver columns by rx, nulls where unknown (C1). Receivers are a small dimension; Spark broadcasts it by its size."""
    return det.join(rx, "rx", "left")


def sync_detections(det: DataFrame, rx: DataFrame) -> DataFrame:
    """Detections of receivers' own beacons, with the beacon's owner."""
    return det.join(rx.select(F.col("sync_tag").alias("tag"), F.col("rx").alias("owner")), "tag")


def with_release(tags: DataFrame, release: DataFrame, date: str, cut, how: str = "left") -> DataFrame:
    """Tags with their release group by date: upper before cut, else lower, also without a date."""
    return tags.join(release, "tag", how).withColumn("release", F.when(F.col(date) < cut, "upper").otherwise("lower"))


def keep_tags(det: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of the tags listed (C4)."""
    return det.join(tags, "tag", "left_semi")


def drop_tags(det: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of tags that are not listed (C4)."""
    return det.join(tags, "tag", "left_anti")


def override(rx: DataFrame, solved: DataFrame) -> DataFrame:
    """Receivers with solved coordinates where there are any (C9). solved: rx, solved_x, solved_y."""
    out = rx.join(solved, "rx", "left")
    return out.withColumns({"rx_x": F.coalesce("solved_x", "rx_x"), "rx_y": F.coalesce("solved_y", "rx_y")}).select(rx.columns)


def pair_transits(pings: DataFrame, rx: DataFrame) -> DataFrame:
    """tx, rx, n, mean and population deviation of transit times from beacons' owners to others (C10). pings: ping_id, tag, rx, t."""
    own = pings.join(rx.select(F.col("rx"), F.col("sync_tag").alias("tag")), ["rx", "tag"]).select("ping_id", F.col("rx").alias("tx"), F.col("t").alias("t0"))
    both = pings.join(own, "ping_id").where("rx <> tx")
    dt = F.col("t") - F.col("t0")
    return both.groupBy("tx", "rx").agg(F.count(F.lit(1)).alias("n"), F.avg(dt).alias("transit"), F.stddev_pop(dt).alias("transit_sd"))


def rx_distances(rx: DataFrame) -> DataFrame:
    """Distance of every two receivers (C11). The receivers of one array: tens of rows."""
    a, b = rx.select(F.col("rx").alias("rx_a"), F.col("rx_x").alias("xa"), F.col("rx_y").alias("ya")), rx.select(F.col("rx").alias("rx_b"), F.col("rx_x").alias("xb"), F.col("rx_y").alias("yb"))
    return a.crossJoin(b).select("rx_a", "rx_b", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")).alias("dist"))


def pair_similarity(det: DataFrame, min_overlap: float = 600.0) -> DataFrame:
    """rec_a, rec_b, similarity: sums over tags of the smaller count, of records that overlap in time."""
    span = det.groupBy("rx").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    n = det.groupBy("rx", "tag").agg(F.count(F.lit(1)).alias("n")).join(span, "rx")
    a, b = n.alias("a"), n.alias("b")
    overlap = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    both = a.join(b, (F.col("a.tag") == F.col("b.tag")) & (F.col("a.rx") < F.col("b.rx"))).where(overlap >= min_overlap)
    return both.groupBy(F.col("a.rx").alias("rec_a"), F.col("b.rx").alias("rec_b")).agg(F.sum(F.least("a.n", "b.n")).alias("similarity"))


def match_candidates(det: DataFrame, max_shift: float = 20.0) -> DataFrame:
    """Pairs of detections of a tag by different receivers less than max_shift apart (C13): buckets of max_shift and their neighbours."""
    bucket = F.floor(F.col("t") / max_shift)
    a = det.select("tag", F.col("rx").alias("rx_a"), F.col("t").alias("t_a"), F.col("seq").alias("seq_a"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    b = det.select("tag", F.col("rx").alias("rx_b"), F.col("t").alias("t_b"), F.col("seq").alias("seq_b"), bucket.alias("_b"))
    near = F.abs(F.col("t_a") - F.col("t_b")) < max_shift
    return a.join(b, ["tag", "_b"]).where((F.col("rx_a") < F.col("rx_b")) & near).drop("_b")


def merge_matched(a: DataFrame, b: DataFrame, match: DataFrame, slope: float = 1.0, shift: float = 0.0) -> DataFrame:
    """Two records as one (C15): a's times set to b's clock by the fitted line (C14), matched rows once at the earlier time, the rest of
    both. a, b: seq, tag, t; match: seq_a, seq_b. t_a stays as it was heard."""
    left = a.select(F.col("seq").alias("seq_a"), F.col("tag").alias("tag_a"), F.col("t").alias("t_a")).join(match, "seq_a", "left")
    right = b.select(F.col("seq").alias("seq_b"), F.col("tag").alias("tag_b"), F.col("t").alias("t_b"))
    out = left.join(right, "seq_b", "full_outer")
    return out.select(F.coalesce("tag_a", "tag_b").alias("tag"), F.least(F.col("t_a") * slope + shift, "t_b").alias("t"), "seq_a", "seq_b", "t_a", "t_b")


def contradictions(a: DataFrame, b: DataFrame, match: DataFrame, interval: Column, slope: float = 1.0, shift: float = 0.0, share: float = 0.8, slice_seconds: float = 86400.0) -> DataFrame:
    """Hits of a tag that follow each other in two records, a's on b's clock by the fitted line, closer than share of the tag's
    interval though not both are matched: signs that a match is wrong (C14). a, b: seq, tag, t; match: seq_a, seq_b; interval:
    seconds, over tag. Equal times: a's first, then by seq. Hits without tag or time take no part. Slices of time are sorted
    apart, and each begins with the tag's last hit before it, from a summary with one row a tag and slice."""
    sides = []
    for det, side, t in ((a, "a", F.col("t") * slope + shift), (b, "b", F.col("t"))):
        known = match.select(F.col(f"seq_{side}").alias("_seq")).distinct().withColumn("matched", F.lit(True))
        own = det.where("tag is not null and t is not null").select("tag", F.struct(t.cast("double").alias("t"), F.lit(side).alias("side"), "seq").alias("_hit"))
        own = own.join(known, F.col("_hit.seq") == F.col("_seq"), "left")
        sides.append(own.select("tag", F.col("_hit").withField("matched", F.coalesce("matched", F.lit(False))).alias("hit")))
    rows = sides[0].unionByName(sides[1]).withColumn("_slice", F.floor(F.col("hit.t") / slice_seconds))
    last = rows.groupBy("tag", "_slice").agg(F.max("hit").alias("_last"))
    edges = last.select("tag", "_slice", F.lag("_last").over(Window.partitionBy("tag").orderBy("_slice")).alias("_edge"))
    inside = F.lag("hit").over(Window.partitionBy("tag", "_slice").orderBy("hit"))
    pairs = rows.join(edges, ["tag", "_slice"]).select("tag", "hit", F.coalesce(inside, "_edge").alias("before"))
    gap = F.col("hit.t") - F.col("before.t")
    pairs = pairs.where((gap < share * interval) & ~(F.col("hit.matched") & F.col("before.matched")))
    return pairs.select("tag", F.col("before.side").alias("side_1"), F.col("before.seq").alias("seq_1"), F.col("hit.side").alias("side_2"), F.col("hit.seq").alias("seq_2"), gap.alias("gap"))


def rx_locations(shots: DataFrame) -> DataFrame:
    """Mean place of repeated survey shots of a receiver."""
    return shots.groupBy("rx").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def infer_beacon(det: DataFrame) -> DataFrame:
    """Most frequent tag of each receiver, the smallest on ties."""
    n = det.groupBy("rx", "tag").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("rx").agg(F.max_by("tag", F.struct("n", -F.col("tag"))).alias("beacon"), F.max("n").alias("n"))


def tag_summary(det: DataFrame) -> DataFrame:
    """Count, first, last, duration and middle time of each tag (D3)."""
    out = det.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.withColumns({"duration": F.col("last") - F.col("first"), "mid": F.col("first") + (F.col("last") - F.col("first")) / 2})


def tag_rx_matrix(det: DataFrame, receivers: list[str]) -> DataFrame:
    """Detections of each tag by receiver, a column each."""
    return det.groupBy("tag").pivot("rx", receivers).count().fillna(0)


def funnel(det: DataFrame, rx: DataFrame, fish: DataFrame) -> DataFrame:
    """Total, not from beacons, of known fish, distinct fish tags: one pass."""
    beacons = rx.select(F.col("sync_tag").alias("tag"), F.lit(True).alias("_beacon")).where("tag is not null").distinct()
    known = fish.select("tag", F.lit(True).alias("_fish")).distinct()
    rows = det.join(beacons, "tag", "left").join(known, "tag", "left")
    free = F.col("_beacon").isNull()
    is_fish = free & F.col("_fish").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(free).alias("not_beacon"), F.count_if(is_fish).alias("known_fish"), F.count_distinct(F.when(is_fish, F.col("tag"))).alias("fish_tags"))


def first_detection(det: DataFrame) -> DataFrame:
    """Earliest detection of each tag, by time and then input order."""
    return det.groupBy("tag").agg(F.min(F.struct("t", "seq", "rx")).alias("f")).select("tag", F.col("f.t").alias("t"), F.col("f.rx").alias("rx"))


def bin_mean(det: DataFrame, width: float = 900.0) -> DataFrame:
    """Mean time and sensor value by time bin over all receivers."""
    return det.groupBy(F.floor(F.col("t") / width).alias("bin")).agg(F.avg("t").alias("t"), F.avg("sensor").alias("sensor"))


def daily_counts(det: DataFrame) -> DataFrame:
    """Detections a day."""
    return det.groupBy(F.window("time", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "n")


def build_pings(det: DataFrame, slop: float = 10.0) -> DataFrame:
    """ping (from 1 within its tag): a new one when the gap is more than slop; of a receiver heard twice in one, the arrival
    nearest the ping's mean (E44)."""
    w = Window.partitionBy("tag").orderBy("t", "seq")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(w)) > slop, F.lit(True))
    rows = det.withColumn("_fresh", fresh.cast("int")).withColumn("ping", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_mean", F.avg("t").over(Window.partitionBy("tag", "ping")))
    nearest = Window.partitionBy("tag", "ping", "rx").orderBy(F.abs(F.col("t") - F.col("_mean")), "t", "seq")
    return rows.withColumn("_k", F.row_number().over(nearest)).where("_k = 1").drop("_fresh", "_mean", "_k")


def ping_masks(pings: DataFrame, rx: DataFrame) -> DataFrame:
    """n_rx of the ping, multi, triple, beacon, self_heard, good_tag (ever heard by three)."""
    owner = rx.select(F.col("sync_tag").alias("tag"), F.col("rx").alias("owner"))
    rows = pings.join(owner, "tag", "left")
    of_ping = rows.groupBy("tag", "ping").agg(F.count(F.lit(1)).alias("n_rx"), F.max(F.coalesce(F.col("rx") == F.col("owner"), F.lit(False))).alias("self_heard"), F.max("owner").isNotNull().alias("beacon"))
    of_ping = of_ping.withColumn("good_tag", F.max("n_rx").over(Window.partitionBy("tag")) >= 3)
    return of_ping.withColumns({"multi": F.col("n_rx") > 1, "triple": F.col("n_rx") > 2})


def padded_chunks(det: DataFrame, length: float, pad: float, t0: float) -> DataFrame:
    """chunk: periods of length, each reaching pad further on either side, so a row may be in two."""
    own = F.floor((F.col("t") - t0) / length)
    into = (F.col("t") - t0) - own * length
    chunks = F.array(own, F.when(into < pad, own - 1), F.when(into >= length - pad, own + 1))
    return det.withColumn("chunk", F.explode(F.array_compact(chunks)))


def pair_offsets(pings: DataFrame) -> DataFrame:
    """Mean offset and largest absolute one of every two receivers in pings of both."""
    a, b = pings.alias("a"), pings.alias("b")
    same = (F.col("a.tag") == F.col("b.tag")) & (F.col("a.ping") == F.col("b.ping")) & (F.col("a.rx") < F.col("b.rx"))
    d = F.col("b.t") - F.col("a.t")
    return a.join(b, same).groupBy(F.col("a.rx").alias("rx_a"), F.col("b.rx").alias("rx_b")).agg(F.avg(d).alias("offset"), F.max(F.abs(d)).alias("largest"), F.count(F.lit(1)).alias("n"))


def remove_mean_offsets(pings: DataFrame, rounds: int = 5) -> DataFrame:
    """Constant clock offset of each receiver, by alternating ping means and receiver means."""
    rows = pings.withColumn("_adj", F.col("t"))
    for _ in range(rounds):
        rows = rows.withColumn("_res", F.col("_adj") - F.avg("_adj").over(Window.partitionBy("tag", "ping")))
        shift = rows.groupBy("rx").agg(F.avg("_res").alias("_shift"))
        rows = rows.join(shift, "rx").withColumn("_adj", F.col("_adj") - F.col("_shift")).drop("_shift", "_res")
    return rows.groupBy("rx").agg(F.avg(F.col("t") - F.col("_adj")).alias("offset"))


def measured_sound_speed(transits: DataFrame, distances: DataFrame) -> DataFrame:
    """Speed from distance and the mean transit of both ways."""
    a, b = transits.alias("a"), transits.alias("b")
    both = a.join(b, (F.col("a.tx") == F.col("b.rx")) & (F.col("a.rx") == F.col("b.tx")) & (F.col("a.tx") < F.col("a.rx")))
    both = both.select(F.col("a.tx").alias("rx_a"), F.col("a.rx").alias("rx_b"), ((F.col("a.transit") + F.col("b.transit")) / 2).alias("transit"))
    return both.join(distances, ["rx_a", "rx_b"]).withColumn("speed", F.try_divide("dist", "transit"))


def gaps(det: DataFrame, key: str, t: str = "t", limit: float = 0.0) -> DataFrame:
    """Gaps longer than limit between successive rows of a key."""
    w = Window.partitionBy(key).orderBy(t)
    return det.select(key, F.col(t).alias("from_t"), F.lead(t).over(w).alias("to_t")).withColumn("gap", F.col("to_t") - F.col("from_t")).where(F.col("gap") > limit)


def top_tags(det: DataFrame, k: int) -> DataFrame:
    """The k tags heard most (F1)."""
    return det.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def stack(*dfs: DataFrame) -> DataFrame:
    """Sources one below the other, columns by name, missing ones null (G1)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def common_tags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tags heard by both."""
    return a.select("tag").intersect(b.select("tag"))


def tags_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct tags of a that b has not."""
    return a.select("tag").subtract(b.select("tag"))


def shared_beacons(rx: DataFrame) -> DataFrame:
    """Beacons claimed by more than one station; none may be."""
    return rx.where("sync_tag is not null").groupBy("sync_tag").agg(F.count_distinct("rx").alias("stations")).where("stations > 1")


def common_period(a: DataFrame, b: DataFrame, t: str = "t") -> DataFrame:
    """Latest start and earliest end of two sets (G6): one row each, joined."""
    x, y = a.agg(F.min(t).alias("a0"), F.max(t).alias("a1")), b.agg(F.min(t).alias("b0"), F.max(t).alias("b1"))
    return x.crossJoin(y).select(F.greatest("a0", "b0").alias("start"), F.least("a1", "b1").alias("stop"))


def start_event(det: DataFrame, key: str = "tag", t: str = "t") -> DataFrame:
    """is_start on the first row of each key."""
    return det.withColumn("is_start", F.row_number().over(Window.partitionBy(key).orderBy(t, "seq")) == 1)
