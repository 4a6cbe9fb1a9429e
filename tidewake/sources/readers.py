"""Readers and writers of the domain's files: detections, receiver logs, debug logs, tracks, gauges, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions.exprs import line_checksum, to_tnum
from tidewake.operators.detections import with_running_total
from tidewake.operators.survey import coverage

# Columns of the headerless detection file.
DET_SCHEMA = "id long, year int, month int, day int, hour int, minute int, second int, epoch long, usec long, tag string, nbwQ double, corrQ double, num1 int, num2 int, one int, pressure double, temp double"
POSITION_SCHEMA = "_row string, x double, y double, tnum double, x_sd double, y_sd double, num_rx int"
NAN_AS_NULL = {"nanValue": "NaN", "nullValue": ""}


def number_lines(rows: DataFrame) -> DataFrame:
    """path, file (its name), line_no (from 0) and line of text rows in the order of their files.

    rows: path, start (of the file's block), at (any number that grows by one from row to row of a block), line. Lines are counted
    by block; a block's lines begin after those of the file's blocks before it. Only the blocks' counts are shuffled, the lines are not."""
    blocks = rows.groupBy("path", "start").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("path").alias("_path"), F.col("start").alias("_start"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    # A row a block of files: the optimiser broadcasts it while it is small.
    met = rows.join(blocks, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
    return met.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), (F.col("at") + F.col("_shift")).alias("line_no"), "line")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with path, file and line_no (A2). Files are read in blocks, as Spark splits them, and numbered exactly."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return number_lines(text)


def read_detections(spark: SparkSession, paths: str | list[str], stations: DataFrame | None = None) -> DataFrame:
    """Detection files with their file name and, by it, their station; line_no and seq (both from 0, seq over all files by path) keep
    the input order, on which E1 to E3 rest (A1). Blank lines have no row. stations: file, station."""
    lines = read_lines(spark, paths).where(F.trim("line") != "")
    rows = lines.select("path", "file", "line_no", F.from_csv("line", DET_SCHEMA).alias("_r")).select("path", "file", "line_no", "_r.*")
    files = lines.groupBy("path").agg((F.max("line_no") + 1).alias("_n"))
    files = files.select(F.col("path").alias("_path"), F.coalesce(F.sum("_n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a file
    rows = rows.join(files, F.col("path") == F.col("_path")).withColumn("seq", F.col("line_no") + F.col("_before")).drop("path", "_path", "_before")
    return rows if stations is None else rows.join(stations, "file", "left")


def parse_receiver_lines(lines: DataFrame) -> DataFrame:
    """Receiver text lines to typed records (A2, A3). lines: file, line_no, line; the first type that matches names a line."""
    raw = F.trim(F.regexp_replace("line", r"^[\x00\s]+|[\x00\s]+$", ""))
    checked = r"^([^#]+),#([0-9A-F][0-9A-F])$"
    rows = lines.withColumn("raw", raw)
    given = F.regexp_extract("raw", checked, 2)
    rows = rows.withColumn("body", F.when(given != "", F.regexp_extract("raw", checked, 1)).otherwise(F.col("raw")))
    rows = rows.withColumn("checksum", F.when(given == "", -1).when(line_checksum(F.col("body")) == given, 1).otherwise(2))
    # The forms of lines.
    sync = r"^\*([0-9]+)(\.\d+)[#0-9\[\]]+,(?:([-.0-9]+),([0-9]),)?OK"
    time = r"^\*([0-9]+)\..*TIME=([-0-9 :]+)$"
    status = r"^[0-9]+,[0-9]+,[-0-9 :]+,STS,[,=A-Z0-9.]+$"
    det = r"^[0-9]+,[0-9]+,[-0-9 :]+,[.0-9]+,[0-9A-F]+,[0-9]+,[-0-9]+,[0-9]+,[0-9]+,[.0-9]+"
    b = F.col("body")
    kind = (
        F.when(b.rlike("^NODE:"), "NODE").when(b.rlike(status), "STATUS").when(b.rlike(r"^\*.*RTMNOW"), "RTMNOW").when(b.rlike(time), "TIME")
        .when(b.rlike(sync), F.when(F.regexp_extract(b, sync, 4) != "", "SYNC").otherwise("OK")).when(b.rlike(det), "DET").otherwise("unknown")
    )
    rows = rows.withColumn("type", kind).withColumn("_f", F.split("body", ","))
    is_ = lambda *names: F.col("type").isin(*names)
    field = lambda i: F.get("_f", F.lit(i))
    pairs = F.str_to_map(F.array_join(F.filter(F.slice("_f", F.lit(5), F.size("_f")), lambda x: F.contains(x, F.lit("="))), ","), F.lit(","), F.lit("="))
    rows = rows.withColumn("status", F.when(is_("STATUS"), pairs))
    number = lambda i: F.when(is_("DET"), field(i).try_cast("double"))
    return rows.select(
        "file", "line_no", "type", "checksum",
        F.when(is_("DET", "STATUS"), field(0)).when(is_("TIME"), F.regexp_extract("body", time, 1)).when(is_("SYNC", "OK"), F.regexp_extract("body", sync, 1)).when(is_("NODE"), F.regexp_replace(field(0), "^NODE:", "")).alias("rx_serial"),
        F.when(is_("DET", "STATUS"), field(1)).alias("seq"),
        F.try_to_timestamp(F.when(is_("DET", "STATUS"), field(2)).when(is_("TIME"), F.regexp_extract("body", time, 2))).alias("time"),
        number(3).alias("t_usec"), F.when(is_("DET"), field(4)).alias("tag"), number(5).alias("corrQ"), number(6).alias("nbwQ"), number(8).alias("pressure"),
        F.coalesce(number(9), F.try_element_at("status", F.lit("WTEMP")).try_cast("double")).alias("temp"),
        F.when(is_("SYNC"), F.regexp_extract("body", sync, 3).try_cast("double")).alias("sync_dt"), F.when(is_("SYNC"), F.regexp_extract("body", sync, 4).try_cast("int")).alias("sync_status"), "status",
    )


def clock_resets(log: DataFrame) -> DataFrame:
    """Clock resets of a debug log (A5): file, line_no, time_pre, time_post, fpga_pre, fpga_post, msg_pre, msg_post. log: file, line_no, time, message.

    A start of the clock closes the last hourly status (or start) before it; a line before a set pairs with the next line."""
    w = Window.partitionBy("file").orderBy("line_no")
    m = F.col("message")
    number = lambda pattern: F.regexp_extract(m, pattern, 1).try_cast("double")
    status, started = number(r"^\s*RTC: [0-9.]+ FPGA: ([0-9.]+) dt="), number(r"^\s*FPGA started!! Init FPGA clock using RTC=([0-9.]+)")
    rows = log.withColumns({"time": F.to_timestamp("time", "MM/dd/yyyy HH:mm:ss"), "_status": status, "_started": started, "_fpga": number(r"FPGA=([0-9.]+)"), "_before": F.contains(m, F.lit("-Before SYNC"))})
    state = F.when(F.coalesce("_status", "_started").isNotNull(), F.struct("time", F.coalesce("_status", "_started").alias("fpga"), "message"))
    rows = rows.withColumn("_last", F.last(state, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumns({"_next_time": F.lead("time").over(w), "_next_fpga": F.lead("_fpga").over(w), "_next_message": F.lead("message").over(w)})
    starts = rows.where("_started is not null").select("file", "line_no", F.col("_last.time").alias("time_pre"), F.col("time").alias("time_post"), F.col("_last.fpga").alias("fpga_pre"), F.col("_started").alias("fpga_post"), F.col("_last.message").alias("msg_pre"), m.alias("msg_post"))
    sets = rows.where("_before").select("file", "line_no", F.col("time").alias("time_pre"), F.col("_next_time").alias("time_post"), F.col("_fpga").alias("fpga_pre"), F.col("_next_fpga").alias("fpga_post"), m.alias("msg_pre"), F.col("_next_message").alias("msg_post"))
    return starts.union(sets)


#: How many tasks list the files of a read.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_tracks(spark: SparkSession, glob: str) -> DataFrame:
    """Track files, the tag from the file name, the index column dropped (A6). They are listed by a few tasks a core, where Spark
    would have a task for each of the first ten thousand files or folders."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        rows = spark.read.csv(glob, schema=POSITION_SCHEMA, header=True, **NAN_AS_NULL)
    finally:
        spark.conf.set(LISTING, before)
    columns = [c.split()[0] for c in POSITION_SCHEMA.split(", ")][1:]
    return rows.select(F.regexp_extract(F.input_file_name(), r"track-([^/]*)\.csv", 1).alias("id"), *columns)


def write_collection(nested: DataFrame, path: str) -> None:
    """A nested track collection as Parquet."""
    nested.write.mode("errorifexists").parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_periods(det: DataFrame, breaks: list[float], path: str, rx: DataFrame | None = None, speed: DataFrame | None = None) -> None:
    """By period of a break list, each in a folder of its own (A8): detections, the receivers that heard any of them (rx: rx, ...) and the
    sound speed (speed: t, ...), the last two where they are given."""
    parts = {"detections": with_period(det, breaks)}
    if rx is not None:
        parts["receivers"] = parts["detections"].select("rx", "period").distinct().join(rx, "rx")
    if speed is not None:
        parts["sound_speed"] = with_period(speed, breaks)
    for name, rows in parts.items():
        rows.where("period >= 0").write.mode("errorifexists").partitionBy("period").parquet(f"{path}/{name}")


def with_period(det: DataFrame, breaks: list[float]) -> DataFrame:
    """period: place in the break list, from 0; -1 before the first and after the last."""
    at = F.size(F.filter(F.array(*map(F.lit, breaks)), lambda b: b <= F.col("t"))) - 1
    return det.withColumn("period", F.when(F.col("t") < breaks[-1], at).otherwise(-1))


def read_gauge(spark: SparkSession, path: str, start, end, offset_h: int = 8, max_gap_h: float = 2.5) -> DataFrame:
    """Gauge file with three header lines: UTC times within a day of the range, finite values (A9). An error where the file does not reach
    over the range and a day on either side, or holds a gap of max_gap_h hours or more there."""
    rows = spark.read.text(path).select(F.split("value", ",").alias("f")).where(F.get("f", F.lit(0)).rlike(r"^\d"))
    time = F.coalesce(*[F.try_to_timestamp(F.get("f", F.lit(0)), F.lit(p)) for p in ("MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")])
    rows = rows.select((time + F.make_dt_interval(hours=F.lit(offset_h))).alias("time"), F.get("f", F.lit(1)).try_cast("double").alias("value"))
    day = F.make_dt_interval(days=F.lit(1))
    good = rows.where(F.col("time").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    kept = good.where((F.col("time") >= F.lit(start) - day) & (F.col("time") < F.lit(end) + day))
    ends = good.agg(F.coalesce((F.min("time") <= F.lit(start) - day) & (F.max("time") >= F.lit(end) + day), F.lit(False)).alias("reaches")).first()
    gap = coverage(kept.select(to_tnum(F.col("time")).alias("t")), 0.0, 0.0, max_gap_h * 3600).first()["gap"]
    if not ends["reaches"] or gap is None or gap >= max_gap_h * 3600:
        raise ValueError(f"{path} does not cover {start} to {end}, with a day on either side: largest gap {gap} s")
    return kept


def parse_sections(spark: SparkSession, paths: str | list[str], slice_rows: int = 1_000_000) -> DataFrame:
    """Section files to rows of layers (A12): file, section, column, dist, x, y, z_bed, z_surf, k, u, v, dz.

    Lines are numbered over a file's blocks. A line of two words names a section, one of eight numbers heads a column, one of four
    is a layer of the column before it. Sections are counted over slices of a file; columns and layers within their section."""
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = read_lines(spark, paths).where(F.trim("line") != "").select("path", "file", F.col("line_no").alias("seq"), words.alias("w")).withColumn("_slice", F.floor(F.col("seq") / slice_rows))
    named = F.col("w")[0] == "section"
    rows = with_running_total(rows.withColumn("_flag", named.cast("int")), ["path"], "_flag", "_section")
    in_order = Window.partitionBy("path", "_section").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(~named & (F.size("w") == 8), F.struct(*[F.col("w")[i].cast("double").alias(c) for i, c in ((0, "dist"), (1, "x"), (2, "y"), (6, "z_bed"), (7, "z_surf"))]))
    rows = rows.withColumns({"section": F.first(F.when(named, F.col("w")[1]), True).over(in_order), "column": (F.count(head).over(in_order) - 1).cast("int"), "_head": F.last(head, True).over(in_order)})
    layer = rows.where(~named & (F.size("w") == 4))
    return layer.select("file", "section", "column", "_head.*", F.col("w")[0].cast("int").alias("k"), *[F.col("w")[i].cast("double").alias(c) for i, c in ((1, "u"), (2, "v"), (3, "dz"))])


def export_releases(tracks: DataFrame, offset_h: int = 8) -> DataFrame:
    """Release table with local-time strings beside the epoch columns (A14). tracks: columns ending in _time."""
    out = tracks
    for c in [c for c in tracks.columns if c.endswith("_time")]:
        out = out.withColumn(f"{c}_local", F.date_format(F.timestamp_seconds(F.bround(c) - offset_h * 3600), "yyyy-MM-dd HH:mm:ss"))
    return out


def gauge_stations(raw: DataFrame) -> DataFrame:
    """Station positions from the comments of gauge files (A15). raw: file, value."""
    lat = F.max(F.regexp_extract("value", r"Lat:\s*(-?[0-9.]+)", 1).try_cast("double"))
    lon = F.max(F.regexp_extract("value", r"Long:\s*(-?[0-9.]+)", 1).try_cast("double"))
    return raw.groupBy("file").agg(lat.alias("lat"), lon.alias("lon"))


def read_flow_table(lines: DataFrame, column: int = 1, cubic_feet: bool = True) -> tuple[DataFrame, DataFrame]:
    """Flows at day-month-name times, in cubic metres, and the rows that do not parse (A16). lines: line."""
    f = F.split("line", ",")
    rows = lines.select("line", F.try_to_timestamp(F.trim(F.get(f, F.lit(0))), F.lit("d MMM yyyy HH:mm")).alias("time"), F.get(f, F.lit(column)).try_cast("double").alias("flow"))
    factor = 0.028316846592 if cubic_feet else 1.0
    ok = F.col("time").isNotNull() & F.col("flow").isNotNull()
    return rows.where(ok).select("time", (F.col("flow") * factor).alias("flow")), rows.where(~ok).select("line")


