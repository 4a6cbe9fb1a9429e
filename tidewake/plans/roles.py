"""The given tables in the roles of the domain: events as detections and positions, orders as a gauge, and so on.

The SQL fragments say the same as the functions, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.exprs import to_tnum

DET = """det AS (SELECT user_id AS tag, event_type AS rx, event_id AS seq, ts AS time, epoch_us(ts) / 1e6 AS t, value AS sensor,
 CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)"""
POS = """pos AS (SELECT user_id AS id, event_id AS seq, epoch_us(ts) / 1e6 AS tnum, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y,
 1 + event_id % 4 AS num_rx, value / 10 AS x_sd, CAST(json_extract(props, '$.k') AS DOUBLE) / 10 AS y_sd FROM events)"""
SEG = POS + """, led AS (SELECT id, seq, x, y, tnum, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(tnum) OVER w AS t2 FROM pos WINDOW w AS (PARTITION BY id ORDER BY tnum, seq)),
seg AS (SELECT id, seq, x AS x1, x2, (x + x2) / 2 AS xm, y AS y1, y2, (y + y2) / 2 AS ym, tnum AS t1, t2, tnum + (t2 - tnum) / 2 AS tm, t2 - tnum AS dt,
 (x2 - x) / (t2 - tnum) AS u, (y2 - y) / (t2 - tnum) AS v, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) / (t2 - tnum) AS speed, atan2(y2 - y, x2 - x) AS head
 FROM led WHERE t2 IS NOT NULL)"""
RX = """rx AS (SELECT rx, CAST(rx_x AS DOUBLE) AS rx_x, CAST(rx_y AS DOUBLE) AS rx_y, sync_tag FROM (VALUES ('click', 0.0, 0.0, 1), ('view', 120.0, 10.0, 2), ('purchase', 60.0, 90.0, 3), ('signup', 10.0, 70.0, 4), ('error', 130.0, 80.0, 5)) AS r(rx, rx_x, rx_y, sync_tag))"""
#: Receivers with places and beacon tags.
RECEIVERS = [("click", 0.0, 0.0, 1), ("view", 120.0, 10.0, 2), ("purchase", 60.0, 90.0, 3), ("signup", 10.0, 70.0, 4), ("error", 130.0, 80.0, 5)]
GAUGE = """gauge AS (SELECT epoch_us(o_orderdate) / 1e6 AS t, sum(o_totalprice) AS value FROM orders GROUP BY 1)"""
HOURLY = """hourly AS (SELECT floor(t / 3600) * 3600 AS t, avg(sensor) AS value FROM det WHERE rx = 'view' GROUP BY 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("tag"), F.col("event_type").alias("rx"), F.col("event_id").alias("seq"), F.col("ts").alias("time"), to_tnum(F.col("ts")).alias("t"), F.col("value").alias("sensor"), k.alias("k"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return d.select(
        F.col("tag").alias("id"), "seq", F.col("t").alias("tnum"), F.col("sensor").alias("x"), F.col("k").alias("y"),
        (1 + F.col("seq") % 4).alias("num_rx"), (F.col("sensor") / 10).alias("x_sd"), (F.col("k") / 10).alias("y_sd"),
    )


def receivers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECEIVERS, "rx string, rx_x double, rx_y double, sync_tag long")


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(to_tnum(F.col("o_orderdate").cast("timestamp")).alias("t")).agg(F.sum("o_totalprice").alias("value"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).where("rx = 'view'")
    return d.groupBy((F.floor(F.col("t") / 3600) * 3600.0).alias("t")).agg(F.avg("sensor").alias("value"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and modelled values by transect, slice and model."""
    price, less = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("transect"), F.col("l_linestatus").alias("slice"), F.col("l_linenumber").alias("model"),
        (price * (1 - less)).alias("obs_u"), (price * (1 - F.col("l_tax"))).alias("mod_u"), (F.col("l_quantity") * 100).alias("obs_v"), (F.col("l_quantity") * 98 + 40).alias("mod_v"),
    )


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the oracles round them."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
