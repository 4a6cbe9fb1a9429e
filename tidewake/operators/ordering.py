"""Places of rows in a global order, however their key is spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import kept


def numbered(df: DataFrame, order: list[str | Column], out: str, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """df with each row's place in the order (from 0, nulls first), or with weight the sum of that column over the rows before it.

    Spark samples the order and deals rows out by ranges of equal size, ties in the first columns parted by the later ones, so a key
    with most of its rows in a small part of its range, or at one value, fills no task. The dealt rows are written once, since ranges
    are drawn anew on every run; places are those in the range and the sums of the ranges before, a row for each range. parts: how many ranges, if not the session's."""
    dealt = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = kept(dealt, "numbered").withColumn("_range", F.shiftright("_at", 33))
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    ranges = rows.groupBy("_range").agg(size.alias("_n"))
    before = ranges.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    if weight is None:
        place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        place = F.coalesce(F.sum(weight).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, "_range").withColumn(out, place + F.col("_before")).drop("_range", "_before", "_at")


#: Rows of a part, for steps that hold a part at once.
ROWS_A_PART = 500_000


def parts_of(df: DataFrame) -> int:
    """As many parts as df's rows need, and no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS_A_PART + 1)


#: Groups up to which their small tables are broadcast.
GROUPS_BROADCAST = 100_000


def small(groups: DataFrame) -> DataFrame:
    """A table of a row a group, to be broadcast if the groups are few, so that a group with most of the rows fills no task of a join."""
    return F.broadcast(groups) if groups.count() <= GROUPS_BROADCAST else groups


def quantile_by(df: DataFrame, by: str, col: str, q: float, out: str, parts: int | None = None) -> DataFrame:
    """by, out: the exact quantile of col in each group, between its two neighbours as F.percentile has it, however many values a group
    has: distinct values are counted and numbered, and only those at the quantile are picked. Nulls take no part. parts: in how many
    parts values are counted, where most are distinct."""
    some = df.where(F.col(col).isNotNull())
    cells = (some.repartition(parts, by, col) if parts else some).groupBy(by, col).agg(F.count(F.lit(1)).alias("_n"))
    rows = kept(numbered(cells, [by, col], "_place", "_n", parts), "quantile")
    groups = rows.groupBy(by).agg(F.min("_place").alias("_start"), ((F.sum("_n") - 1) * q).alias("_pos"))
    groups = small(kept(groups.select(F.col(by).alias("_by"), "_start", "_pos"), "quantile-groups"))
    into = F.col("_place") - F.col("_start")
    at = lambda place: F.max(F.when((into <= place) & (place < into + F.col("_n")), F.col(col)))
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    found = rows.join(groups, F.col(by).eqNullSafe(F.col("_by"))).where((into <= hi) & (lo < into + F.col("_n")))
    found = found.groupBy(by, "_pos").agg(at(lo).alias("_lo"), at(hi).alias("_hi"))
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((hi - F.col("_pos")) * F.col("_lo") + (F.col("_pos") - lo) * F.col("_hi"))
    return found.select(by, value.cast("double").alias(out))
