"""Points in intervals, and a total order over all rows, without a task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takemark.storage import saved


def points_within(points: DataFrame, point: str, intervals: DataFrame, lo: str, hi: str, on: list[str], width: float) -> DataFrame:
    """Pairs of points and intervals of one group ``on`` with lo <= point <= hi, with the columns of both.

    Time is cut into buckets of ``width``: a point is in one, an interval in all that it touches, and they
    meet by an equi-join on group and bucket, so that a long group is spread over many tasks and a pair is tested only
    where both are near. Each pair is found once. Null points, null ends and intervals that end before they begin pair with nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    left = points.where(F.col(point).isNotNull()).withColumn("_bucket", bucket(point))
    right = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return left.join(right, [*on, "_bucket"]).where((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop("_bucket")


def prefix_sums(cells: DataFrame, group: list[str], place: str, value: str, name: str = "cum", decimals: int = 10) -> DataFrame:
    """cells with name: the sum of value in its group up to and with its place, rounded beyond the noise of summation."""
    return cells.withColumn(name, F.round(F.sum(value).over(Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)), decimals))


def sums_within(cells: DataFrame, group: list[str], place: str, value: str, spans: DataFrame, on: list[str], lo: str, hi: str) -> DataFrame:
    """spans x the groups of cells with their ``on``: total of a group, and inside, its sum over places from lo to hi.

    on is a part of group. Two lookups in a table of prefix sums answer a span, however long it is: the cost is
    linear in cells and in answers. Places are dense from 0.
    """
    rest = [c for c in group if c not in on]
    sums = prefix_sums(cells, group, place, value).select(*group, F.col(place).alias("_place"), "cum")
    totals = sums.groupBy(*group).agg(F.max_by("cum", "_place").alias("total"))
    asked = spans.join(totals, on)
    at_hi = sums.select(*group, F.col("_place").alias(hi), F.col("cum").alias("_upto"))
    at_lo = sums.select(*group, (F.col("_place") + 1).alias(lo), F.col("cum").alias("_before"))
    found = asked.join(at_hi, [*on, *rest, hi], "left").join(at_lo, [*on, *rest, lo], "left")
    return found.withColumn("inside", F.coalesce("_upto", "total") - F.coalesce("_before", F.lit(0.0))).drop("_upto", "_before")


def ranked(rows: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """rows with pos (from 0, in the total order) and rank (dense, from 1), written once.

    Range partitions are sorted each on its own; what comes before a partition is the sum of the counts of those before it,
    a number a partition. No task sees more than its partition. Rows with equal keys share a rank; their pos among each other is
    any, so give a total order where reruns must agree.
    """
    cut = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    placed = saved(cut.sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")), "ranged")
    within = Window.partitionBy("_part").orderBy(*order)
    local = placed.withColumn("_pos", F.row_number().over(Window.partitionBy("_part").orderBy("_seq")) - 1).withColumn("_rank", F.dense_rank().over(within))
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.max("_rank").alias("d")).collect()
    offsets, n, d = [], 0, 0
    for r in sorted(counts):
        offsets.append((r["_part"], n, d))
        n, d = n + r["n"], d + r["d"]
    table = rows.sparkSession.createDataFrame(offsets, "_part int, _n long, _d long")
    out = local.join(F.broadcast(table), "_part")  # a short row per partition
    return out.select(*rows.columns, (F.col("_pos") + F.col("_n")).alias("pos"), (F.col("_rank") + F.col("_d")).alias("rank"))
