"""Row numbers and running sums inside groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.sources.shared import shared_folder


def rank_rows(
    frame: DataFrame,
    group: list[str],
    order: list[str],
    name: str = "rank",
    running: dict[str, str] | None = None,
    bounded: bool = True,
) -> DataFrame:
    """Add ``name``: the 0-based row number inside the group.

    ``running`` maps an output column to an integer column of which the inclusive running
    sum inside the group is added. ``bounded`` groups (one change holds at most some
    thousand files) use one window task per group. Otherwise no task ever holds a whole
    group: rows are range-partitioned on group and order, so a hot group spreads over many
    partitions, and each partition adds the totals of the partitions before it.
    """
    running = running or {}
    if bounded:
        window = Window.partitionBy(*group).orderBy(*order)
        upto = window.rowsBetween(Window.unboundedPreceding, 0)
        frame = frame.withColumn(name, (F.row_number().over(window) - 1).cast("int"))
        for target, source in running.items():
            frame = frame.withColumn(target, F.sum(source).over(upto))
        return frame

    spark = frame.sparkSession
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The checkpoint fixes which row sits in which partition before the two reads below.
    placed = (
        frame.repartitionByRange(parts, *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .checkpoint()
    )
    local = Window.partitionBy("_part", *group).orderBy("_at")
    local_sum = local.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn(name, F.row_number().over(local) - 1)
    for target, source in running.items():
        placed = placed.withColumn(target, F.sum(source).over(local_sum))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.count("*").alias("_n")] + [
        F.sum(source).alias(f"_s{i}") for i, source in enumerate(running.values())
    ]
    spans = placed.groupBy(*group, "_part").agg(*sums)
    zero = F.lit(0)
    offsets = spans.select(
        *group, "_part",
        F.coalesce(F.sum("_n").over(before), zero).alias("_rows"),
        *[F.coalesce(F.sum(f"_s{i}").over(before), zero).alias(f"_o{i}") for i in range(len(running))],
    )
    joined = placed.join(offsets, [*group, "_part"])
    joined = joined.withColumn(name, (F.col(name) + F.col("_rows")).cast("int"))
    for i, target in enumerate(running):
        joined = joined.withColumn(target, F.col(target) + F.col(f"_o{i}"))
    return joined.drop("_at", "_part", "_rows", *[f"_o{i}" for i in range(len(running))])


def ordered_list(order: list[str], *values: str) -> Column:
    """Aggregate: the rows of a group as structs in a fixed order."""
    return F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order])))


def ordered_text(order: list[str], value: str, separator: str = "") -> Column:
    """Aggregate: texts of a group joined in a fixed order."""
    return F.array_join(ordered_list(order, value)[value], separator)
