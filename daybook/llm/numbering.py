"""Positions of sorted rows without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import stage


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows with ``position`` (from 0, in their group, by ``order``) and ``size`` of the group.

    Rows are dealt by ranges of group and order, so a group of any size is spread over many tasks;
    what a task holds is counted, and the counts before it are its first position. Rows that are
    alike in group and order take neighbouring positions in any order. ``groups`` hold no nulls.
    """
    dealt = df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id())
    rows = stage(dealt, name)
    held = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_held"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select(
        *groups,
        "_part",
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_first"),
        F.sum("_held").over(Window.partitionBy(*groups)).alias("size"),
    )
    within = Window.partitionBy(*groups, "_part").orderBy(*order)
    placed = rows.withColumn("_at", F.row_number().over(within) - 1)
    joined = placed.join(firsts, [*groups, "_part"])
    return joined.withColumn("position", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")
