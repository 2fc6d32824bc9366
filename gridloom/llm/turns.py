"""The place of each turn in its conversation, for conversations of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored


def numbered(df: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """df with the number of each row from 1 in its group, by the order given (nulls first); the group is not null.

    Rows are range-partitioned by group and order and written, so that a group of any size lies in several parts; each part
    numbers its own rows, and a row for each part of a group carries the counts of the parts before it. Rows alike in group
    and order are numbered in any order.
    """
    dealt = stored(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_part"))
    before = stored(counts.select(group, "_part", (upto - F.col("_n")).alias("_before")).where("_before > 0"), "numbered-before")
    within = Window.partitionBy(group, "_part").orderBy(*order)
    own = dealt.withColumn(name, F.row_number().over(within).cast("long"))
    found = own.join(before, [group, "_part"], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return found.select(*df.columns, name)
