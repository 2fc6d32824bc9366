"""Ranks, running totals and exact quantiles over whole tables, without a task that holds all values.

Rows are counted by value, the counts are range-partitioned by the value, and each partition adds to its own running
totals those of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import staged


def running(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """df, which has one row for each value of ``order`` (and group ``by``), with a column upto_x for each x of sums: the
    total of x over the rows up to this one in the order, of its group."""
    by = by or []
    key = F.desc(order) if descending else F.asc(order)
    dealt = staged(df.repartitionByRange(*by, key).withColumn("_p", F.spark_partition_id()))
    totals = dealt.groupBy("_p", *by).agg(*(F.sum(x).alias(f"_t_{x}") for x in sums))  # a row for each partition and group in it
    earlier = Window.partitionBy(*by).orderBy("_p") if by else Window.orderBy("_p")
    before = totals.select("_p", *by, *((F.sum(f"_t_{x}").over(earlier) - F.col(f"_t_{x}")).alias(f"_b_{x}") for x in sums))
    within = Window.partitionBy("_p", *by).orderBy(key)
    joined = dealt.join(before, ["_p", *by])
    found = joined.withColumns({f"upto_{x}": F.sum(x).over(within) + F.col(f"_b_{x}") for x in sums})
    return found.drop("_p", *(f"_b_{x}" for x in sums))


def _at(run: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """wanted (by, i, lo, hi, frac) with the values of 0-based ranks lo and hi, blended: (by, i, q)."""
    both = run.join(F.broadcast(wanted), by) if by else run.crossJoin(F.broadcast(wanted))
    first = F.col("upto_n") - F.col("n")
    holds = {k: (first <= F.col(k)) & (F.col(k) < F.col("upto_n")) for k in ("lo", "hi")}
    some = both.where(holds["lo"] | holds["hi"]).groupBy(*by, "i", "frac")
    ends = some.agg(F.max(F.when(holds["lo"], F.col("v"))).alias("a"), F.max(F.when(holds["hi"], F.col("v"))).alias("b"))
    return ends.select(*by, "i", (F.col("a") * (1 - F.col("frac")) + F.col("b") * F.col("frac")).alias("q"))


def quantiles(df: DataFrame, column: str, at: list[float]) -> DataFrame:
    """One row with an array ``q``: the exact quantiles of a column, interpolated; without values it is null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    run = running(counts, "v", ["n"])
    place = F.col("p") * (F.col("total") - 1)
    wanted = run.agg(F.sum("n").alias("total")).where("total > 0").select("total", F.posexplode(F.array(*map(F.lit, at))).alias("i", "p"))  # a row for each quantile
    wanted = wanted.select("i", F.floor(place).alias("lo"), F.ceil(place).alias("hi"), (place - F.floor(place)).alias("frac"))
    listed = F.array_sort(F.collect_list(F.struct("i", "q")))
    return _at(run, wanted, []).agg(F.when(F.count("*") > 0, F.transform(listed, lambda x: x["q"])).alias("q"))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column; null where a column has no values."""
    pairs = ", ".join(f"'{c}', cast(`{c}` AS double)" for c in columns)
    counts = df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (c, v)")).where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    run = running(counts, "v", ["n"], ["c"])
    half = (F.col("total") - 1) / 2
    wanted = run.groupBy("c").agg(F.sum("n").alias("total")).select("c", F.lit(0).alias("i"), F.floor(half).alias("lo"), F.ceil(half).alias("hi"), (half - F.floor(half)).alias("frac"))
    found = _at(run, wanted, ["c"])  # a row for each column
    return found.agg(*(F.max(F.when(F.col("c") == c, F.col("q"))).alias(c) for c in columns))


def quantiles_by(df: DataFrame, by: list[str], values: dict[str, Column], at: list[float]) -> DataFrame:
    """(by, and for each name of values an array of its exact quantiles in the group, interpolated; null without values).

    All groups, columns and ranks in one pass: values are counted by group, the counts are range-partitioned by group and
    value, and running totals tell which count holds a wanted rank. A group of any size lies in many partitions. Groups with a
    null in ``by`` are left out, others have a row each.
    """
    pairs = ", ".join(f"'{n}', _v{i}" for i, n in enumerate(values))
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).select(*by, *(v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())))
    counts = known.select(*by, F.expr(f"stack({len(values)}, {pairs}) AS (_c, _v)")).groupBy(*by, "_c", "_v").agg(F.count("_v").alias("n"))
    run = staged(running(counts, "_v", ["n"], [*by, "_c"]))  # the count of nulls is 0, so that a group without values is here too
    place = F.col("p") * (F.col("total") - 1)
    wanted = run.groupBy(*by, "_c").agg(F.sum("n").alias("total")).where("total > 0").withColumn("p", F.explode(F.array(*map(F.lit, at))))
    wanted = wanted.select(*by, "_c", "p", F.floor(place).alias("lo"), F.ceil(place).alias("hi"), (place - F.floor(place)).alias("frac"))
    first = F.col("upto_n") - F.col("n")
    holds = {k: (first <= F.col(k)) & (F.col(k) < F.col("upto_n")) for k in ("lo", "hi")}
    ends = run.where("n > 0").join(staged(wanted), [*by, "_c"]).where(holds["lo"] | holds["hi"]).groupBy(*by, "_c", "p", "frac")
    ends = ends.agg(F.max(F.when(holds["lo"], F.col("_v"))).alias("a"), F.max(F.when(holds["hi"], F.col("_v"))).alias("b"))
    blended = F.when(F.col("frac") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("frac")) + F.col("b") * F.col("frac"))
    found = ends.select(*by, "_c", "p", blended.alias("q")).unionByName(run.select(*by, F.lit(None).cast("string").alias("_c"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("q")))
    each = {n: [F.max(F.when((F.col("_c") == n) & (F.col("p") == p), F.col("q"))) for p in at] for n in values}
    return found.groupBy(*by).agg(*(F.array(*q).alias(n) for n, q in each.items()))
