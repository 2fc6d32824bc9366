"""Windows over series of any length: a table is cut into parts of even size along its order, and parts hand on what the next
ones need.

With few long series, windows by entity run in few tasks. Here a table is range-partitioned by entity and time and written
once; each row then knows its part and its place in its series, and every window runs by part. What a part needs of earlier
or later ones is handed on in two ways: ``carried`` sums up each part in one row and passes these along (running totals, the
nearest value on either side); ``with_halo`` copies the last rows before a part into it, for frames of bounded depth. Tasks
thus grow with the rows, whatever the number of series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.tables import staged

#: Of each row: its series as text, its part, and its place in its series from 1.
HIDDEN = ["_key", "_part", "_pos"]


def order() -> WindowSpec:
    """The order of a series within each part of a cut table."""
    return Window.partitionBy("_key", "_part").orderBy("_pos")


def cut(df: DataFrame, group: list[str], time: str, count: int | None = None) -> DataFrame:
    """df as a stage table with the columns HIDDEN, in ``count`` parts or as many as the session's shuffles have; a table that is
    cut already stays as it is.

    A series of a null group is one like others. Rows of equal group and time have their places in any order, but a fixed one.
    """
    if "_part" in df.columns:
        return df
    dealt = df.repartitionByRange(*([count] if count else []), *group, time).sortWithinPartitions(*group, time)
    row = F.monotonically_increasing_id()  # counts up within a partition, whose number is in the upper 31 bits
    key = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in group))
    rows = staged(dealt.withColumns({"_key": key, "_row": row}).withColumns({"_part": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND((1 << 33) - 1)}))
    spans = rows.groupBy("_key", "_part").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    earlier = Window.partitionBy("_key").orderBy("_part")
    starts = spans.select("_key", "_part", (F.sum("n").over(earlier) - F.col("n") - F.col("first") + 1).alias("shift"))
    return rows.join(staged(starts), ["_key", "_part"]).withColumn("_pos", F.col("_row") + F.col("shift")).drop("_row", "shift")


def uncut(df: DataFrame) -> DataFrame:
    return df.drop(*HIDDEN)


def _nearest(columns: list[str]) -> dict[str, Column]:
    """Of each part: the first and the last value of each column, with their places; null where it has none."""
    out = {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.col("_pos"))
        pair = F.struct(F.col(c).alias("v"), F.col("_pos").alias("i"))
        out |= {f"_first_{c}": F.min_by(pair, known), f"_last_{c}": F.max_by(pair, known)}
    return out


def carried(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(_key, _part, and for each column structs _before_ and _after_ of (v, i)): the nearest values outside a part, and their
    places. A row for each part of each series; only these rows are walked along a series."""
    ends = parts.groupBy("_key", "_part").agg(*(x.alias(n) for n, x in _nearest(columns).items()))
    back = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_key").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    found = [F.last(f"_last_{c}", True).over(back).alias(f"_before_{c}") for c in columns] + [F.last(f"_first_{c}", True).over(ahead).alias(f"_after_{c}") for c in columns]
    return ends.select("_key", "_part", *found)


def interpolate(parts: DataFrame, columns: list[str], limit: int | None = 2, mode: str = "prefix", edges: bool = False) -> DataFrame:
    """Linear interpolation over places in a series, of a cut table.

    mode "prefix" fills the first ``limit`` rows of each gap, "whole_gap" only gaps of at most ``limit`` rows; without a limit all
    inner gaps are filled. ``edges`` gives leading and trailing rows the nearest value. Each part fills from its own values and
    those carried to it, so a gap may span parts.
    """
    back = order().rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_key", "_part").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)  # a frame that only grows
    known = parts.join(staged(carried(parts, columns)), ["_key", "_part"])
    out = {}
    for c in columns:
        pair = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_pos").alias("i")))
        out |= {f"_b_{c}": F.coalesce(F.last(pair, True).over(back), F.col(f"_before_{c}")), f"_a_{c}": F.coalesce(F.last(pair, True).over(ahead), F.col(f"_after_{c}"))}
    near = known.withColumns(out)
    filled = {}
    for c in columns:
        before, after = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        line = before["v"] + (after["v"] - before["v"]) * (F.col("_pos") - before["i"]) / F.nullif(after["i"] - before["i"], F.lit(0))
        if limit is not None:
            gap = after["i"] - before["i"] - 1 if mode == "whole_gap" else F.col("_pos") - before["i"]
            line = F.when(gap <= limit, line)
        filled[c] = F.coalesce(F.col(c), line, *((before["v"], after["v"]) if edges else ()))
    return near.withColumns(filled).drop(*out, *(f"_{k}_{c}" for k in ("before", "after") for c in columns))


def last_values(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls take the last value before them in their series, of a cut table; nothing looks ahead."""
    back = order().rowsBetween(Window.unboundedPreceding, 0)
    known = parts.join(staged(carried(parts, columns)), ["_key", "_part"])
    filled = {c: F.coalesce(F.last(c, True).over(back), F.col(f"_before_{c}")["v"]) for c in columns}
    return known.withColumns(filled).drop(*(f"_{k}_{c}" for k in ("before", "after") for c in columns))


def with_halo(parts: DataFrame, compute: Callable[[DataFrame, WindowSpec], DataFrame], halo: int) -> DataFrame:
    """``compute`` (rows and an order -> rows) on a cut table, each part of a series having the ``halo`` rows before it.

    Only these rows are copied: at most halo for each place where a series passes from one part to the next, or several parts
    if they are shorter than the halo. The table that says which part hands rows to which has a row for each such place, fewer
    than there are parts, so it is broadcast.
    """
    spans = parts.groupBy("_key", "_part").agg(F.max("_pos").alias("_end"), (F.min("_pos") - 1).alias("base"))
    later = Window.partitionBy("_key").orderBy("_part").rowsBetween(1, halo)  # each part has a row at least
    spans = spans.withColumn("_to", F.collect_list(F.struct(F.col("_part").alias("part"), "base")).over(later))
    spans = spans.withColumn("_to", F.filter("_to", lambda x: x["base"] < F.col("_end") + halo)).where(F.size("_to") > 0)
    given = parts.join(F.broadcast(staged(spans.select("_key", "_part", "_to"))), ["_key", "_part"]).where(F.col("_pos") > F.col("_to")[0]["base"] - halo)
    given = given.withColumn("_x", F.explode("_to")).where(F.col("_pos") > F.col("_x")["base"] - halo)
    given = given.withColumns({"_part": F.col("_x")["part"], "_own": F.lit(False)}).drop("_to", "_x")
    both = parts.withColumn("_own", F.lit(True)).unionByName(given)
    return compute(both, order()).where("_own").drop("_own")
