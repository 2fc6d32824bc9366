"""Connected components of an edge table by alternating large-star and small-star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, new_folder, stored


class _Tables:
    """Stage tables that are deleted when nothing reads them any more."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame) -> DataFrame:
        self.paths.append(new_folder(self.spark, "edges"))
        return stored(df, "edges", self.paths[-1])

    def clear(self, keep: int = 0) -> None:
        """Deletes all but the last ``keep``."""
        gone = self.paths[: len(self.paths) - keep]
        for path in gone:
            discard(self.spark, path)
        self.paths = self.paths[len(gone) :]


def _to_least(pairs: DataFrame, tables: _Tables) -> DataFrame:
    """pairs (u, v): for each u the least node among u and its v, as m.

    Minima are pre-aggregated in each task and written first: the join then has a shuffle of its own on both sides, of
    which the part of a hot u can be split at run time.
    """
    least = tables.put(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of 64-bit ids -> (node, root): root is the least node reachable; only nodes of an edge appear.

    Null ends and loops are ignored; repeated edges are one. Every step is written to the shared folder, and what no step
    reads any more is deleted, so neither the lineage nor the driver nor the folder grows: the driver sees a count and a
    checksum of the edges. Rounds go on until nothing changes, some log n of them.
    """
    tables = _Tables(edges.sparkSession)
    now = tables.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.selectExpr("a AS node", "b AS root").unionAll(now.selectExpr("b AS node", "b AS root")).distinct()
        seen = state
        both = now.selectExpr("a AS u", "b AS v").unionAll(now.selectExpr("b AS u", "a AS v"))
        large = tables.put(_to_least(both, tables).where("v > u").selectExpr("v AS u", "m AS v").distinct())
        small = _to_least(large, tables)
        small = small.where("v <> m").selectExpr("v AS a", "m AS b").unionAll(small.selectExpr("u AS a", "m AS b"))
        now = tables.put(small.where("a <> b").distinct())
        tables.clear(keep=1)
