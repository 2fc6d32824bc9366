"""Scans and sinks: CSV logs read as text under a fixed schema, Parquet tables, quarantine, counters, exports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CALENDAR_COLUMNS, TRAFFIC_COLUMNS, WEATHER_COLUMNS
from ..functions.columns import blank_to_null


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all columns as text; types come later, so that junk is counted and not lost."""
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).csv(path)


def scan_traffic(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, TRAFFIC_COLUMNS)


def scan_weather(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, WEATHER_COLUMNS)


def scan_calendar(spark: SparkSession, path: str) -> DataFrame:
    return typed_calendar(scan_csv(spark, path, CALENDAR_COLUMNS))


def typed_calendar(raw: DataFrame) -> DataFrame:
    """Dates, flags of 0 and 1 (junk and null are 0), and names without null."""
    flags = [F.coalesce(F.expr(f"cast(try_cast({c} AS double) <> 0 AS int)"), F.lit(0)).alias(c) for c in ("public_holiday", "event_flag", "roadwork_flag")]
    names = {c: F.coalesce(F.col(c), F.lit("")) for c in ("holiday_name", "event_name")}
    return raw.select(
        F.expr("cast(try_to_timestamp(trim(date), 'yyyy-MM-dd') AS date)").alias("date"),
        flags[0], names["holiday_name"].alias("holiday_name"), flags[1], names["event_name"].alias("event_name"), flags[2],
    )


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quarantine(*rejected: tuple[str, DataFrame]) -> DataFrame:
    """All rejected rows, every column as text, with their source; columns that a source lacks are null."""
    parts = [df.select(*(F.col(c).cast("string").alias(c) for c in df.columns), F.lit(name).alias("_source_table")) for name, df in rejected]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def counters(*found: tuple[str, DataFrame]) -> DataFrame:
    """One-row aggregates as a tidy table (stage, metric, value)."""
    parts = [df.select(F.lit(stage).alias("stage"), F.expr(stacked(df.columns))) for stage, df in found]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def stacked(columns: list[str], name: str = "metric", value: str = "value") -> str:
    """SQL that turns columns into rows (name, value as double)."""
    return f"stack({len(columns)}, " + ", ".join(f"'{c}', cast(`{c}` AS double)" for c in columns) + f") AS ({name}, {value})"


def scratch(spark: SparkSession) -> str:
    """A new folder in the session's shared storage (``spark.checkpoint.dir``), which goes when the driver ends; where the
    setting is missing, one of our own if the master is local, so that there is one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if _passing:
        _passing[-1].append(path)
    return path


#: Folders made inside each open ``passing``.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Stage tables made inside are deleted at the end, but for those put in the list that it yields."""
    kept: list[DataFrame] = []
    _passing.append([])
    try:
        yield kept
    finally:
        made, stay = _passing.pop(), {df._stage for df in kept}
        for path in made:
            if path in stay:
                if _passing:
                    _passing[-1].append(path)
                continue
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, wide: bool = False) -> DataFrame:
    """df written as a stage table and read back, so that what stands on it does not compute it again. ``wide`` tables, of about a
    hundred columns, are packed tighter."""
    path = scratch(df.sparkSession)
    if wide:
        df.write.option("compression", "zstd").parquet(path)
    else:
        write_table(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


class BrokenStage(ValueError):
    """A stage table whose counters break an expectation."""


class Observed:
    """Counters of a chain, taken from its stage tables as they are written.

    Spark's own observations would gather them in the write itself; in Spark 4.1 a session that has used one can no longer run the
    closures of MLlib that hold the session, so each stage takes its counters in one pass over the columns they need.
    """

    def __init__(self):
        self.values: dict[tuple[str, str], float | None] = {}

    def stage(self, df: DataFrame, section: str, counters: dict[str, Column], expect: Callable[[dict], str | None] | None = None) -> DataFrame:
        """``staged`` df; counters are aggregates over its rows. ``expect`` gets them by name and returns what is wrong, if anything:
        that ends the chain."""
        out = staged(df)
        found = out.agg(*(x.alias(n) for n, x in counters.items())).first().asDict()
        self.values |= {(section, n): x for n, x in found.items()}
        if expect and (wrong := expect(found)):
            raise BrokenStage(f"{section}: {wrong}")
        return out

    def put(self, section: str, name: str, value: float | None) -> None:
        """A counter that follows from others."""
        self.values[section, name] = value

    def table(self, spark: SparkSession, wanted: list[tuple[str, str]]) -> DataFrame:
        """(section, metric, value) of the wanted counters."""
        rows = [(a, b, None if self.values[a, b] is None else float(self.values[a, b])) for a, b in wanted]
        return spark.createDataFrame(rows, "section string, metric string, value double")


def write_counters(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A small report (one row per entity, say) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


__all__ = ["BrokenStage", "Observed", "blank_to_null", "counters", "export_csv", "passing", "quarantine", "read_table", "scratch", "staged", "scan_calendar", "scan_csv", "scan_traffic", "scan_weather", "stacked", "typed_calendar", "write_counters", "write_table"]
