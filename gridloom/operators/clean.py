"""Cleaning: copies, the complete grid, outliers, gaps, and medians by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import STATIC_COLUMNS
from . import parts, ranks


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each set of equal rows."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("exact_duplicates"))


def dedup_most_complete(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the one with most values; ties go by all columns in order, so the result is determined."""
    complete = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    order = [complete.desc(), *(F.col(c).asc_nulls_last() for c in df.columns if c not in keys)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def entity_master(df: DataFrame, entity: str = "road_id", columns: list[str] = STATIC_COLUMNS) -> DataFrame:
    """The mode of each static column per entity: nulls do not count, ties go to the smallest."""
    return df.groupBy(entity).agg(*(F.mode(c, True).alias(c) for c in columns))


def time_grid(df: DataFrame, entity: str = "road_id", time: str = "timestamp", minutes: int = 30) -> DataFrame:
    """Every entity at every step between the first and the last time of all.

    The entities alone are so small that adaptive execution would merge them into one partition, and one task would make the whole
    grid. Entities and pieces of 48 steps are dealt to as many partitions as tasks run at a time, a number that stays.
    """
    span = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).where("a IS NOT NULL")  # one row
    pieces = span.select("b", F.explode(F.sequence("a", "b", F.expr(f"interval {48 * minutes} minutes"))).alias("_at"))
    dealt = df.select(entity).where(F.col(entity).isNotNull()).distinct().crossJoin(pieces).repartition(df.sparkSession.sparkContext.defaultParallelism, entity, "_at")
    steps = F.expr(f"sequence(_at, least(b, _at + interval {47 * minutes} minutes), interval {minutes} minutes)")
    return dealt.select(entity, F.explode(steps).alias(time))


def on_grid(df: DataFrame, entity: str = "road_id", time: str = "timestamp", minutes: int = 30, static: list[str] = STATIC_COLUMNS) -> DataFrame:
    """The complete grid with the readings where there are some, and static columns from the entities' master table."""
    grid = time_grid(df, entity, time, minutes)
    readings = df.drop(*static)
    master = entity_master(df, entity, static)
    return grid.join(readings, [entity, time], "left").join(master, entity, "left")


def grid_completeness(df: DataFrame, entity: str = "road_id", time: str = "timestamp", minutes: int = 30) -> DataFrame:
    """One row: grid rows, rows without a reading, and their percentage."""
    expected = time_grid(df, entity, time, minutes).agg(F.count("*").alias("expected"))
    have = df.agg(F.count("*").alias("have"))
    return expected.crossJoin(have).select("expected", (F.col("expected") - F.col("have")).alias("absent"), F.round((F.col("expected") - F.col("have")) / F.col("expected") * 100, 6).alias("absent_pct"))


def null_outliers(df: DataFrame, columns: list[str], threshold: float = 5.0, entity: str = "road_id") -> DataFrame:
    """Values more than ``threshold`` sample deviations from their entity's mean become null; without spread none do."""
    spread = df.groupBy(entity).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    out = {}
    for c in columns:
        z = (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        out[c] = F.when(F.coalesce(F.abs(z) <= threshold, F.lit(True)), F.col(c))
    rows = df.join(spread.withColumnRenamed(entity, "_entity"), F.col(entity).eqNullSafe(F.col("_entity")), "left")
    return rows.withColumns(out).drop("_entity", *(f"_{k}_{c}" for k in "ms" for c in columns))


def interpolate(df: DataFrame, columns: list[str], group: list[str], time: str = "timestamp", limit: int | None = 2, mode: str = "prefix", edges: bool = False) -> DataFrame:
    """Linear interpolation of several columns over row positions, see ``parts.interpolate``; a table that is cut stays cut."""
    filled = parts.interpolate(parts.cut(df, group, time), columns, limit, mode, edges)
    return filled if "_part" in df.columns else parts.uncut(filled)


def interpolate_causal(df: DataFrame, columns: list[str], group: list[str], time: str = "timestamp") -> DataFrame:
    """Without look-ahead: the last value seen before, for use where later readings must not leak."""
    filled = parts.last_values(parts.cut(df, group, time), columns)
    return filled if "_part" in df.columns else parts.uncut(filled)


def fill_with_medians(df: DataFrame, columns: list[str], levels: list[list[str]], small: int = 0) -> DataFrame:
    """Nulls take the exact median of their group, from the finest level to the coarsest ([] is the whole table).

    All medians are those of the column before any filling. A group may hold any share of the rows: medians are selected from
    range-partitioned counts by value (``ranks.quantiles_by``). Only groups of the first ``small`` levels are aggregated whole;
    these are small by nature, as a half hour of a weekday of a road has a row a week, however many roads there are.
    """
    source = df
    for k, level in enumerate(levels):
        if k < small:
            found = source.groupBy(*level).agg(*(F.median(c).alias(f"_{c}") for c in columns))
        elif level:
            found = ranks.quantiles_by(source, level, {c: F.col(c) for c in columns}, [0.5]).select(*level, *(F.col(c)[0].alias(f"_{c}") for c in columns))
        else:
            found = ranks.medians(source, columns).select(*(F.col(c).alias(f"_{c}") for c in columns))
        df = df.join(found, level, "left") if level else df.crossJoin(F.broadcast(found))  # one row
        df = df.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))
    return df


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    listed = ", ".join(f"'{c}', `{c}`" for c in columns)
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).selectExpr(f"stack({len(columns)}, {listed}) AS (column_name, nulls)")


def segment_length(df: DataFrame, entity: str = "road_id") -> DataFrame:
    """The median of travel time x speed / 60 of each entity, over rows with speed above 0."""
    length = F.when(F.col("avg_speed") > 0, F.col("travel_time") * F.col("avg_speed") / 60)
    return ranks.quantiles_by(df, [entity], {"q": length}, [0.5]).select(entity, F.col("q")[0].alias("segment_length_km"))


def fill_travel_time(df: DataFrame, entity: str = "road_id", source: DataFrame | None = None) -> DataFrame:
    """segment_length_km, and travel_time from it where it is null; speed 0 gives no time. ``source`` has the same speeds and travel
    times: a stage table that df stands on, so that df need not be one."""
    back = F.col("segment_length_km") / F.nullif(F.col("avg_speed"), F.lit(0.0)) * 60
    return df.join(segment_length(df if source is None else source, entity), entity, "left").withColumn("travel_time", F.coalesce("travel_time", back))
