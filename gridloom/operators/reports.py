"""Report aggregates over the clean panel and over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import banded, label_of, ordinal
from . import ranks


def class_shares(df: DataFrame, column: str) -> DataFrame:
    """(label, n, share) of the rows that have one."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def daily_profile(df: DataFrame, value: str = "traffic_volume") -> DataFrame:
    kind = F.when(F.weekday("timestamp") >= 5, "weekend").otherwise("weekday")
    return df.groupBy(kind.alias("kind"), "tod").agg(F.avg(value).alias("mean"))


def entity_by_hour(df: DataFrame, value: Column, entity: str = "road_id") -> DataFrame:
    """A row per entity with columns h0 to h23 of means, and their mean (cells without rows do not count)."""
    cells = df.groupBy(entity).pivot("hour", list(range(24))).agg(F.avg("v")) if "v" in df.columns else (
        df.select(entity, F.hour("timestamp").alias("hour"), value.alias("v")).groupBy(entity).pivot("hour", list(range(24))).agg(F.avg("v"))
    )
    cells = cells.withColumnsRenamed({str(h): f"h{h}" for h in range(24)})
    have = [F.when(F.col(f"h{h}").isNotNull(), 1).otherwise(0) for h in range(24)]
    mean = sum((F.coalesce(f"h{h}", F.lit(0.0)) for h in range(24)), F.lit(0.0)) / F.nullif(sum(have, F.lit(0)), F.lit(0))
    return cells.withColumn("row_mean", mean)


def five_numbers(df: DataFrame, by: str, value: str) -> DataFrame:
    """q1, median, q3, and whiskers: the extreme values within 1.5 times the range between quartiles."""
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    q = ranks.quantiles_by(rows, [by], {"q": F.col(value)}, [0.25, 0.5, 0.75])
    q = q.select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(q, by).groupBy(by).agg(
        F.first("q1").alias("q1"), F.first("q2").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"),
    )


def histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """(bin, n) of equal widths between the least and the largest value; the last bin has its upper end."""
    rows = df.where(F.col(value).isNotNull())
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.floor((F.col(value) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    place = F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0))).cast("int")
    return rows.crossJoin(F.broadcast(span)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, correlation) over the rows that have both values."""
    both = df.agg(*(F.corr(f, target).alias(f) for f in features))
    listed = ", ".join(f"'{f}', `{f}`" for f in features)
    return both.selectExpr(f"stack({len(features)}, {listed}) AS (feature, correlation)")


def strongest(correlation: DataFrame, k: int) -> DataFrame:
    return correlation.where("correlation IS NOT NULL AND NOT isnan(correlation)").orderBy(F.desc(F.round(F.abs("correlation"), 9)), "feature").limit(k)


def incident_rate(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg((F.avg((F.coalesce(F.col("accident_count"), F.lit(0)) > 0).cast("double")) * 100).alias("rate_pct"), F.count("*").alias("n"))


def entity_comparison(df: DataFrame, entity: str = "road_id") -> DataFrame:
    return df.groupBy(entity).agg(
        F.avg("traffic_volume").alias("mean_volume"), F.avg("avg_speed").alias("mean_speed"), F.stddev_samp("travel_time").alias("std_travel_time"),
        F.avg((F.coalesce(F.col("accident_count"), F.lit(0)) > 0).cast("double")).alias("incident_rate"),
        F.avg(F.coalesce(F.col("congestion_level") == "Severe", F.lit(False)).cast("double")).alias("severe_share"),
    )


def ranked(df: DataFrame, metric: str, key: str, descending: bool = True) -> DataFrame:
    """df (one row per entity) with rank by the metric; ties by key."""
    order = F.desc_nulls_last(F.round(metric, 9)) if descending else F.asc_nulls_last(F.round(metric, 9))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(order, key)))


def peak_and_busiest(df: DataFrame) -> DataFrame:
    """One row: the hour of largest mean volume, and the entity of largest mean volume."""
    hours = df.groupBy(F.hour("timestamp").alias("hour")).agg(F.round(F.avg("traffic_volume"), 9).alias("v"))
    roads = df.groupBy("road_id").agg(F.round(F.avg("traffic_volume"), 9).alias("v"))
    peak = hours.agg(F.max_by("hour", F.struct("v", -F.col("hour"))).alias("peak_hour"))
    return peak.crossJoin(roads.agg(F.min_by("road_id", F.struct(-F.col("v"), F.col("road_id"))).alias("busiest")))


def conditional_gap(df: DataFrame, by: str, a: str, b: str, value: str) -> DataFrame:
    return df.agg((F.avg(F.when(F.col(by) == a, F.col(value))) - F.avg(F.when(F.col(by) == b, F.col(value)))).alias("gap"))


def daily(df: DataFrame) -> DataFrame:
    """Means per calendar day; days without rows have nulls."""
    days = df.agg(F.min(F.to_date("timestamp")).alias("a"), F.max(F.to_date("timestamp")).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    means = df.groupBy(F.to_date("timestamp").alias("day")).agg(F.avg("traffic_volume").alias("mean_volume"), F.avg("avg_speed").alias("mean_speed"))
    return days.join(means, "day", "left")


def visibility_bands(df: DataFrame, edges: list[float] = [0, 1000, 2000, 4000, 10000]) -> DataFrame:  # noqa: B006
    labels = [f"{int(a)}-{int(b)}" for a, b in zip(edges, edges[1:], strict=False)]
    band = banded(F.col("visibility"), edges, labels, closed="right")
    return df.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(
        F.avg("avg_speed").alias("mean_speed"), F.avg("traffic_volume").alias("mean_volume"),
        (F.avg((F.coalesce(F.col("accident_count"), F.lit(0)) > 0).cast("double")) * 100).alias("incident_pct"), F.count("*").alias("n"),
    )


def latest(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """The rows of the last time."""
    return df.join(F.broadcast(df.agg(F.max(time).alias(time))), time)


def last_days(df: DataFrame, days: int, time: str = "timestamp") -> DataFrame:
    edge = df.agg((F.max(time) - F.expr(f"interval {days} days")).alias("_edge"))
    return df.crossJoin(F.broadcast(edge)).where(F.col(time) >= F.col("_edge")).drop("_edge")


def corridor(df: DataFrame) -> DataFrame:
    """One row of totals over forecasts."""
    return df.agg(
        F.sum("pred_y_volume").alias("volume"), F.avg("pred_y_volume").alias("mean_volume"), F.count_if(F.col("pred_congestion").isin("Heavy", "Severe")).alias("congested"),
        F.avg("pred_y_travel_time").alias("mean_travel_time"), F.sum("pred_y_travel_time").alias("travel_time"),
    )


def worst_class(df: DataFrame, column: str) -> DataFrame:
    return df.agg(label_of(F.max(ordinal(F.col(column)))).alias("worst"))


def risk_list(df: DataFrame, n: int = 10, score: str = "pred_accident_prob") -> DataFrame:
    return df.orderBy(F.desc(F.round(score, 9)), "road_id", "timestamp").limit(n)


def top_risk_lift(df: DataFrame, y: str = "y_accident", score: str = "pred_accident_prob") -> DataFrame:
    base = df.agg(F.avg(F.col(y).cast("double")).alias("base"))
    return risk_list(df, 1, score).crossJoin(F.broadcast(base)).select("road_id", F.col(score).alias("risk"), (F.col(score) / F.nullif(F.col("base"), F.lit(0.0))).alias("lift"))


def stable_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by the MD5 of the key and the seed: the same ones in every run, and in any engine that has it."""
    return df.orderBy(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(str(seed))).cast("binary")), *key).limit(n)


def most_recent(df: DataFrame, n: int, time: str = "timestamp", key: str = "road_id") -> DataFrame:
    return df.orderBy(F.desc(time), key).limit(n)


def export_summary(df: DataFrame, first: str, last: str) -> DataFrame:
    rows = df.where(F.to_date("timestamp").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.groupBy("road_id").agg(
        F.round(F.avg("y_volume"), 3).alias("mean_volume"), F.round(F.avg("pred_y_volume"), 3).alias("mean_forecast"),
        F.round(F.avg(F.abs(F.col("pred_y_volume") - F.col("y_volume"))), 3).alias("mae"),
        F.round(F.avg((F.col("pred_congestion") == "Severe").cast("double")), 3).alias("severe_share"), F.round(F.avg("pred_accident_prob"), 3).alias("risk"),
    )
