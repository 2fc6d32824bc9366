"""Context for the panel: weather, calendar, congestion classes and the vehicle mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import condition_of, congestion_of, half_hour
from . import ranks
from .clean import interpolate
from .validate import unique_by

MIX = {"2W": "share_2w", "Car": "share_car", "LCV": "share_lcv", "HCV": "share_hcv"}


def clean_weather(df: DataFrame) -> DataFrame:
    """Labels of the vocabulary; temperature and visibility interpolated both ways per station; rainfall null is 0."""
    df = df.withColumn("weather_condition", condition_of(F.col("weather_condition")))
    df = interpolate(df, ["temperature", "rainfall", "visibility"], ["station_id"], limit=None, edges=True)
    return df.withColumn("rainfall", F.coalesce("rainfall", F.lit(0.0)))


def label_cardinality(raw: DataFrame) -> DataFrame:
    """One row: distinct labels before and after, rows that map to nothing, and the labels that do not."""
    label, clean = F.col("weather_condition"), condition_of(F.col("weather_condition"))
    unmapped = F.when((clean == "Unknown") & label.isNotNull(), F.lower(F.trim(label)))
    return raw.agg(
        F.count_distinct(label).alias("before"), F.count_distinct(clean).alias("after"),
        F.count_if(clean == "Unknown").alias("unknown_rows"), F.array_join(F.array_sort(F.collect_set(unmapped)), ",").alias("unmapped"),
    )


def half_hourly(df: DataFrame, entity: str = "station_id", time: str = "timestamp") -> DataFrame:
    """Hourly rows at both half hours of their hour; of several for one step the one of the earliest time stays."""
    hour = F.date_trunc("hour", time).cast("timestamp_ntz")
    both = df.withColumn("join_ts", F.explode(F.array(hour, hour + F.expr("interval 30 minutes"))))
    order = Window.partitionBy(entity, "join_ts").orderBy(time, *[c for c in df.columns if c not in (entity, time)])
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", time)


def with_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """panel left join half-hourly weather on station and time; two rows of weather for one of them fail the join."""
    right = weather.withColumnsRenamed({"station_id": "weather_station_id", "join_ts": "timestamp"})
    return panel.join(unique_by(right, ["weather_station_id", "timestamp"], "weather"), ["weather_station_id", "timestamp"], "left")


def with_calendar(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """panel left join the calendar (a row per date) on the local date; dates without one have no flags and no names."""
    joined = panel.withColumn("date", F.to_date("timestamp")).join(unique_by(calendar, ["date"], "calendar"), "date", "left").drop("date")
    return joined.fillna(0, ["public_holiday", "event_flag", "roadwork_flag"]).fillna("", ["holiday_name", "event_name"])


def match_rate(joined: DataFrame, right_column: str) -> DataFrame:
    return joined.agg(F.avg(F.col(right_column).isNotNull().cast("double")).alias("match_rate"))


def with_congestion(df: DataFrame) -> DataFrame:
    """vc_ratio = volume over half the hourly capacity; blank labels take the ratio's class, marked congestion_derived."""
    vc = F.col("traffic_volume") / F.nullif(F.col("road_capacity") / 2, F.lit(0.0))
    out = df.withColumn("vc_ratio", vc).withColumn("congestion_derived", F.col("congestion_level").isNull())
    return out.withColumn("congestion_level", F.coalesce("congestion_level", congestion_of(F.col("vc_ratio"))))


def rule_agreement(df: DataFrame) -> DataFrame:
    """One row: blank labels, and the share of given labels that equal the class of their ratio (no class is unequal)."""
    return df.agg(*(x.alias(n) for n, x in agreement_counters().items()))


def agreement_counters() -> dict[str, Column]:
    derived = congestion_of(F.col("traffic_volume") / F.nullif(F.col("road_capacity") / 2, F.lit(0.0)))
    same = F.when(F.col("congestion_level").isNotNull(), F.coalesce(derived == F.col("congestion_level"), F.lit(False)).cast("double"))
    return {"blank": F.count_if(F.col("congestion_level").isNull()), "agreement": F.avg(same)}


def vehicle_mix(df: DataFrame, column: str = "vehicle_type_dist") -> DataFrame:
    """Shares of the vehicle kinds from a JSON object; without one, the share's median over the table."""
    parsed = F.from_json(column, "map<string,double>")
    out = df.withColumns({name: F.try_element_at(parsed, F.lit(key)) for key, name in MIX.items()})
    found = ranks.medians(out, list(MIX.values())).select(*(F.col(c).alias(f"_{c}") for c in MIX.values()))  # one row
    out = out.crossJoin(F.broadcast(found)).withColumns({c: F.coalesce(c, f"_{c}") for c in MIX.values()})
    return out.drop(column, *(f"_{c}" for c in MIX.values()))


def mix_failures(df: DataFrame, column: str = "vehicle_type_dist") -> DataFrame:
    """One row: texts that are no JSON object with entries."""
    return df.agg(*(x.alias(n) for n, x in mix_counters(column).items()))


def mix_counters(column: str = "vehicle_type_dist") -> dict[str, Column]:
    parsed = F.from_json(column, "map<string,double>")
    bad = F.col(column).isNotNull() & (F.coalesce(F.size(parsed), F.lit(0)) <= 0)
    return {"parse_failures": F.count_if(bad), "null_texts": F.count_if(F.col(column).isNull())}


def with_slots(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """tod: half hour of the day, 0 to 47; dow: weekday from Monday 0."""
    return df.withColumns({"tod": half_hour(F.col(time)), "dow": F.weekday(time)})
