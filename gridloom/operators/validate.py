"""Validation: typing, rules with reasons, split into valid and rejected rows, and audits of later tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, TRAFFIC_COLUMNS, TRAFFIC_NUMBERS, WEATHER_COLUMNS, WEATHER_NUMBERS, Config
from ..functions.columns import blank_to_null, moment, number, reasons


class MissingColumns(ValueError):
    pass


def check_schema(df: DataFrame, expected: list[str]) -> DataFrame:
    """df with the expected columns only; extra ones are dropped, a missing one is an error."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df.select(*expected)


def typed_traffic(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    df = check_schema(raw, [*TRAFFIC_COLUMNS, *keep])
    text = ["road_id", "road_name", "weather_station_id", "congestion_level"]
    return df.withColumns({"timestamp": moment("yyyy-MM-dd")} | {c: number(c) for c in TRAFFIC_NUMBERS} | {c: blank_to_null(c) for c in text})


def typed_weather(raw: DataFrame) -> DataFrame:
    df = check_schema(raw, WEATHER_COLUMNS)
    return df.withColumns({"timestamp": moment("dd/MM/yyyy")} | {c: number(c) for c in WEATHER_NUMBERS})


def tagged(df: DataFrame, columns: list[str], config: Config = DEFAULT, key: str | None = None) -> DataFrame:
    """df with _reject_reason: the ranges of its columns, an unparseable timestamp, and a missing key."""
    extra = [("unparseable_timestamp", F.col("timestamp").isNull())]
    if key:
        extra.append((f"missing_{key}", F.col(key).isNull()))
    ranges = {c: config.ranges[c] for c in config.ranges if c in columns}
    return df.withColumn("_reject_reason", reasons(ranges, *extra))


def tagged_traffic(raw: DataFrame, config: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    return tagged(typed_traffic(raw, keep), TRAFFIC_COLUMNS, config, "road_id")


def tagged_weather(raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return tagged(typed_weather(raw), WEATHER_COLUMNS, config)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of a tagged table."""
    return df.where("_reject_reason = ''").drop("_reject_reason"), df.where("_reject_reason <> ''")


def reason_histogram(df: DataFrame) -> DataFrame:
    return df.where("_reject_reason <> ''").groupBy(F.col("_reject_reason").alias("reason")).agg(F.count("*").alias("n"))


def intake_summary(df: DataFrame, entity: str = "road_id") -> DataFrame:
    """One row: raw, valid and rejected rows, entities, and the span of the valid ones."""
    valid = F.col("_reject_reason") == ""
    return df.agg(
        F.count("*").alias("raw"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("rejected"),
        F.count_distinct(F.when(valid, F.col(entity))).alias("entities"),
        F.min(F.when(valid, F.col("timestamp"))).alias("first"), F.max(F.when(valid, F.col("timestamp"))).alias("last"),
    )


def upload_scan(df: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """(rule, n): rows that meet each SQL condition, and rows beyond the first of their key."""
    counted = df.agg(*(F.count_if(F.expr(rule)).alias(name) for name, rule in rules.items()), (F.count("*") - F.count_distinct(F.struct(*keys))).alias("duplicate_keys"))
    listed = ", ".join(f"'{c}', {c}" for c in counted.columns)
    return counted.selectExpr(f"stack({len(counted.columns)}, {listed}) AS (rule, n)")


UPLOAD_RULES = {
    "negative_volume": "traffic_volume < 0", "speed_over_200": "avg_speed > 200", "occupancy_over_100": "occupancy > 100", "blank_label": "congestion_level IS NULL",
}


def unique_by(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df as the right side of a left join that must keep the row count: the stage that reads a key with several rows fails, and
    says which. Rows of a null key, which match nothing, are left out. The grouping is by the join's keys, so the join has no
    shuffle of its own."""
    rest = [c for c in df.columns if c not in keys]
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    one = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    reason = F.concat(F.lit(f"{name}: "), F.col("_n").cast("string"), F.lit(" rows of "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(reason))
    return one.select(*keys, checked.alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that stand more than once: empty if a left join on them keeps the row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def grid_audit(df: DataFrame, entity: str = "road_id", time: str = "timestamp") -> DataFrame:
    """One row: entities, the least and largest number of rows of one, distinct steps in time, repeated keys."""
    step = df.withColumn("step", F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.lag(time).over(Window.partitionBy(entity).orderBy(time)).cast("timestamp")))
    per = step.groupBy(entity).agg(F.count("*").alias("rows"), F.min("step").alias("low"), F.max("step").alias("high"), (F.count("*") - F.count_distinct(time)).alias("repeated"))
    return per.agg(
        F.count("*").alias("entities"), F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"),
        F.min("low").alias("min_step"), F.max("high").alias("max_step"), F.sum("repeated").alias("repeated_keys"),
    )


def leakage_audit(df: DataFrame, features: list[str], target: str, banned: list[str], limit: float = 0.99) -> DataFrame:
    """(feature, correlation, contemporaneous, suspicious) of every feature, from one aggregation."""
    corr = df.agg(*(F.corr(f, target).alias(f) for f in features))
    listed = ", ".join(f"'{f}', `{f}`" for f in features)
    rows = corr.selectExpr(f"stack({len(features)}, {listed}) AS (feature, correlation)")
    known = F.col("feature").isin(banned) if banned else F.lit(False)
    return rows.select("feature", "correlation", known.alias("contemporaneous"), F.coalesce(F.abs("correlation") > limit, F.lit(False)).alias("suspicious"))


def lag_audit(df: DataFrame, pairs: dict[str, tuple[str, int]], rolling: dict[str, tuple[str, int, int]], entity: str = "road_id", time: str = "timestamp") -> DataFrame:
    """(check, mismatches): lag columns against the rows they name, rolling means against frames that end before the row."""
    order = Window.partitionBy(entity).orderBy(time)
    checks = {name: ~F.col(name).eqNullSafe(F.lag(source, k).over(order)) for name, (source, k) in pairs.items()}
    for name, (source, width, least) in rolling.items():
        frame = order.rowsBetween(-width, -1)
        want = F.when(F.count(source).over(frame) >= least, F.avg(source).over(frame))
        checks[name] = ~(F.round(F.col(name), 6).eqNullSafe(F.round(want, 6)))
    marked = df.select(*(c.cast("int").alias(n) for n, c in checks.items()))
    summed = marked.agg(*(F.sum(n).alias(n) for n in checks))
    listed = ", ".join(f"'{n}', `{n}`" for n in checks)
    return summed.selectExpr(f"stack({len(checks)}, {listed}) AS (check, mismatches)")


def select_features(df: DataFrame, excluded: set[str]) -> list[str]:
    """Numeric columns that are not excluded, sorted."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return sorted(c for c, kind in df.dtypes if kind in numeric and c not in excluded)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
