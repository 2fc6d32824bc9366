"""Registered queries: one for each operator, over the tables of ``panel.Tables``, with its DuckDB SQL from ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CHANNELS, CLASSES, CONDITIONS, DEFAULT, STATIC_COLUMNS, TEMPERATURE_BANDS
from ..functions import columns as c
from ..operators import clean, enrich, features, metrics, models, parts, reports
from ..operators import validate as v
from ..sources import tables as s
from . import fit_queries
from .oracle import VC, band, code, condition, sql
from .panel import Tables, cleaned, scoreboard

REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def add(name: str, query: Callable[[Tables], DataFrame], body: str | None = None, rounded: str = "") -> None:
    REGISTRY[name] = (query, None if body is None else sql(body, rounded))


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, as both engines add in their own order."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def _csv(t: Tables, df: DataFrame, scan) -> DataFrame:
    path = s.scratch(t.spark)
    df.write.option("header", True).csv(path)
    return scan(t.spark, path)


def _round_trip(t: Tables, df: DataFrame) -> DataFrame:
    path = s.scratch(t.spark)
    s.write_table(df, path)
    return s.read_table(t.spark, path)


# ---- sources and sinks
add("s1_calendar_scan", lambda t: _csv(t, t.raw_calendar, s.scan_calendar), "SELECT * FROM calendar")
add("s2_weather_scan", lambda t: v.split_valid(v.tagged_weather(_csv(t, t.weather, s.scan_weather)))[0].select("station_id", "timestamp", *("temperature", "rainfall", "visibility")),
    "SELECT station_id, timestamp, temperature, rainfall, visibility FROM valid_weather")
add("s3_traffic_scan", lambda t: v.split_valid(v.tagged_traffic(_csv(t, t.traffic, s.scan_traffic)))[0].select("road_id", "timestamp", *CHANNELS, "congestion_level"),
    "SELECT road_id, timestamp, traffic_volume, avg_speed, occupancy, congestion_level FROM valid")
add("s4_parquet_sink", lambda t: _round_trip(t, t.valid).groupBy("road_id").agg(F.count("*").alias("n"), F.sum("traffic_volume").alias("volume")),
    "SELECT road_id, count(*) AS n, sum(traffic_volume) AS volume FROM valid GROUP BY 1")
add("s5_parquet_scan", lambda t: _round_trip(t, t.deduped.select("road_id", "timestamp", "traffic_volume")), "SELECT road_id, timestamp, traffic_volume FROM deduped")
_QUARANTINED = ["road_id", "timestamp", "avg_speed", "station_id", "temperature", "_reject_reason", "_source_table"]


def _quarantine(t: Tables) -> DataFrame:
    found = s.quarantine(("traffic", v.split_valid(t.tagged)[1]), ("weather", v.split_valid(t.tagged_weather)[1]))
    return _round_trip(t, found)


_Q_SQL = """SELECT road_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, avg_speed::VARCHAR AS avg_speed, NULL::VARCHAR AS station_id, NULL::VARCHAR AS temperature, _reject_reason, 'traffic' AS _source_table
    FROM tagged WHERE _reject_reason <> '' UNION ALL SELECT NULL, strftime(timestamp, '%Y-%m-%d %H:%M:%S'), NULL, station_id, temperature::VARCHAR, _reject_reason, 'weather' FROM tagged_weather WHERE _reject_reason <> ''"""
add("s6_quarantine", lambda t: _quarantine(t).select(*_QUARANTINED), _Q_SQL)
add("u1_quarantine_union", lambda t: s.quarantine(("traffic", v.split_valid(t.tagged)[1]), ("weather", v.split_valid(t.tagged_weather)[1])).groupBy("_source_table", "_reject_reason").agg(F.count("*").alias("n")),
    f"SELECT _source_table, _reject_reason, count(*) AS n FROM ({_Q_SQL}) GROUP BY ALL")


def _counters(t: Tables) -> DataFrame:
    found = s.counters(("ingest", v.intake_summary(t.tagged).drop("first", "last")), ("clean", clean.grid_completeness(t.deduped)))
    path = s.scratch(t.spark)
    s.write_counters(found, path)
    return t.spark.read.schema("stage string, metric string, value double").json(path)


add("s7_run_counters", lambda t: r(_counters(t)), """SELECT 'ingest' AS stage, unnest(['raw', 'valid', 'rejected', 'entities']) AS metric, unnest([count(*), count(*) FILTER (_reject_reason = ''), count(*) FILTER (_reject_reason <> ''),
    count(DISTINCT road_id) FILTER (_reject_reason = '')])::DOUBLE AS value FROM tagged UNION ALL SELECT 'clean', unnest(['expected', 'absent', 'absent_pct']), unnest([e::DOUBLE, e - h, round((e - h) / e * 100, 6)])
    FROM (SELECT (SELECT count(*) FROM grid) AS e, (SELECT count(*) FROM deduped) AS h)""")  # fmt: skip


def _export(t: Tables) -> DataFrame:
    path = s.scratch(t.spark)
    s.export_csv(reports.export_summary(t.decoded, "2024-01-05", "2024-01-20").orderBy("road_id"), path)
    return t.spark.read.schema("road_id string, mean_volume double, mean_forecast double, mae double, severe_share double, risk double").option("header", True).csv(path)


_EXPORT = """SELECT road_id, round(avg(y_volume), 3) AS mean_volume, round(avg(pred_y_volume), 3) AS mean_forecast, round(avg(abs(pred_y_volume - y_volume)), 3) AS mae,
    round(avg((pred_congestion = 'Severe')::INT), 3) AS severe_share, round(avg(pred_accident_prob), 3) AS risk FROM decoded WHERE timestamp::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1"""
add("s8_csv_export", _export, _EXPORT)

# ---- validation
add("v1_required_columns", lambda t: v.check_schema(t.traffic.withColumn("unknown_extra", F.lit(1)), ["road_id", "date", "time", "traffic_volume"]), "SELECT road_id, date, time, traffic_volume FROM traffic")
add("v2_numeric_coercion", lambda t: t.traffic.select("road_id", "date", "time", c.number("traffic_volume")), "SELECT road_id, date, time, try_cast(traffic_volume AS DOUBLE) AS traffic_volume FROM traffic")
add("v3_timestamps", lambda t: t.traffic.select("road_id", "date", "time", c.moment("yyyy-MM-dd").alias("ts")).unionAll(t.weather.select("station_id", "date", "time", c.moment("dd/MM/yyyy"))),
    "SELECT road_id, date, time, try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M') AS ts FROM traffic UNION ALL SELECT station_id, date, time, try_strptime(date || ' ' || time, '%d/%m/%Y %H:%M') FROM weather")
add("v3_instants", lambda t: t.deduped.select("road_id", "timestamp", c.instant(F.col("timestamp"), DEFAULT.timezone).alias("utc")), "SELECT road_id, timestamp, timestamp - INTERVAL '5 hours 30 minutes' AS utc FROM deduped")
add("v4_range_rules", lambda t: t.tagged.groupBy("_reject_reason").agg(F.count("*").alias("n")), "SELECT _reject_reason, count(*) AS n FROM tagged GROUP BY 1")
add("v5_extra_reasons", lambda t: t.tagged.agg(F.count_if(F.col("_reject_reason").contains("unparseable_timestamp;")).alias("unparseable"), F.count_if(F.col("_reject_reason").contains("missing_road_id;")).alias("missing")),
    "SELECT count(*) FILTER (timestamp IS NULL) AS unparseable, count(*) FILTER (road_id IS NULL) AS missing FROM typed")
add("v6_valid_split", lambda t: t.valid.groupBy("road_id").agg(F.count("*").alias("n"), F.max("timestamp").alias("last")), "SELECT road_id, count(*) AS n, max(timestamp) AS last FROM valid GROUP BY 1")
add("v7_sentinels", lambda t: t.traffic.select(c.blank_to_null("road_id"), c.blank_to_null("congestion_level")).groupBy("road_id", "congestion_level").agg(F.count("*").alias("n")),
    "SELECT road_id, congestion_level, count(*) AS n FROM typed GROUP BY ALL")
add("v8_reason_histogram", lambda t: v.reason_histogram(t.tagged), "SELECT _reject_reason AS reason, count(*) AS n FROM tagged WHERE _reject_reason <> '' GROUP BY 1")
add("v8_intake_summary", lambda t: v.intake_summary(t.tagged), """SELECT count(*) AS raw, count(*) FILTER (_reject_reason = '') AS valid, count(*) FILTER (_reject_reason <> '') AS rejected,
    count(DISTINCT road_id) FILTER (_reject_reason = '') AS entities, min(timestamp) FILTER (_reject_reason = '') AS first, max(timestamp) FILTER (_reject_reason = '') AS last FROM tagged""")  # fmt: skip
add("v9_upload_scan", lambda t: v.upload_scan(v.typed_traffic(t.traffic), ["road_id", "timestamp"], v.UPLOAD_RULES), """SELECT unnest(['negative_volume', 'speed_over_200', 'occupancy_over_100', 'blank_label', 'duplicate_keys']) AS rule,
    unnest([count(*) FILTER (traffic_volume < 0), count(*) FILTER (avg_speed > 200), count(*) FILTER (occupancy > 100), count(*) FILTER (congestion_level IS NULL), count(*) - count(DISTINCT (road_id, timestamp))]) AS n FROM typed""")  # fmt: skip
add("v10_join_keeps_rows", lambda t: v.repeated_keys(t.valid, ["road_id", "timestamp"]), "SELECT road_id, timestamp, count(*) AS n FROM valid GROUP BY ALL HAVING count(*) > 1")
add("v11_grid_audit", lambda t: v.grid_audit(t.grid), """SELECT count(*) AS entities, min(c) AS min_rows, max(c) AS max_rows, 1800::BIGINT AS min_step, 1800::BIGINT AS max_step, 0::BIGINT AS repeated_keys
    FROM (SELECT road_id, count(*) AS c FROM grid GROUP BY 1)""")  # fmt: skip
_AUDITED = ["traffic_volume", "traffic_volume_lag1", "avg_speed_lag1", "vc_ratio", "hour"]
add("v12_leakage_audit", lambda t: r(v.leakage_audit(t.features, _AUDITED, "y_volume", ["traffic_volume", "vc_ratio"])), f"""SELECT feature, correlation, feature IN ('traffic_volume', 'vc_ratio') AS contemporaneous, abs(correlation) > 0.99 AS suspicious FROM (
    SELECT unnest([{', '.join(repr(x) for x in _AUDITED)}]) AS feature, unnest([{', '.join(f'corr({x}, y_volume)' for x in _AUDITED)}]) AS correlation FROM features)""", "correlation")  # fmt: skip
add("v13_lag_audit", lambda t: v.lag_audit(t.features, {"traffic_volume_lag1": ("traffic_volume", 1), "avg_speed_lag48": ("avg_speed", 48)}, {"traffic_volume_rollmean4": ("traffic_volume", 4, 2)}).withColumn("mismatches", F.col("mismatches").cast("long")),
    "SELECT unnest(['traffic_volume_lag1', 'avg_speed_lag48', 'traffic_volume_rollmean4']) AS \"check\", unnest([0, 0, 0])::BIGINT AS mismatches FROM (SELECT count(*) FROM events)")

# ---- projections, filters, splits
add("p1_drop_leaks", lambda t: t.lite.drop("vehicle_count", "vehicle_type_dist").where("traffic_volume IS NOT NULL").select("road_id", "timestamp", "traffic_volume", "occupancy"), "SELECT road_id, timestamp, traffic_volume, occupancy FROM lite WHERE traffic_volume IS NOT NULL")
_NOT_FEATURES = {"traffic_volume", "avg_speed", "occupancy", "travel_time", "accident_count", "vc_ratio", "vehicle_count", "temperature", "rainfall", "visibility", "tod", "dow"}
_P2 = [f"{x}_lag{k}" for x in [*CHANNELS, "vc_ratio"] for k in (1, 2, 3, 4, 48, 336)] + [f"{x}_roll{m}{w}" for x in ("traffic_volume", "avg_speed") for m in ("mean", "std") for w in (4, 8, 48)]
_P2 += ["volume_delta_1", "volume_delta_2", "speed_delta_1", "volume_dod_change", "volume_vs_roll8", "speed_vs_roll8", "hour", "minute_of_day", "day_of_week", "day_of_month", "month", "week_of_year"]
_P2 += ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "is_am_peak", "is_pm_peak", "is_peak", "is_night", "public_holiday", "event_flag", "roadwork_flag", "holiday_x_peak", "event_x_peak", "roadwork_x_peak"]
_P2 += ["road_capacity", "capacity_30min", "vc_lag1", "headroom_lag1", "signal_timing", "signal_capacity_ratio", "temperature_lag1", "rainfall_lag1", "visibility_lag1", "rain_flag", "heavy_rain_flag"]
_P2 += ["low_visibility_flag", "rain_x_peak", "rain_3h", "congestion_lag1_ord", "congestion_lag48_ord", "latitude", "longitude"]
add("p2_feature_selection", lambda t: t.features.agg(*(F.count(x).alias(x) for x in v.select_features(t.features, _NOT_FEATURES | {x for x in t.features.columns if x.startswith("y_")}))).select(F.expr(
    s.stacked(v.select_features(t.features, _NOT_FEATURES | {x for x in t.features.columns if x.startswith("y_")}), "feature", "values"))),
    f"SELECT unnest([{', '.join(repr(x) for x in _P2)}]) AS feature, unnest([{', '.join(f'count({x})' for x in _P2)}])::DOUBLE AS \"values\" FROM features")
add("p3_ordered_projection", lambda t: r(t.features.select(*dict.fromkeys(["road_id", "timestamp", "y_volume", "road_id", "hour", "y_volume", "vc_lag1"]))), "SELECT road_id, timestamp, y_volume, hour, vc_lag1 FROM features", "vc_lag1")
add("p4_warm_up", lambda t: t.features.where("traffic_volume_lag336 IS NOT NULL").select("road_id", "timestamp", "traffic_volume_lag336"), "SELECT road_id, timestamp, traffic_volume_lag336 FROM features WHERE traffic_volume_lag336 IS NOT NULL")
add("p5_split_bounds", lambda t: features.split_bounds(t.predictions), "SELECT * FROM bounds")
add("p6_three_way_split", lambda t: t.split.groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")), "SELECT split, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM split GROUP BY 1")
add("p7_latest_window", lambda t: reports.latest(t.lite).select("road_id", "timestamp", "traffic_volume"), "SELECT road_id, timestamp, traffic_volume FROM lite WHERE timestamp = (SELECT max(timestamp) FROM lite)")
add("p8_last_days", lambda t: reports.last_days(t.lite, 7).select("road_id", "timestamp", "traffic_volume"), "SELECT road_id, timestamp, traffic_volume FROM lite WHERE timestamp >= (SELECT max(timestamp) FROM lite) - INTERVAL 7 DAY")
add("p9_date_range", lambda t: t.lite.where("to_date(timestamp) BETWEEN date'2024-01-05' AND date'2024-01-07'").groupBy("road_id").agg(F.count("traffic_volume").alias("n")), "SELECT road_id, count(traffic_volume) AS n FROM lite WHERE timestamp::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' GROUP BY 1")
add("p10_selector", lambda t: t.lite.groupBy("road_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("n")), "SELECT road_id, min(timestamp) AS first, max(timestamp) AS last, count(*) AS n FROM lite GROUP BY 1")
add("p11_display", lambda t: r(reports.latest(t.lite).select(F.col("road_id").alias("segment"), F.col("road_name").alias("name"), F.col("vc_ratio").alias("load"), F.col("congestion_level").alias("state"))),
    "SELECT road_id AS segment, road_name AS name, vc_ratio AS load, congestion_level AS state FROM lite WHERE timestamp = (SELECT max(timestamp) FROM lite)", "load")
add("p12_map_layer", lambda t: r(reports.latest(t.decoded).select("road_id", "latitude", "longitude", "pred_congestion", "pred_y_volume", "pred_accident_prob")),
    "SELECT road_id, latitude, longitude, pred_congestion, pred_y_volume, pred_accident_prob FROM decoded WHERE timestamp = (SELECT max(timestamp) FROM decoded)", "pred_y_volume")
add("p13_forward_folds", lambda t: features.forward_folds(t.predictions).groupBy("block").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")),
    "SELECT block, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM predictions JOIN (SELECT timestamp, (ntile(4) OVER (ORDER BY timestamp) - 1)::INT AS block FROM (SELECT DISTINCT timestamp FROM predictions)) USING (timestamp) GROUP BY 1")

# ---- joins
add("j1_time_grid", lambda t: clean.time_grid(t.deduped).groupBy("road_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")), "SELECT road_id, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM grid GROUP BY 1")
add("j2_grid_readings", lambda t: t.grid.select("road_id", "timestamp", "traffic_volume", "avg_speed"), "SELECT road_id, timestamp, traffic_volume, avg_speed FROM grid")
add("j3_master_join", lambda t: t.grid.groupBy("road_id", *STATIC_COLUMNS).agg(F.count("*").alias("n")), f"SELECT road_id, {', '.join(STATIC_COLUMNS)}, count(*) AS n FROM grid GROUP BY ALL")
add("j4_weather_join", lambda t: enrich.with_weather(t.grid.select("road_id", "timestamp", "weather_station_id"), t.half_hourly).select("road_id", "timestamp", "weather_condition", "temperature", "rainfall"), "SELECT road_id, timestamp, weather_condition, temperature, rainfall FROM lite")
add("j5_calendar_join", lambda t: enrich.with_calendar(t.grid.select("road_id", "timestamp"), t.calendar), "SELECT road_id, timestamp, public_holiday, holiday_name, event_flag, event_name, roadwork_flag FROM lite")
add("j6_match_rate", lambda t: r(enrich.match_rate(t.lite, "weather_condition")), "SELECT avg((weather_condition IS NOT NULL)::INT) AS match_rate FROM lite", "match_rate")
add("j7_predictions_intervals", lambda t: r(t.predictions.select("road_id", "timestamp", "y_volume", "pred_y_volume").join(t.intervals.select("road_id", "timestamp", "volume_p10", "volume_p90"), ["road_id", "timestamp"], "left")),
    "SELECT road_id, timestamp, p.y_volume, p.pred_y_volume, volume_p10, volume_p90 FROM predictions p LEFT JOIN intervals i USING (road_id, timestamp)", "pred_y_volume volume_p10 volume_p90")

# ---- aggregations
add("a1_entity_master", lambda t: clean.entity_master(t.deduped), "SELECT * FROM master")
add("a2_exact_duplicates", lambda t: clean.exact_duplicates(t.traffic), "SELECT ((SELECT count(*) FROM traffic) - (SELECT count(*) FROM (SELECT DISTINCT * FROM traffic)))::BIGINT AS exact_duplicates")
add("a3_null_counts", lambda t: clean.null_counts(t.grid, [*CHANNELS, "signal_timing"]), "SELECT unnest(['traffic_volume', 'avg_speed', 'occupancy', 'signal_timing']) AS column_name, unnest([count(*) - count(traffic_volume), count(*) - count(avg_speed), count(*) - count(occupancy), count(*) - count(signal_timing)]) AS nulls FROM grid")
_MEDIAN = """SELECT g.road_id, g.timestamp, coalesce(g.{c}, a.m, b.m{last}) AS {c} FROM grid g LEFT JOIN (SELECT {keys}, median({c}) AS m FROM grid GROUP BY ALL) a ON {on}
    LEFT JOIN (SELECT road_id, median({c}) AS m FROM grid GROUP BY ALL) b ON b.road_id = g.road_id"""
add("a4_seasonal_median", lambda t: r(clean.fill_with_medians(s.staged(t.grid.select("road_id", "timestamp", "dow", "tod", "traffic_volume")), ["traffic_volume"], [["road_id", "dow", "tod"], ["road_id"], []], small=1).select("road_id", "timestamp", "traffic_volume")),
    _MEDIAN.format(c="traffic_volume", keys="road_id, dow, tod", on="a.road_id = g.road_id AND a.dow = g.dow AND a.tod = g.tod", last=", (SELECT median(traffic_volume) FROM grid)"), "traffic_volume")
add("a5_signal_median", lambda t: r(clean.fill_with_medians(s.staged(t.grid.select("road_id", "timestamp", "tod", "signal_timing")), ["signal_timing"], [["road_id", "tod"], ["road_id"]], small=1).select("road_id", "timestamp", "signal_timing")),
    _MEDIAN.format(c="signal_timing", keys="road_id, tod", on="a.road_id = g.road_id AND a.tod = g.tod", last=""), "signal_timing")
add("a6_segment_length", lambda t: r(clean.segment_length(t.lite)), "SELECT road_id, median(CASE WHEN avg_speed > 0 THEN travel_time * avg_speed / 60 END) AS segment_length_km FROM lite GROUP BY 1", "segment_length_km")
add("a7_rule_agreement", lambda t: r(enrich.rule_agreement(t.grid)), f"SELECT count(*) FILTER (congestion_level IS NULL) AS blank, avg(coalesce({band(VC)} = congestion_level, false)::INT) FILTER (congestion_level IS NOT NULL) AS agreement FROM grid", "agreement")
add("a8_label_cardinality", lambda t: enrich.label_cardinality(t.weather), f"""SELECT count(DISTINCT weather_condition) AS before, count(DISTINCT {condition('weather_condition')}) AS after, count(*) FILTER ({condition('weather_condition')} = 'Unknown') AS unknown_rows,
    coalesce(string_agg(DISTINCT CASE WHEN {condition('weather_condition')} = 'Unknown' THEN lower(trim(weather_condition)) END, ','), '') AS unmapped FROM weather""")  # fmt: skip
add("a9_class_shares", lambda t: r(reports.class_shares(t.lite, "congestion_level")), "SELECT congestion_level AS label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM lite WHERE congestion_level IS NOT NULL GROUP BY 1", "share")
add("a10_base_rate", lambda t: r(t.features.agg(F.avg(F.col("y_accident").cast("double")).alias("base_rate"))), "SELECT avg(y_accident) AS base_rate FROM features", "base_rate")
add("a11_daily_profile", lambda t: r(reports.daily_profile(t.lite)), "SELECT CASE WHEN dow >= 5 THEN 'weekend' ELSE 'weekday' END AS kind, tod, avg(traffic_volume) AS mean FROM lite GROUP BY ALL", "mean")
_CELLS = ", ".join(f"avg(v) FILTER (hour = {h}) AS h{h}" for h in range(24))
_HEAT = f"SELECT *, list_avg([{', '.join(f'h{h}' for h in range(24))}]) AS row_mean FROM (SELECT road_id, {_CELLS} FROM ({{}}) GROUP BY 1)"
_HEAT_NAMES = " ".join(f"h{h}" for h in range(24)) + " row_mean"
add("a12_heatmap", lambda t: r(reports.entity_by_hour(t.lite, F.col("vc_ratio"))), _HEAT.format("SELECT road_id, hour(timestamp) AS hour, vc_ratio AS v FROM lite"), _HEAT_NAMES)
add("a13_severity_heatmap", lambda t: r(reports.entity_by_hour(t.predictions, (F.col("pred_congestion_code") - F.col("y_congestion_code")).cast("double"))),
    _HEAT.format("SELECT road_id, hour, pred_congestion_code - y_congestion_code AS v FROM predictions"), _HEAT_NAMES)
add("a14_five_numbers", lambda t: r(reports.five_numbers(t.lite, "weather_condition", "avg_speed")), """SELECT weather_condition, min(q[1]) AS q1, min(q[2]) AS median, min(q[3]) AS q3,
    min(avg_speed) FILTER (avg_speed BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS low, max(avg_speed) FILTER (avg_speed BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS high
    FROM lite JOIN (SELECT weather_condition, quantile_cont(avg_speed, [0.25, 0.5, 0.75]) AS q FROM lite WHERE weather_condition IS NOT NULL AND avg_speed IS NOT NULL GROUP BY 1) USING (weather_condition)
    WHERE avg_speed IS NOT NULL GROUP BY 1""", "q1 median q3 low high")  # fmt: skip
_HIST = """SELECT least({b} - 1, coalesce(floor(({x} - lo) * {b} / nullif(hi - lo, 0)), 0))::INT AS bin, count(*) AS n FROM {t}, (SELECT min({x}) AS lo, max({x}) AS hi FROM {t}) WHERE {x} IS NOT NULL GROUP BY 1"""
add("a15_histogram", lambda t: reports.histogram(t.features, "y_volume", 60), _HIST.format(x="y_volume", b=60, t="features"))
add("a15_residual_histogram", lambda t: reports.histogram(t.predictions.withColumn("e", F.round(F.col("pred_y_volume") - F.col("y_volume"), 6)), "e", 50), _HIST.format(x="e", b=50, t="(SELECT round(pred_y_volume - y_volume, 6) AS e FROM predictions)"))
_CORR = ["traffic_volume_lag1", "avg_speed_lag1", "occupancy_lag1", "hour", "is_peak", "temperature_lag1", "vc_lag1", "rain_3h"]
_CORR_SQL = f"SELECT unnest([{', '.join(repr(x) for x in _CORR)}]) AS feature, unnest([{', '.join(f'corr({x}, y_speed)' for x in _CORR)}]) AS correlation FROM features"
add("a16_correlations", lambda t: r(reports.correlations(t.features, _CORR, "y_speed")), _CORR_SQL, "correlation")
add("a17_incident_by_hour", lambda t: r(reports.incident_rate(t.features, "hour")), "SELECT hour, avg((coalesce(accident_count, 0) > 0)::INT) * 100 AS rate_pct, count(*) AS n FROM features GROUP BY 1", "rate_pct")
add("a17_incident_by_class", lambda t: r(reports.incident_rate(t.lite, "congestion_level")), "SELECT congestion_level, avg((coalesce(accident_count, 0) > 0)::INT) * 100 AS rate_pct, count(*) AS n FROM lite WHERE congestion_level IS NOT NULL GROUP BY 1", "rate_pct")
_COMPARE = """SELECT road_id, avg(traffic_volume) AS mean_volume, avg(avg_speed) AS mean_speed, stddev_samp(travel_time) AS std_travel_time, avg((coalesce(accident_count, 0) > 0)::INT) AS incident_rate,
    avg(coalesce(congestion_level = 'Severe', false)::INT) AS severe_share FROM lite GROUP BY 1"""
_COMPARE_NAMES = "mean_volume mean_speed std_travel_time incident_rate severe_share"
add("a18_segment_comparison", lambda t: r(reports.entity_comparison(t.lite)), _COMPARE, _COMPARE_NAMES)
add("a19_peak_and_busiest", lambda t: reports.peak_and_busiest(t.lite), """SELECT (SELECT hour FROM (SELECT hour(timestamp)::INT AS hour, round(avg(traffic_volume), 9) AS v FROM lite GROUP BY 1) ORDER BY v DESC NULLS LAST, hour LIMIT 1) AS peak_hour,
    (SELECT road_id FROM (SELECT road_id, round(avg(traffic_volume), 9) AS v FROM lite GROUP BY 1) ORDER BY v DESC NULLS LAST, road_id LIMIT 1) AS busiest""")  # fmt: skip
add("a20_conditional_gap", lambda t: r(reports.conditional_gap(t.lite, "weather_condition", "Rain", "Clear", "avg_speed")), "SELECT avg(avg_speed) FILTER (weather_condition = 'Rain') - avg(avg_speed) FILTER (weather_condition = 'Clear') AS gap FROM lite", "gap")
add("a21_daily_resample", lambda t: r(reports.daily(t.lite)), """SELECT day, mean_volume, mean_speed FROM (SELECT unnest(generate_series(min(timestamp::DATE), max(timestamp::DATE), INTERVAL 1 DAY))::DATE AS day FROM lite)
    LEFT JOIN (SELECT timestamp::DATE AS day, avg(traffic_volume) AS mean_volume, avg(avg_speed) AS mean_speed FROM lite GROUP BY 1) USING (day)""", "mean_volume mean_speed")  # fmt: skip
add("a22_road_comparison", lambda t: r(reports.entity_comparison(t.lite.where("weather_condition = 'Rain'"))), _COMPARE.replace("FROM lite", "FROM lite WHERE weather_condition = 'Rain'"), _COMPARE_NAMES)
add("a23_visibility_bands", lambda t: r(reports.visibility_bands(t.lite)), """SELECT CASE WHEN visibility <= 1000 THEN '0-1000' WHEN visibility <= 2000 THEN '1000-2000' WHEN visibility <= 4000 THEN '2000-4000' ELSE '4000-10000' END AS band,
    avg(avg_speed) AS mean_speed, avg(traffic_volume) AS mean_volume, avg((coalesce(accident_count, 0) > 0)::INT) * 100 AS incident_pct, count(*) AS n FROM lite WHERE visibility > 0 AND visibility <= 10000 GROUP BY 1""", "mean_speed mean_volume incident_pct")  # fmt: skip
add("a24_corridor", lambda t: r(reports.corridor(reports.latest(t.decoded))), """SELECT sum(pred_y_volume) AS volume, avg(pred_y_volume) AS mean_volume, count(*) FILTER (pred_congestion IN ('Heavy', 'Severe')) AS congested,
    avg(pred_y_travel_time) AS mean_travel_time, sum(pred_y_travel_time) AS travel_time FROM decoded WHERE timestamp = (SELECT max(timestamp) FROM decoded)""", "volume mean_volume mean_travel_time travel_time")  # fmt: skip
add("a25_worst_class", lambda t: reports.worst_class(reports.latest(t.decoded), "pred_congestion"), "SELECT list_extract(['Free-flow', 'Moderate', 'Heavy', 'Severe'], (max(pred_congestion_code) + 1)::INT) AS worst FROM decoded WHERE timestamp = (SELECT max(timestamp) FROM decoded)")
add("a26_export_summary", lambda t: reports.export_summary(t.decoded, "2024-01-05", "2024-01-20"), _EXPORT)


def _scoreboard(t: Tables) -> DataFrame:
    return scoreboard(t.spark, t.traffic, t.valid_weather, t.calendar)[1]


add("a27_quality_scoreboard", lambda t: r(_scoreboard(t)), f"""SELECT 'ingest' AS section, unnest(['raw', 'valid', 'rejected', 'entities']) AS metric, unnest([count(*), count(*) FILTER (_reject_reason = ''), count(*) FILTER (_reject_reason <> ''), count(DISTINCT road_id) FILTER (_reject_reason = '')])::DOUBLE AS value FROM tagged
    UNION ALL SELECT 'clean', 'exact_duplicates', (SELECT count(*) FROM traffic) - (SELECT count(*) FROM (SELECT DISTINCT * FROM traffic))
    UNION ALL SELECT 'clean', unnest(['expected', 'absent', 'absent_pct']), unnest([e::DOUBLE, e - h, round((e - h) / e * 100, 6)]) FROM (SELECT (SELECT count(*) FROM grid) AS e, (SELECT count(*) FROM deduped) AS h)
    UNION ALL SELECT 'weather', 'match_rate', avg((weather_condition IS NOT NULL)::INT) FROM lite
    UNION ALL SELECT 'congestion', unnest(['blank', 'agreement']), unnest([count(*) FILTER (congestion_level IS NULL), avg(coalesce({band(VC)} = congestion_level, false)::INT) FILTER (congestion_level IS NOT NULL)]) FROM grid
    UNION ALL SELECT 'mix', unnest(['parse_failures', 'null_texts']), unnest([count(*) FILTER (vehicle_type_dist = 'broken'), count(*) FILTER (vehicle_type_dist IS NULL)]) FROM deduped""", "value")  # fmt: skip
add("a28_grid_completeness", lambda t: clean.grid_completeness(t.deduped), "SELECT e AS expected, e - h AS absent, round((e - h) / e * 100, 6) AS absent_pct FROM (SELECT (SELECT count(*) FROM grid) AS e, (SELECT count(*) FROM deduped) AS h)")
add("a29_residual_medians", lambda t: r(features.fill_medians(t.lite.select("road_id", "timestamp", "temperature", "visibility"), ["temperature", "visibility"])),
    "SELECT road_id, timestamp, coalesce(temperature, (SELECT median(temperature) FROM lite)) AS temperature, coalesce(visibility, (SELECT median(visibility) FROM lite)) AS visibility FROM lite", "temperature visibility")

# ---- windows
add("w1_dedup", lambda t: t.deduped.select("road_id", "timestamp", "traffic_volume", "travel_time", "congestion_level"), "SELECT road_id, timestamp, traffic_volume, travel_time, congestion_level FROM deduped")
add("w2_outliers", lambda t: clean.null_outliers(t.grid, CHANNELS, 2.5).select("road_id", "timestamp", *CHANNELS), "SELECT road_id, timestamp, " + ", ".join(
    f"CASE WHEN coalesce(abs(({x} - avg({x}) OVER w) / nullif(stddev_samp({x}) OVER w, 0)) <= 2.5, true) THEN {x} END AS {x}" for x in CHANNELS) + " FROM grid WINDOW w AS (PARTITION BY road_id)")
_GAPS = """SELECT *, max(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY {k} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bi, min(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY {k} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai
    FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY timestamp) AS i FROM {t})"""
_LINE = "WITH g AS ({gaps}) SELECT g.{k}, g.timestamp, coalesce(g.{x}, CASE WHEN {rule} THEN b.{x} + (a.{x} - b.{x}) * (g.i - g.bi) / nullif(g.ai - g.bi, 0) END{edges}) AS {x} FROM g LEFT JOIN g b ON b.{k} = g.{k} AND b.i = g.bi LEFT JOIN g a ON a.{k} = g.{k} AND a.i = g.ai"
_TRAFFIC_GAPS = dict(gaps=_GAPS.format(x="traffic_volume", k="road_id", t="grid"), x="traffic_volume", k="road_id", edges="")
add("w3_interpolate_prefix", lambda t: r(clean.interpolate(t.grid, ["traffic_volume"], ["road_id"], limit=2).select("road_id", "timestamp", "traffic_volume")), f"SELECT * FROM ({_LINE.format(rule='g.i - g.bi <= 2', **_TRAFFIC_GAPS)})", "traffic_volume")
add("w3_interpolate_whole_gap", lambda t: r(clean.interpolate(t.grid, ["traffic_volume"], ["road_id"], limit=2, mode="whole_gap").select("road_id", "timestamp", "traffic_volume")),
    f"SELECT * FROM ({_LINE.format(rule='g.ai - g.bi - 1 <= 2', **_TRAFFIC_GAPS)})", "traffic_volume")
add("w4_interpolate_both", lambda t: r(clean.interpolate(t.valid_weather, ["temperature"], ["station_id"], limit=None, edges=True).select("station_id", "timestamp", "temperature")),
    f"SELECT * FROM ({_LINE.format(gaps=_GAPS.format(x='temperature', k='station_id', t='valid_weather'), rule='true', x='temperature', k='station_id', edges=', b.temperature, a.temperature')})", "temperature")
_LAGS = [f"{x}_lag{k}" for x in [*CHANNELS, "vc_ratio"] for k in (1, 2, 3, 4, 48, 336)]
add("w5_lags", lambda t: r(t.features.select("road_id", "timestamp", *_LAGS)), f"SELECT road_id, timestamp, {', '.join(_LAGS)} FROM features", " ".join(x for x in _LAGS if x.startswith("vc")))
_DELTAS = ["volume_delta_1", "volume_delta_2", "speed_delta_1", "volume_dod_change"]
add("w6_differences", lambda t: t.features.select("road_id", "timestamp", *_DELTAS), f"SELECT road_id, timestamp, {', '.join(_DELTAS)} FROM features")
_MEANS, _STDS = ([f"{x}_roll{k}{w}" for x in ("traffic_volume", "avg_speed") for w in (4, 8, 48)] for k in ("mean", "std"))
add("w7_rolling_means", lambda t: r(t.features.select("road_id", "timestamp", *_MEANS)), f"SELECT road_id, timestamp, {', '.join(_MEANS)} FROM features", " ".join(_MEANS))
add("w8_rolling_deviations", lambda t: r(t.features.select("road_id", "timestamp", *_STDS)), f"SELECT road_id, timestamp, {', '.join(_STDS)} FROM features", " ".join(_STDS))
add("w9_deviation_from_mean", lambda t: r(t.features.select("road_id", "timestamp", "volume_vs_roll8", "speed_vs_roll8")), "SELECT road_id, timestamp, volume_vs_roll8, speed_vs_roll8 FROM features", "volume_vs_roll8 speed_vs_roll8")
add("w10_rain_3h", lambda t: r(t.features.select("road_id", "timestamp", "rain_3h")), "SELECT road_id, timestamp, rain_3h FROM features", "rain_3h")
_WX = ["temperature_lag1", "rainfall_lag1", "visibility_lag1", "weather_condition_lag1"]
add("w11_lagged_weather", lambda t: t.features.select("road_id", "timestamp", *_WX), f"SELECT road_id, timestamp, {', '.join(_WX)} FROM features")
add("w12_lagged_class", lambda t: t.features.select("road_id", "timestamp", "congestion_lag1_ord", "congestion_lag48_ord"), "SELECT road_id, timestamp, congestion_lag1_ord, congestion_lag48_ord FROM features")
add("w13_entity_code", lambda t: features.entity_code(t.deduped.select("road_id")).distinct(), "SELECT road_id, (dense_rank() OVER (ORDER BY road_id) - 1)::INT AS road_code FROM master")
add("w14_sequences", lambda t: features.in_parts(t.lite.fillna(0.0, CHANNELS), lambda df, order: features.sequences(df, CHANNELS, order=order), halo=12).select("road_id", "timestamp", F.size("window").alias("n"), F.col("window")[0]["traffic_volume"].alias("oldest"), F.col("window")[11]["traffic_volume"].alias("newest"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x["avg_speed"]).alias("speed_sum")),
    """SELECT road_id, timestamp, 12 AS n, oldest, newest, speed_sum FROM (SELECT road_id, timestamp, count(*) OVER w AS c, first_value(coalesce(traffic_volume, 0)) OVER w AS oldest, last_value(coalesce(traffic_volume, 0)) OVER w AS newest, sum(coalesce(avg_speed, 0)) OVER w AS speed_sum
    FROM lite WINDOW w AS (PARTITION BY road_id ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE c = 12""")  # fmt: skip
add("w15_persistence", lambda t: t.features.select("road_id", "timestamp", F.col("traffic_volume_lag1").alias("volume"), F.col("avg_speed_lag1").alias("speed"), F.greatest("congestion_lag1_ord", F.lit(0)).alias("class")),
    "SELECT road_id, timestamp, traffic_volume_lag1 AS volume, avg_speed_lag1 AS speed, greatest(congestion_lag1_ord, 0) AS class FROM features")
_CONF = "(SELECT unnest([0, 1, 2, 3]) AS actual) a, (SELECT unnest([0, 1, 2, 3]) AS predicted) p"
_CONFUSION = f"SELECT actual, predicted, (SELECT count(*) FROM predictions WHERE y_congestion_code = actual AND pred_congestion_code = predicted) AS n FROM {_CONF}"


def _confusion(t: Tables) -> DataFrame:
    return metrics.confusion(t.predictions, "y_congestion_code", "pred_congestion_code", [0, 1, 2, 3]).withColumns({k: F.col(k).cast("int") for k in ("actual", "predicted")})


add("w16_row_shares", lambda t: r(metrics.row_shares(_confusion(t))), f"SELECT *, n / greatest(sum(n) OVER (PARTITION BY actual), 1) AS share FROM ({_CONFUSION})", "share")

# ---- order, limits, samples
add("o1_ordered_within", lambda t: t.grid.repartition("road_id").sortWithinPartitions("road_id", "timestamp").select("road_id", "timestamp", "traffic_volume"), "SELECT road_id, timestamp, traffic_volume FROM grid")
add("o2_risk_watchlist", lambda t: reports.risk_list(t.predictions, 10).select("road_id", "timestamp", "pred_accident_prob"), "SELECT road_id, timestamp, pred_accident_prob FROM predictions ORDER BY round(pred_accident_prob, 9) DESC, road_id, timestamp LIMIT 10")
add("o3_top_risk_lift", lambda t: r(reports.top_risk_lift(t.predictions)), "SELECT road_id, pred_accident_prob AS risk, pred_accident_prob / nullif((SELECT avg(y_accident) FROM predictions), 0) AS lift FROM predictions ORDER BY round(pred_accident_prob, 9) DESC, road_id, timestamp LIMIT 1", "lift")
add("o4_top_correlated", lambda t: r(reports.strongest(reports.correlations(t.features, _CORR, "y_speed"), 5)), f"SELECT * FROM ({_CORR_SQL}) WHERE correlation IS NOT NULL AND NOT isnan(correlation) ORDER BY round(abs(correlation), 9) DESC, feature LIMIT 5", "correlation")
add("o5_rerank", lambda t: r(reports.ranked(reports.entity_comparison(t.lite), "mean_speed", "road_id").select("rank", "road_id", "mean_speed")), f"SELECT (row_number() OVER (ORDER BY round(mean_speed, 9) DESC NULLS LAST, road_id))::INT AS rank, road_id, mean_speed FROM ({_COMPARE})", "mean_speed")
add("o6_stable_sample", lambda t: reports.stable_sample(t.predictions, ["road_id", "timestamp"], 4000).select("road_id", "timestamp", "y_volume"),
    "SELECT road_id, timestamp, y_volume FROM predictions ORDER BY md5(road_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|42'), road_id, timestamp LIMIT 4000")
add("o7_most_recent", lambda t: reports.most_recent(t.predictions, 500).select("road_id", "timestamp", "y_volume"), "SELECT road_id, timestamp, y_volume FROM predictions ORDER BY timestamp DESC, road_id LIMIT 500")
add("u2_half_hourly", lambda t: t.half_hourly, "SELECT * FROM half_hourly")

# ---- scalar functions
add("f1_vocabulary", lambda t: t.weather.select("station_id", "date", "time", c.condition_of(F.col("weather_condition")).alias("label")), f"SELECT station_id, date, time, {condition('weather_condition')} AS label FROM weather")
add("f2_slots", lambda t: t.grid.select("road_id", "timestamp", "tod", "dow"), "SELECT road_id, timestamp, tod, dow FROM grid")
add("f3_floor_hour", lambda t: t.deduped.select("road_id", "timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour"), (F.col("timestamp") + F.expr("interval 30 minutes")).alias("next")), "SELECT road_id, timestamp, date_trunc('hour', timestamp)::TIMESTAMP AS hour, timestamp + INTERVAL 30 MINUTE AS next FROM deduped")
add("f4_local_date", lambda t: t.deduped.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n")), "SELECT timestamp::DATE AS day, count(*) AS n FROM deduped GROUP BY 1")
add("f4_local_date_of_instant", lambda t: t.deduped.groupBy(F.to_date("timestamp").alias("utc_day"), F.to_date(c.local_time(F.col("timestamp"), DEFAULT.timezone)).alias("day")).agg(F.count("*").alias("n")),
    "SELECT timestamp::DATE AS utc_day, (timestamp + INTERVAL '5 hours 30 minutes')::DATE AS day, count(*) AS n FROM deduped GROUP BY 1, 2")
add("f5_vc_ratio", lambda t: r(t.lite.select("road_id", "timestamp", "vc_ratio")), "SELECT road_id, timestamp, vc_ratio FROM lite", "vc_ratio")
add("f6_congestion_bands", lambda t: t.lite.select("road_id", "timestamp", "congestion_level", "congestion_derived"), "SELECT road_id, timestamp, congestion_level, congestion_derived FROM lite")
_MIX = ", ".join(f"CASE WHEN vehicle_type_dist <> 'broken' THEN json_extract_string(vehicle_type_dist, '$.\"{k}\"')::DOUBLE END AS {x}" for k, x in enrich.MIX.items())
add("f7_vehicle_mix", lambda t: r(enrich.vehicle_mix(t.deduped).select("road_id", "timestamp", *enrich.MIX.values())),
    f"WITH m AS (SELECT road_id, timestamp, {_MIX} FROM deduped) SELECT road_id, timestamp, " + ", ".join(f"round(coalesce({x}, (SELECT median({x}) FROM m)), 6) AS {x}" for x in enrich.MIX.values()) + " FROM m")
add("f7_mix_failures", lambda t: enrich.mix_failures(t.deduped), "SELECT count(*) FILTER (vehicle_type_dist = 'broken') AS parse_failures, count(*) FILTER (vehicle_type_dist IS NULL) AS null_texts FROM deduped")
add("f8_travel_time", lambda t: r(clean.fill_travel_time(t.lite).select("road_id", "timestamp", "travel_time")), """SELECT l.road_id, timestamp, coalesce(travel_time, s / nullif(avg_speed, 0) * 60) AS travel_time FROM lite l
    JOIN (SELECT road_id, median(CASE WHEN avg_speed > 0 THEN travel_time * avg_speed / 60 END) AS s FROM lite GROUP BY 1) m ON m.road_id = l.road_id""", "travel_time")  # fmt: skip
add("f9_constant_fills", lambda t: t.lite.fillna(0.0, ["accident_count", "rainfall"]).select("road_id", "timestamp", "accident_count", "rainfall", "event_flag", "event_name"), "SELECT road_id, timestamp, coalesce(accident_count, 0) AS accident_count, coalesce(rainfall, 0) AS rainfall, event_flag, event_name FROM lite")
_CLOCK = ["hour", "minute_of_day", "day_of_week", "day_of_month", "month", "week_of_year"]
add("f10_clock", lambda t: features.clock(t.lite).select("road_id", "timestamp", *_CLOCK), f"SELECT road_id, timestamp, {', '.join(_CLOCK)} FROM clocked")
add("f11_cyclic", lambda t: r(features.clock(t.lite).select("road_id", "timestamp", "hour_sin", "hour_cos", "dow_sin", "dow_cos")), "SELECT road_id, timestamp, hour_sin, hour_cos, dow_sin, dow_cos FROM clocked", "hour_sin hour_cos dow_sin dow_cos")
_FLAGS = ["is_weekend", "is_am_peak", "is_pm_peak", "is_peak", "is_night"]
add("f12_time_flags", lambda t: t.features.select("road_id", "timestamp", *_FLAGS), f"SELECT road_id, timestamp, {', '.join(_FLAGS)} FROM features")
add("f13_interactions", lambda t: t.features.select("road_id", "timestamp", "holiday_x_peak", "event_x_peak", "roadwork_x_peak", "rain_x_peak"), "SELECT road_id, timestamp, holiday_x_peak, event_x_peak, roadwork_x_peak, rain_x_peak FROM features")
_CAP = ["capacity_30min", "vc_lag1", "headroom_lag1", "signal_capacity_ratio"]
add("f14_capacity", lambda t: r(t.features.select("road_id", "timestamp", *_CAP)), f"SELECT road_id, timestamp, {', '.join(_CAP)} FROM features", " ".join(_CAP))
add("f15_weather_flags", lambda t: t.features.select("road_id", "timestamp", "rain_flag", "heavy_rain_flag", "low_visibility_flag"), "SELECT road_id, timestamp, rain_flag, heavy_rain_flag, low_visibility_flag FROM features")
add("f16_temperature_bands", lambda t: t.features.select("road_id", "timestamp", "temp_band"), "SELECT road_id, timestamp, temp_band FROM features")
add("f17_one_hot", lambda t: features.one_hot(features.one_hot(t.features.select("road_id", "timestamp", "weather_condition_lag1", "temp_band"), "weather_condition_lag1", CONDITIONS), "temp_band", TEMPERATURE_BANDS).drop("weather_condition_lag1", "temp_band"),
    "SELECT road_id, timestamp, " + ", ".join(f"coalesce({x} = '{y}', false)::INT AS {x}_{y}" for x, ys in (("weather_condition_lag1", CONDITIONS), ("temp_band", TEMPERATURE_BANDS)) for y in ys) + " FROM features")
add("f18_ordinals", lambda t: t.lite.select("road_id", "timestamp", c.ordinal(F.col("congestion_level")).alias("code")).withColumn("label", c.label_of(F.col("code"))), f"SELECT road_id, timestamp, {code('congestion_level')} AS code, congestion_level AS label FROM lite")
add("f19_targets", lambda t: features.targets(t.lite).select("road_id", "timestamp", "y_volume", "y_speed", "y_travel_time", "y_congestion", "y_congestion_code", "y_accident"), "SELECT road_id, timestamp, y_volume, y_speed, y_travel_time, y_congestion, y_congestion_code, y_accident FROM features")
add("f20_errors", lambda t: r(t.predictions.select("road_id", "timestamp", (F.col("pred_y_volume") - F.col("y_volume")).alias("residual"), F.abs(F.col("pred_y_volume") - F.col("y_volume")).alias("abs_error"))), "SELECT road_id, timestamp, pred_y_volume - y_volume AS residual, abs(pred_y_volume - y_volume) AS abs_error FROM predictions", "residual abs_error")
_CONFIDENCE = "CASE WHEN rel <= 0.25 THEN 'High' WHEN rel <= 0.55 THEN 'Medium' ELSE 'Low' END"
add("f21_confidence", lambda t: t.intervals.where("volume_p90 IS NOT NULL").select("road_id", "timestamp", c.confidence(F.col("volume_p10"), F.col("volume_p90"), F.col("pred_y_volume")).alias("confidence")),
    f"SELECT road_id, timestamp, {_CONFIDENCE} AS confidence FROM (SELECT *, (volume_p90 - volume_p10) / greatest(pred_y_volume, 1) AS rel FROM intervals) WHERE volume_p90 IS NOT NULL")
add("f22_sorted_quantiles", lambda t: r(t.predictions.select("road_id", "timestamp", F.array_sort(F.array("pred_y_volume", "y_volume", "pred_y_travel_time")).alias("q")).select("road_id", "timestamp", F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"))),
    "SELECT road_id, timestamp, q[1] AS lo, q[2] AS mid, q[3] AS hi FROM (SELECT road_id, timestamp, list_sort([pred_y_volume, y_volume, pred_y_travel_time], 'ASC', 'NULLS LAST') AS q FROM predictions)", "lo mid hi")
add("f23_condition_label", lambda t: models.with_condition(t.predictions).select("road_id", "timestamp", "condition"), "SELECT road_id, timestamp, condition FROM conditioned")
add("f24_logistic", lambda t: r(t.predictions.select("road_id", "timestamp", c.logistic(F.col("y_volume") / 100 - 1).alias("p"))), "SELECT road_id, timestamp, 1 / (1 + exp(-(y_volume / 100 - 1))) AS p FROM predictions", "p")
_REG = """sqrt(avg(pow({p} - {y}, 2))) AS rmse, avg(abs({p} - {y})) AS mae, avg(CASE WHEN abs({y}) > 1e-6 THEN abs(({p} - {y}) / {y}) END) * 100 AS mape, 1 - sum(pow({p} - {y}, 2)) / nullif(var_pop({y}) * count(*), 0) AS r2, count(*) AS n"""
_E1 = _REG.format(p="pred_y_volume", y="y_volume")
_COVER = "SELECT avg((y_volume BETWEEN volume_p10 AND volume_p90)::INT) AS coverage, avg(volume_p90 - volume_p10) AS mean_width, median(volume_p90 - volume_p10) AS median_width, avg(volume_p90 - volume_p10) / nullif(avg(y_volume), 0) * 100 AS width_pct_of_mean FROM intervals WHERE volume_p90 - volume_p10 IS NOT NULL"
add("f25_verdict", lambda t: metrics.coverage(t.intervals, "y_volume", "volume_p10", "volume_p90").select((F.abs(F.round("coverage", 6) - 0.8) <= 0.06).alias("on_target")), f"SELECT abs(round(coverage, 6) - 0.8) <= 0.06 AS on_target FROM ({_COVER})")


def _tidy(t: Tables) -> DataFrame:
    """(target, model, metric, value): persistence, the rolling mean and the training mean as volume models."""
    train = t.split.where("split = 'train'").agg(F.avg("y_volume").alias("mean"))
    test = t.split.where("split = 'test'").crossJoin(F.broadcast(train))  # one row
    rows = test.select("y_volume", F.expr("stack(3, 'persistence', coalesce(traffic_volume_lag1, pred_y_volume), 'rolling', pred_y_volume, 'mean', mean) AS (model, p)"))
    return metrics.regression(rows, "y_volume", "p", ["model"]).select(F.lit("volume").alias("target"), "model", F.expr(s.stacked(["rmse", "mae", "r2"])))


_TIDY = "WITH x AS (SELECT *, coalesce(traffic_volume_lag1, pred_y_volume) AS l1, (SELECT avg(y_volume) FROM split WHERE split = 'train') AS mean FROM split WHERE split = 'test') " + " UNION ALL ".join(
    f"SELECT 'volume' AS target, '{m}' AS model, unnest(['rmse', 'mae', 'r2']) AS metric, unnest([rmse, mae, r2]) AS value FROM (SELECT {_REG.format(p=p, y='y_volume')} FROM x)" for m, p in (("persistence", "l1"), ("rolling", "pred_y_volume"), ("mean", "mean")))
add("f26_relative_gain", lambda t: r(_tidy(t).where("metric = 'rmse'").groupBy("target").agg((100 * (1 - F.max(F.when(F.col("model") == "rolling", F.col("value"))) / F.max(F.when(F.col("model") == "mean", F.col("value"))))).alias("gain_pct"))),
    f"SELECT target, 100 * (1 - max(value) FILTER (model = 'rolling') / max(value) FILTER (model = 'mean')) AS gain_pct FROM ({_TIDY}) WHERE metric = 'rmse' GROUP BY 1", "gain_pct")

# ---- evaluation
add("e1_regression", lambda t: r(metrics.regression(t.predictions, "y_volume", "pred_y_volume")), f"SELECT {_E1} FROM predictions", "rmse mae mape r2")
add("e2_confusion", _confusion, _CONFUSION)
_PER = f"""SELECT label, support, hits, given, coalesce(hits / nullif(given, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(given + support, 0), 0) AS f1 FROM (
    SELECT l.label, (SELECT sum(n) FROM c WHERE actual = l.label)::BIGINT AS support, (SELECT sum(n) FROM c WHERE actual = l.label AND predicted = l.label)::BIGINT AS hits, (SELECT sum(n) FROM c WHERE predicted = l.label)::BIGINT AS given FROM (SELECT unnest([0, 1, 2, 3]) AS label) l)"""
add("e3_per_class", lambda t: r(metrics.per_class(_confusion(t))), f"WITH c AS ({_CONFUSION}) SELECT label, support, hits, given, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_PER})")
add("e4_class_summary", lambda t: r(metrics.class_summary(metrics.per_class(_confusion(t)))), f"""WITH c AS ({_CONFUSION}) SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
    round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall FROM ({_PER}) WHERE support > 0 OR given > 0""")  # fmt: skip
_SCORES = "SELECT pred_accident_prob AS s, count(*) FILTER (y_accident = 1) AS tp, count(*) FILTER (y_accident <> 1) AS fp FROM predictions GROUP BY 1"
_RUN = f"SELECT *, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(fp) OVER (ORDER BY s DESC) AS cfp FROM ({_SCORES})"
add("e5_roc_auc", lambda t: r(metrics.ranking_quality(t.predictions, "y_accident", "pred_accident_prob").select("roc_auc")), f"SELECT sum(fp * (ctp - tp) + 0.5 * fp * tp) / (sum(tp)::DOUBLE * sum(fp)) AS roc_auc FROM ({_RUN})", "roc_auc")
add("e6_average_precision", lambda t: r(metrics.ranking_quality(t.predictions, "y_accident", "pred_accident_prob").select("average_precision")), f"SELECT sum(tp * ctp / (ctp + cfp)) / sum(tp) AS average_precision FROM ({_RUN})", "average_precision")
_AT = "SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / n AS flagged_rate FROM (SELECT count(*) FILTER (g AND y) AS tp, count(*) FILTER (g AND NOT y) AS fp, count(*) FILTER (NOT g AND y) AS fn, count(*) AS n FROM (SELECT pred_accident_prob >= 0.4 AS g, y_accident = 1 AS y FROM predictions))"
add("e7_at_threshold", lambda t: r(metrics.at_threshold(t.predictions, "y_accident", "pred_accident_prob", 0.4)), _AT, "precision recall f1 flagged_rate")
add("e8_top_decile", lambda t: r(metrics.top_share_lift(t.predictions, "y_accident", "pred_accident_prob", ["road_id", "timestamp"])), """SELECT k, avg(y_accident) AS top_rate, avg(y_accident) / nullif(any_value(base), 0) AS lift FROM (SELECT *, row_number() OVER (ORDER BY pred_accident_prob DESC, road_id, timestamp) AS i FROM predictions),
    (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT AS k, avg(y_accident) AS base FROM predictions) WHERE i <= k GROUP BY k""", "top_rate lift")  # fmt: skip
_STEPS = ", ".join(repr(0.5 + (0.999 - 0.5) * i / 119) for i in range(120))
add("e9_best_threshold", lambda t: r(metrics.best_threshold(t.predictions, "y_accident", "pred_accident_prob")), f"""WITH q AS (SELECT unnest(quantile_cont(pred_accident_prob, [{_STEPS}])) AS threshold, unnest(range(120)) AS i FROM predictions)
    SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (SELECT threshold, i, coalesce(2 * count(*) FILTER (y_accident = 1) / nullif(count(*) + (SELECT sum(y_accident) FROM predictions), 0), 0) AS f1
    FROM q JOIN predictions ON pred_accident_prob >= threshold GROUP BY ALL) ORDER BY f1 DESC, i LIMIT 1""")  # fmt: skip
_BREAK = "sqrt(avg(pow(pred_y_volume - y_volume, 2))) AS rmse, avg(abs(pred_y_volume - y_volume)) AS mae, avg(pred_y_volume - y_volume) AS bias, count(*) AS n FROM predictions"
add("e10_breakdown", lambda t: r(metrics.breakdown(t.predictions, "y_volume", "pred_y_volume", ["road_id"])), f"SELECT road_id, {_BREAK} GROUP BY 1", "rmse mae bias")
add("e10_breakdown_by_hour", lambda t: r(metrics.breakdown(t.predictions, "y_volume", "pred_y_volume", ["hour"])), f"SELECT hour, {_BREAK} GROUP BY 1", "rmse mae bias")
add("e11_scoreboard", lambda t: r(metrics.scoreboard(_tidy(t), ["rmse", "mae", "r2"])), f"SELECT target, model, max(value) FILTER (metric = 'rmse') AS rmse, max(value) FILTER (metric = 'mae') AS mae, max(value) FILTER (metric = 'r2') AS r2 FROM ({_TIDY}) GROUP BY ALL", "rmse mae r2")
add("e12_coverage", lambda t: r(metrics.coverage(t.intervals, "y_volume", "volume_p10", "volume_p90")), _COVER, "coverage mean_width median_width width_pct_of_mean")
add("e13_width_by_condition", lambda t: r(t.intervals.where("volume_p90 IS NOT NULL").groupBy("condition").agg(F.avg(F.col("volume_p90") - F.col("volume_p10")).alias("mean_width"), F.count("*").alias("n"))), "SELECT condition, avg(volume_p90 - volume_p10) AS mean_width, count(*) AS n FROM intervals WHERE volume_p90 IS NOT NULL GROUP BY 1", "mean_width")
add("e14_calibration", lambda t: r(metrics.calibration(t.predictions.withColumn("half", F.col("pred_accident_prob") / 2), "y_accident", "pred_accident_prob", "half")), "SELECT avg(pow(pred_accident_prob - y_accident, 2)) AS brier_raw, avg(pow(pred_accident_prob / 2 - y_accident, 2)) AS brier_calibrated, avg(pred_accident_prob / 2) AS mean_predicted, avg(y_accident) AS observed FROM predictions", "brier_raw brier_calibrated mean_predicted observed")
add("e15_width_vs_error", lambda t: r(metrics.line_fit(t.intervals.select((F.col("volume_p90") - F.col("volume_p10")).alias("w"), F.abs(F.col("pred_y_volume") - F.col("y_volume")).alias("e")), "w", "e")), "SELECT regr_slope(e, w) AS slope, regr_intercept(e, w) AS intercept, corr(e, w) AS r FROM (SELECT volume_p90 - volume_p10 AS w, abs(pred_y_volume - y_volume) AS e FROM intervals)", "slope intercept r")
add("e16_residual_summary", lambda t: r(metrics.breakdown(t.split.where("split = 'test'"), "y_volume", "pred_y_volume", ["road_id"])), f"SELECT road_id, {_BREAK.replace('predictions', 'split')} WHERE split = 'test' GROUP BY 1", "rmse mae bias")
add("e17_winners", lambda t: r(metrics.winners(_tidy(t), {"volume": ("rmse", "min")})), f"SELECT target, model, metric, value FROM ({_TIDY}) WHERE metric = 'rmse' ORDER BY value, model LIMIT 1", "value")
add("e18_model_comparison", lambda t: r(_tidy(t).where("model IN ('persistence', 'rolling')").groupBy("target", "metric").pivot("model", ["persistence", "rolling"]).agg(F.first("value"))),
    f"SELECT target, metric, max(value) FILTER (model = 'persistence') AS persistence, max(value) FILTER (model = 'rolling') AS rolling FROM ({_TIDY}) WHERE model IN ('persistence', 'rolling') GROUP BY ALL", "persistence rolling")

# ---- models: fitted on the full feature table, with the settings of models.REGRESSORS and CLASSIFIERS


def _regressed(t: Tables, name: str) -> DataFrame:
    rows, xs = t.design
    model = models.fitted(rows.where("split = 'train'"), xs, "y_volume", models.REGRESSORS[name](), name == "linear")
    return r(metrics.regression(models.predicted(model, rows.where("split = 'test'"), "p"), "y_volume", "p"), 3)


def _classified(t: Tables, label: str, name: str, classes: int) -> DataFrame:
    rows, xs = t.design
    rows = rows.where(f"{label} >= 0")
    train = models.with_weights(rows.where("split = 'train'"), label)
    model = models.fitted(train, xs, label, models.CLASSIFIERS[name](), name in ("logistic", "svm"), classes)
    scored = models.predicted(model, rows.where("split = 'test'"), "p").select(F.col(label).cast("int").alias("y"), F.col("p").cast("int").alias("p"))
    return r(metrics.class_summary(metrics.per_class(metrics.confusion(scored, "y", "p", list(range(classes))))), 3)


def _risk(t: Tables) -> DataFrame:
    rows, xs = t.design
    model = models.fitted(models.with_weights(rows.where("split = 'train'"), "y_accident"), xs, "y_accident", models.CLASSIFIERS["logistic"](), True)
    return models.risk(model, rows.where("split <> 'train'"), "risk")


add("m1_scaler", lambda t: r(models.scaled(t.split.select("road_id", "timestamp", "split", "y_volume"), ["y_volume"])), "SELECT road_id, timestamp, split, coalesce((y_volume - m) / nullif(s, 0), 0) AS y_volume FROM split, (SELECT avg(y_volume) AS m, stddev_pop(y_volume) AS s FROM split WHERE split = 'train')", "y_volume")
add("m2_baselines", lambda t: r(models.baselines(t.split, "y_volume", "y_congestion_code").select("road_id", "timestamp", "mean_forecast", "majority")), """SELECT road_id, timestamp, (SELECT avg(y_volume) FROM split WHERE split = 'train') AS mean_forecast,
    (SELECT y_congestion_code FROM split WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS majority FROM split WHERE split <> 'train'""", "mean_forecast")  # fmt: skip
add("m3_linear_regression", lambda t: _regressed(t, "linear"))


def _coefficients(t: Tables) -> DataFrame:
    rows, xs = t.design
    return r(models.coefficients(models.fitted(rows.where("split = 'train'"), xs, "y_volume", models.REGRESSORS["linear"](), True), xs, rows), 3)


add("m4_coefficients", _coefficients)
add("m5_logistic_binary", lambda t: _classified(t, "y_accident", "logistic", 2))
add("m5_logistic_multinomial", lambda t: _classified(t, "y_congestion_code", "logistic", 4))
add("m6_tree_regressor", lambda t: _regressed(t, "tree"))
add("m6_tree_classifier", lambda t: _classified(t, "y_congestion_code", "tree", 4))
add("m7_forest_regressor", lambda t: _regressed(t, "forest"))
add("m7_forest_classifier", lambda t: _classified(t, "y_congestion_code", "forest", 4))
add("m8_boosted_regressor", lambda t: _regressed(t, "boosted"))
add("m8_boosted_classifier", lambda t: _classified(t, "y_congestion_code", "boosted", 4))
add("m8_boosted_binary", lambda t: _classified(t, "y_accident", "boosted", 2))
add("m9_linear_svm", lambda t: _classified(t, "y_accident", "svm", 2))
add("m10_positive_weight", lambda t: r(models.positive_weight(t.split.where("split = 'train'"), "y_accident")), "SELECT count(*) FILTER (y_accident = 0) / nullif(count(*) FILTER (y_accident = 1), 0) AS weight FROM split WHERE split = 'train'", "weight")
add("m10_class_weights", lambda t: r(models.class_weights(t.split.where("split = 'train'"), "y_congestion_code")), "SELECT y_congestion_code AS label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM split WHERE split = 'train' GROUP BY 1", "weight")


def _platt(t: Tables) -> DataFrame:
    scored = _risk(t)
    middle = scored.where("split = 'val'").agg(F.median(F.unix_timestamp(F.col("timestamp").cast("timestamp"))).alias("_mid"))
    halves = scored.where("split = 'val'").crossJoin(F.broadcast(middle))
    early = halves.where("unix_timestamp(cast(timestamp AS timestamp)) <= _mid").drop("_mid")
    done, (a, b) = models.platt(early, scored.where("split = 'test'"), "risk", "y_accident", "calibrated")
    return r(metrics.calibration(done, "y_accident", "risk", "calibrated").withColumns({"a": F.lit(a), "b": F.lit(b)}), 3)


add("m11_platt", _platt)


def _forward(t: Tables) -> DataFrame:
    rows, xs = t.design
    folds = s.staged(features.forward_folds(rows.where("split = 'train'").select("timestamp", "y_volume", models.VECTOR)), wide=True)
    return r(models.forward_validation(folds, xs, "y_volume", {f"depth {d}": models.REGRESSORS["boosted"](maxDepth=d, maxIter=10) for d in (3, 5)}), 3)


add("m12_forward_validation", _forward)
add("m13_batch_scoring", lambda t: r(models.scored_frame(t.panel_scores("y_volume", "y_travel_time", "y_congestion")).groupBy("pred_congestion", "confidence").agg(
    F.count("*").alias("n"), F.avg(F.col("volume_p90") - F.col("volume_p10")).alias("mean_width"), F.avg("pred_y_travel_time").alias("mean_travel_time")), 3))
add("m13_scored_rows", lambda t: r(models.scored_frame(t.panel_scores()).select("road_id", "timestamp", "y_volume", "pred_y_volume", "volume_p10", "volume_p90", "pred_y_speed", "pred_y_travel_time", "pred_congestion", "pred_accident_prob", "confidence"), 3))
add("e11_fitted_scoreboard", lambda t: r(t.panel_models().board.groupBy("target", "model", "chosen").pivot("metric", ["rmse", "mae", "r2", "accuracy", "macro_f1", "roc_auc"]).agg(F.first("value")), 3))
add("e12_fitted_coverage", lambda t: r(metrics.coverage(t.panel_scores("y_volume"), "y_volume", "volume_p10", "volume_p90"), 3))
add("e17_fitted_winners", lambda t: r(t.panel_models().board.where("chosen").select("target", "model", "metric", "value"), 3))
add("e14_fitted_calibration", lambda t: r(metrics.calibration(t.panel_scores("y_accident"), "y_accident", "pred_accident_raw", "pred_accident_prob"), 3))
add("m16_fitted_card", lambda t: r(t.panel_models().cards, 3))
add("m14_intervals", lambda t: r(t.intervals.select("road_id", "timestamp", "volume_p10", "volume_p50", "volume_p90")), "SELECT road_id, timestamp, volume_p10, volume_p50, volume_p90 FROM intervals", "volume_p10 volume_p50 volume_p90")


def _importance(t: Tables) -> DataFrame:
    rows, xs = t.design
    return r(models.importance(models.fitted(rows.where("split = 'train'"), xs, "y_volume", models.REGRESSORS["tree"]()), xs, rows), 3)


add("m15_importance", _importance)
add("m16_model_card", lambda t: r(t.split.groupBy().agg(F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "test").alias("test_rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.lit(2).alias("n_features")).crossJoin(
    metrics.regression(t.split.where("split = 'test'"), "y_volume", "pred_y_volume"))), f"""SELECT * FROM (SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows, min(timestamp) AS first, max(timestamp) AS last, 2 AS n_features FROM split),
    (SELECT {_E1} FROM split WHERE split = 'test')""", "rmse mae mape r2")  # fmt: skip
add("m17_prediction_table", lambda t: r(t.split.where("split = 'test'").select("road_id", "timestamp", "y_volume", "pred_y_volume", "pred_accident_prob")),
    "SELECT road_id, timestamp, y_volume, pred_y_volume, pred_accident_prob FROM split WHERE split = 'test'", "pred_y_volume")
add("m18_sequence_stats", lambda t: r(models.sequence_stats(t.split, ["y_volume", "pred_y_volume"])), "SELECT avg(y_volume) AS y_volume_mean, avg(pred_y_volume) AS pred_y_volume_mean, coalesce(nullif(stddev_pop(y_volume), 0), 1) AS y_volume_sd, coalesce(nullif(stddev_pop(pred_y_volume), 0), 1) AS pred_y_volume_sd FROM split WHERE split = 'train'", "y_volume_mean pred_y_volume_mean y_volume_sd pred_y_volume_sd")


def _saved(t: Tables) -> DataFrame:
    (rows, xs), path = t.design, s.scratch(t.spark)
    models.save(models.fitted(rows.where("split = 'train'"), xs, "y_volume", models.REGRESSORS["linear"](), True), path)
    return r(metrics.regression(models.predicted(models.load(path), rows.where("split = 'test'"), "p"), "y_volume", "p"), 3)


add("m19_save_and_load", _saved)


def _ceiling(t: Tables) -> DataFrame:
    rows, xs = t.design
    out = None
    for name, columns in (("honest", xs), ("contemporaneous", [*xs, "y_speed", "y_volume"])):
        model = models.fitted(models.with_weights(rows.where("split = 'train'"), "y_accident"), columns, "y_accident", models.CLASSIFIERS["logistic"](), True)
        found = metrics.ranking_quality(models.risk(model, rows.where("split = 'test'"), "risk"), "y_accident", "risk").withColumn("features", F.lit(name))
        out = found if out is None else out.unionAll(found)
    gap = out.groupBy().pivot("features", ["honest", "contemporaneous"]).agg(F.first("roc_auc"))
    return r(gap.select("honest", "contemporaneous", (F.col("contemporaneous") - F.col("honest")).alias("gap"), (F.col("contemporaneous") - F.col("honest") < 0.05).alias("at_ceiling")), 2)


add("e19_signal_ceiling", _ceiling)
fit_queries.register(add, r)

# ---- whole chains
_FILLED = f"""WITH gated AS (SELECT road_id, timestamp, accident_count, CASE WHEN coalesce(abs((traffic_volume - avg(traffic_volume) OVER w) / nullif(stddev_samp(traffic_volume) OVER w, 0)) <= 5, true) THEN traffic_volume END AS traffic_volume FROM grid WINDOW w AS (PARTITION BY road_id)),
    lined AS MATERIALIZED (SELECT x.*, isodow(timestamp) AS dow, hour(timestamp) * 2 + minute(timestamp) // 30 AS tod FROM ({_LINE.format(rule='g.i - g.bi <= 2', gaps=_GAPS.format(x='traffic_volume', k='road_id', t='gated'), x='traffic_volume', k='road_id', edges='')}) x),
    filled AS (SELECT l.road_id, l.timestamp, coalesce(l.traffic_volume, s.m, e.m, (SELECT median(traffic_volume) FROM lined)) AS traffic_volume FROM lined l
        LEFT JOIN (SELECT road_id, dow, tod, median(traffic_volume) AS m FROM lined GROUP BY ALL) s ON s.road_id = l.road_id AND s.dow = l.dow AND s.tod = l.tod LEFT JOIN (SELECT road_id, median(traffic_volume) AS m FROM lined GROUP BY ALL) e ON e.road_id = l.road_id)"""
add("chain_cleaned", lambda t: r(cleaned(t.valid).groupBy("road_id").agg(F.count("*").alias("rows"), F.count("traffic_volume").alias("volumes"), F.avg("traffic_volume").alias("mean_volume"))),
    f"{_FILLED} SELECT road_id, count(*) AS rows, count(traffic_volume) AS volumes, avg(traffic_volume) AS mean_volume FROM filled GROUP BY 1", "mean_volume")
add("chain_dataset", lambda t: t.dataset.groupBy("road_id", "road_code").agg(F.count("*").alias("rows"), F.count("traffic_volume_lag336").alias("warm"), F.sum("y_accident").alias("incidents")),
    f"""{_FILLED}, lagged AS (SELECT f.road_id, lag(f.traffic_volume, 336) OVER (PARTITION BY f.road_id ORDER BY f.timestamp) AS old, coalesce(g.accident_count > 0, false)::INT AS y_accident FROM filled f JOIN gated g ON g.road_id = f.road_id AND g.timestamp = f.timestamp)
    SELECT road_id, (dense_rank() OVER (ORDER BY road_id) - 1)::INT AS road_code, count(*) AS rows, count(old) AS warm, sum(y_accident)::BIGINT AS incidents FROM lagged WHERE old IS NOT NULL GROUP BY 1""")  # fmt: skip
add("chunked_features", lambda t: r(features.chunked(t.lite, lambda df: df.withColumns(features.lags(["traffic_volume"], (1, 48)) | features.rolling(["traffic_volume"], (8,))), hours=72, halo=48).select(
    "road_id", "timestamp", "traffic_volume_lag1", "traffic_volume_lag48", "traffic_volume_rollmean8")), "SELECT road_id, timestamp, traffic_volume_lag1, traffic_volume_lag48, traffic_volume_rollmean8 FROM features", "traffic_volume_rollmean8")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs to the daily profile of volume: scan, validate, deduplicate, grid, interpolate, lag, roll, aggregate."""
    t = Tables.shared(spark, sf_dir)
    filled = clean.interpolate(parts.cut(t.grid, ["road_id"], "timestamp"), ["traffic_volume"], ["road_id"], limit=2)
    rows = features.in_parts(filled, lambda df, order: df.withColumns(features.lags(["traffic_volume"], (1,), order) | features.rolling(["traffic_volume"], (4,), order)), halo=4)
    kind = F.when(F.weekday("timestamp") >= 5, "weekend").otherwise("weekday")
    return r(rows.groupBy(kind.alias("kind"), "tod").agg(F.avg("traffic_volume").alias("mean"), F.avg("traffic_volume_lag1").alias("mean_lag1"), F.avg("traffic_volume_rollmean4").alias("mean_roll4")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, q=q: q(Tables.shared(spark, sf_dir))) for name, (q, _) in REGISTRY.items()}
    return found | {"flagship": flagship}


_FLAGSHIP = f"""WITH i AS (SELECT * FROM ({_LINE.format(rule='g.i - g.bi <= 2', **_TRAFFIC_GAPS)})),
    x AS (SELECT *, lag(traffic_volume, 1) OVER (PARTITION BY road_id ORDER BY timestamp) AS l1, CASE WHEN count(traffic_volume) OVER w >= 2 THEN avg(traffic_volume) OVER w END AS r4
    FROM i WINDOW w AS (PARTITION BY road_id ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
    SELECT CASE WHEN isodow(timestamp) >= 6 THEN 'weekend' ELSE 'weekday' END AS kind, (hour(timestamp) * 2 + minute(timestamp) // 30)::INT AS tod,
    avg(traffic_volume) AS mean, avg(l1) AS mean_lag1, avg(r4) AS mean_roll4 FROM x GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    found = {name: text for name, (_, text) in REGISTRY.items() if text}
    return found | {"flagship": sql(_FLAGSHIP, "mean mean_lag1 mean_roll4")}


__all__ = ["CLASSES", "REGISTRY", "flagship", "oracle_sql", "queries"]
