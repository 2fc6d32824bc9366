"""DuckDB SQL for the shared tables: one WITH list that every query's SQL stands on."""

from __future__ import annotations

from ..config import BANDS, RANGES, STATIC_COLUMNS, TRAFFIC_COLUMNS, TRAFFIC_NUMBERS, VOCABULARY


def _ranges(columns: list[str]) -> str:
    return " || ".join(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c}_out_of_range;' ELSE '' END" for c, (lo, hi) in RANGES.items() if c in columns)


def _blank(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN ('nan', '', 'None') THEN trim({c}) END AS {c}"


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM deduped d WHERE d.road_id = r.road_id AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"


VC = "traffic_volume / nullif(road_capacity / 2, 0)"


def band(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN '{name}'" for lo, hi, name in BANDS) + " END"


def code(x: str) -> str:
    return "CASE " + f"{x} " + " ".join(f"WHEN '{name}' THEN {i}" for i, (_, _, name) in enumerate(BANDS)) + " ELSE -1 END"


def condition(x: str) -> str:
    return f"CASE lower(trim({x})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VOCABULARY.items()) + " ELSE 'Unknown' END"


_TEXT = ["road_id", "road_name", "weather_station_id", "congestion_level"]
_TYPED = ", ".join([_blank(c) if c in _TEXT else f"try_cast({c} AS DOUBLE) AS {c}" if c in TRAFFIC_NUMBERS else c for c in TRAFFIC_COLUMNS])
_REST = [c for c in [*TRAFFIC_COLUMNS, "timestamp"] if c not in ("road_id", "timestamp")]
_COMPLETE = " + ".join(f"({c} IS NOT NULL)::INT" for c in [*TRAFFIC_COLUMNS, "timestamp"])
_READINGS = [c for c in TRAFFIC_COLUMNS if c not in ("road_id", *STATIC_COLUMNS)]
_CHANNELS = ["traffic_volume", "avg_speed", "occupancy", "vc_ratio"]
_W = "OVER (PARTITION BY road_id ORDER BY timestamp)"


def frame(width: int) -> str:
    return f"OVER (PARTITION BY road_id ORDER BY timestamp ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"


def rolled(c: str, w: int) -> list[str]:
    enough = f"count({c}) {frame(w)} >= {max(2, w // 2)}"
    return [f"CASE WHEN {enough} THEN avg({c}) {frame(w)} END AS {c}_rollmean{w}", f"CASE WHEN {enough} THEN stddev_samp({c}) {frame(w)} END AS {c}_rollstd{w}"]


_HISTORY = [f"lag({c}, {k}) {_W} AS {c}_lag{k}" for c in _CHANNELS for k in (1, 2, 3, 4, 48, 336)]
_HISTORY += [x for c in ("traffic_volume", "avg_speed") for w in (4, 8, 48) for x in rolled(c, w)]
_HISTORY += [f"lag({c}, 1) {_W} AS {c}_lag1" for c in ("temperature", "rainfall", "visibility", "weather_condition")]
_HISTORY += [f"sum(rainfall) {frame(6)} AS rain_3h"]
_HISTORY += [f"coalesce(lag({code('congestion_level')}, {k}) {_W}, -1) AS congestion_lag{k}_ord" for k in (1, 48)]
_HOURS = "(hour(timestamp) + minute(timestamp) / 60.0)"

PARTS: dict[str, str] = {
    "cells": """SELECT user_id // 10 AS seg, (user_id // 10) % 25 AS kind, time_bucket(INTERVAL '30 minutes', ts) AS w, min(event_id) AS eid, round(sum(value))::BIGINT AS vol,
        round(avg(value))::BIGINT AS spd, count(*) AS n, count(*) FILTER (event_type = 'error') AS err FROM events GROUP BY 1, 2, 3""",
    "raw_rows": """SELECT CASE WHEN eid % 109 = 0 THEN 'nan' ELSE ' SEG-' || lpad(seg::VARCHAR, 9, '0') END AS road_id, CASE WHEN eid % 31 = 0 THEN NULL ELSE n_name END AS road_name,
        '12.' || lpad((seg % 100)::VARCHAR, 2, '0') AS latitude, '77.' || lpad((seg % 100)::VARCHAR, 2, '0') AS longitude, 'WS-' || (seg // 5) AS weather_station_id,
        CASE WHEN eid % 107 = 0 THEN '2024-13-40' ELSE strftime(w, '%Y-%m-%d') END AS date, strftime(w, '%H:%M') AS time,
        CASE WHEN eid % 11 = 0 THEN NULL WHEN eid % 97 = 0 THEN 'junk' WHEN eid % 101 = 0 THEN '-5' ELSE vol::VARCHAR END AS traffic_volume, n::VARCHAR AS vehicle_count,
        CASE WHEN eid % 17 = 0 THEN NULL WHEN eid % 13 = 0 THEN 'broken' ELSE '{"2W": 0.' || (eid % 10) || ', "Car": 0.' || (eid % 7) || ', "LCV": 0.' || (eid % 5) || ', "HCV": 0.' || (eid % 3) || '}' END AS vehicle_type_dist,
        CASE WHEN eid % 103 = 0 THEN '999' WHEN eid % 37 = 0 THEN NULL ELSE spd::VARCHAR END AS avg_speed, CASE WHEN eid % 41 = 0 THEN NULL ELSE (n * 7)::VARCHAR END AS occupancy,
        CASE WHEN eid % 7 = 0 THEN '' WHEN eid % 29 = 0 THEN 'Heavy' WHEN vol * 2 < 0.5 * (100 + 10 * kind) THEN 'Free-flow' WHEN vol * 2 < 0.8 * (100 + 10 * kind) THEN 'Moderate'
             WHEN vol * 2 < (100 + 10 * kind) THEN 'Heavy' ELSE 'Severe' END AS congestion_level,
        CASE WHEN eid % 19 = 0 THEN NULL ELSE (1 + eid % 50)::VARCHAR END AS travel_time, CASE WHEN eid % 23 = 0 THEN NULL ELSE err::VARCHAR END AS accident_count,
        CASE WHEN eid % 27 = 0 THEN NULL ELSE (30 + eid % 60)::VARCHAR END AS signal_timing, (100 + 10 * kind)::VARCHAR AS road_capacity, eid
        FROM cells JOIN nation ON n_nationkey = kind""",
    "traffic": f"""SELECT {', '.join(TRAFFIC_COLUMNS)} FROM (SELECT * FROM raw_rows UNION ALL SELECT * FROM raw_rows WHERE eid % 50 = 0
        UNION ALL SELECT * REPLACE ('' AS congestion_level, NULL::VARCHAR AS travel_time) FROM raw_rows WHERE eid % 60 = 1)""",
    "weather_cells": "SELECT user_id // 50 AS st, time_bucket(INTERVAL '1 hour', ts) AS h, min(event_id) AS eid, round(avg(value) / 2)::BIGINT AS temp FROM events GROUP BY 1, 2",
    "weather": """SELECT 'WS-' || st AS station_id, strftime(h, '%d/%m/%Y') AS date, strftime(h, '%H:%M') AS time,
        CASE WHEN eid % 21 = 0 THEN NULL ELSE list_extract(['Clear', ' RAIN', 'rainy ', 'cloudy', 'Overcast', 'Fog', 'foggy', 'haze'], (eid % 8 + 1)::INT) END AS weather_condition,
        CASE WHEN eid % 13 = 0 THEN NULL WHEN eid % 113 = 0 THEN '99' ELSE temp::VARCHAR END AS temperature, CASE WHEN eid % 17 = 0 THEN NULL ELSE (eid % 4) || '.' || (eid % 10) END AS rainfall,
        CASE WHEN eid % 19 = 0 THEN NULL ELSE (500 + (eid % 50) * 100)::VARCHAR END AS visibility FROM weather_cells""",
    "raw_calendar": """SELECT strftime(d, '%Y-%m-%d') AS date, CASE WHEN day(d) IN (1, 26) THEN '1' WHEN day(d) = 5 THEN 'x' ELSE '0' END AS public_holiday,
        CASE WHEN day(d) IN (1, 26) THEN 'Holiday ' || day(d) END AS holiday_name, CASE WHEN day(d) % 10 = 0 THEN '1' ELSE '0' END AS event_flag,
        CASE WHEN day(d) % 10 = 0 THEN 'Fair' END AS event_name, CASE WHEN day(d) % 7 = 0 THEN '1' WHEN day(d) % 7 = 1 THEN NULL ELSE '0' END AS roadwork_flag
        FROM (SELECT DISTINCT ts::DATE AS d FROM events)""",
    "calendar": """SELECT date::DATE AS date, coalesce((try_cast(public_holiday AS DOUBLE) <> 0)::INT, 0) AS public_holiday, coalesce(holiday_name, '') AS holiday_name,
        coalesce((try_cast(event_flag AS DOUBLE) <> 0)::INT, 0) AS event_flag, coalesce(event_name, '') AS event_name, coalesce((try_cast(roadwork_flag AS DOUBLE) <> 0)::INT, 0) AS roadwork_flag FROM raw_calendar""",
    "typed": f"SELECT {_TYPED}, try_strptime(trim(date) || ' ' || trim(time), '%Y-%m-%d %H:%M') AS timestamp FROM traffic",
    "tagged": f"""SELECT *, {_ranges(TRAFFIC_COLUMNS)} || CASE WHEN timestamp IS NULL THEN 'unparseable_timestamp;' ELSE '' END
        || CASE WHEN road_id IS NULL THEN 'missing_road_id;' ELSE '' END AS _reject_reason FROM typed""",
    "typed_weather": """SELECT station_id, date, time, weather_condition, try_cast(temperature AS DOUBLE) AS temperature, try_cast(rainfall AS DOUBLE) AS rainfall,
        try_cast(visibility AS DOUBLE) AS visibility, try_strptime(trim(date) || ' ' || trim(time), '%d/%m/%Y %H:%M') AS timestamp FROM weather""",
    "tagged_weather": f"""SELECT *, {_ranges(['temperature', 'rainfall', 'visibility'])} || CASE WHEN timestamp IS NULL THEN 'unparseable_timestamp;' ELSE '' END AS _reject_reason FROM typed_weather""",
    "valid": "SELECT * EXCLUDE (_reject_reason) FROM tagged WHERE _reject_reason = ''",
    "valid_weather": "SELECT * EXCLUDE (_reject_reason) FROM tagged_weather WHERE _reject_reason = ''",
    "deduped": f"""SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY road_id, timestamp ORDER BY {_COMPLETE} DESC,
        {', '.join(f'{c} ASC NULLS LAST' for c in _REST)}) AS _n FROM valid) WHERE _n = 1""",
    "master": f"SELECT r.road_id, {', '.join(_mode(c) for c in STATIC_COLUMNS)} FROM (SELECT DISTINCT road_id FROM deduped) r",
    "steps": "SELECT unnest(generate_series(a, b, INTERVAL '30 minutes')) AS timestamp FROM (SELECT min(timestamp) AS a, max(timestamp) AS b FROM deduped)",
    "grid": f"""SELECT g.road_id, g.timestamp, {', '.join('d.' + c for c in _READINGS)}, {', '.join('m.' + c for c in STATIC_COLUMNS)},
        (hour(g.timestamp) * 2 + minute(g.timestamp) // 30)::INT AS tod, (isodow(g.timestamp) - 1)::INT AS dow
        FROM (SELECT road_id, timestamp FROM (SELECT DISTINCT road_id FROM deduped), steps) g
        LEFT JOIN deduped d ON d.road_id = g.road_id AND d.timestamp = g.timestamp LEFT JOIN master m ON m.road_id = g.road_id""",
    "half_hourly": f"""SELECT station_id, {condition('weather_condition')} AS weather_condition, temperature, rainfall, visibility, join_ts FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id, join_ts ORDER BY timestamp) AS _n FROM (
        SELECT *, unnest([date_trunc('hour', timestamp), date_trunc('hour', timestamp) + INTERVAL '30 minutes'])::TIMESTAMP AS join_ts FROM valid_weather)) WHERE _n = 1""",
    "lite": f"""SELECT g.* EXCLUDE (date, time, congestion_level), w.weather_condition, w.temperature, w.rainfall, w.visibility, coalesce(c.public_holiday, 0) AS public_holiday,
        coalesce(c.holiday_name, '') AS holiday_name, coalesce(c.event_flag, 0) AS event_flag, coalesce(c.event_name, '') AS event_name, coalesce(c.roadwork_flag, 0) AS roadwork_flag,
        {VC} AS vc_ratio, g.congestion_level IS NULL AS congestion_derived, coalesce(g.congestion_level, {band(VC)}) AS congestion_level
        FROM grid g LEFT JOIN half_hourly w ON w.station_id = g.weather_station_id AND w.join_ts = g.timestamp LEFT JOIN calendar c ON c.date = g.timestamp::DATE""",
    "clocked": f"""SELECT *, hour(timestamp)::INT AS hour, (hour(timestamp) * 60 + minute(timestamp))::INT AS minute_of_day, dow AS day_of_week, day(timestamp)::INT AS day_of_month,
        month(timestamp)::INT AS month, week(timestamp)::INT AS week_of_year, sin(2 * pi() * {_HOURS} / 24) AS hour_sin, cos(2 * pi() * {_HOURS} / 24) AS hour_cos,
        sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos, (dow >= 5)::INT AS is_weekend, ({_HOURS} >= 7 AND {_HOURS} < 10.5)::INT AS is_am_peak,
        ({_HOURS} >= 16.5 AND {_HOURS} < 20)::INT AS is_pm_peak, ({_HOURS} < 6 OR {_HOURS} >= 22)::INT AS is_night FROM lite""",
    "history": f"SELECT *, greatest(is_am_peak, is_pm_peak) AS is_peak, {', '.join(_HISTORY)} FROM clocked",
    "features": f"""SELECT *, traffic_volume AS y_volume, avg_speed AS y_speed, travel_time AS y_travel_time, congestion_level AS y_congestion, {code('congestion_level')} AS y_congestion_code,
        coalesce(accident_count > 0, false)::INT AS y_accident, public_holiday * is_peak AS holiday_x_peak, event_flag * is_peak AS event_x_peak, roadwork_flag * is_peak AS roadwork_x_peak,
        traffic_volume_lag1 - traffic_volume_lag2 AS volume_delta_1, traffic_volume_lag2 - traffic_volume_lag3 AS volume_delta_2, avg_speed_lag1 - avg_speed_lag2 AS speed_delta_1,
        traffic_volume_lag48 - traffic_volume_lag336 AS volume_dod_change, traffic_volume_lag1 - traffic_volume_rollmean8 AS volume_vs_roll8, avg_speed_lag1 - avg_speed_rollmean8 AS speed_vs_roll8,
        road_capacity / 2 AS capacity_30min, traffic_volume_lag1 / nullif(road_capacity / 2, 0) AS vc_lag1, road_capacity / 2 - traffic_volume_lag1 AS headroom_lag1,
        signal_timing / nullif(road_capacity, 0) * 1000 AS signal_capacity_ratio, coalesce(rainfall_lag1 > 0.1, false)::INT AS rain_flag, coalesce(rainfall_lag1 > 2.5, false)::INT AS heavy_rain_flag,
        coalesce(visibility_lag1 < 2000, false)::INT AS low_visibility_flag, CASE WHEN temperature_lag1 <= 10 THEN 'cold' WHEN temperature_lag1 <= 20 THEN 'mild' WHEN temperature_lag1 <= 30 THEN 'warm' WHEN temperature_lag1 > 30 THEN 'hot' END AS temp_band,
        coalesce(rainfall_lag1 > 0.1, false)::INT * is_peak AS rain_x_peak FROM history""",
    "scored": """SELECT road_id, road_name, timestamp, latitude, longitude, hour, is_peak, rain_flag, y_volume, y_speed, y_travel_time, y_congestion, y_congestion_code, y_accident,
        traffic_volume_rollmean4, signal_timing, capacity_30min, traffic_volume_lag1 FROM features WHERE y_volume IS NOT NULL AND traffic_volume_rollmean4 IS NOT NULL""",
    "bounds": """SELECT a + to_seconds(floor(s * 0.7)) AS train_end, a + to_seconds(floor(s * 0.85)) AS val_end FROM (
        SELECT min(timestamp) AS a, epoch(max(timestamp)) - epoch(min(timestamp)) AS s FROM scored)""",
    "trained": "SELECT * FROM scored, bounds WHERE timestamp <= train_end",
    "line": """SELECT regr_slope(y_volume, traffic_volume_rollmean4) AS b, regr_intercept(y_volume, traffic_volume_rollmean4) AS a,
        regr_slope(y_travel_time, signal_timing) AS tb, regr_intercept(y_travel_time, signal_timing) AS ta FROM trained""",
    "hourly": "SELECT hour, round((sum(y_accident) + 1) / (count(*) + 2), 6) AS risk FROM trained GROUP BY 1",
    "predictions": f"""SELECT s.* EXCLUDE (traffic_volume_rollmean4, signal_timing, capacity_30min, traffic_volume_lag1), a + b * traffic_volume_rollmean4 AS pred_y_volume, ta + tb * signal_timing AS pred_y_travel_time,
        greatest({code(band('greatest(0, round((a + b * traffic_volume_rollmean4) / nullif(capacity_30min, 0), 9))'))}, 0) AS pred_congestion_code,
        coalesce(risk, 0.5) AS pred_accident_prob, traffic_volume_lag1 FROM scored s CROSS JOIN line LEFT JOIN hourly h ON h.hour = s.hour""",
    "decoded": "SELECT *, list_extract(['Free-flow', 'Moderate', 'Heavy', 'Severe'], (pred_congestion_code + 1)::INT) AS pred_congestion FROM predictions",
    "split": "SELECT p.*, CASE WHEN timestamp <= train_end THEN 'train' WHEN timestamp <= val_end THEN 'val' ELSE 'test' END AS split FROM predictions p, bounds",
    "conditioned": """SELECT *, CASE WHEN is_peak = 1 AND rain_flag = 1 THEN 'peak & rain' WHEN is_peak = 1 THEN 'peak' WHEN rain_flag = 1 THEN 'rain' ELSE 'off-peak dry' END AS condition FROM split""",
    "fine": "SELECT road_id, condition, quantile_cont(y_volume - pred_y_volume, [0.1, 0.5, 0.9]) AS q FROM conditioned WHERE split = 'val' GROUP BY ALL HAVING count(*) >= 5",
    "coarse": "SELECT condition, quantile_cont(y_volume - pred_y_volume, [0.1, 0.5, 0.9]) AS q FROM conditioned WHERE split = 'val' GROUP BY ALL",
    "intervals": """SELECT c.*, pred_y_volume + coalesce(f.q, o.q)[1] AS volume_p10, pred_y_volume + coalesce(f.q, o.q)[2] AS volume_p50, pred_y_volume + coalesce(f.q, o.q)[3] AS volume_p90
        FROM conditioned c LEFT JOIN fine f ON f.road_id = c.road_id AND f.condition = c.condition LEFT JOIN coarse o ON o.condition = c.condition WHERE split = 'test'""",
}


def sql(body: str, rounded: str = "", digits: int = 6) -> str:
    """``body`` over the shared tables; the columns named in ``rounded`` are rounded."""
    names = rounded.split()
    body = f"SELECT * FROM ({body})" if body.startswith("WITH") else body
    if names:
        body = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in names)}) FROM ({body})"
    return "WITH " + ",\n".join(f"{name} AS ({part})" for name, part in PARTS.items()) + "\n" + body
