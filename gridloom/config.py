"""Settings of the panel: fixed values of the domain (bounds, vocabularies, bands, lags), and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

TRAFFIC_COLUMNS = [
    "road_id", "road_name", "latitude", "longitude", "weather_station_id", "date", "time", "traffic_volume", "vehicle_count",
    "vehicle_type_dist", "avg_speed", "occupancy", "congestion_level", "travel_time", "accident_count", "signal_timing", "road_capacity",
]
TRAFFIC_NUMBERS = ["latitude", "longitude", "traffic_volume", "vehicle_count", "avg_speed", "occupancy", "travel_time", "accident_count", "signal_timing", "road_capacity"]
WEATHER_COLUMNS = ["station_id", "date", "time", "weather_condition", "temperature", "rainfall", "visibility"]
WEATHER_NUMBERS = ["temperature", "rainfall", "visibility"]
CALENDAR_COLUMNS = ["date", "public_holiday", "holiday_name", "event_flag", "event_name", "roadwork_flag"]
STATIC_COLUMNS = ["road_name", "latitude", "longitude", "weather_station_id", "road_capacity"]
CHANNELS = ["traffic_volume", "avg_speed", "occupancy"]

#: The channels of sequence windows.
SEQUENCE_CHANNELS = [
    "traffic_volume", "avg_speed", "occupancy", "vc_ratio", "temperature", "rainfall", "visibility", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "is_peak", "is_weekend", "public_holiday", "event_flag", "roadwork_flag",
]

#: Physical bounds, both ends included.
RANGES = {
    "traffic_volume": (0, 5000), "avg_speed": (0, 200), "occupancy": (0, 100), "travel_time": (0, 240), "accident_count": (0, 20),
    "signal_timing": (0, 300), "road_capacity": (100, 10000), "temperature": (-20, 60), "rainfall": (0, 500), "visibility": (0, 50000),
}
#: Weather labels in lower case.
VOCABULARY = {"clear": "Clear", "cloudy": "Cloudy", "overcast": "Cloudy", "rain": "Rain", "rainy": "Rain", "fog": "Fog", "foggy": "Fog"}
CONDITIONS = ["Clear", "Cloudy", "Fog", "Rain", "Unknown"]
#: Congestion classes by volume over capacity, lower end included.
BANDS = [(0.0, 0.5, "Free-flow"), (0.5, 0.8, "Moderate"), (0.8, 1.0, "Heavy"), (1.0, 99.0, "Severe")]
CLASSES = [label for _, _, label in BANDS]
TEMPERATURE_BANDS = ["cold", "mild", "warm", "hot"]


@dataclass(frozen=True)
class Config:
    timezone: str = "Asia/Kolkata"
    window_minutes: int = 30
    z_threshold: float = 5.0
    max_interpolate_gap: int = 2
    lags: tuple[int, ...] = (1, 2, 3, 4, 48, 336)
    rolling: tuple[int, ...] = (4, 8, 48)
    train_frac: float = 0.70
    val_frac: float = 0.15
    sequence_length: int = 12
    ranges: dict = field(default_factory=lambda: dict(RANGES))


DEFAULT = Config()
