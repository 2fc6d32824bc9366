"""The chain from raw logs to the feature table, and the tables that the registered queries share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHANNELS, DEFAULT, Config
from ..functions.columns import condition_of, congestion_of, flag, ordinal
from ..operators import clean, enrich, features, models, parts
from ..operators import validate as v
from ..sources import feed
from ..sources.tables import Observed, passing, scratch, staged, typed_calendar


def intake(traffic: DataFrame, observed: Observed) -> DataFrame:
    """Valid readings of the raw log, equal rows being one, with the counters of all of its rows."""
    copies = traffic.groupBy(*traffic.columns).agg(F.count("*").alias("_copies"))
    valid = F.col("_reject_reason") == ""
    total = {"raw": F.lit(True), "valid": valid, "rejected": ~valid}
    counters = {n: F.sum(F.when(x, F.col("_copies")).otherwise(0)) for n, x in total.items()} | {"exact_duplicates": F.sum(F.col("_copies") - 1)}
    return v.split_valid(observed.stage(v.tagged_traffic(copies, keep=("_copies",)), "ingest", counters))[0].drop("_copies")


def cleaned(valid: DataFrame, config: Config = DEFAULT, causal: bool = False, observed: Observed | None = None) -> DataFrame:
    """Valid readings -> the complete grid without copies, outliers and gaps, cut in parts."""
    seen = observed or Observed()
    readings = {"have": F.count("*")} | enrich.mix_counters()
    deduped = seen.stage(clean.dedup_most_complete(valid, ["road_id", "timestamp"]), "readings", readings)  # each stage table is read several times below
    grid = enrich.with_slots(clean.on_grid(deduped, minutes=config.window_minutes))
    nulls = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in (*CHANNELS, "signal_timing")}
    grid = parts.cut(grid, ["road_id"], "timestamp")  # all windows of the chain run by these parts
    first = {"expected": F.count("*"), "entities": F.count_if(F.col("_pos") == 1)}
    grid = seen.stage(grid, "grid", first | nulls | enrich.agreement_counters())
    gated = clean.null_outliers(grid, CHANNELS, config.z_threshold)
    if causal:
        filled = clean.interpolate_causal(gated, CHANNELS, ["road_id"])
    else:
        filled = clean.interpolate(gated, CHANNELS, ["road_id"], limit=config.max_interpolate_gap)
    expected = seen.values["grid", "expected"]
    kept = lambda found: None if found["rows"] == expected else f"{found['rows']} rows of {expected}"
    filled = clean.fill_with_medians(seen.stage(filled, "filled", {"rows": F.count("*")} | {f"left_{c}": F.count_if(F.col(c).isNull()) for c in CHANNELS}, kept), CHANNELS, [["road_id", "dow", "tod"], ["road_id"], []], small=1)
    filled = clean.fill_with_medians(seen.stage(filled, "medians", {"rows": F.count("*")}, kept), ["signal_timing"], [["road_id", "tod"], ["road_id"]], small=1)
    return filled.fillna(0.0, ["accident_count"])


def merged(panel: DataFrame, weather: DataFrame, calendar: DataFrame, observed: Observed | None = None) -> DataFrame:
    """The clean panel, which stays cut in parts, with weather, calendar, classes, the vehicle mix and travel times; leaking
    columns are gone. A right table with several rows for one of the panel's ends the chain."""
    seen = observed or Observed()
    joined = enrich.with_calendar(enrich.with_weather(panel, enrich.half_hourly(enrich.clean_weather(weather.drop("date", "time")))), calendar)
    matched = {"rows": F.count("*"), "match_rate": F.avg(F.col("weather_condition").isNotNull().cast("double"))}
    rows = seen.stage(enrich.with_congestion(joined), "weather", matched)
    mixed = enrich.vehicle_mix(rows).drop("vehicle_count", "date", "time")
    return staged(clean.fill_travel_time(mixed, source=rows))


#: The counters of the quality scoreboard, by section.
SCOREBOARD = [
    *(("ingest", x) for x in ("raw", "valid", "rejected", "entities")), *(("clean", x) for x in ("exact_duplicates", "expected", "absent", "absent_pct")), ("weather", "match_rate"),
    ("congestion", "blank"), ("congestion", "agreement"), ("mix", "parse_failures"), ("mix", "null_texts"),
]


def scoreboard(spark: SparkSession, traffic: DataFrame, weather: DataFrame, calendar: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(the merged panel, its quality scoreboard): the chain from raw logs runs once, and the counters come from its writes."""
    seen = Observed()
    panel = merged(cleaned(intake(traffic, seen), config, observed=seen), weather, calendar, seen)
    at = seen.values
    expected, have = at["grid", "expected"], at["readings", "have"]
    found = {("ingest", "entities"): at["grid", "entities"], ("clean", "exact_duplicates"): at["ingest", "exact_duplicates"], ("clean", "expected"): expected, ("clean", "absent"): expected - have}
    found |= {("clean", "absent_pct"): round((expected - have) / expected * 100, 6) if expected else None, ("congestion", "blank"): at["grid", "blank"], ("congestion", "agreement"): at["grid", "agreement"]}
    found |= {("mix", n): at["readings", n] for n in ("parse_failures", "null_texts")}
    for (section, name), value in found.items():
        seen.put(section, name, value)
    return panel, seen.table(spark, SCOREBOARD)


class Tables:
    """The tables of one data folder, each built on the ones before it; those that many queries read are stage tables."""

    _last: tuple[tuple, Tables] | None = None

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> Tables:
        """The tables of the folder last asked for are kept for the session, as long as its input files stay what they were, so
        that what one query has staged serves the next ones."""
        key = (spark.sparkContext.applicationId, *feed.version(spark, sf_dir))
        if not cls._last or cls._last[0] != key:
            cls._last = key, cls(spark, sf_dir)
        return cls._last[1]

    @cached_property
    def traffic(self) -> DataFrame:
        return feed.traffic(self.spark, self.dir)

    @cached_property
    def weather(self) -> DataFrame:
        return feed.weather(self.spark, self.dir)

    @cached_property
    def raw_calendar(self) -> DataFrame:
        return feed.calendar(self.spark, self.dir)

    @cached_property
    def calendar(self) -> DataFrame:
        return typed_calendar(self.raw_calendar)

    @cached_property
    def tagged(self) -> DataFrame:
        return v.tagged_traffic(self.traffic)

    @cached_property
    def tagged_weather(self) -> DataFrame:
        return v.tagged_weather(self.weather)

    @cached_property
    def valid(self) -> DataFrame:
        return v.split_valid(self.tagged)[0]

    @cached_property
    def valid_weather(self) -> DataFrame:
        return v.split_valid(self.tagged_weather)[0]

    @cached_property
    def deduped(self) -> DataFrame:
        return staged(clean.dedup_most_complete(self.valid, ["road_id", "timestamp"]))

    @cached_property
    def grid(self) -> DataFrame:
        return enrich.with_slots(clean.on_grid(self.deduped))

    @cached_property
    def half_hourly(self) -> DataFrame:
        labelled = self.valid_weather.drop("date", "time").withColumn("weather_condition", condition_of(F.col("weather_condition")))
        return enrich.half_hourly(labelled)

    @cached_property
    def lite(self) -> DataFrame:
        """The grid with its gaps, and its context: for queries on features, without the cost of filling."""
        joined = enrich.with_calendar(enrich.with_weather(self.grid.drop("date", "time"), self.half_hourly), self.calendar)
        return staged(enrich.with_congestion(joined))

    @cached_property
    def full(self) -> DataFrame:
        valid, weather, calendar = self.valid, self.valid_weather, self.calendar
        with passing(self.spark) as kept:
            kept.append(merged(cleaned(valid), weather, calendar))
        return kept[0]

    @cached_property
    def features(self) -> DataFrame:
        rows = features.targets(features.clock(self.lite))
        df = features.differences(features.in_parts(rows, lambda d, order: features.history(d, order=order), features.depth()))
        return features.weather_flags(features.capacity(df))

    @cached_property
    def scored(self) -> DataFrame:
        """Rows with a volume and a rolling mean before it, which the predictions below are made for; a stage table."""
        rows = self.features.where("y_volume IS NOT NULL AND traffic_volume_rollmean4 IS NOT NULL")
        return staged(rows.select(
            "road_id", "road_name", "timestamp", "latitude", "longitude", "hour", "is_peak", "rain_flag", "y_volume", "y_speed", "y_travel_time", "y_congestion", "y_congestion_code", "y_accident",
            "traffic_volume_rollmean4", "signal_timing", "capacity_30min", "traffic_volume_lag1",
        ))

    @cached_property
    def predictions(self) -> DataFrame:
        """Forecasts of models small enough for SQL to fit too, all fitted on the training rows: least-squares lines for volume
        and travel time, the class of the forecast volume, and the hour's share of incidents as risk; a stage table."""
        train = features.with_split(self.scored).where("split = 'train'")
        lines = train.agg(*(f(F.col(y), F.col(x)).alias(n) for n, f, y, x in (
            ("b", F.regr_slope, "y_volume", "traffic_volume_rollmean4"), ("a", F.regr_intercept, "y_volume", "traffic_volume_rollmean4"),
            ("tb", F.regr_slope, "y_travel_time", "signal_timing"), ("ta", F.regr_intercept, "y_travel_time", "signal_timing"),
        )))
        hourly = train.groupBy("hour").agg(F.round((F.sum("y_accident") + 1) / (F.count("*") + 2), 6).alias("risk"))  # 24 rows
        volume = F.col("a") + F.col("b") * F.col("traffic_volume_rollmean4")
        load = F.greatest(F.lit(0.0), F.round(volume / F.nullif(F.col("capacity_30min"), F.lit(0.0)), 9))
        rows = self.scored.crossJoin(F.broadcast(lines)).join(F.broadcast(hourly), "hour", "left").withColumns({
            "pred_y_volume": volume, "pred_y_travel_time": F.col("ta") + F.col("tb") * F.col("signal_timing"),
            "pred_congestion_code": F.greatest(ordinal(congestion_of(load)), F.lit(0)), "pred_accident_prob": F.coalesce("risk", F.lit(0.5)),
        })
        return staged(rows.select(
            *[c for c in self.scored.columns if c not in ("traffic_volume_rollmean4", "signal_timing", "capacity_30min", "traffic_volume_lag1")],
            "pred_y_volume", "pred_y_travel_time", "pred_congestion_code", "pred_accident_prob", "traffic_volume_lag1",
        ))

    @cached_property
    def decoded(self) -> DataFrame:
        from ..functions.columns import label_of

        return self.predictions.withColumn("pred_congestion", label_of(F.col("pred_congestion_code")))

    @cached_property
    def split(self) -> DataFrame:
        return features.with_split(self.predictions)

    @cached_property
    def intervals(self) -> DataFrame:
        """Test rows with 80 % intervals from the validation rows' residuals."""
        rows = models.with_condition(self.split)
        keys, fallback = ["road_id", "condition"], ["condition"]
        fine, coarse = models.residual_quantiles(rows.where("split = 'val'"), "y_volume", "pred_y_volume", keys, fallback, least=5)
        return models.with_intervals(rows.where("split = 'test'"), "pred_y_volume", fine, coarse, keys, fallback)

    @cached_property
    def dataset(self) -> DataFrame:
        full = self.full
        with passing(self.spark) as kept:
            kept.append(staged(features.dataset(full), wide=True))
        return features.entity_code(kept[0])

    @cached_property
    def design(self) -> tuple[DataFrame, list[str]]:
        """(rows of the feature table with targets and split, without nulls in the features, which are there as one vector, too; the features' names), as a
        stage table dealt by key, so that seeded models repeat. It holds the vectors; the features' columns come from them."""
        rows = self.dataset.where("y_volume IS NOT NULL AND y_speed IS NOT NULL AND y_travel_time IS NOT NULL")
        names = v.select_features(rows, NOT_FEATURES | {c for c in rows.columns if c.startswith("y_")})
        roles = [c for c in rows.columns if c.startswith("y_") and c != "y_congestion"] + ["road_id", "road_name", "timestamp"]
        filled = features.fill_medians(rows.select(*roles, *names), names)
        dealt = features.with_split(filled).repartition("road_id", "timestamp").sortWithinPartitions("road_id", "timestamp")
        packed = models.vector_only(dealt.withColumn("y_accident", F.col("y_accident").cast("double")), names)
        return models.with_features(staged(packed, wide=True), names), names

    @cached_property
    def _fitted(self) -> dict[str, models.PanelModels]:
        return {}

    def panel_models(self, *targets: str) -> models.PanelModels:
        """Models of every family for all targets, or those asked for, each fitted once, saved, and read back."""
        targets = targets or tuple(models.TARGETS)
        if missing := [t for t in targets if t not in self._fitted]:
            (rows, names), path = self.design, scratch(self.spark)
            models.fit_panel(rows, names, targets=missing).save(path)
            self._fitted.update(dict.fromkeys(missing, models.PanelModels.load(self.spark, path)))
        return models.PanelModels.of({t: self._fitted[t] for t in models.TARGETS if t in targets})

    def panel_scores(self, *targets: str) -> DataFrame:
        """Test rows with the forecasts of all targets, or those asked for, the calibrated risk and the volume's intervals; a stage table."""
        found, (rows, names) = self.panel_models(*targets), self.design
        return staged(found.score(rows.where("split = 'test'")).drop(*names))


#: Columns that are no features: the row's own measurements, which are not known in advance.
NOT_FEATURES = {"traffic_volume", "avg_speed", "occupancy", "travel_time", "accident_count", "vc_ratio", "temperature", "rainfall", "visibility", "segment_length_km", "tod", "dow"}

__all__ = ["Tables", "cleaned", "flag", "merged", "ordinal"]
