"""Leakage-safe features: what a row has of moving quantities comes from earlier rows of its entity.

All window columns share one ordering per entity. Entities alone would give few tasks where series are few and long, so the
feature table runs its windows by parts of series (``parts``), each with the rows before it that the deepest frame reaches.
``chunked`` does the same by the clock, for series without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CHANNELS, CONDITIONS, DEFAULT, TEMPERATURE_BANDS, Config
from ..functions.columns import banded, flag, ordinal
from . import parts, ranks


def along(entity: str = "road_id", time: str = "timestamp"):
    return Window.partitionBy(entity).orderBy(time)


def lags(columns: list[str], steps: tuple[int, ...], order=None) -> dict[str, Column]:
    order = order or along()
    return {f"{c}_lag{k}": F.lag(c, k).over(order) for c in columns for k in steps}


def rolling(columns: list[str], widths: tuple[int, ...], order=None) -> dict[str, Column]:
    """Means and sample deviations of the rows before; null with fewer than max(2, width // 2) values."""
    order, out = order or along(), {}
    for c in columns:
        for w in widths:
            frame = order.rowsBetween(-w, -1)
            enough = F.count(c).over(frame) >= max(2, w // 2)
            out[f"{c}_rollmean{w}"] = F.when(enough, F.avg(c).over(frame))
            out[f"{c}_rollstd{w}"] = F.when(enough, F.stddev_samp(c).over(frame))
    return out


def targets(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "y_volume": F.col("traffic_volume"), "y_speed": F.col("avg_speed"), "y_travel_time": F.col("travel_time"), "y_congestion": F.col("congestion_level"),
        "y_congestion_code": ordinal(F.col("congestion_level")), "y_accident": flag(F.col("accident_count") > 0),
    })


def clock(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Clock features and flags of the row's own time, which are known in advance; products with calendar flags."""
    t = F.col(time)
    hours = F.hour(t) + F.minute(t) / 60
    angle_h, angle_d = 2 * F.pi() * hours / 24, 2 * F.pi() * F.weekday(t) / 7
    df = df.withColumns({
        "hour": F.hour(t), "minute_of_day": F.hour(t) * 60 + F.minute(t), "day_of_week": F.weekday(t), "day_of_month": F.dayofmonth(t),
        "month": F.month(t), "week_of_year": F.weekofyear(t),
        "hour_sin": F.sin(angle_h), "hour_cos": F.cos(angle_h), "dow_sin": F.sin(angle_d), "dow_cos": F.cos(angle_d),
        "is_weekend": flag(F.weekday(t) >= 5), "is_am_peak": flag((hours >= 7) & (hours < 10.5)), "is_pm_peak": flag((hours >= 16.5) & (hours < 20)),
        "is_night": flag((hours < 6) | (hours >= 22)),
    })
    df = df.withColumn("is_peak", F.greatest("is_am_peak", "is_pm_peak"))
    return df.withColumns({f"{n}_x_peak": F.col(c) * F.col("is_peak") for n, c in (("holiday", "public_holiday"), ("event", "event_flag"), ("roadwork", "roadwork_flag"))})


def depth(config: Config = DEFAULT) -> int:
    """Rows before a row that its features reach."""
    return max(*config.lags, *config.rolling, 48)


def history(df: DataFrame, config: Config = DEFAULT, order=None) -> DataFrame:
    """Lags, rolling statistics, lagged weather and classes, in one projection over one ordering."""
    channels = [*CHANNELS, "vc_ratio"]
    order = order or along()
    code = ordinal(F.col("congestion_level"))
    found = lags(channels, config.lags, order) | rolling(["traffic_volume", "avg_speed"], config.rolling, order)
    found |= {f"{c}_lag1": F.lag(c, 1).over(order) for c in ("temperature", "rainfall", "visibility", "weather_condition")}
    found |= {"rain_3h": F.sum("rainfall").over(order.rowsBetween(-6, -1))}
    found |= {f"congestion_lag{k}_ord": F.coalesce(F.lag(code, k).over(order), F.lit(-1)) for k in (1, 48)}
    return df.withColumns(found)


def in_parts(df: DataFrame, compute, halo: int, entity: str = "road_id", time: str = "timestamp") -> DataFrame:
    """``compute`` (rows, order -> rows) by parts of series with a halo; a table that is not cut yet is cut first."""
    return parts.uncut(parts.with_halo(parts.cut(df, [entity], time), compute, halo))


def differences(df: DataFrame) -> DataFrame:
    """Momentum: differences of lags (day over week, see the column's name), and deviations from rolling means."""
    v, s = "traffic_volume", "avg_speed"
    return df.withColumns({
        "volume_delta_1": F.col(f"{v}_lag1") - F.col(f"{v}_lag2"), "volume_delta_2": F.col(f"{v}_lag2") - F.col(f"{v}_lag3"),
        "speed_delta_1": F.col(f"{s}_lag1") - F.col(f"{s}_lag2"), "volume_dod_change": F.col(f"{v}_lag48") - F.col(f"{v}_lag336"),
        "volume_vs_roll8": F.col(f"{v}_lag1") - F.col(f"{v}_rollmean8"), "speed_vs_roll8": F.col(f"{s}_lag1") - F.col(f"{s}_rollmean8"),
    })


def capacity(df: DataFrame) -> DataFrame:
    half = F.col("road_capacity") / 2
    return df.withColumns({
        "capacity_30min": half, "vc_lag1": F.col("traffic_volume_lag1") / F.nullif(half, F.lit(0.0)), "headroom_lag1": half - F.col("traffic_volume_lag1"),
        "signal_capacity_ratio": F.col("signal_timing") / F.nullif(F.col("road_capacity"), F.lit(0.0)) * 1000,
    })


def weather_flags(df: DataFrame) -> DataFrame:
    """Flags and bands of the lagged weather; null breaks no bound, so its flag is 0."""
    df = df.withColumns({
        "rain_flag": flag(F.col("rainfall_lag1") > 0.1), "heavy_rain_flag": flag(F.col("rainfall_lag1") > 2.5), "low_visibility_flag": flag(F.col("visibility_lag1") < 2000),
        "temp_band": banded(F.col("temperature_lag1"), [None, 10, 20, 30, None], TEMPERATURE_BANDS, closed="right"),
    })
    return df.withColumn("rain_x_peak", F.col("rain_flag") * F.col("is_peak"))


def one_hot(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """A 0/1 column per label of a fixed list; null and other labels are all 0."""
    return df.withColumns({f"{column}_{label}": flag(F.col(column) == label) for label in labels})


def entity_code(df: DataFrame, entity: str = "road_id") -> DataFrame:
    """road_code: the rank of the entity among all, from 0, by running counts over the range-partitioned entities."""
    ids = ranks.running(df.select(entity).where(F.col(entity).isNotNull()).distinct().withColumn("n", F.lit(1)), entity, ["n"])
    return df.join(ids.select(entity, (F.col("upto_n") - 1).cast("int").alias("road_code")), entity)


def sequences(df: DataFrame, columns: list[str], length: int = 12, order=None) -> DataFrame:
    """``window``: the structs of the last ``length`` rows before a row, oldest first; rows with fewer are dropped."""
    order = order or along()
    window = F.collect_list(F.struct(*columns)).over(order.rowsBetween(-length, -1))
    return df.withColumn("window", window).where(F.size("window") == length)


def dataset(merged: DataFrame, config: Config = DEFAULT, strict: bool = False) -> DataFrame:
    """The feature table. strict: the vehicle mix comes from the row before, too."""
    def past(df: DataFrame, order) -> DataFrame:
        if strict:
            df = df.withColumns({c: F.lag(c, 1).over(order) for c in ("share_2w", "share_car", "share_lcv", "share_hcv")})
        return history(df, config, order)

    df = differences(in_parts(targets(clock(merged)), past, depth(config)))
    df = one_hot(one_hot(weather_flags(capacity(df)), "weather_condition_lag1", CONDITIONS), "temp_band", TEMPERATURE_BANDS)
    return df.where(F.col(f"traffic_volume_lag{max(config.lags)}").isNotNull())


def fill_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """What is still null takes its column's exact median over the table; a column without values takes 0."""
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    holed = [c for c in columns if nulls[c]]  # medians are looked for only where something is to be filled
    whole = df.withColumns({c: F.col(c).cast("double") for c in columns if c not in holed})
    if not holed:
        return whole
    found = ranks.medians(df, holed).select(*(F.coalesce(c, F.lit(0.0)).alias(f"_{c}") for c in holed))  # one row
    return whole.crossJoin(F.broadcast(found)).withColumns({c: F.coalesce(F.col(c).cast("double"), f"_{c}") for c in holed}).drop(*(f"_{c}" for c in holed))


def split_bounds(df: DataFrame, time: str = "timestamp", train: float = DEFAULT.train_frac, val: float = DEFAULT.val_frac) -> DataFrame:
    """One row: train_end and val_end as times between the first and the last."""
    low, high = F.min(time).alias("a"), F.max(time).alias("b")
    seconds = "unix_timestamp(cast({} AS timestamp))"
    span = df.agg(low, high).selectExpr("a", f"({seconds.format('b')} - {seconds.format('a')}) AS s")
    return span.selectExpr(f"a + make_dt_interval(0, 0, 0, cast(floor(s * {train}) AS decimal(18,6))) AS train_end", f"a + make_dt_interval(0, 0, 0, cast(floor(s * {train + val}) AS decimal(18,6))) AS val_end")


def with_split(df: DataFrame, time: str = "timestamp", train: float = DEFAULT.train_frac, val: float = DEFAULT.val_frac) -> DataFrame:
    """split: train up to train_end, val up to val_end, test after."""
    joined = df.crossJoin(F.broadcast(split_bounds(df, time, train, val)))
    split = F.when(F.col(time) <= F.col("train_end"), "train").when(F.col(time) <= F.col("val_end"), "val").otherwise("test")
    return joined.withColumn("split", split).drop("train_end", "val_end")


def forward_folds(df: DataFrame, k: int = 3, time: str = "timestamp") -> DataFrame:
    """block: 0 to k, contiguous in time; fold i trains on blocks below i and validates on block i."""
    times = df.select(time).distinct()
    return df.join(times.withColumn("block", F.ntile(k + 1).over(Window.orderBy(time)) - 1), time)


def chunked(df: DataFrame, compute, hours: int, halo: int, entity: str = "road_id", time: str = "timestamp", minutes: int = 30) -> DataFrame:
    """``compute`` (rows -> rows, ordered by entity and time) on chunks of ``hours``, each with ``halo`` rows before it.

    ``compute`` gets a table whose entity column also names the chunk, so its windows run on many tasks per entity.
    """
    width = hours * 3600
    second = F.unix_timestamp(F.col(time).cast("timestamp"))
    own = F.floor(second / width)
    last = F.floor((second + halo * minutes * 60) / width)
    copies = df.withColumn("_chunk", F.explode(F.sequence(own, last))).withColumns({"_own": own == F.col("_chunk"), "_entity": F.col(entity)})
    found = compute(copies.withColumn(entity, F.concat_ws("|", "_entity", "_chunk")))
    return found.where("_own").withColumn(entity, F.col("_entity")).drop("_chunk", "_own", "_entity")
