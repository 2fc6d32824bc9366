"""The panel's raw tables derived from the events and nation tables: text columns with the defects of real logs.

A sensor stands for ten users, a weather station for five sensors, so both grow with the events; a sensor has the name and
region of nation ``sensor % 25``. A reading is one sensor's half hour with at least one event. The least event id of a
reading, ``eid``, decides by its divisors which defects the reading has (blanks, junk, faults, copies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TRAFFIC_COLUMNS


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells this state of the input files from another: their names, sizes and times of change; and the session's zone."""
    found = [sf_dir, spark.conf.get("spark.sql.session.timeZone")]
    for name in ("events", "nation"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        found += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return tuple(found)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def total(value: str = "value", order: str = "event_id") -> Column:
    """The sum of a double column over a cell's events in the order of their ids; null without values.

    A sum of doubles depends on its order in the last digit, and a rounding tie (12.5 against 12.499999999999998) makes a whole
    unit of it: added as rows arrive, some cells would change with files, splits and executors. A cell's events are one list; it
    has ten or fifty users' half hour or hour.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.when(F.count(value) > 0, F.aggregate(listed, F.lit(0.0), lambda a, x: a + x[value]))


def mean(value: str = "value", order: str = "event_id") -> Column:
    return total(value, order) / F.count(value)


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor log: all columns text, one row per sensor and half hour, with repeated and faulty rows."""
    cells = (
        events(spark, sf_dir)
        .groupBy(F.expr("user_id DIV 10").alias("seg"), F.window("ts", "30 minutes")["start"].alias("w"))
        .agg(
            F.min("event_id").alias("eid"), F.round(total()).cast("long").alias("vol"), F.round(mean()).cast("long").alias("spd"),
            F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("err"),
        )
    )
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("kind"), "n_name")
    cells = cells.withColumn("kind", F.col("seg") % 25).join(F.broadcast(nation), "kind")  # 25 rows
    rows = cells.selectExpr(
        "CASE WHEN eid % 109 = 0 THEN 'nan' ELSE concat(' SEG-', lpad(cast(seg AS string), 9, '0')) END AS road_id",
        "CASE WHEN eid % 31 = 0 THEN NULL ELSE n_name END AS road_name",
        "concat('12.', lpad(cast(seg % 100 AS string), 2, '0')) AS latitude",
        "concat('77.', lpad(cast(seg % 100 AS string), 2, '0')) AS longitude",
        "concat('WS-', seg DIV 5) AS weather_station_id",
        "CASE WHEN eid % 107 = 0 THEN '2024-13-40' ELSE date_format(w, 'yyyy-MM-dd') END AS date",
        "date_format(w, 'HH:mm') AS time",
        "CASE WHEN eid % 11 = 0 THEN NULL WHEN eid % 97 = 0 THEN 'junk' WHEN eid % 101 = 0 THEN '-5' ELSE cast(vol AS string) END AS traffic_volume",
        "cast(n AS string) AS vehicle_count",
        "CASE WHEN eid % 17 = 0 THEN NULL WHEN eid % 13 = 0 THEN 'broken' ELSE concat('{\"2W\": 0.', eid % 10, ', \"Car\": 0.', eid % 7, ', \"LCV\": 0.', eid % 5, ', \"HCV\": 0.', eid % 3, '}') END AS vehicle_type_dist",
        "CASE WHEN eid % 103 = 0 THEN '999' WHEN eid % 37 = 0 THEN NULL ELSE cast(spd AS string) END AS avg_speed",
        "CASE WHEN eid % 41 = 0 THEN NULL ELSE cast(n * 7 AS string) END AS occupancy",
        "CASE WHEN eid % 7 = 0 THEN '' WHEN eid % 29 = 0 THEN 'Heavy' WHEN vol * 2 < 0.5 * (100 + 10 * kind) THEN 'Free-flow' WHEN vol * 2 < 0.8 * (100 + 10 * kind) THEN 'Moderate' WHEN vol * 2 < (100 + 10 * kind) THEN 'Heavy' ELSE 'Severe' END AS congestion_level",
        "CASE WHEN eid % 19 = 0 THEN NULL ELSE cast(1 + eid % 50 AS string) END AS travel_time",
        "CASE WHEN eid % 23 = 0 THEN NULL ELSE cast(err AS string) END AS accident_count",
        "CASE WHEN eid % 27 = 0 THEN NULL ELSE cast(30 + eid % 60 AS string) END AS signal_timing",
        "cast(100 + 10 * kind AS string) AS road_capacity",
        "eid",
    )
    # A row, its copy and its poorer copy come from one pass; a union of three would work out the cells for each.
    each = rows.withColumn("_copy", F.explode(F.expr("filter(array(0, 1, 2), x -> x = 0 OR x = 1 AND eid % 50 = 0 OR x = 2 AND eid % 60 = 1)")))
    poorer = F.col("_copy") == 2
    each = each.withColumns({"congestion_level": F.when(poorer, "").otherwise(F.col("congestion_level")), "travel_time": F.when(~poorer, F.col("travel_time"))})
    return each.select(*TRAFFIC_COLUMNS)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly weather log of the stations: text columns, day first in its dates."""
    cells = (
        events(spark, sf_dir)
        .groupBy(F.expr("user_id DIV 50").alias("st"), F.window("ts", "1 hour")["start"].alias("h"))
        .agg(F.min("event_id").alias("eid"), F.round(mean() / 2).cast("long").alias("temp"))
    )
    labels = ["Clear", " RAIN", "rainy ", "cloudy", "Overcast", "Fog", "foggy", "haze"]
    listed = ", ".join(f"'{x}'" for x in labels)
    return cells.selectExpr(
        "concat('WS-', st) AS station_id", "date_format(h, 'dd/MM/yyyy') AS date", "date_format(h, 'HH:mm') AS time",
        f"CASE WHEN eid % 21 = 0 THEN NULL ELSE element_at(array({listed}), cast(eid % 8 AS int) + 1) END AS weather_condition",
        "CASE WHEN eid % 13 = 0 THEN NULL WHEN eid % 113 = 0 THEN '99' ELSE cast(temp AS string) END AS temperature",
        "CASE WHEN eid % 17 = 0 THEN NULL ELSE concat(cast(eid % 4 AS string), '.', cast(eid % 10 AS string)) END AS rainfall",
        "CASE WHEN eid % 19 = 0 THEN NULL ELSE cast(500 + (eid % 50) * 100 AS string) END AS visibility",
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per date of the events: flags as text, some of them blank."""
    days = events(spark, sf_dir).select(F.to_date("ts").alias("d")).distinct()
    return days.selectExpr(
        "date_format(d, 'yyyy-MM-dd') AS date",
        "CASE WHEN day(d) IN (1, 26) THEN '1' WHEN day(d) = 5 THEN 'x' ELSE '0' END AS public_holiday",
        "CASE WHEN day(d) IN (1, 26) THEN concat('Holiday ', day(d)) END AS holiday_name",
        "CASE WHEN day(d) % 10 = 0 THEN '1' ELSE '0' END AS event_flag",
        "CASE WHEN day(d) % 10 = 0 THEN 'Fair' END AS event_name",
        "CASE WHEN day(d) % 7 = 0 THEN '1' WHEN day(d) % 7 = 1 THEN NULL ELSE '0' END AS roadwork_flag",
    )
