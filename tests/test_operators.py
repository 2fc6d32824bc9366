"""Small fixtures for behaviour that is easy to get wrong: gaps, ties, nulls, band edges, zero denominators."""

import datetime
import os
import random
import statistics
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns as c
from gridloom.operators import clean, features, metrics, models, ranks
from gridloom.operators import validate as v
from gridloom.plans import queries
from gridloom.plans.panel import Tables
from gridloom.sources import tables


def series(spark, values, kind="double"):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(minutes=30 * i), x) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, f"road_id string, timestamp timestamp_ntz, x {kind}")


def values(df, name="x"):
    return [r[name] for r in df.orderBy("timestamp").collect()]


_ = None
GAPS = [_, _, 1.0, _, _, _, _, 6.0, _, 8.0, 9.0, _, _, _]


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({"limit": 2}, [_, _, 1, 2, 3, _, _, 6, 7, 8, 9, _, _, _]),
        ({"limit": 2, "mode": "whole_gap"}, [_, _, 1, _, _, _, _, 6, 7, 8, 9, _, _, _]),
        ({"limit": None, "edges": True}, [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 9]),
    ],
)
def test_interpolation(spark, options, want):
    assert values(clean.interpolate(series(spark, GAPS), ["x"], ["road_id"], **options)) == want


def test_causal_fill_never_looks_ahead(spark):
    assert values(clean.interpolate_causal(series(spark, GAPS), ["x"], ["road_id"])) == [_, _, 1, 1, 1, 1, 1, 6, 6, 8, 9, 9, 9, 9]


def test_rolling_excludes_the_row_and_needs_two_values(spark):
    df = series(spark, [1.0, _, 3.0, 4.0, 5.0, 6.0, 7.0]).withColumns(features.rolling(["x"], (4,)))
    assert values(df, "x_rollmean4") == [_, _, _, 2.0, pytest.approx(8 / 3), 4.0, 4.5]


def test_mode_ties_and_medians(spark):
    df = spark.createDataFrame([("r", x, y) for x, y in zip(["b", "a", "b", "a", None], [0.0, 1.0, 2.0, 3.0, None], strict=True)], "road_id string, name string, x double")
    assert clean.entity_master(df, columns=["name"]).first()["name"] == "a"
    assert {r.x for r in clean.fill_with_medians(df, ["x"], [["road_id"], []]).collect()} == {0.0, 1.0, 2.0, 3.0, 1.5}


def test_dedup_keeps_the_most_complete_and_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 3, "x"), ("k", 2, "x"), ("l", None, None), ("l", None, None)], "key string, a int, b string")
    assert sorted((r.key, r.a) for r in clean.dedup_most_complete(df, ["key"]).collect()) == [("k", 2), ("l", None)]
    assert clean.exact_duplicates(df).first()[0] == 1


def test_outliers_without_spread_stay(spark):
    assert values(clean.null_outliers(series(spark, [5.0, 5.0, 5.0]), ["x"])) == [5, 5, 5]
    assert values(clean.null_outliers(series(spark, [1.0] * 30 + [100.0]), ["x"]))[-1] is None


def test_band_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 0.8, 1.0, -0.1, 99.0, None)], "x double")
    assert [r[0] for r in df.select(c.congestion_of(F.col("x"))).collect()] == ["Moderate", "Heavy", "Severe", None, None, None]
    df = spark.createDataFrame([(x,) for x in (10.0, 20.0, 30.0, 30.1, None)], "x double")
    assert [r[0] for r in df.select(c.banded(F.col("x"), [None, 10, 20, 30, None], ["cold", "mild", "warm", "hot"], "right")).collect()] == ["cold", "mild", "warm", "hot", None]
    df = spark.createDataFrame([(x,) for x in (25.0, 55.0, 56.0)], "w double")
    assert [r[0] for r in df.select(c.confidence(F.lit(0.0), F.col("w"), F.lit(100.0))).collect()] == ["High", "Medium", "Low"]


def test_flags_of_null_and_ordinals(spark):
    row = spark.range(1).select(c.flag(F.lit(None).cast("double") > 1).alias("f"), c.ordinal(F.lit("Heavy")).alias("a"), c.ordinal(F.lit(None).cast("string")).alias("b"), c.label_of(F.lit(3)).alias("l")).first()
    assert tuple(row) == (0, 2, -1, "Severe")


def test_timestamps_and_reasons(spark):
    df = spark.createDataFrame([("13/02/2025", " 05:30"), ("32/02/2025", "05:30"), ("junk", None)], "date string, time string")
    assert [r[0] for r in df.select(c.moment("dd/MM/yyyy")).collect()] == [datetime.datetime(2025, 2, 13, 5, 30), None, None]
    df = spark.createDataFrame([(-1.0, 300.0), (None, 1.0)], "traffic_volume double, avg_speed double")
    got = [r[0] for r in df.select(c.reasons({"traffic_volume": (0, 5000), "avg_speed": (0, 200)})).collect()]
    assert got == ["traffic_volume_out_of_range;avg_speed_out_of_range;", ""]


def test_local_time_of_other_zones(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        df = spark.createDataFrame([("2025-01-05", "05:30")], "date string, time string").select(c.moment("yyyy-MM-dd").alias("timestamp"))
        row = features.clock(df.withColumns({k: F.lit(0) for k in ("public_holiday", "event_flag", "roadwork_flag")})).first()
        assert (row.hour, row.minute_of_day, row.day_of_week, row.week_of_year, row.is_night) == (5, 330, 6, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_missing_columns_are_an_error(spark):
    with pytest.raises(v.MissingColumns, match="road_id"):
        v.check_schema(spark.range(1), ["road_id"])
    assert v.check_schema(spark.range(1).withColumn("more", F.lit(1)), ["id"]).columns == ["id"]


def test_regression_edges(spark):
    df = spark.createDataFrame([(10.0, 10.0), (20.0, 20.0), (30.0, 30.0)], "y double, p double")
    row = metrics.regression(df, "y", "p").first()
    assert (row.rmse, row.mae, row.r2, row.n) == (0, 0, 1, 3)
    df = spark.createDataFrame([(0.0, 5.0), (100.0, 110.0), (200.0, 190.0)], "y double, p double")
    assert metrics.regression(df, "y", "p").first().mape == pytest.approx(7.5)


def test_ranking_quality_with_ties(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5], strict=True)), "y int, s double")
    row = metrics.ranking_quality(df, "y", "s").first()
    assert row.average_precision == pytest.approx(0.8333, abs=1e-4) and row.roc_auc == pytest.approx(5 / 6)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.ranking_quality(tied, "y", "s").first().roc_auc == pytest.approx(0.875)


def test_thresholds_and_lift(spark):
    df = spark.range(2000).selectExpr("cast(id % 20 = 0 AS int) AS y", "least(1D, 0.5 * cast(id % 20 = 0 AS int) + 0.5 * rand(3)) AS s", "id")
    best = metrics.best_threshold(df, "y", "s").first()
    assert 0 < best.threshold < 1 and best.f1 > 0.8
    row = metrics.top_share_lift(df, "y", "s", ["id"], 0.05).first()
    assert row.k == 100 and row.top_rate > 0.8 and row.lift > 15


def test_class_measures_without_rows_are_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "y string, p string")
    rows = {r.label: r for r in metrics.per_class(metrics.confusion(df, "y", "p", ["a", "b", "c"])).collect()}
    assert rows["a"].recall == 0.5 and rows["b"].precision == 0 and rows["c"].f1 == 0
    assert metrics.class_summary(metrics.per_class(metrics.confusion(df, "y", "p", ["a", "b", "c"]))).first().accuracy == 0.5


def test_linear_model_recovers_coefficients(spark):
    df = spark.range(4000).selectExpr(*(f"randn({k}) AS x{k}" for k in range(5))).withColumn("y", F.expr("2 * x0 - x1 - 1.5 * x2 + 3.5 * x3 + 0.8 * x4 + 7"))
    from pyspark.ml.regression import LinearRegression

    model = models.fitted(df, [f"x{k}" for k in range(5)], "y", LinearRegression(solver="normal"))
    assert [round(x, 6) for x in model.stages[-1].coefficients] == [2, -1, -1.5, 3.5, 0.8] and model.stages[-1].intercept == pytest.approx(7)


def test_chunks_with_a_halo_change_nothing(spark):
    df = series(spark, [float(i * i % 17) for i in range(400)])
    work = lambda d: d.withColumns(features.lags(["x"], (1, 48)) | features.rolling(["x"], (8,)))
    whole = sorted(tuple(r) for r in work(df).select("timestamp", "x_lag1", "x_lag48", "x_rollmean8").collect())
    assert whole == sorted(tuple(r) for r in features.chunked(df, work, hours=10, halo=48).select("timestamp", "x_lag1", "x_lag48", "x_rollmean8").collect())


def test_empty_tables(spark):
    df = spark.createDataFrame([], "road_id string, timestamp timestamp_ntz, x double")
    assert clean.interpolate(df, ["x"], ["road_id"]).count() == 0 and clean.time_grid(df).count() == 0
    assert clean.dedup_most_complete(df, ["road_id", "timestamp"]).count() == 0


def test_interpolation_of_a_long_series_takes_linear_time(spark):
    n = 60_000
    df = spark.range(n).selectExpr("'a' AS road_id", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 30 * id) AS timestamp", "CASE WHEN id % 7 < 3 THEN double(id) END AS x", "id")
    began = time.time()
    got = clean.interpolate(df, ["x"], ["road_id"], limit=None).where("x IS NULL OR abs(x - id) > 1e-6").count()
    assert got == (n - 1) % 7 - 2 if (n - 1) % 7 > 2 else got == 0
    assert time.time() - began < 60


def test_running_totals_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), k, rng.randrange(9)) for k in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, v int, n long")
    for by, down in ((None, False), (["g"], True)):
        got = {(r.g, r.v): r.upto_n for r in ranks.running(df, "v", ["n"], by, down).collect()}
        for g, v, _n in rows:
            assert got[g, v] == sum(m for h, w, m in rows if (by is None or h == g) and (w >= v if down else w <= v))
    assert ranks.running(df.limit(0), "v", ["n"]).count() == 0


def test_exact_quantiles_and_medians(spark):
    rng = random.Random(2)
    values = [rng.choice([None, 0.0, rng.gauss(0, 9)]) for _ in range(301)]
    df = spark.createDataFrame([(x, None, 3.0) for x in values], "x double, y double, z double")
    have, at = sorted(x for x in values if x is not None), [0.0, 0.1, 0.5, 0.77, 1.0]
    got = ranks.quantiles(df, "x", at).first().q
    for p, q in zip(at, got, strict=True):
        place = p * (len(have) - 1)
        low = have[int(place)]
        assert abs(q - (low + (have[min(int(place) + 1, len(have) - 1)] - low) * (place - int(place)))) < 1e-9
    assert ranks.medians(df, ["x", "y", "z"]).first() == (pytest.approx(statistics.median(have)), None, 3.0)
    assert ranks.quantiles(df, "y", at).first().q is None


def test_top_share_with_all_scores_tied(spark):
    df = spark.range(1000).selectExpr("id AS key", "0.5 AS score", "int(id % 4 = 0) AS y")
    row = metrics.top_share_lift(df, "y", "score", ["key"]).first()
    assert (row.k, row.top_rate, row.lift) == (100, 0.25, 1.0)


def test_local_times_and_instants(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 01:15:00' AS t")
    row = df.select(c.instant(F.col("t"), "Asia/Kolkata").alias("utc"), c.local_time(c.instant(F.col("t"), "America/New_York"), "America/New_York").alias("back")).first()
    assert row.utc == datetime.datetime(2024, 3, 9, 19, 45) and row.back == datetime.datetime(2024, 3, 10, 1, 15)


def test_panel_models_name_what_is_missing(spark):
    df = spark.createDataFrame([(1.0, "train")], "y_volume double, split string")
    with pytest.raises(ValueError, match="lag1"):
        models.panel_models(df, ["lag1"])


def test_panel_models_score_from_disk_as_before(spark, tmp_path):
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 30 * int(id))")
    df = spark.range(900).select(F.concat(F.lit("r"), F.col("id") % 3).alias("road_id"), at.alias("timestamp"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("is_peak"), F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("rain_flag"), "id")
    df = df.withColumns({"split": F.when(F.col("id") < 500, "train").when(F.col("id") < 700, "val").otherwise("test"), "y_volume": 3 * F.col("x") + F.col("id") % 11, "y_speed": 50 - F.col("x"), "y_travel_time": F.col("x") ** 2})
    df = df.withColumns({"y_congestion_code": (F.col("x") / 2).cast("int"), "y_accident": ((F.col("x") + F.col("id") % 4) > 6).cast("double")}).drop("id")
    found = models.fit_panel(df, ["x", "is_peak", "rain_flag"], families=("linear", "tree"))
    test = df.where("split = 'test'")
    first = found.score(test).orderBy("timestamp").collect()
    found.save(str(tmp_path))
    again = models.PanelModels.load(spark, str(tmp_path))
    assert again.score(test).orderBy("timestamp").collect() == first and len(first) == 200
    assert all(0 <= r.pred_accident_prob <= 1 and r.volume_p10 <= r.volume_p50 <= r.volume_p90 and r.pred_accident == int(r.pred_accident_prob >= again.threshold) for r in first)
    chosen = {r.target: r.model for r in again.board.where("chosen").select("target", "model").distinct().collect()}
    assert set(chosen) == set(models.TARGETS) and chosen["y_travel_time"] == "tree" and {r.target: r.model for r in again.cards.collect()} == chosen
    with pytest.raises(ValueError, match="rain_flag"):
        again.score(test.drop("rain_flag"))


def test_models_without_a_metric_come_last():
    assert sorted(["a", "b", "c"], key=lambda n: models._better("rmse", {"a": None, "b": 2.0, "c": 1.0}[n], n)) == ["c", "b", "a"]
    assert sorted(["a", "b", "c"], key=lambda n: models._better("macro_f1", {"a": None, "b": 0.0, "c": 0.0}[n], n)) == ["b", "c", "a"]


def test_outliers_of_a_null_entity(spark):
    df = spark.createDataFrame([(None, float(x)) for x in [1] * 30 + [500]], "road_id string, x double")
    assert clean.null_outliers(df, ["x"], 5.0).where("x IS NULL").count() == 1



def test_models_are_fitted_on_the_vectors_that_came_with_the_rows(spark):
    df = spark.range(400).selectExpr("id % 7 AS a", "CAST(id % 11 AS double) AS b", "CAST(3 * (id % 7) - 2 * (id % 11) AS double) AS y")
    df = df.unionAll(spark.sql("SELECT 1L, CAST('NaN' AS double), 1e6D UNION ALL SELECT 2L, CAST(NULL AS double), 1e6D"))
    whole = models.with_vector(df, ["a", "b"])
    assert whole.where("_vector IS NULL").count() == 2
    lost = whole.withColumns({"a": F.lit(0), "b": F.lit(0.0)})  # the vectors hold the features, and are read
    for rows, scale in ((df, False), (whole, False), (lost, False), (whole, True)):
        model = models.fitted(rows, ["a", "b"], "y", models.REGRESSORS["linear"](), scale)
        scored = models.predicted(model, df, "p").collect()
        assert len(scored) == 400 and all(abs(r["p"] - r["y"]) < 1e-6 for r in scored)
    other = models.fitted(whole, ["b"], "y", models.REGRESSORS["linear"]())  # of other features, so it is not taken
    assert len(other.stages[-1].coefficients) == 1


def test_trees_are_fitted_in_no_more_partitions_than_tasks(spark, monkeypatch):
    seen, fit = [], models.DecisionTreeRegressor.fit
    monkeypatch.setattr(models.DecisionTreeRegressor, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    df = spark.range(0, 4000, 1, 40).selectExpr("double(id % 7) AS x", "double(id % 7 > 3) AS y")
    model = models.fitted(df, ["x"], "y", models.REGRESSORS["tree"]())
    assert seen == [spark.sparkContext.defaultParallelism]
    assert models.predicted(model, df, "p").where("p <> y").count() == 0


def test_travel_times_are_filled_from_the_stage_table_that_the_rows_stand_on(spark):
    rows = spark.createDataFrame([("a", 30.0, 2.0), ("a", 60.0, None), ("b", 0.0, None)], "road_id string, avg_speed double, travel_time double")
    found = {(r["road_id"], r["avg_speed"]): r["travel_time"] for r in clean.fill_travel_time(rows.withColumn("more", F.lit(1)), source=rows).collect()}
    assert found == {("a", 30.0): 2.0, ("a", 60.0): 1.0, ("b", 0.0): None}


def test_the_grid_is_made_by_as_many_tasks_as_run_at_a_time(spark):
    """One road or a few: adaptive execution must not leave the grid to one task; steps end with the last time of all."""
    start = datetime.datetime(2024, 1, 1, 3)
    for roads in (1, 3):
        rows = [(f"r{k}", start + datetime.timedelta(minutes=30 * i)) for k in range(roads) for i in (0, 500)]
        grid = clean.time_grid(spark.createDataFrame([*rows, (None, start)], "road_id string, timestamp timestamp_ntz"))
        sizes = [n for n in grid.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) > 1 and max(sizes) < roads * 501
        found = sorted(map(tuple, grid.collect()))
        assert found == [(f"r{k}", start + datetime.timedelta(minutes=30 * i)) for k in range(roads) for i in range(501)]


def test_panel_models_are_scored_in_one_pass(spark, monkeypatch):
    """One stage table holds the forecasts of all models; weighted rows are written as label, weight and vector only."""
    written, staged = [], models.staged
    monkeypatch.setattr(models, "staged", lambda df: (written.append(df.columns), staged(df))[1])
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"r{i % 3}", start + datetime.timedelta(minutes=30 * i), "train" if i < 200 else "val" if i < 300 else "test", float(i % 17), i % 2, i % 3 % 2, 2.0 * (i % 17), 1.0 * (i % 17), 5.0, i % 4, float(i % 5 == 0)) for i in range(400)]
    names = "road_id string, timestamp timestamp_ntz, split string, x double, is_peak int, rain_flag int, y_volume double, y_speed double, y_travel_time double, y_congestion_code int, y_accident double"
    found = models.fit_panel(spark.createDataFrame(rows, names), ["x", "is_peak", "rain_flag"], families=("linear", "tree"))
    assert [c for c in written if "weight" in c] == [["y_congestion_code", "weight", models.VECTOR], ["y_accident", "weight", models.VECTOR]]
    scored = [c for c in written if "split" in c]
    assert len(scored) == 1 and sum("_by_" in c for c in scored[0]) == 10
    assert found.kept["y_volume"][0] == "linear" and len(found.cards.collect()) == 5


def test_the_linear_svm_is_fitted_on_all_training_rows(spark, monkeypatch):
    class Stop(Exception):
        pass

    def fitted(train, *_):
        seen.append(train.count())
        raise Stop

    seen, rows = [], spark.range(40_100).selectExpr("id % 2 AS y_accident", "double(id % 7) AS x", "CASE WHEN id < 40000 THEN 'train' ELSE 'test' END AS split", "id AS timestamp", "'r' AS road_id")
    monkeypatch.setattr(models, "fitted", fitted)
    with pytest.raises(Stop):
        queries.REGISTRY["m9_linear_svm"][0](SimpleNamespace(design=(rows, ["x"])))
    assert seen == [40_000]


def test_features_are_written_as_vectors_and_read_back(spark):
    df = spark.createDataFrame([("r", 1, 2.5), ("s", 0, -1.0), ("t", 3, float("nan"))], "road_id string, a int, b double")
    written = models.vector_only(df, ["a", "b"])
    assert written.columns == ["road_id", models.VECTOR]
    back = models.with_features(tables.staged(written, wide=True), ["a", "b"])
    assert back.columns == ["road_id", models.VECTOR, "a", "b"] and back.schema[models.VECTOR].metadata["names"] == ["a", "b"]
    assert {(r["road_id"], r["a"], r["b"]) for r in back.collect()} == {("r", 1.0, 2.5), ("s", 0.0, -1.0), ("t", None, None)}


def test_stage_tables_of_a_finished_step_are_deleted(spark):
    with tables.passing(spark) as kept:
        first = tables.staged(spark.range(5))
        kept.append(tables.staged(first.selectExpr("id + 1 AS id")))
        assert os.path.exists(first._stage)
    assert not os.path.exists(first._stage) and sorted(r["id"] for r in kept[0].collect()) == [1, 2, 3, 4, 5]


def test_one_against_the_rest_is_scored_as_by_its_own_transform(spark):
    df = spark.range(300).selectExpr("double(id % 7) AS x", "double(id % 11) AS z", "double(id % 7 % 3) AS y", "1.0D AS weight")
    model = models.fitted(df, ["x", "z"], "y", models.CLASSIFIERS["boosted"](maxIter=2, maxDepth=2), classes=3)
    found = models.predicted(model, df.withColumn("id", F.monotonically_increasing_id()), "p")
    assert "prediction" not in found.columns and not [c for c in found.columns if c.startswith("_raw")]
    own = model.transform(df.withColumn("id", F.monotonically_increasing_id())).select("id", "prediction")
    assert found.join(own, "id").where("p = prediction").count() == 300


def _panel(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"r{i % 3}", start + datetime.timedelta(minutes=30 * i), "train" if i < 200 else "val" if i < 300 else "test", float(i % 17), float(i % 2), float(i % 3 % 2), 2.0 * (i % 17), 1.0 * (i % 17), 5.0, i % 4, float(i % 5 == 0)) for i in range(400)]
    names = "road_id string, timestamp timestamp_ntz, split string, x double, is_peak double, rain_flag double, y_volume double, y_speed double, y_travel_time double, y_congestion_code int, y_accident double"
    return spark.createDataFrame(rows, names), ["x", "is_peak", "rain_flag"]


def test_a_query_fits_the_models_of_its_own_targets(spark, monkeypatch):
    """The coverage of the volume needs the volume's models alone; what a query has fitted the next ones take."""
    asked, fit = [], models.fit_panel
    monkeypatch.setattr(models, "fit_panel", lambda rows, names, targets=None, **_: asked.append(list(targets)) or fit(rows, names, families=("linear",), targets=targets))
    t = Tables(spark, "")
    t.__dict__["design"] = _panel(spark)
    assert queries.REGISTRY["e12_fitted_coverage"][0](t).count() == 1
    assert {r["target"] for r in queries.REGISTRY["e17_fitted_winners"][0](t).collect()} == set(models.TARGETS)
    assert asked == [["y_volume"], ["y_speed", "y_travel_time", "y_congestion", "y_accident"]]
    assert queries.REGISTRY["m13_scored_rows"][0](t).where("volume_p10 <= volume_p90 AND pred_accident_prob BETWEEN 0 AND 1 AND pred_congestion IS NOT NULL").count() == 100 and len(asked) == 2


def test_the_fitted_queries_try_every_family(spark):
    t = Tables(spark, "")
    t.__dict__["design"] = _panel(spark)
    found = {(r["target"], r["model"]) for r in queries.REGISTRY["e11_fitted_scoreboard"][0](t).collect()}
    assert found == {(k, m) for k, x in models.TARGETS.items() for m in ("linear" if x == "rmse" else "logistic", "tree", "forest", "boosted")}


def test_a_vector_that_came_with_the_rows_is_made_longer(spark):
    df = spark.range(200).selectExpr("double(id % 7) AS a", "double(id % 11) AS b", "double(id % 7 + 2 * (id % 11)) AS y")
    lost = models.with_vector(df, ["a"]).withColumn("a", F.lit(0.0))  # what the vector holds is read, not the column
    model = models.fitted(lost, ["a", "b"], "y", models.REGRESSORS["linear"]())
    assert models.predicted(model, lost, "p").where("abs(p - y) < 1e-6").count() == 200
    assert models.predicted(model, df, "p").where("abs(p - y) < 1e-6").count() == 200
