"""Windows by parts of series, grouped quantiles, observed counters and guards, and models from sums, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import clean, enrich, features, fits, parts, ranks
from gridloom.operators import validate as v
from gridloom.plans import panel
from gridloom.sources.tables import BrokenStage, Observed

SCHEMA = "g string, t long, x double, y double"


def _series(spark, seed, sizes, holes=0.6):
    pick = np.random.default_rng(seed)
    rows = [(g, int(t), None if pick.random() < holes else float(pick.integers(100)), None if pick.random() < holes else float(pick.integers(9))) for g, n in sizes.items() for t in range(n)]
    pick.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame(rows, columns=["g", "t", "x", "y"])


SIZES = {"a": 700, "b": 3, "c": 1, None: 40, "": 25, "z": 90}


@pytest.mark.parametrize("count,limit,edges", [(1, 2, False), (3, None, True), (40, None, False), (40, 2, False)])
def test_interpolation_by_parts_is_that_of_whole_series(spark, count, limit, edges):
    df, plain = _series(spark, 1, SIZES)
    cut = parts.cut(df, ["g"], "t", count)
    got = parts.interpolate(cut, ["x", "y"], limit, "prefix", edges).toPandas().sort_values(["g", "t"], na_position="first").reset_index(drop=True)
    direction = {"limit_direction": "both"} if edges else {"limit_area": "inside", "limit": limit}
    want = [g.sort_values("t").assign(**{c: g.sort_values("t")[c].astype(float).interpolate("linear", **direction) for c in "xy"}) for _, g in plain.groupby("g", dropna=False)]
    want = pd.concat(want).sort_values(["g", "t"], na_position="first").reset_index(drop=True)
    assert got["_pos"].tolist() == (want["t"] + 1).tolist()
    for c in "xy":
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_long_gaps_span_many_parts(spark):
    df = spark.range(1000).selectExpr("'one' AS g", "id AS t", "IF(id IN (5, 905), CAST(id AS double), NULL) AS x")
    for mode, filled in (("prefix", {6, 7}), ("whole_gap", set())):
        got = clean.interpolate(df.repartition(9), ["x"], ["g"], "t", 2, mode).where("x IS NOT NULL").collect()
        assert {r.t for r in got} == {5, 905} | filled and all(r.x == r.t for r in got)
    whole = clean.interpolate(parts.cut(df, ["g"], "t", 12), ["x"], ["g"], "t", None, edges=True).collect()
    assert all(r.x == min(max(r.t, 5), 905) for r in whole) and len({r._part for r in whole}) == 12
    back = clean.interpolate_causal(df, ["x"], ["g"], "t").orderBy("t").collect()
    assert [r.x for r in back] == [None] * 5 + [5.0] * 900 + [905.0] * 95 and back[0].__fields__ == ["g", "t", "x"]


@pytest.mark.parametrize("count,halo", [(1, 7), (5, 7), (60, 50)])
def test_halos_of_parts_reach_all_rows_before(spark, count, halo):
    """Also where parts are much shorter than the halo."""
    df, plain = _series(spark, 2, SIZES, 0.2)

    def past(rows, order):
        return rows.withColumns({"lag": F.lag("x", halo).over(order), "sum": F.sum("x").over(order.rowsBetween(-halo, -1)), "n": F.count("*").over(order.rowsBetween(-halo, -1))})

    cut = parts.cut(df, ["g"], "t", count)
    got = parts.uncut(parts.with_halo(cut, past, halo)).toPandas().sort_values(["g", "t"], na_position="first")
    want = plain.sort_values(["g", "t"], na_position="first").copy()
    want["x"] = want["x"].astype(float)
    series = want.groupby("g", dropna=False)
    want["lag"] = series["x"].shift(halo)
    want["n"] = series.cumcount().clip(upper=halo)
    want["sum"] = series["x"].transform(lambda s: s.shift(1).rolling(halo, min_periods=1).sum())
    assert len(got) == len(want) and got["n"].tolist() == want["n"].tolist()
    for c in ("lag", "sum"):
        np.testing.assert_allclose(got[c].astype(float), want[c], equal_nan=True)


def test_parts_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert clean.interpolate(none, ["x"], ["g"], "t").count() == 0
    assert features.in_parts(none, lambda d, o: d.withColumn("l", F.lag("x").over(o)), 3, "g", "t").columns == [*none.columns, "l"]


def test_features_run_by_parts_with_one_road(spark):
    """With one series all parts work on it."""
    df = spark.range(2000).selectExpr("'r' AS road_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 30 * int(id)) AS timestamp", "CAST(id AS double) AS traffic_volume")
    cut = parts.cut(df, ["road_id"], "timestamp", 8)
    got = features.in_parts(cut, lambda d, o: d.withColumns(features.lags(["traffic_volume"], (1, 336), o)).withColumn("task", F.spark_partition_id()), 336)
    rows = got.collect()
    assert all(r.traffic_volume_lag336 == (r.traffic_volume - 336 if r.traffic_volume >= 336 else None) for r in rows) and len(rows) == 2000


@pytest.mark.parametrize("by", [["g"], ["g", "h"]])
def test_quantiles_by_group(spark, by):
    pick = np.random.default_rng(5)
    rows = [("hot" if k % 3 else f"g{k % 17}", k % 2, float(pick.integers(40)) / 4 if pick.random() < 0.8 else None, float(k)) for k in range(900)] + [("empty", 0, None, 1.0), (None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, h int, x double, w double")
    got = {tuple(r[c] for c in by): (r.a, r.b) for r in ranks.quantiles_by(df, by, {"a": F.col("x"), "b": F.col("w") * 2}, [0.1, 0.5, 0.9]).collect()}
    plain = pd.DataFrame(rows, columns=["g", "h", "x", "w"]).dropna(subset=["g"])
    want = {(k if isinstance(k, tuple) else (k,)): g for k, g in plain.groupby(by[0] if len(by) == 1 else by)}
    assert set(got) == set(want)
    for k, g in want.items():
        for found, column in zip(got[k], (g["x"], g["w"] * 2), strict=True):
            values = column.dropna()
            if len(values):
                np.testing.assert_allclose(found, np.quantile(values, [0.1, 0.5, 0.9]))
            else:
                assert found == [None] * 3


# ---- counters and guards
def test_counters_come_with_the_write(spark):
    seen = Observed()
    out = seen.stage(spark.range(10), "s", {"rows": F.count("*"), "odd": F.count_if(F.col("id") % 2 == 1), "none": F.sum(F.when(F.col("id") > 99, 1))})
    assert out.count() == 10 and seen.values == {("s", "rows"): 10, ("s", "odd"): 5, ("s", "none"): None}
    assert [tuple(r) for r in seen.table(spark, [("s", "odd"), ("s", "none")]).collect()] == [("s", "odd", 5.0), ("s", "none", None)]
    with pytest.raises(BrokenStage, match="s: 10 rows of 9"):
        seen.stage(spark.range(10), "s", {"rows": F.count("*")}, lambda found: None if found["rows"] == 9 else f"{found['rows']} rows of 9")
    assert seen.stage(spark.range(0), "e", {"rows": F.count("*")}).count() == 0 and seen.values["e", "rows"] == 0


def test_a_repeated_hour_of_weather_stops_the_join(spark):
    panel_rows = spark.createDataFrame([("w", 1, 1.0), ("w", 2, 2.0), (None, 3, 3.0)], "weather_station_id string, timestamp int, v double")
    weather = spark.createDataFrame([("w", 1, 20.0), ("u", 1, 21.0), (None, 3, 5.0), (None, 3, 6.0)], "station_id string, join_ts int, temperature double")
    got = enrich.with_weather(panel_rows, weather).orderBy("v").collect()
    assert [(r.v, r.temperature) for r in got] == [(1.0, 20.0), (2.0, None), (3.0, None)]
    twice = weather.unionAll(weather.where("station_id = 'w'"))
    with pytest.raises(Exception, match="weather: 2 rows of w, 1"):
        enrich.with_weather(panel_rows, twice).collect()
    with pytest.raises(Exception, match="calendar: 3 rows of 2024-01-01"):
        v.unique_by(spark.sql("SELECT DATE'2024-01-01' AS date, id AS flag FROM range(3)"), ["date"], "calendar").collect()


def test_a_repeated_day_of_the_calendar_stops_the_chain(spark):
    t = panel.Tables(spark, "/root/testdata/sf0.001")
    doubled = t.calendar.unionAll(t.calendar)
    with pytest.raises(Exception, match="calendar: 2 rows of"):
        panel.merged(panel.cleaned(t.valid), t.valid_weather, doubled)


# ---- models from sums
@pytest.fixture(scope="module")
def rows(spark):
    pick = np.random.default_rng(3)
    n = 1500
    x = pick.normal(size=(n, 3)) * [1, 100, 0.1] + [0, 5000, 7]
    noise = pick.standard_t(3, n)
    y = 3 + x @ [2.0, -0.01, 5.0] + noise * (1 + np.abs(x[:, 0]))
    label = (pick.random(n) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - (x[:, 1] - 5000) / 100)))).astype(float)
    data = [(*map(float, a), float(b), float(c), k // 375, 1.0) for k, (a, b, c) in enumerate(zip(x, y, label, strict=True))] + [(None, 1.0, 1.0, 1.0, 1.0, 0, 1.0), (1.0, float("nan"), 1.0, 1.0, 1.0, 0, 1.0)]
    return spark.createDataFrame(data, "a double, b double, c double, y double, label double, block int, one double").repartition(5).persist(), x, y, label


def test_least_squares_are_those_of_numpy(rows):
    df, x, y, _ = rows
    beta, table = fits.least_squares(df, ["a", "b", "c"], "y")
    np.testing.assert_allclose(beta, np.linalg.lstsq(np.column_stack((np.ones(len(x)), x)), y, rcond=None)[0], rtol=1e-6)
    got = {r.feature: r.standardised for r in table.collect()}
    np.testing.assert_allclose([got[f] for f in "abc"], beta[1:] * x.std(0), rtol=1e-6)
    flat, _ = fits.least_squares(df, ["a", "one", "b", "c"], "y")
    assert flat[2] == 0 and np.allclose(np.delete(flat, 2), beta, rtol=1e-6)


def test_logistic_regression_is_that_of_mllib(rows):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df, *_ = rows
    beta = fits.logistic_regression(df, ["a", "b"], "label")
    clean_rows = VectorAssembler(inputCols=["a", "b"], outputCol="v", handleInvalid="skip").transform(df)
    model = LogisticRegression(featuresCol="v", labelCol="label", tol=1e-12, maxIter=200).fit(clean_rows.where("NOT isnan(b)"))
    np.testing.assert_allclose(beta, [model.intercept, *model.coefficients.toArray()], rtol=1e-4)


def test_quantile_lines_hold_their_share_of_rows(rows):
    df, x, y, _ = rows
    found = fits.quantile_regression(df, ["a", "b", "c"], "y")
    full = np.column_stack((np.ones(len(x)), x))
    for q, beta in found.items():
        assert abs((y <= full @ beta).mean() - q) < 0.02


def test_forward_ridge_is_a_refit_of_every_fold(rows):
    df, x, y, _ = rows
    got = {(r.ridge, r.fold): (r.rmse, r.chosen) for r in fits.forward_ridge(df, ["a", "b", "c"], "y", "block", [0.0, 50.0]).collect()}
    block = np.arange(len(x)) // 375
    for strength in (0.0, 50.0):
        for fold in (1, 2, 3):
            a, b = x[block < fold], y[block < fold]
            centred = a - a.mean(0)
            beta = np.linalg.solve(centred.T @ centred + strength * np.eye(3), centred.T @ (b - b.mean()))
            left = y[block == fold] - b.mean() - (x[block == fold] - a.mean(0)) @ beta
            np.testing.assert_allclose(got[strength, fold][0], np.sqrt((left**2).mean()), rtol=1e-6)
    assert sum(chosen for _, chosen in got.values()) == 3


def test_tree_splits_are_the_best_of_all(rows):
    df, x, y, _ = rows
    keep = df.where("a IS NOT NULL AND NOT isnan(b)")
    tree = {r.node: r for r in fits.regression_tree(keep, ["a", "b"], "y", depth=2, bins=8, least=30).collect()}

    def best(rows_of):
        found = None
        for f in (0, 1):
            for cut in np.quantile(x[:, f], np.arange(1, 8) / 8):
                left = rows_of & (x[:, f] <= cut)
                right = rows_of & ~left
                if min(left.sum(), right.sum()) >= 30:
                    gain = y[left].sum() ** 2 / left.sum() + y[right].sum() ** 2 / right.sum() - y[rows_of].sum() ** 2 / rows_of.sum()
                    if found is None or gain > found[0] + 1e-6:
                        found = (gain, f, cut)
        return found

    here = {1: np.ones(len(x), bool)}
    for node in (1, 2, 3):
        gain, f, cut = best(here[node])
        assert (tree[node].feature, tree[node].n) == ("ab"[f], here[node].sum()) and abs(tree[node].threshold - cut) < 1e-9 and abs(tree[node].gain - gain) < 1e-3
        here[2 * node], here[2 * node + 1] = here[node] & (x[:, f] <= cut), here[node] & (x[:, f] > cut)
    assert all(abs(tree[k].mean - y[here[k]].mean()) < 1e-9 and tree[k].feature is None for k in (4, 5, 6, 7))
    shares = fits.tree_importance(fits.regression_tree(keep, ["a", "b"], "y", depth=2, bins=8, least=30)).collect()
    assert abs(sum(r.importance for r in shares) - 1) < 1e-12 and sorted(r["rank"] for r in shares) == list(range(1, len(shares) + 1))
