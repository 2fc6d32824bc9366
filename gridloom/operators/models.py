"""Distributed models: MLlib estimators over the feature table, each a DataFrame in and a DataFrame out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLASSES
from ..functions.columns import condition_label, confidence, label_of, logistic
from ..sources.tables import passing, staged
from . import fits, metrics, ranks

SEED = 42


def scaled(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """z-scores with the training rows' mean and population deviation; a constant feature is 0."""
    stats = df.where(F.col(split) == "train").agg(*(F.avg(f).alias(f"_m_{f}") for f in features), *(F.stddev_pop(f).alias(f"_s_{f}") for f in features))  # one row
    out = {f: F.coalesce((F.col(f) - F.col(f"_m_{f}")) / F.nullif(F.col(f"_s_{f}"), F.lit(0.0)), F.when(F.col(f).isNotNull(), F.lit(0.0))) for f in features}
    return df.crossJoin(F.broadcast(stats)).withColumns(out).drop(*(f"_{k}_{f}" for k in "ms" for f in features))


def baselines(df: DataFrame, y: str, label: str, split: str = "split") -> DataFrame:
    """Rows beyond training with the training mean of y, and the commonest training label."""
    stats = df.where(F.col(split) == "train").agg(F.avg(y).alias("mean_forecast"), F.mode(label, True).alias("majority"))
    return df.where(F.col(split) != "train").crossJoin(F.broadcast(stats))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * rows of the class)."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counted.crossJoin(F.broadcast(total)).select("label", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    return df.agg((F.count_if(F.col(label) == 0) / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias("weight"))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label)), df[label] == F.col("label")).drop("label")  # a row per class


#: Settings of the estimators; a caller's own come first.
REGRESSORS: dict[str, Callable] = {
    "linear": lambda **k: LinearRegression(**{"solver": "normal"} | k),
    "tree": lambda **k: DecisionTreeRegressor(**{"maxDepth": 12, "minInstancesPerNode": 20, "seed": SEED} | k),
    "forest": lambda **k: RandomForestRegressor(**{"numTrees": 60, "maxDepth": 12, "minInstancesPerNode": 4, "featureSubsetStrategy": "sqrt", "cacheNodeIds": True, "seed": SEED} | k),
    "boosted": lambda **k: GBTRegressor(**{"maxIter": 40, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.85, "seed": SEED} | k),
}
CLASSIFIERS: dict[str, Callable] = {
    "logistic": lambda **k: LogisticRegression(**{"weightCol": "weight", "maxIter": 50} | k),
    "tree": lambda **k: DecisionTreeClassifier(**{"maxDepth": 12, "minInstancesPerNode": 20, "seed": SEED, "weightCol": "weight"} | k),
    "forest": lambda **k: RandomForestClassifier(**{"numTrees": 60, "maxDepth": 12, "minInstancesPerNode": 4, "featureSubsetStrategy": "sqrt", "cacheNodeIds": True, "seed": SEED, "weightCol": "weight"} | k),
    "boosted": lambda **k: GBTClassifier(**{"maxIter": 10, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.85, "seed": SEED, "weightCol": "weight"} | k),
    "svm": lambda **k: LinearSVC(**{"weightCol": "weight", "maxIter": 50} | k),
}


#: A column with the vector of a row's features, whose names are in its metadata.
VECTOR = "_vector"


def _held(df: DataFrame) -> list[str] | None:
    """The names of the features whose vector came with the rows, if any."""
    return df.schema[VECTOR].metadata.get("names") if VECTOR in df.columns else None


def with_vector(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the features of each row as one vector, to be written with it: fitting then need not put them together again in each
    of its passes. A row with a null or NaN among them has none."""
    held = _held(df)
    if held and features[: len(held)] == held:  # a vector that is there is only made longer
        values = F.concat(F.when(F.col(VECTOR).isNotNull(), vector_to_array(VECTOR)), F.array(*(F.col(c).cast("double") for c in features[len(held) :])).cast("array<double>"))
    else:
        values = F.array(*(F.col(c).cast("double") for c in features))
    vector = F.when(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x)), array_to_vector(values))
    return df.withColumn(VECTOR, vector).withMetadata(VECTOR, {"names": features})


def vector_only(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the features' vector in place of the features, to be written so."""
    return with_vector(df, features).drop(*features)


def with_features(df: DataFrame, features: list[str]) -> DataFrame:
    """What ``vector_only`` left with the features as columns again, doubles worked out where they are asked for; null in a row without a vector."""
    listed = df.withColumn("_values", F.when(F.col(VECTOR).isNotNull(), vector_to_array(VECTOR)))
    return listed.select(*df.columns, *(F.col("_values")[i].alias(c) for i, c in enumerate(features)))


def _vectored(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the vector that came with the rows if it is that of these features, else a new one."""
    return df if _held(df) == features else with_vector(df, features)


def _points(train: DataFrame, features: list[str], kept: list[str]) -> DataFrame:
    """The kept columns and ``features``, the rows' vector; rows without one are left out."""
    return _vectored(train, features).where(F.col(VECTOR).isNotNull()).select(*kept, F.col(VECTOR).alias("features", metadata={}))


def fitted(train: DataFrame, features: list[str], label: str, estimator, scale: bool = False, classes: int = 2, scaler=None) -> PipelineModel:
    """One pipeline of assembler, scaler and estimator: what is fitted scaled is scored scaled. Rows with a null or NaN feature take no
    part in either. ``scaler`` is one fitted on the same rows before."""
    vector = "scaled" if scale else "features"
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")]
    weight = estimator.getOrDefault("weightCol") if estimator.hasParam("weightCol") and estimator.isDefined("weightCol") else None
    points = _points(train, features, [label, weight] if weight else [label])
    if scale:
        stages.append(scaler or StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(points))
        points = stages[-1].transform(points)
    estimator = estimator.copy({estimator.getParam("featuresCol"): vector, estimator.getParam("labelCol"): label})
    if estimator.hasParam("maxMemoryInMB"):  # trees: each partition hands on the histograms of all nodes, so there are no more than tasks at a time
        points = points.coalesce(points.sparkSession.sparkContext.defaultParallelism)
    if classes > 2 and isinstance(estimator, (GBTClassifier, LinearSVC)):
        estimator = OneVsRest(classifier=estimator, featuresCol=vector, labelCol=label, weightCol="weight")
    return PipelineModel([*stages, estimator.fit(points)])


def _argmax(model: OneVsRestModel, df: DataFrame) -> DataFrame:
    """``model.transform`` (the first class of the largest margin), without its Python functions."""
    margins, columns = [], df.columns
    for i, one in enumerate(model.models):
        names = {one.getParam(k): "" for k in ("predictionCol", "probabilityCol") if one.hasParam(k)}
        df = one.copy(names | {one.rawPredictionCol: f"_raw{i}"}).transform(df)
        margins.append(vector_to_array(f"_raw{i}")[1])
    listed = F.array(*margins)
    return df.withColumn("prediction", (F.array_position(listed, F.array_max(listed)) - 1).cast("double")).select(*columns, "prediction")


def scored_by(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with the model's columns; the vector that came with the rows is taken if it is that of the model's features."""
    names, stages = model.stages[0].getInputCols(), model.stages
    held = _held(df)
    if held and names[: len(held)] == held:
        df, stages = _vectored(df, names).where(F.col(VECTOR).isNotNull()).withColumn("features", F.col(VECTOR)).withMetadata("features", {}), stages[1:]
    for stage in stages:
        df = _argmax(stage, df) if isinstance(stage, OneVsRestModel) else stage.transform(df)
    return df


def predicted(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    scored = scored_by(model, df)
    return scored.withColumnRenamed("prediction", name).drop("features", "scaled", "rawPrediction", "probability")


def risk(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """The probability of class 1; an unbounded margin goes through the logistic function."""
    scored = scored_by(model, df)
    p = vector_to_array("probability")[1] if "probability" in scored.columns else logistic(vector_to_array("rawPrediction")[1])
    return scored.withColumn(name, p).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def coefficients(model: PipelineModel, features: list[str], df: DataFrame) -> DataFrame:
    """(feature, coefficient per deviation) of a linear model."""
    sd = df.agg(*(F.stddev_samp(f).alias(f) for f in features)).first()
    values = model.stages[-1].coefficients.toArray()
    scale = any(isinstance(s, type(model.stages[0])) is False and s.__class__.__name__ == "StandardScalerModel" for s in model.stages)
    return df.sparkSession.createDataFrame([(f, float(v if scale else v * (sd[f] or 0.0))) for f, v in zip(features, values, strict=True)], "feature string, coefficient double")


def importance(model: PipelineModel, features: list[str], df: DataFrame, top: int = 30) -> DataFrame:
    """(rank, feature, importance): tree importances or absolute coefficients, as shares of their sum."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(values.sum()) or 1.0
    rows = sorted(((f, float(v) / total) for f, v in zip(features, values, strict=True)), key=lambda r: (-r[1], r[0]))[:top]
    return df.sparkSession.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(rows)], "rank int, feature string, importance double")


def platt(calibrate: DataFrame, df: DataFrame, score: str, label: str, name: str) -> tuple[DataFrame, tuple[float, float]]:
    """(df with calibrated probabilities, (a, b)): a logistic curve over the score, fitted on held-out rows."""
    model = Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_v"), LogisticRegression(featuresCol="_v", labelCol=label)]).fit(calibrate)
    curve = model.stages[-1]
    a, b = float(curve.coefficients[0]), float(curve.intercept)
    return df.withColumn(name, logistic(F.lit(a) * F.col(score) + F.lit(b))), (a, b)


def forward_validation(df: DataFrame, features: list[str], label: str, candidates: dict[str, object], folds: int = 3, block: str = "block") -> DataFrame:
    """(candidate, mean_rmse, sd_rmse, chosen): fold i trains on blocks before i and validates on block i."""
    rows = []
    for name, estimator in candidates.items():
        for i in range(1, folds + 1):
            model = fitted(df.where(F.col(block) < i), features, label, estimator)
            found = metrics.regression(predicted(model, df.where(F.col(block) == i), "_p"), label, "_p").first()
            rows.append((name, i, found["rmse"]))
    each = df.sparkSession.createDataFrame(rows, "candidate string, fold int, rmse double")
    mean = each.groupBy("candidate").agg(F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("sd_rmse"))
    best = mean.agg(F.min_by("candidate", "mean_rmse").alias("best"))
    return mean.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("candidate") == F.col("best")).drop("best")


def residual_quantiles(val: DataFrame, y: str, p: str, keys: list[str], fallback: list[str], least: int = 30, quantiles=(0.1, 0.5, 0.9)) -> tuple[DataFrame, DataFrame]:
    """Quantiles of y - p on validation rows, by keys (groups of ``least`` rows) and by the fallback's keys."""
    rows = val.withColumn("_r", F.col(y) - F.col(p)).where("_r IS NOT NULL")
    enough = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    fine = ranks.quantiles_by(rows, keys, {"_q": F.col("_r")}, list(quantiles)).join(enough, keys)
    return fine, ranks.quantiles_by(rows, fallback, {"_qf": F.col("_r")}, list(quantiles))


def with_intervals(df: DataFrame, p: str, fine: DataFrame, coarse: DataFrame, keys: list[str], fallback: list[str], name: str = "volume") -> DataFrame:
    """p plus the quantiles of its group, sorted so that they never cross."""
    joined = df.join(fine, keys, "left").join(coarse, fallback, "left").withColumn("_q", F.coalesce("_q", "_qf"))
    ordered = F.array_sort(F.transform("_q", lambda q: q + F.col(p)))
    return joined.withColumns({f"{name}_p{n}": ordered[k] for k, n in enumerate((10, 50, 90))}).drop("_q", "_qf")


def scored_frame(df: DataFrame) -> DataFrame:
    """Decoded class, interval width and confidence label for scored rows."""
    return df.withColumns({
        "pred_congestion": label_of(F.col("pred_congestion_code")), "confidence_width": F.col("volume_p90") - F.col("volume_p10"),
        "confidence": confidence(F.col("volume_p10"), F.col("volume_p90"), F.col("pred_y_volume")),
    })


def with_condition(df: DataFrame) -> DataFrame:
    return df.withColumn("condition", condition_label(F.col("is_peak"), F.col("rain_flag")))


def sequence_stats(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """One row of training means and population deviations of each channel; a deviation of 0 counts as 1."""
    train = df.where(F.col(split) == "train")
    return train.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_sd") for c in columns))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


#: Ensembles of ``fit_panel``: smaller than the defaults, as each is fitted for every target.
PANEL_SETTINGS = {"forest": {"numTrees": 10, "maxDepth": 6}, "boosted": {"maxIter": 5, "maxDepth": 4}}
TARGETS = {"y_volume": "rmse", "y_speed": "rmse", "y_travel_time": "rmse", "y_congestion": "macro_f1", "y_accident": "roc_auc"}


@dataclass
class PanelModels:
    """A model for each target with what scoring needs besides: the curve of the incident risk (a, b), its threshold, and the
    residual quantiles of the volume; of targets that are not there they are None. ``board`` and ``cards`` tell how they were chosen."""

    names: list[str]
    kept: dict[str, tuple[str, PipelineModel]]
    curve: tuple[float, float] | None
    threshold: float | None
    fine: DataFrame | None
    coarse: DataFrame | None
    board: DataFrame
    cards: DataFrame

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with every target's forecast, the calibrated risk, its verdict and the intervals of the volume; a missing feature is
        an error. The condition of a row decides its interval, so is_peak and rain_flag are needed, too."""
        missing = [c for c in [*self.names, "road_id", "is_peak", "rain_flag"] if c not in rows.columns]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        out = _vectored(rows, self.names)
        for target, (_, model) in self.kept.items():
            out = _forecast(model, out, target)
        out = with_condition(out.drop(VECTOR))
        if self.curve is not None:
            out = out.withColumn("pred_accident_prob", logistic(F.lit(self.curve[0]) + F.lit(self.curve[1]) * F.col("pred_accident_raw")))
        if self.threshold is not None:
            out = out.withColumn("pred_accident", (F.col("pred_accident_prob") >= self.threshold).cast("int"))
        return out if self.fine is None else with_intervals(out, "pred_y_volume", self.fine, self.coarse, ["road_id", "condition"], ["condition"])

    def save(self, path: str) -> None:
        """Everything under one folder: models by target, tables as Parquet, numbers as one line of JSON."""
        for target, (_, model) in self.kept.items():
            save(model, f"{path}/models/{target}")
        for name in ("fine", "coarse", "board", "cards"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        numbers = {"names": self.names, "families": {t: n for t, (n, _) in self.kept.items()}, "curve": self.curve, "threshold": self.threshold, "intervals": self.fine is not None}
        self.board.sparkSession.createDataFrame([(json.dumps(numbers),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PanelModels:
        numbers = json.loads(spark.read.text(f"{path}/numbers").first()[0])
        kept = {t: (n, load(f"{path}/models/{t}")) for t, n in numbers["families"].items()}
        tables = (spark.read.parquet(f"{path}/{name}") if numbers["intervals"] or name in ("board", "cards") else None for name in ("fine", "coarse", "board", "cards"))
        return cls(numbers["names"], kept, numbers["curve"] and tuple(numbers["curve"]), numbers["threshold"], *tables)

    @classmethod
    def of(cls, found: dict[str, PanelModels]) -> PanelModels:
        """The models of these targets, each from the one given for it."""
        risk, volume = found.get("y_accident"), found.get("y_volume")
        board, cards = ([getattr(m, name).where(F.col("target") == t) for t, m in found.items()] for name in ("board", "cards"))
        return cls(
            next(iter(found.values())).names, {t: m.kept[t] for t, m in found.items()}, risk and risk.curve, risk and risk.threshold,
            volume and volume.fine, volume and volume.coarse, reduce(DataFrame.unionAll, board), reduce(DataFrame.unionAll, cards),
        )


def _forecast_name(target: str) -> str:
    return {"y_accident": "pred_accident_raw", "y_congestion": "pred_congestion_code"}.get(target, f"pred_{target}")


def _forecast(model: PipelineModel, rows: DataFrame, target: str) -> DataFrame:
    name = _forecast_name(target)
    if target == "y_accident":
        return risk(model, rows, name)
    scored = predicted(model, rows, name)
    return scored.withColumn(name, F.col(name).cast("int")) if target == "y_congestion" else scored


def forecasts(found: dict[tuple[str, str], PipelineModel], rows: DataFrame, features: list[str], kept: list[str]) -> DataFrame:
    """The kept columns and the forecast of each model (target, family), named by both, in one pass over the rows' vectors."""
    out = _vectored(rows, features).select(*kept, VECTOR).where(F.col(VECTOR).isNotNull())
    for (target, family), model in found.items():
        scored = _forecast(model, out, target)
        out = scored.withColumnRenamed(_forecast_name(target), f"{target}_by_{family}")
    return out.drop(VECTOR)


def _scores(scored: DataFrame, target: str) -> dict[str, dict]:
    """The metrics of a target on the validation and on the test rows."""
    if target == "y_accident":
        found = {p: metrics.ranking_quality(scored.where(f"split = '{p}'"), "y_accident", "pred_accident_raw").first() for p in ("val", "test")}
        return {p: {"roc_auc": r["roc_auc"]} for p, r in found.items()}
    if target == "y_congestion":
        labels = list(range(len(CLASSES)))
        tables = {p: metrics.confusion(scored.where(f"split = '{p}' AND y_congestion_code >= 0"), "y_congestion_code", "pred_congestion_code", labels) for p in ("val", "test")}
        found = {p: metrics.class_summary(metrics.per_class(t)).first() for p, t in tables.items()}
        return {p: {k: r[k] for k in ("accuracy", "macro_f1")} for p, r in found.items()}
    found = {r["split"]: r.asDict() for r in metrics.regression(scored, target, f"pred_{target}", ["split"]).collect()}
    return {p: {k: found.get(p, {}).get(k) for k in ("rmse", "mae", "r2")} for p in ("val", "test")}


def _better(metric: str, value: float | None, name: str) -> tuple:
    """Sorts the best model first: by its metric, one without a metric last, ties by name."""
    return (value is None, 0.0 if value is None else value if metric == "rmse" else -value, name)


#: Fits that run at a time: the passes of one fill the gaps that another leaves between its own.
AT_A_TIME = 3


def fit_panel(rows: DataFrame, names: list[str], families: tuple[str, ...] | None = None, targets: Iterable[str] | None = None) -> PanelModels:
    """Models for all targets, or those asked for, from one feature table (split train, val, test).

    For each target a model of each family (linear or logistic, tree, forest, boosted) is fitted on the training rows, and the
    best on the validation rows is kept: by rmse, macro F1 and ROC-AUC. The incident risk is calibrated on the earlier half of
    the validation rows, by time, and its threshold is chosen on the later half; both see scores of the kept model only. Intervals
    come from the kept volume model's validation residuals. A missing feature or target is an error.
    """
    asked = {t: m for t, m in TARGETS.items() if targets is None or t in targets}
    labels = {t: "y_congestion_code" if t == "y_congestion" else t for t in asked}
    missing = [c for c in [*names, "split", *labels.values()] if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    with passing(rows.sparkSession) as kept:
        found = _fit_panel(rows, names, families or ("linear", "tree", "forest", "boosted"), asked, labels)
        kept.extend(df for df in (found.fine, found.coarse) if df is not None)
    return found


def _fit_panel(rows: DataFrame, names: list[str], families: tuple[str, ...], asked: dict[str, str], labels: dict[str, str]) -> PanelModels:
    spark, train = rows.sparkSession, rows.where("split = 'train'")
    sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    board, cards, kept, best_rows = [], [], {}, {}

    def top(model: PipelineModel) -> str:
        last = model.stages[-1]
        if isinstance(last, OneVsRestModel):
            weights = sum(m.featureImportances.toArray() for m in last.models)
        elif not hasattr(last, "featureImportances") and getattr(last, "numClasses", 2) > 2:
            weights = abs(last.coefficientMatrix.toArray()).sum(axis=0)
        else:
            weights = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
        return ",".join(sorted(names, key=lambda n: (-weights[names.index(n)], n))[:5])

    scaler, wanted = None, {}
    if "linear" in families and "rmse" in asked.values():  # the numbers have the same training rows
        scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(_points(train, names, []))
    for target, metric in asked.items():
        label = labels[target]
        source = train if metric == "rmse" else staged(_vectored(with_weights(train.where(f"{label} >= 0"), label), names).select(label, "weight", VECTOR))
        for family in families:
            name = "logistic" if family == "linear" and metric != "rmse" else family
            estimator = (REGRESSORS if metric == "rmse" else CLASSIFIERS)[name](**PANEL_SETTINGS.get(family, {}))
            wanted[target, name] = source, names, label, estimator, family == "linear", len(CLASSES) if target == "y_congestion" else 2, scaler if metric == "rmse" else None
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        models = dict(zip(wanted, pool.map(lambda w: fitted(*w), wanted.values()), strict=True))
    later = rows.where("split <> 'train'")
    if "y_congestion" in asked:
        later = later.withColumn("y_congestion_code", F.col("y_congestion_code").cast("int"))
    later = staged(forecasts(models, later, names, ["road_id", "timestamp", "split", *labels.values(), "is_peak", "rain_flag"]))

    def judged_by(key: tuple[str, str]) -> tuple[DataFrame, dict[str, dict]]:
        target, name = key
        scored = later.select("road_id", "timestamp", "split", labels[target], F.col(f"{target}_by_{name}").alias(_forecast_name(target)), "is_peak", "rain_flag")
        return scored, _scores(scored, target)

    with ThreadPoolExecutor(AT_A_TIME) as pool:
        judged = dict(zip(models, pool.map(judged_by, models), strict=True))
    for target, metric in asked.items():
        tried = {n: (models[t, n], *judged[t, n]) for t, n in models if t == target}
        order = sorted(tried, key=lambda n: _better(metric, tried[n][2]["val"][metric], n))
        best = order[0]
        for name, (_, _, found) in tried.items():
            board.extend((target, name, k, float(x), name == best) for k, x in found["test"].items() if x is not None)
        kept[target], best_rows[target] = (best, tried[best][0]), tried[best][1]
        value = tried[best][2]["test"][metric]
        cards.append([target, best, len(names), sizes.get("train", 0), sizes.get("test", 0), metric, None if value is None else float(value), None, top(tried[best][0])])
    curve = threshold = fine = coarse = None
    if "y_accident" in asked:
        val = best_rows["y_accident"].where("split = 'val'").withColumn("_s", F.unix_timestamp(F.col("timestamp").cast("timestamp")))
        span = val.agg(F.min("_s").alias("a"), F.max("_s").alias("b")).first()
        middle = (span["a"] + span["b"]) / 2 if span["a"] is not None else 0
        curve = tuple(map(float, fits.logistic_regression(val.where(F.col("_s") <= middle), ["pred_accident_raw"], "y_accident")))
        late = val.where(F.col("_s") > middle).withColumn("p", logistic(F.lit(curve[0]) + F.lit(curve[1]) * F.col("pred_accident_raw")))
        at = metrics.best_threshold(late, "y_accident", "p").first()
        threshold = float(at["threshold"]) if at and at["threshold"] is not None else None
        cards[-1][7] = threshold
    if "y_volume" in asked:
        residuals = with_condition(best_rows["y_volume"].where("split = 'val'"))
        fine, coarse = map(staged, residual_quantiles(residuals, "y_volume", "pred_y_volume", ["road_id", "condition"], ["condition"]))
    kinds = "target string, model string, n_features int, train_rows long, test_rows long, metric string, value double, threshold double, top_features string"
    tables = spark.createDataFrame(board, "target string, model string, metric string, value double, chosen boolean"), spark.createDataFrame([tuple(c) for c in cards], kinds)
    return PanelModels(names, kept, curve, threshold, fine, coarse, *tables)


def panel_models(rows: DataFrame, names: list[str], path: str | None = None, families: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored test rows, board of all models' test metrics, a card for each target) of ``fit_panel``. Given a path, the models are
    written there and the rows are scored by what is read back."""
    found = fit_panel(rows, names, families)
    if path:
        found.save(path)
        found = PanelModels.load(rows.sparkSession, path)
    return staged(found.score(rows.where("split = 'test'"))), found.board, found.cards
