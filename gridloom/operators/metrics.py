"""Evaluation as aggregations: one pass where the measure allows it, ranked frames of distinct scores where not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranks


def regression(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """rmse, mae, mape (rows with |y| <= 1e-6 do not count), r2, n; by group if asked."""
    e = F.col(p) - F.col(y)
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    return df.where(ok).groupBy(*(by or [])).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(F.abs(y) > 1e-6, F.abs(e / F.nullif(F.col(y), F.lit(0.0))))) * 100).alias("mape"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"), F.count("*").alias("n"),
    )


def breakdown(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    e = F.col(p) - F.col(y)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return rows.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.count("*").alias("n"))


def confusion(df: DataFrame, y: str, p: str, labels: list) -> DataFrame:
    """(actual, predicted, n) for every pair of labels, zeros included."""
    names = df.sparkSession.createDataFrame([(x,) for x in labels], ["label"])
    cells = names.withColumnRenamed("label", "actual").crossJoin(names.withColumnRenamed("label", "predicted"))  # labels squared
    n = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(n, ["actual", "predicted"], "left").fillna(0, ["n"])


def row_shares(matrix: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("actual"))
    return matrix.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def per_class(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each label; a measure without rows is 0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    given = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("given"))
    zero = F.lit(0.0)
    both = actual.join(given, "label").withColumns({
        "precision": F.coalesce(F.col("hits") / F.nullif(F.col("given"), F.lit(0)), zero), "recall": F.coalesce(F.col("hits") / F.nullif(F.col("support"), F.lit(0)), zero),
    })
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero), zero)
    return both.withColumn("f1", f1)


def class_summary(classes: DataFrame) -> DataFrame:
    """accuracy, macro and weighted f1, macro precision and recall, over labels that occur on either side."""
    total = F.sum("support")
    return classes.where("support > 0 OR given > 0").agg(
        (F.sum("hits") / total).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
    )


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, tp, fp, ctp, cfp): positives and negatives at each distinct score, and from the highest down to it."""
    counted = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("score"))
    counted = counted.agg(F.count_if(F.col(y) == 1).alias("tp"), F.count_if(F.col(y) != 1).alias("fp"))
    return ranks.running(counted, "score", ["tp", "fp"], descending=True).withColumnsRenamed({"upto_tp": "ctp", "upto_fp": "cfp"})


def ranking_quality(df: DataFrame, y: str, score: str, digits: int | None = 6) -> DataFrame:
    """roc_auc (ties count half) and average_precision (step-wise). Scores are rounded to ``digits`` first, if any, and
    counted by value."""
    df = df.withColumn("_s", F.round(score, digits) if digits is not None else F.col(score))
    frame = _by_score(df, y, "_s")
    p, n = F.sum("tp").cast("double"), F.sum("fp").cast("double")
    return frame.agg(
        (F.sum(F.col("fp") * (F.col("ctp") - F.col("tp")) + 0.5 * F.col("fp") * F.col("tp")) / F.nullif(p * n, F.lit(0.0))).alias("roc_auc"),
        (F.sum(F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))) / F.nullif(p, F.lit(0.0))).alias("average_precision"),
    )


def at_threshold(df: DataFrame, y: str, score: str, threshold: Column | float) -> DataFrame:
    given, true = F.col(score) >= threshold, F.col(y) == 1
    counted = df.agg(F.count_if(given & true).alias("tp"), F.count_if(given & ~true).alias("fp"), F.count_if(~given & true).alias("fn"), F.count("*").alias("n"))
    return counted.select(*_measures(), ((F.col("tp") + F.col("fp")) / F.col("n")).alias("flagged_rate"))


def _measures() -> list[Column]:
    zero = F.lit(0)
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), zero), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), zero), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), zero), F.lit(0.0))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def top_share_lift(df: DataFrame, y: str, score: str, key: list[str], share: float = 0.1) -> DataFrame:
    """Rate of positives among the highest max(1, int(share * n)) scores (ties by key), and its lift over all rows.

    The rows above the k-th score are counted by distinct scores. Ties at that score are counted by key and ranked by running
    totals over their partitions, as all of them may be one.
    """
    rows = df.where(F.col(score).isNotNull())
    every = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).cast("long").alias("k"), F.avg((F.col(y) == 1).cast("double")).alias("base"))
    counted = rows.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("c"), F.count_if(F.col(y) == 1).alias("pos"))
    levels = ranks.running(counted, "_s", ["c", "pos"], descending=True).crossJoin(F.broadcast(every))
    edge = levels.where("upto_c >= k").orderBy("upto_c").limit(1).selectExpr("_s AS edge", "k", "base", "k - (upto_c - c) AS take", "upto_pos - pos AS above")
    ties = rows.join(F.broadcast(edge), rows[score] == edge["edge"])
    ties = ties.groupBy(F.struct(*key).alias("_k"), "take").agg(F.count("*").alias("c"), F.count_if(F.col(y) == 1).alias("pos"))
    placed = ranks.running(ties, "_k", ["c"]).withColumn("in", F.greatest(F.lit(0), F.least(F.col("c"), F.col("take") - (F.col("upto_c") - F.col("c")))))
    picked = placed.agg(F.coalesce(F.sum(F.least("pos", "in")), F.lit(0)).alias("tied"))  # of rows with one key positives come first
    rate = (F.col("above") + F.col("tied")) / F.col("k")
    return edge.crossJoin(picked).select("k", rate.alias("top_rate"), (rate / F.nullif(F.col("base"), F.lit(0.0))).alias("lift"))


def best_threshold(df: DataFrame, y: str, score: str, steps: int = 120, low: float = 0.5, high: float = 0.999) -> DataFrame:
    """(threshold, f1): of ``steps`` quantiles of the score, the one of highest f1; of equals the lowest.

    Rows are first counted by the candidate interval they fall in; f1 then comes from sums over the candidates.
    """
    at = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    rows = df.where(F.col(score).isNotNull())
    candidates = ranks.quantiles(rows, score, at).withColumnRenamed("q", "t")
    place = F.size(F.filter("t", lambda t: t <= F.col(score)))
    counted = rows.crossJoin(F.broadcast(candidates)).groupBy(place.alias("place")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count("*").alias("all"))
    totals = counted.agg(F.sum("pos").alias("positives"))
    listed = candidates.select(F.posexplode("t").alias("i", "threshold"))
    sums = listed.crossJoin(F.broadcast(counted)).where("place > i").groupBy("i", "threshold").agg(F.sum("pos").alias("tp"), F.sum("all").alias("given"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("given") + F.col("positives"), F.lit(0)), F.lit(0.0))
    return sums.crossJoin(F.broadcast(totals)).select("i", "threshold", f1.alias("f1")).orderBy(F.desc("f1"), "i").limit(1).select("threshold", "f1")


def coverage(df: DataFrame, y: str, low: str, high: str) -> DataFrame:
    width = F.col(high) - F.col(low)
    rows = df.where(F.col(y).isNotNull() & width.isNotNull()).withColumn("_w", width)
    found = rows.agg(
        F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.avg("_w").alias("mean_width"),
        (F.avg("_w") / F.nullif(F.avg(y), F.lit(0.0)) * 100).alias("width_pct_of_mean"),
    )
    middle = ranks.medians(rows, ["_w"]).select(F.col("_w").alias("median_width"))
    return found.crossJoin(middle).select("coverage", "mean_width", "median_width", "width_pct_of_mean")  # a row each


def calibration(df: DataFrame, y: str, raw: str, calibrated: str) -> DataFrame:
    return df.agg(
        F.avg(F.pow(F.col(raw) - F.col(y), 2)).alias("brier_raw"), F.avg(F.pow(F.col(calibrated) - F.col(y), 2)).alias("brier_calibrated"),
        F.avg(calibrated).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"),
    )


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))


def scoreboard(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(target, model, metric, value) -> one row per target and model with a column per metric."""
    return metrics.groupBy("target", "model").pivot("metric", names).agg(F.first("value"))


def winners(metrics: DataFrame, best: dict[str, tuple[str, str]]) -> DataFrame:
    """Per target the model of lowest ("min") or highest ("max") value of its deciding metric; ties by name."""
    sign = F.lit(None).cast("double")
    for target, (metric, way) in best.items():
        sign = F.when((F.col("target") == target) & (F.col("metric") == metric), F.lit(1.0 if way == "min" else -1.0)).otherwise(sign)
    rows = metrics.withColumn("_v", sign * F.col("value")).where("_v IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("target").orderBy("_v", "model"))
    return rows.withColumn("_n", first).where("_n = 1").select("target", "model", "metric", "value")
