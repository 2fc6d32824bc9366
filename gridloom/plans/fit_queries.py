"""Queries of models fitted from sums (``operators.fits``) and of windows over all channels, each with SQL that fits the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SEQUENCE_CHANNELS
from ..operators import features, fits, metrics, models
from ..sources.tables import staged
from .panel import Tables

XS = ["traffic_volume_lag1", "hour"]
TREE_XS = ["traffic_volume_lag1", "hour", "is_peak"]
RIDGES = [0.0, 1e5, 1e8]
BINS, LEAST = 16, 20

_TRAIN = "SELECT y_volume AS y, traffic_volume_lag1 AS a, hour AS b FROM split WHERE split = 'train' AND traffic_volume_lag1 IS NOT NULL"
_OLS = f"""SELECT *, my - ca * ma - cb * mb AS c0 FROM (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ca, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS cb FROM (
    SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM ({_TRAIN})))"""


def _train(t: Tables) -> DataFrame:
    return t.split.where("split = 'train'")


def _normal(t: Tables) -> DataFrame:
    beta, _ = fits.least_squares(_train(t), XS, "y_volume")
    rows = t.split.where("split = 'test' AND traffic_volume_lag1 IS NOT NULL")
    return rows.select("road_id", "timestamp", "y_volume", fits.line(beta, XS).alias("pred_y_volume"))


def _newton(t: Tables) -> DataFrame:
    """The chance of an incident by the load before, classes weighing alike."""
    rows = staged(models.with_weights(_train(t).where("traffic_volume_lag1 IS NOT NULL"), "y_accident").withColumn("x", F.col("traffic_volume_lag1") / 100))
    beta = fits.logistic_regression(rows, ["x"], "y_accident", F.col("weight"))
    return t.spark.createDataFrame([("intercept", float(beta[0])), ("x", float(beta[1]))], "term string, value double")


def _logit_sql(rows: str) -> str:
    """Newton's steps over rows (y, x, w): (a, b) of the last one."""
    return f"""WITH RECURSIVE z AS MATERIALIZED ({rows}), fit(i, a, b) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
        SELECT i + 1, (t0 - c * s1) / s0, c FROM (SELECT *, (t1 - s1 * t0 / s0) / (s2 - s1 * s1 / s0) AS c FROM (
            SELECT i, sum(h) AS s0, sum(h * x) AS s1, sum(h * x * x) AS s2, sum(h * u) AS t0, sum(h * x * u) AS t1 FROM (
                SELECT i, x, w * p * (1 - p) AS h, eta + (y - p) / (p * (1 - p)) AS u FROM (
                    SELECT i, x, y, w, a + b * x AS eta, greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-(a + b * x))))) AS p FROM fit, z)) GROUP BY i)) WHERE i < 15)
        SELECT a, b FROM fit WHERE i = 15"""


def _platt(t: Tables) -> DataFrame:
    """Calibration of the risk on the earlier half of the validation rows, by time; scores of the test rows before and after."""
    val = t.split.where("split = 'val'").withColumn("s", F.unix_timestamp(F.col("timestamp").cast("timestamp")))
    middle = val.select("s").distinct().agg(((F.min("s") + F.max("s")) / 2).alias("_mid"))  # one row
    early = staged(val.crossJoin(F.broadcast(middle)).where("s <= _mid"))
    a, b = fits.logistic_regression(early, ["pred_accident_prob"], "y_accident")
    test = t.split.where("split = 'test'").withColumn("calibrated", 1 / (1 + F.exp(-fits.line([a, b], ["pred_accident_prob"]))))
    scores = test.agg(*(F.avg((F.col(c) - F.col("y_accident")) ** 2).alias(n) for n, c in (("brier_raw", "pred_accident_prob"), ("brier_calibrated", "calibrated"))), F.avg("calibrated").alias("mean_calibrated"))
    return scores.select(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), "brier_raw", "brier_calibrated", "mean_calibrated")


_PLATT_ROWS = """SELECT y_accident AS y, pred_accident_prob AS x, 1 AS w FROM split WHERE split = 'val' AND epoch(timestamp) <= (SELECT (min(epoch(timestamp)) + max(epoch(timestamp))) / 2 FROM split WHERE split = 'val')"""


def _quantile_lines(t: Tables) -> dict:
    return fits.quantile_regression(staged(_train(t).where("traffic_volume_lag1 IS NOT NULL").select("y_volume", "traffic_volume_lag1")), ["traffic_volume_lag1"], "y_volume")


def _lines(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(float(q), float(b[0]), float(b[1])) for q, b in _quantile_lines(t).items()], "quantile double, intercept double, slope double")


def _line_coverage(t: Tables) -> DataFrame:
    """Coverage of the test rows by the lines of 10 % and 90 %, and whether it is within 0.06 of 0.80."""
    lines = _quantile_lines(t)
    each = {f"p{round(100 * q)}": fits.line(b, ["traffic_volume_lag1"]) for q, b in lines.items()}
    test = t.split.where("split = 'test' AND traffic_volume_lag1 IS NOT NULL").withColumns(each)
    ordered = F.array_sort(F.array(*each))
    found = metrics.coverage(test.withColumns({"low": ordered[0], "high": ordered[2]}), "y_volume", "low", "high")
    return found.withColumn("near_nominal", F.abs(F.col("coverage") - 0.80) <= 0.06)


_QUANTILES = f"""WITH RECURSIVE z AS MATERIALIZED (SELECT y, a AS x FROM ({_TRAIN})),
    fit(i, q, a, b) AS (SELECT 0, q, (SELECT regr_intercept(y, x) FROM z), (SELECT regr_slope(y, x) FROM z) FROM (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q) UNION ALL
        SELECT i + 1, q, (t0 - c * s1) / s0, c FROM (SELECT *, (t1 - s1 * t0 / s0) / (s2 - s1 * s1 / s0) AS c FROM (
            SELECT i, q, sum(h) AS s0, sum(h * x) AS s1, sum(h * x * x) AS s2, sum(h * y) AS t0, sum(h * x * y) AS t1 FROM (
                SELECT i, q, x, y, CASE WHEN y - a - b * x >= 0 THEN q ELSE 1 - q END / greatest(abs(y - a - b * x), 0.1) AS h FROM fit, z) GROUP BY i, q)) WHERE i < 40)
    SELECT q AS quantile, a AS intercept, b AS slope FROM fit WHERE i = 40"""


def _ridge(t: Tables) -> DataFrame:
    folds = features.forward_folds(_train(t).where("traffic_volume_lag1 IS NOT NULL"))
    return fits.forward_ridge(folds, ["traffic_volume_lag1"], "y_volume", "block", RIDGES)


_RIDGE = f"""WITH z AS (SELECT timestamp, y_volume AS y, traffic_volume_lag1 AS x FROM split WHERE split = 'train' AND traffic_volume_lag1 IS NOT NULL),
    times AS (SELECT timestamp, ntile(4) OVER (ORDER BY timestamp) - 1 AS block FROM (SELECT DISTINCT timestamp FROM z)),
    b AS (SELECT block, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM z JOIN times USING (timestamp) GROUP BY 1),
    p AS (SELECT *, {', '.join(f'sum({c}) OVER w AS p{c}' for c in ('n', 'sx', 'sy', 'sxx', 'sxy'))} FROM b WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, (psxy - psx * psy / pn) / (psxx - psx * psx / pn + ridge) AS m FROM p, (SELECT unnest({RIDGES}) AS ridge) WHERE pn IS NOT NULL),
    e AS (SELECT ridge, block AS fold, sqrt((syy + n * c * c + m * m * sxx + 2 * c * m * sx - 2 * c * sy - 2 * m * sxy) / n) AS rmse FROM (SELECT *, psy / pn - m * psx / pn AS c FROM f)),
    s AS (SELECT ridge, avg(rmse) AS mean_rmse, stddev_pop(rmse) AS sd_rmse FROM e GROUP BY 1)
    SELECT e.ridge, e.fold, e.rmse, s.mean_rmse, s.sd_rmse, s.ridge = (SELECT ridge FROM s ORDER BY mean_rmse, ridge LIMIT 1) AS chosen FROM e JOIN s USING (ridge)"""


def _tree(t: Tables) -> DataFrame:
    rows = staged(_train(t).select("y_volume", *TREE_XS))
    return fits.regression_tree(rows, TREE_XS, "y_volume", depth=3, bins=BINS, least=LEAST)


def _tree_sql(depth: int = 3) -> str:
    n = len(TREE_XS)
    at = [k / BINS for k in range(1, BINS)]
    parts = [
        f"z AS MATERIALIZED (SELECT y_volume AS y, {', '.join(f'{f}::DOUBLE AS f{i}' for i, f in enumerate(TREE_XS))} FROM split WHERE split = 'train')",
        f"cuts AS MATERIALIZED (SELECT {', '.join(f'list_sort(list_distinct(quantile_cont(f{i}, {at}))) AS c{i}' for i in range(n))} FROM z)",
        f"rows0 AS MATERIALIZED (SELECT y, {', '.join(f'CASE WHEN f{i} IS NULL THEN len(c{i}) ELSE len(list_filter(c{i}, lambda c: f{i} > c)) END AS b{i}' for i in range(n))}, 1 AS node FROM z, cuts)",
    ]
    bins, picked = ", ".join(f"b{i}" for i in range(n)), "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(n)) + " END"
    for d in range(depth + 1):
        parts.append(f"total{d} AS MATERIALIZED (SELECT node, count(*) AS n, avg(y) AS mean FROM rows{d} GROUP BY 1)")
        if d == depth:
            break
        parts += [
            f"sums{d} AS (SELECT node, f, bin, count(*) AS n, sum(y) AS s FROM (SELECT node, y, unnest({list(range(n))}) AS f, unnest([{bins}]) AS bin FROM rows{d}) GROUP BY ALL)",
            f"run{d} AS (SELECT node, f, bin, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER v AS nt, sum(s) OVER v AS st FROM sums{d} WINDOW w AS (PARTITION BY node, f ORDER BY bin), v AS (PARTITION BY node, f))",
            f"best{d} AS MATERIALIZED (SELECT * FROM (SELECT node, f, bin, round(sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt, 6) AS gain FROM run{d} WHERE nl >= {LEAST} AND nt - nl >= {LEAST}) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1)",
            f"rows{d + 1} AS MATERIALIZED (SELECT y, {bins}, 2 * r.node + ({picked} > bin)::INT AS node FROM rows{d} r JOIN best{d} USING (node))",
        ]
    threshold = "CASE f " + " ".join(f"WHEN {i} THEN c{i}[bin + 1]" for i in range(n)) + " END"
    grown = " UNION ALL ".join(f"SELECT t.node, f, bin, gain, n, mean FROM total{d} t LEFT JOIN best{d} USING (node)" for d in range(depth))
    return f"WITH {', '.join(parts)} SELECT node, list_extract({TREE_XS}, f + 1) AS feature, {threshold} AS threshold, gain, n, mean FROM ({grown} UNION ALL SELECT node, NULL, NULL, NULL, n, mean FROM total{depth}), cuts"


def _sequences(t: Tables) -> DataFrame:
    """Of each window of 12 rows: the oldest, the newest and the mean value of all 16 channels, nulls being 0."""
    rows = features.clock(t.lite).select("road_id", "timestamp", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SEQUENCE_CHANNELS))
    windows = features.in_parts(rows, lambda df, order: features.sequences(df, SEQUENCE_CHANNELS, order=order), halo=12)

    def three(c: str) -> list[Column]:
        total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[c])
        return [F.col("window")[0][c].alias(f"{c}_oldest"), F.col("window")[11][c].alias(f"{c}_newest"), (total / 12).alias(f"{c}_mean")]

    return windows.select("road_id", "timestamp", *(x for c in SEQUENCE_CHANNELS for x in three(c)))


_SEQUENCE_PARTS = ", ".join(f"first_value(coalesce({c}, 0)::DOUBLE) OVER w AS {c}_oldest, last_value(coalesce({c}, 0)::DOUBLE) OVER w AS {c}_newest, avg(coalesce({c}, 0)::DOUBLE) OVER w AS {c}_mean" for c in SEQUENCE_CHANNELS)
_SEQUENCES = f"SELECT * EXCLUDE (c) FROM (SELECT road_id, timestamp, count(*) OVER w AS c, {_SEQUENCE_PARTS} FROM history WINDOW w AS (PARTITION BY road_id ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE c = 12"


def _channel_stats(t: Tables) -> DataFrame:
    rows = features.with_split(features.clock(t.lite))
    stats = models.sequence_stats(rows.select("split", *(F.col(c).cast("double").alias(c) for c in SEQUENCE_CHANNELS)), SEQUENCE_CHANNELS)
    listed = ", ".join(f"'{c}', {c}_mean, {c}_sd" for c in SEQUENCE_CHANNELS)
    return stats.selectExpr(f"stack({len(SEQUENCE_CHANNELS)}, {listed}) AS (channel, mean, sd)")


_STATS = f"""SELECT unnest([{', '.join(repr(c) for c in SEQUENCE_CHANNELS)}]) AS channel, unnest([{', '.join(f'avg({c}::DOUBLE)' for c in SEQUENCE_CHANNELS)}]) AS mean,
    unnest([{', '.join(f'coalesce(nullif(stddev_pop({c}::DOUBLE), 0), 1)' for c in SEQUENCE_CHANNELS)}]) AS sd
    FROM history, (SELECT min(timestamp) AS a, epoch(max(timestamp)) - epoch(min(timestamp)) AS s FROM lite) WHERE timestamp <= a + to_seconds(floor(s * 0.7))"""


def register(add: Callable, r: Callable) -> None:
    add("m3_normal_equations", lambda t: r(_normal(t)), f"SELECT road_id, timestamp, y_volume, c0 + ca * traffic_volume_lag1 + cb * hour AS pred_y_volume FROM split, ({_OLS}) WHERE split = 'test' AND traffic_volume_lag1 IS NOT NULL", "pred_y_volume")
    add("m4_standardised_coefficients", lambda t: r(fits.least_squares(_train(t), XS, "y_volume")[1]), f"SELECT unnest(['intercept', '{XS[0]}', '{XS[1]}']) AS feature, unnest([c0, ca, cb]) AS coefficient, unnest([NULL, ca * sqrt(saa), cb * sqrt(sbb)]) AS standardised FROM ({_OLS})", "coefficient standardised")
    weighed = "SELECT y_accident AS y, traffic_volume_lag1 / 100 AS x, n / (k * m) AS w FROM split JOIN (SELECT y_accident, count(*) AS m, sum(count(*)) OVER () AS n, count(*) OVER () AS k FROM split WHERE split = 'train' AND traffic_volume_lag1 IS NOT NULL GROUP BY 1) USING (y_accident) WHERE split = 'train' AND traffic_volume_lag1 IS NOT NULL"
    add("m5_newton_logistic", lambda t: r(_newton(t)), f"SELECT unnest(['intercept', 'x']) AS term, unnest([a, b]) AS value FROM ({_logit_sql(weighed)})", "value")
    add("m6_histogram_tree", lambda t: r(_tree(t), 4), f"SELECT * REPLACE (round(threshold, 4) AS threshold, round(gain, 4) AS gain, round(mean, 4) AS mean) FROM ({_tree_sql()})")
    add("m15_tree_importance", lambda t: r(fits.tree_importance(_tree(t))), f"SELECT *, row_number() OVER (ORDER BY importance DESC, feature)::INT AS rank FROM (SELECT feature, sum(gain) / sum(sum(gain)) OVER () AS importance FROM ({_tree_sql()}) WHERE feature IS NOT NULL GROUP BY 1)", "importance")
    add("m11_platt_newton", lambda t: r(_platt(t)), f"""SELECT a, b, avg((pred_accident_prob - y_accident) ** 2) AS brier_raw, avg((1 / (1 + exp(-(a + b * pred_accident_prob))) - y_accident) ** 2) AS brier_calibrated, avg(1 / (1 + exp(-(a + b * pred_accident_prob)))) AS mean_calibrated
        FROM split, ({_logit_sql(_PLATT_ROWS)}) WHERE split = 'test' GROUP BY a, b""", "a b brier_raw brier_calibrated mean_calibrated")  # fmt: skip
    add("m12_forward_ridge", lambda t: r(_ridge(t)), _RIDGE, "rmse mean_rmse sd_rmse")
    add("m14_quantile_lines", lambda t: r(_lines(t), 3), f"SELECT quantile, round(intercept, 3) AS intercept, round(slope, 3) AS slope FROM ({_QUANTILES})")
    bounds = "list_sort([{0}])".format(", ".join(f"(SELECT intercept FROM fit WHERE quantile = {q}) + (SELECT slope FROM fit WHERE quantile = {q}) * traffic_volume_lag1" for q in (0.1, 0.5, 0.9)))
    add("m14_quantile_coverage", lambda t: r(_line_coverage(t), 3), f"""WITH fit AS MATERIALIZED ({_QUANTILES}), rows AS (SELECT y_volume, {bounds} AS q FROM split WHERE split = 'test' AND traffic_volume_lag1 IS NOT NULL)
        SELECT round(avg((y_volume BETWEEN q[1] AND q[3])::INT), 3) AS coverage, round(avg(q[3] - q[1]), 3) AS mean_width, round(median(q[3] - q[1]), 3) AS median_width, round(avg(q[3] - q[1]) / avg(y_volume) * 100, 3) AS width_pct_of_mean,
        abs(avg((y_volume BETWEEN q[1] AND q[3])::INT) - 0.80) <= 0.06 AS near_nominal FROM rows""")  # fmt: skip
    add("w14_channel_windows", lambda t: r(_sequences(t)), _SEQUENCES, " ".join(f"{c}_{k}" for c in SEQUENCE_CHANNELS for k in ("oldest", "newest", "mean")))
    add("m18_channel_stats", lambda t: r(_channel_stats(t)), _STATS, "mean sd")
