"""Models fitted from sums over the rows: least squares, ridge over forward folds, logistic and quantile regression, and trees.

Each pass over the table yields a small matrix or a table of counts, whatever the number of rows: weighted sums of products
of columns (``grams``) for the linear models, sums by node, feature and bin for the trees. What is solved on the driver has the
size of the features. All ties are broken by a total order, so that SQL can fit the same models.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import staged
from . import ranks


def grams(df: DataFrame, columns: list[str], weights: dict[str, Column] | None = None, by: str | None = None) -> dict[tuple[int, str], np.ndarray]:
    """{(block, weight's name): sums of w * x_i * x_j over the rows of a block}, x being 1 and the columns, all in one pass.

    Rows with a null or NaN in a column, weight or block are left out. ``by`` is a column of small whole numbers, else the block is
    0. Each task adds up its rows and gives one matrix for each block and weight.
    """
    weights = weights or {"": F.lit(1.0)}
    names, k = list(weights), len(columns)
    sent = df.select(
        (F.col(by) if by else F.lit(0)).cast("int").alias("b"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.array(*(w.cast("double") for w in weights.values())).alias("w")
    )

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            x, w = (np.asarray(batch.column(n).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, m) for n, m in ((1, k), (2, len(names))))
            good = ~np.isnan(block) & ~np.isnan(x).any(1) & ~np.isnan(w).any(1)
            x, w, block = np.hstack((np.ones((int(good.sum()), 1)), x[good])), w[good], block[good].astype(int)
            for b in np.unique(block):
                own = block == b
                here = np.stack([(x[own] * w[own, n : n + 1]).T @ x[own] for n in range(len(names))])
                found[b] = found[b] + here if b in found else here
        for b, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], ["b", "s"])

    parts = sent.mapInArrow(add, "b int, s array<double>").select("b", F.posexplode("s").alias("i", "s")).groupBy("b", "i").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    for row in parts.collect():  # blocks x weights x (columns + 1) squared numbers
        out.setdefault(row["b"], np.zeros(len(names) * (k + 1) ** 2))[row["i"]] = row["s"]
    return {(b, n): s.reshape(len(names), k + 1, k + 1)[i] for b, s in out.items() for i, n in enumerate(names)}


def solved(gram: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """(intercept, coefficients) for the last column of a gram matrix on the others; ridge penalises the coefficients only.

    Sums are centred and scaled first; of collinear columns the least coefficients are taken.
    """
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    spread = gram[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread)[:-1], 0))
    scale[scale <= 1e-9 * np.sqrt(n) * (1 + np.abs(mean[:-1]))] = np.inf  # a constant column has no coefficient
    inner = spread[:-1, :-1] / np.outer(scale, scale) + np.diag(ridge / scale**2)
    beta = np.linalg.lstsq(inner, spread[:-1, -1] / scale, rcond=1e-12)[0] / scale
    return np.concatenate(([mean[-1] - mean[:-1] @ beta], beta))


def squared_error(gram: np.ndarray, beta: np.ndarray) -> float:
    """The sum of squared residuals of (intercept, coefficients) over the rows of a gram matrix."""
    v = np.append(beta, -1.0)
    return float(v @ gram @ v)


def line(beta: Sequence[float], features: list[str]) -> Column:
    """The linear predictor as an expression."""
    return sum((F.lit(float(b)) * F.col(f) for b, f in zip(beta[1:], features, strict=True)), F.lit(float(beta[0])))


def coefficients(df: DataFrame, beta: np.ndarray, features: list[str], gram: np.ndarray) -> DataFrame:
    """(feature, coefficient, standardised): the last times the feature's population deviation; the intercept has none."""
    mean = gram[0, 1 : len(features) + 1] / gram[0, 0]
    sd = np.sqrt(np.maximum(np.diag(gram)[1 : len(features) + 1] / gram[0, 0] - mean**2, 0))
    rows = [("intercept", float(beta[0]), None)] + [(f, float(b), float(b * s)) for f, b, s in zip(features, beta[1:], sd, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, standardised double")


def least_squares(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, DataFrame]:
    """(intercept and coefficients, their table) by the normal equations, from one pass."""
    gram = grams(df, [*features, label])[0, ""]
    beta = solved(gram)
    return beta, coefficients(df, beta, features, gram)


def logistic_regression(df: DataFrame, features: list[str], label: str, weight: Column | None = None, steps: int = 15, tolerance: float = 1e-10) -> np.ndarray:
    """(intercept, coefficients) of the chance that label is 1, by Newton's steps: each is a weighted least-squares fit of the
    working response, one pass over the rows."""
    beta = np.zeros(len(features) + 1)
    given = F.lit(1.0) if weight is None else weight
    for _ in range(steps):
        eta = line(beta, features)
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), 1 / (1 + F.exp(-eta))))
        working = df.withColumns({"_eta": eta, "_p": p}).withColumn("_z", F.col("_eta") + (F.col(label) - F.col("_p")) / (F.col("_p") * (1 - F.col("_p"))))
        fresh = solved(grams(working, [*features, "_z"], {"h": given * F.col("_p") * (1 - F.col("_p"))})[0, "h"])
        moved, beta = np.abs(fresh - beta).max(), fresh
        if moved < tolerance:
            break
    return beta


def quantile_regression(df: DataFrame, features: list[str], label: str, at: Sequence[float] = (0.1, 0.5, 0.9), steps: int = 40, least: float = 0.1) -> dict[float, np.ndarray]:
    """{quantile: (intercept, coefficients)} by iteratively reweighted least squares of the pinball loss, all in the same passes.

    A row weighs as its side of the line does, over its distance from it, which counts as ``least`` if smaller. Steps start from the
    least-squares line.
    """
    start = solved(grams(df, [*features, label])[0, ""])
    found = {q: start for q in at}
    for _ in range(steps):
        weights = {}
        for q, beta in found.items():
            gap = F.col(label) - line(beta, features)
            weights[str(q)] = F.when(gap >= 0, F.lit(float(q))).otherwise(F.lit(1 - float(q))) / F.greatest(F.abs(gap), F.lit(float(least)))
        sums = grams(df, [*features, label], weights)
        found = {q: solved(sums[0, str(q)]) for q in at}
    return found


def forward_ridge(df: DataFrame, features: list[str], label: str, block: str, strengths: Sequence[float]) -> DataFrame:
    """(ridge, fold, rmse, mean_rmse, sd_rmse, chosen): fold i is fitted on blocks before i and scored on block i.

    One pass gives the sums of each block; running totals over the blocks fit every fold and strength, and a block's own sums
    score it, so the number of strengths costs nothing. The least mean of the folds is chosen, of equal ones the first strength.
    """
    sums = {b: m for (b, _), m in grams(df, [*features, label], by=block).items()}
    rows, fold = [], []
    for strength in strengths:
        seen, errors = None, []
        for b in sorted(sums):
            if seen is not None:
                errors.append((b, float(np.sqrt(max(0.0, squared_error(sums[b], solved(seen, strength))) / sums[b][0, 0]))))
            seen = sums[b] if seen is None else seen + sums[b]
        fold.append((strength, errors))
    means = [float(np.mean([e for _, e in errors])) for _, errors in fold]
    best = int(np.argmin(means)) if means else 0
    for k, (strength, errors) in enumerate(fold):
        deviation = float(np.std([e for _, e in errors]))
        rows += [(float(strength), int(b), e, means[k], deviation, k == best) for b, e in errors]
    return df.sparkSession.createDataFrame(rows, "ridge double, fold int, rmse double, mean_rmse double, sd_rmse double, chosen boolean")


def cut_points(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Places to cut each feature: its exact quantiles at 1/bins, 2/bins, .., each once."""
    at = [k / bins for k in range(1, bins)]
    one = ranks.quantiles_by(df.withColumn("_all", F.lit(0)), ["_all"], {f: F.col(f) for f in features}, at).first()
    return {f: sorted({x for x in one[f] if x is not None}) if one else [] for f in features}


def regression_tree(df: DataFrame, features: list[str], label: str, depth: int = 3, bins: int = 16, least: int = 20) -> DataFrame:
    """A tree grown level by level: (node, feature, threshold, gain, n, mean), node 1 being the root and 2k and 2k + 1 its children.

    For each node the split with the largest fall of squared error, rounded to 6 digits, is taken; equal ones go by name of the
    feature, then by threshold. A row goes left if its value is at most the threshold. Leaves have no feature. Each level is one
    grouping of the rows by node, feature and bin; only its sums are compared. A null value of a feature lies in the last bin, so it
    goes right; rows without a label are left out.
    """
    cuts = cut_points(df, features, bins)
    binned = {f"_b{i}": sum((F.when(F.col(f) <= c, 0).otherwise(1) for c in cuts[f]), F.lit(0)) for i, f in enumerate(features)}
    y = F.col(label).cast("double")
    rows = staged(df.where(y.isNotNull()).select(y.alias("_y"), *(b.alias(n) for n, b in binned.items()), F.lit(1).alias("node")))
    levels, listed = [], ", ".join(f"{i}, _b{i}" for i in range(len(features)))
    for _ in range(depth):
        totals = rows.groupBy("node").agg(F.count("*").alias("n"), F.avg("_y").alias("mean"))
        sums = rows.select("node", "_y", F.expr(f"stack({len(features)}, {listed}) AS (f, bin)")).groupBy("node", "f", "bin").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
        order, whole = Window.partitionBy("node", "f").orderBy("bin"), Window.partitionBy("node", "f")
        run = sums.select("node", "f", "bin", F.sum("n").over(order).alias("nl"), F.sum("s").over(order).alias("sl"), F.sum("n").over(whole).alias("nt"), F.sum("s").over(whole).alias("st"))
        right_n, right_s = F.col("nt") - F.col("nl"), F.col("st") - F.col("sl")
        able = run.where((F.col("nl") >= least) & (right_n >= least))
        able = able.withColumn("gain", F.round(F.col("sl") ** 2 / F.col("nl") + right_s**2 / right_n - F.col("st") ** 2 / F.col("nt"), 6)).where("gain > 0")
        best = able.groupBy("node").agg(F.max_by(F.struct("f", "bin", "gain"), F.struct("gain", (-F.col("f")).alias("a"), (-F.col("bin")).alias("b"))).alias("x"))
        found = totals.join(best, "node", "left").select("node", "x.f", "x.bin", "x.gain", "n", "mean").collect()  # at most 2 ** level rows
        levels.append(found)
        child = F.lit(None).cast("int")
        for x in found:
            if x["f"] is not None:
                child = F.when(F.col("node") == x["node"], 2 * F.col("node") + F.when(F.col(f"_b{x['f']}") > x["bin"], 1).otherwise(0)).otherwise(child)
        rows = staged(rows.withColumn("node", child).where("node IS NOT NULL"))
    last = rows.groupBy("node").agg(F.count("*").alias("n"), F.avg("_y").alias("mean"))
    levels.append(last.select("node", *(F.lit(None).alias(c) for c in ("f", "bin", "gain")), "n", "mean").collect())
    out = [(x["node"], None if x["f"] is None else features[x["f"]], None if x["f"] is None else cuts[features[x["f"]]][x["bin"]], x["gain"], x["n"], x["mean"]) for level in levels for x in level]
    return df.sparkSession.createDataFrame(out, "node int, feature string, threshold double, gain double, n long, mean double")


def tree_importance(tree: DataFrame) -> DataFrame:
    """(feature, importance, rank): each feature's share of all gains of a tree; equal ones go by name."""
    gains = tree.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("gain").alias("g"))
    shares = gains.crossJoin(gains.agg(F.sum("g").alias("t"))).select("feature", (F.col("g") / F.col("t")).alias("importance"))
    return shares.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # a row for each feature
