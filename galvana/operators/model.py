"""Elastic-net state-of-health model with leave-one-cell-out validation, from per-cell sufficient statistics.

One aggregation per cell gives counts, sums and cross products; the statistics of a fold are the total's minus the held-out
cell's. A fold is solved from those numbers by cyclic coordinate descent in its task, so folds run side by side and no
sample leaves the executors. Predictions are a native dot product.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .config import FEATURE_COLS


@dataclass(frozen=True)
class ElasticNet:
    alpha: float = 1e-3
    l1_ratio: float = 0.5
    max_iter: int = 20000
    tol: float = 1e-4


def _x(name: str) -> Column:
    """Missing features count as 0."""
    return F.when(finite(F.col(name)), F.col(name)).otherwise(F.lit(0.0))


def gram_stats(df: DataFrame, names=FEATURE_COLS, target: str = "soh", by: str = "cell_id") -> DataFrame:
    """Per cell: n, sy, syy, and arrays sx, sxy, sxx (upper triangle by rows). Rows without a target are left out."""
    x, y = [_x(n) for n in names], F.col(target)
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    return df.where(finite(y)).groupBy(by).agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
        F.array(*[F.sum(c) for c in x]).alias("sx"), F.array(*[F.sum(c * y) for c in x]).alias("sxy"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("sxx"),
    )


def coordinate_descent(gram: np.ndarray, xy: np.ndarray, yy: float, n: float, net: ElasticNet) -> np.ndarray:
    """Weights for centred data given by its products. Sweeps stop when the largest relative change is below the tolerance
    and the duality gap is below it times the target's sum of squares; results depend on that rule, so it is kept exact."""
    l1, l2 = net.alpha * net.l1_ratio * n, net.alpha * (1 - net.l1_ratio) * n
    w, product, diagonal = np.zeros(len(xy)), np.zeros(len(xy)), np.diag(gram)
    for sweep in range(net.max_iter):
        largest = change = 0.0
        for j in range(len(w)):
            if diagonal[j] == 0:
                continue
            old = w[j]
            rest = xy[j] - product[j] + old * diagonal[j]
            w[j] = np.sign(rest) * max(abs(rest) - l1, 0) / (diagonal[j] + l2)
            if w[j] != old:
                product += (w[j] - old) * gram[j]
            change, largest = max(change, abs(w[j] - old)), max(largest, abs(w[j]))
        if largest == 0 or change / largest < net.tol or sweep == net.max_iter - 1:
            residual = yy - 2 * w @ xy + w @ product
            dual = np.abs(xy - product - l2 * w).max()
            shrink = l1 / dual if dual > l1 else 1.0
            gap = 0.5 * residual * (1 + shrink**2) if dual > l1 else residual
            gap += l1 * np.abs(w).sum() - shrink * (yy - w @ xy) + 0.5 * l2 * (1 + shrink**2) * (w @ w)
            if gap < net.tol * yy:
                break
    return w


def solve(n: float, sx: np.ndarray, sxx: np.ndarray, sy: float, sxy: np.ndarray, syy: float, net: ElasticNet) -> dict:
    """Mean, scale, weights on scaled features, and intercept."""
    p = len(sx)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = sxx
    full = full + np.triu(full, 1).T
    mean = sx / n
    centred = full - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred) / n, 0))
    scale[scale < 1e-15 * np.maximum(np.abs(mean), 1)] = 1.0
    gram = centred / np.outer(scale, scale)
    xy = (sxy - mean * sy) / scale
    w = coordinate_descent(gram, xy, float(syy - sy * sy / n), n, net)
    return {"mean": mean, "scale": scale, "coef": w, "intercept": sy / n}


_FIT = "mean array<double>, scale array<double>, coef array<double>, intercept double, n_train long"


#: Fits a linear model from n, sx, sxx (upper triangle), sy, sxy, syy: a dict of mean, scale, coef, intercept.
Solver = Callable[..., dict]


def loco_models(stats: DataFrame, net: ElasticNet = ElasticNet(), solver: Solver = solve) -> DataFrame:
    """(cell_id, mean, scale, coef, intercept, n_train): the model of each fold, fitted without that cell.

    With one cell there is no training data, and no row for it. `solver` may be any function like `solve`.
    """
    p = stats.select(F.size("sx").alias("p")).first()
    p = p["p"] if p else 0
    add = lambda c, m: F.array(*[F.sum(F.col(c)[i]) for i in range(m)]).alias(c)
    total = stats.agg(F.struct(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), add("sx", p), add("sxy", p), add("sxx", p * (p + 1) // 2)).alias("t"))

    def folds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                n = r.t["n"] - r.n
                if n > 0:
                    rest = {c: np.array(r.t[c]) - getattr(r, c) for c in ("sx", "sxx", "sxy")}
                    fit = solver(n, rest["sx"], rest["sxx"], r.t["sy"] - r.sy, rest["sxy"], r.t["syy"] - r.syy, net)
                    out.append({"cell_id": r.cell_id, "n_train": n} | fit)
            yield pd.DataFrame(out, columns=["cell_id", "mean", "scale", "coef", "intercept", "n_train"])

    return stats.withColumn("t", total.scalar()).mapInPandas(folds, f"cell_id string, {_FIT}")  # one struct, by one subquery


def totals(stats: DataFrame) -> dict:
    """The sums of all cells as numbers and arrays; one row reaches the driver."""
    p = len(stats.select("sx").first()["sx"])
    add = lambda c, m: F.array(*[F.sum(F.col(c)[i]) for i in range(m)]).alias(c)
    t = stats.agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), add("sx", p), add("sxy", p), add("sxx", p * (p + 1) // 2)).first()
    return {c: np.array(t[c]) if isinstance(t[c], list) else t[c] for c in t.asDict()}


def of_features(t: dict, chosen: list[int]) -> dict:
    """The same sums for some of the features, in their order: a model of fewer features needs no scan of its own."""
    p = len(t["sx"])
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = t["sxx"]
    full = full + np.triu(full, 1).T
    return t | {"sx": t["sx"][chosen], "sxy": t["sxy"][chosen], "sxx": full[np.ix_(chosen, chosen)][np.triu_indices(len(chosen))]}


def full_model(stats: DataFrame | dict, net: ElasticNet = ElasticNet(), solver: Solver = solve) -> dict:
    """The model over all cells, from their statistics or from `totals`."""
    t = stats if isinstance(stats, dict) else totals(stats)
    return solver(t["n"], t["sx"], t["sxx"], t["sy"], t["sxy"], t["syy"], net)


def linear(names, mean, scale, coef, intercept: Column) -> Column:
    """Prediction from feature columns; the parameters are array columns or sequences of numbers."""
    get = lambda a, i: a[i] if isinstance(a, Column) else F.lit(float(a[i]))
    total = intercept
    for i, n in enumerate(names):
        total = total + (_x(n) - get(mean, i)) / get(scale, i) * get(coef, i)
    return total


def loco_predictions(df: DataFrame, net: ElasticNet = ElasticNet(), names=FEATURE_COLS, target: str = "soh", solver: Solver = solve) -> DataFrame:
    """(cell_id, cycle_number, y_true, y_pred) of every row with a target, by the model that hasn't seen its cell."""
    rows = df.withColumn("cell_id", F.col("cell_id").cast("string")).where(finite(F.col(target)))
    models = loco_models(gram_stats(rows, names, target), net, solver)
    joined = rows.join(models, "cell_id")
    y = linear(names, F.col("mean"), F.col("scale"), F.col("coef"), F.col("intercept"))
    return joined.select("cell_id", "cycle_number", F.col(target).alias("y_true"), y.alias("y_pred"))


def predictions(df: DataFrame, model: dict, names=FEATURE_COLS) -> DataFrame:
    """`df` with soh_pred by one model."""
    y = linear(names, model["mean"], model["scale"], model["coef"], F.lit(float(model["intercept"])))
    return df.withColumn("soh_pred", y)


def metrics(predicted: DataFrame) -> DataFrame:
    """rmse, mae, r2 for each cell and, with cell_id null, over all: one pass with grouping sets."""
    e = F.col("y_true") - F.col("y_pred")
    squares = F.sum(e * e)
    return predicted.rollup("cell_id").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - squares / F.when(F.var_pop("y_true") > 0, F.var_pop("y_true") * F.count("*"))).alias("r2"),
    )


def importance(spark, model: dict, names=FEATURE_COLS) -> DataFrame:
    """Weights on scaled features, largest first."""
    rows = [(n, float(c), abs(float(c))) for n, c in zip(names, model["coef"], strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double").orderBy(F.desc("abs_coefficient"), "feature")


def top_importance(importance: DataFrame, n: int) -> DataFrame:
    """The n features of largest absolute weight with their rank; ties by name. One row for each feature."""
    order = Window.orderBy(F.desc("abs_coefficient"), "feature")
    return importance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def saved_models(spark: SparkSession, folder: str) -> DataFrame:
    """(path, config_hash, features, net) of the models that `save` wrote into a folder, newest name first; what isn't such
    a file is left out."""
    net = ", ".join(f"{f.name}: {'int' if f.name == 'max_iter' else 'double'}" for f in fields(ElasticNet))
    schema = f"features array<string>, config_hash string, net struct<{net}>"
    read = spark.read.schema(schema).option("mode", "PERMISSIVE").json(f"{folder}/*.json", multiLine=True)
    return read.select(F.col("_metadata.file_name").alias("path"), "config_hash", "features", "net").where("config_hash IS NOT NULL").orderBy(F.desc("path"))


def save(model: dict, path: str, config_hash: str, net: ElasticNet = ElasticNet(), names=FEATURE_COLS) -> None:
    """The model as JSON, tied to the configuration of its features."""
    plain = {k: v.tolist() if isinstance(v, np.ndarray) else float(v) for k, v in model.items()}
    with open(path, "w") as f:
        json.dump({"features": list(names), "config_hash": config_hash, "net": asdict(net), "model": plain}, f, indent=1)


def load(path: str, config_hash: str | None = None) -> dict:
    """ValueError if the model belongs to another configuration."""
    with open(path) as f:
        kept = json.load(f)
    if config_hash is not None and kept["config_hash"] != config_hash:
        raise ValueError(f"the model was fitted under configuration {kept['config_hash']}, not {config_hash}")
    return {k: np.array(v) if isinstance(v, list) else v for k, v in kept["model"].items()}
