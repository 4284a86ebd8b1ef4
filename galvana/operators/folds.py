"""Preparation of features for all folds of a grouped cross-validation at once: imputation, clipping, scaling, model.

A fold's training data are the rows of all other folds. What preparation needs of them comes from two scans of the table,
however many folds there are:

1. Per fold and column: how many values there are and are missing, their mean and squared deviations, and a KLL sketch. A
   fold's training statistics are merges of the other folds' (running merges from both ends, so as many as there are folds).
   The ranks that medians and quartiles of imputed and clipped columns need follow from counts alone: imputing puts copies of
   the median beside the middle ranks, and clipping keeps the order.
2. The sketches give a bracket for each wanted rank. Values outside all brackets are counted between them, those inside are
   kept with their counts; so the exact value at each rank is found, and no task holds more than a bracket. If a sketch was
   further off than its error says, the rank lies in a gap, and that gap is taken as a bracket in another scan.

The model takes a third scan, which makes the sums of products of every fold from rows prepared as that fold prepares them.
Folds and columns are few; their parameters are the only thing that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .model import ElasticNet, Solver, solve

#: Size of the sketches, and how far in rank a bracket reaches to either side of what they say.
SKETCH, REACH = 2048, 0.004
#: The fold of all rows where there are no folds; no row is in fold ALL, so it trains on every row.
ALL = -1


@dataclass
class Order:
    """What is known of one column's finite training values in one fold."""

    n: int
    missing: int
    mean: float
    squares: float
    brackets: dict[int, tuple[float, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def imputed(self, i: int, median: float) -> float:
        """The value at rank i once the missing ones are the median."""
        before = (self.n + 1) // 2
        return self.values[i] if i < before else median if i < before + self.missing else self.values[i - self.missing]

    def quantile(self, p: float, n: int, at) -> float:
        low, high = floor(p * (n - 1)), ceil(p * (n - 1))
        return at(low) + (at(high) - at(low)) * (p * (n - 1) - low)

    def wanted(self, probs: list[float], imputing: bool) -> set[int]:
        """Ranks of finite values that the quantiles need."""
        if not self.n:
            return set()
        ends = lambda p, n: {floor(p * (n - 1)), ceil(p * (n - 1))}
        out = set().union(*(ends(p, self.n) for p in probs)) if not imputing else ends(0.5, self.n)
        if imputing:
            before = (self.n + 1) // 2
            for i in set().union(*(ends(p, self.n + self.missing) for p in probs)):
                if not before <= i < before + self.missing:
                    out.add(i if i < before else i - self.missing)
        return out


def _double(name: str) -> Column:
    return F.when(finite(F.col(name).cast("double")), F.col(name).cast("double"))


def _rows(df: DataFrame, names: list[str], fold: str | None, *more: Column) -> DataFrame:
    """(f, v0, v1, ...): the fold and the finite values of the columns."""
    of = F.col(fold).cast("int") if fold else F.lit(0)
    return df.select(of.alias("f"), *[_double(n).alias(f"v{i}") for i, n in enumerate(names)], *more)


def _merged(rows: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """(n, mean, squared deviations) of parts together."""
    n = sum(r[0] for r in rows)
    if not n:
        return 0, 0.0, 0.0
    mean = sum(r[0] * r[1] for r in rows if r[0]) / n
    return n, mean, sum(r[2] + r[0] * (r[1] - mean) ** 2 for r in rows if r[0])


def _orders(df: DataFrame, names: list[str], fold: str | None, probs: list[float], imputing: bool) -> dict[int, list[Order]]:
    """The first scan: by fold, what each column needs and where to look for it."""
    p = range(len(names))
    stats = [c for i in p for c in (F.count(f"v{i}").alias(f"n{i}"), F.avg(f"v{i}").alias(f"m{i}"), (F.var_pop(f"v{i}") * F.count(f"v{i}")).alias(f"s{i}"), F.kll_sketch_agg_double(f"v{i}", SKETCH).alias(f"k{i}"))]
    seen = _rows(df, names, fold).groupBy("f").agg(F.count(F.lit(1)).alias("rows"), *stats)
    if fold:
        w = Window.orderBy("f")  # one row for each fold
        before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        seen = seen.withColumns({f"k{i}": F.kll_sketch_merge_double(F.kll_merge_agg_double(f"k{i}").over(before), F.kll_merge_agg_double(f"k{i}").over(after)) for i in p})
    seen = seen.persist()  # few rows, asked for twice
    try:
        parts = {r["f"]: r for r in seen.drop(*[f"k{i}" for i in p]).collect()}
        held = sorted(k for k in parts if k is not None) if fold else [ALL]
        out: dict[int, list[Order]] = {}
        for k in held:
            train = [r for f, r in parts.items() if f != k or not fold]
            orders = []
            for i in p:
                n, mean, squares = _merged([(r[f"n{i}"], r[f"m{i}"], r[f"s{i}"]) for r in train])
                orders.append(Order(n, sum(r["rows"] for r in train) - n, mean, squares))
            out[k] = orders
        ask = []
        for k in held:
            for i, o in enumerate(out[k]):
                for rank in sorted(o.wanted(probs, imputing)):
                    at, slack = (rank + 0.5) / o.n, REACH + 2 / o.n
                    ask.append((0 if not fold else k, i, rank, k, max(at - slack, 0.0), min(at + slack, 1.0)))
        if ask:
            ends = [sorted({e for f, j, _, _, *es in ask if j == i for e in es}) for i in p]  # of all folds: ranks must be constants
            quantile = lambda i: F.when(F.kll_sketch_get_n_double(f"k{i}") > 0, F.kll_sketch_get_quantile_double(f"k{i}", F.lit(ends[i])))
            got = {r["f"]: r for r in seen.select("f", *[quantile(i).alias(f"q{i}") for i in p if ends[i]]).collect()}
            for f, i, rank, k, low, high in ask:
                at = dict(zip(ends[i], got[f][f"q{i}"], strict=True))
                out[k][i].brackets[rank] = (-np.inf if low == 0 else at[low], np.inf if high == 1 else at[high])
    finally:
        seen.unpersist()
    return out


def _united(brackets: list[tuple[float, float]]) -> np.ndarray:
    """Disjoint brackets, ends included, that cover the given ones: low and high ends in two rows."""
    out: list[list[float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return np.array(out).T.reshape(2, -1)


def _look_up(df: DataFrame, names: list[str], fold: str | None, orders: dict[int, list[Order]]) -> None:
    """The second scan: fills the values at the wanted ranks."""
    missing = {(k, i): set(o.brackets) for k, os in orders.items() for i, o in enumerate(os)}
    while any(missing.values()):
        united = [_united([orders[k][i].brackets[r] for k in orders for r in missing[k, i]]) for i in range(len(names))]

        def run(batches: Iterator[pa.RecordBatch], united=united) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                folds = batch.column(0).to_numpy(zero_copy_only=False)
                for i, (low, high) in enumerate(united):
                    if not len(low):
                        continue
                    x = batch.column(1 + i).to_numpy(zero_copy_only=False)
                    good = ~np.isnan(x)
                    x, f = x[good], folds[good]
                    k = np.searchsorted(high, x)  # the first bracket that doesn't end before x
                    inside = (k < len(low)) & (x >= low[np.minimum(k, len(low) - 1)])
                    slot = 2 * k + inside
                    frame = pd.DataFrame({"f": f, "i": np.int32(i), "slot": slot.astype(np.int32), "x": np.where(inside, x, 0.0)})
                    counted = frame.groupby(["f", "i", "slot", "x"], dropna=False, sort=False).size().reset_index(name="n")
                    yield pa.RecordBatch.from_pandas(counted, preserve_index=False).cast(schema)

        schema = pa.schema([("f", pa.int32()), ("i", pa.int32()), ("slot", pa.int32()), ("x", pa.float64()), ("n", pa.int64())])
        folded = F.coalesce("f", F.lit(ALL - 1)).alias("f")  # rows of no fold train every fold
        rows = _rows(df, names, fold).select(folded, *[F.coalesce(f"v{i}", F.lit(float("nan"))).alias(f"v{i}") for i in range(len(names))])
        hits = rows.mapInArrow(run, "f int, i int, slot int, x double, n long").groupBy("f", "i", "slot", "x").agg(F.sum("n").alias("n")).persist()
        try:
            counts = {(r["i"], r["slot"], r["f"]): r["n"] for r in hits.groupBy("i", "slot", "f").agg(F.sum("n").alias("n")).collect()}
            targets, again = [], {key: set() for key in missing}
            for (k, i), ranks in missing.items():
                size = np.zeros(2 * united[i].shape[1] + 1, np.int64)
                for (j, slot, f), n in counts.items():
                    if j == i and (f != k or not fold):
                        size[slot] += n
                ends = np.cumsum(size)
                for rank in ranks:
                    slot = int(np.searchsorted(ends, rank, "right"))
                    if slot % 2:
                        targets.append((i, slot, k, rank, int(rank - (ends[slot] - size[slot]))))
                    else:  # a gap: what lies in it has to be looked at
                        low, high = united[i]
                        orders[k][i].brackets[rank] = (-np.inf if slot == 0 else high[slot // 2 - 1], np.inf if slot // 2 == len(low) else low[slot // 2])
                        again[k, i].add(rank)

            def pick(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
                i, slot = key
                group, out = group.sort_values("x"), []
                for j, s, k, rank, at in targets:
                    if (j, s) == (i, slot):
                        own = group["n"].where((group["f"] != k) | (not fold), 0).cumsum().to_numpy()
                        out.append((i, k, rank, group["x"].to_numpy()[np.searchsorted(own, at, "right")]))
                return pd.DataFrame(out, columns=["i", "k", "rank", "x"])

            inside = hits.where(F.col("slot") % 2 == 1)
            for r in inside.groupBy("i", "slot").applyInPandas(pick, "i int, k int, rank long, x double").collect():
                orders[r["k"]][r["i"]].values[r["rank"]] = r["x"]
        finally:
            hits.unpersist()
        missing = again


@dataclass(frozen=True)
class Treatment:
    """How a fold treats one column: its value where there is none, bounds, and scaling."""

    fill: float | None
    low: float
    high: float
    centre: float = 0.0
    scale: float = 1.0

    def bounded(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x if self.fill is None else np.where(np.isnan(x), self.fill, x), self.low, self.high)

    def applied(self, x: np.ndarray) -> np.ndarray:
        return (self.bounded(x) - self.centre) / self.scale


def exact_quantiles(df: DataFrame, names: list[str], probs: list[float], fold: str | None = None) -> dict[int, list[list[float | None]]]:
    """By fold (ALL without folds) and column: exact quantiles, linear between ranks, of the finite training values; None
    where there are none."""
    orders = _orders(df, names, fold, probs, False)
    _look_up(df, names, fold, orders)
    return {k: [[o.quantile(p, o.n, o.values.__getitem__) if o.n else None for p in probs] for o in os] for k, os in orders.items()}


def fitted(df: DataFrame, names: list[str], fold: str | None = None, kind: str = "robust", sigma: float = 5.0) -> dict[int, dict[str, Treatment]]:
    """By fold (ALL without folds): how each column is imputed by the training median, clipped to `sigma` deviations around
    the mean, and scaled; columns that miss values in training have an indicator `<name>_missing`, which is clipped and
    scaled as well. A column without any training value stays null. Standard scaling (mean, population deviation) takes a
    scan of its own, since it needs the moments of what is left after clipping."""
    if kind not in ("robust", "standard"):
        raise ValueError(f"unknown scaler: {kind}")
    robust = kind == "robust"
    orders = _orders(df, names, fold, [0.25, 0.5, 0.75] if robust else [0.5], True)
    _look_up(df, names, fold, orders)
    out: dict[int, dict[str, Treatment]] = {}
    for k, os in orders.items():
        columns: dict[str, Treatment] = {}
        for name, o in zip(names, os, strict=True):
            if not o.n:
                columns[name] = Treatment(None, -np.inf, np.inf)
                continue
            median = o.quantile(0.5, o.n, o.values.__getitem__)
            moments = _merged([(o.n, o.mean, o.squares), (o.missing, median, 0.0)])
            columns[name] = _treatment(median, moments, (lambda i, o=o, m=median: o.imputed(i, m)) if robust else None, o, sigma)
        for name, o in zip(names, os, strict=True):
            if o.missing:
                total = o.n + o.missing
                mean = o.missing / total
                columns[f"{name}_missing"] = _treatment(None, (total, mean, total * mean * (1 - mean)), (lambda i, o=o: float(i >= o.n)) if robust else None, o, sigma)
        out[k] = columns
    return out if robust else _standardised(df, names, fold, out)


def _treatment(fill: float | None, moments: tuple[int, float, float], at, o: Order, sigma: float) -> Treatment:
    n, mean, squares = moments
    reach = sigma * np.sqrt(squares / n)
    low, high = mean - reach, mean + reach
    if at is None:
        return Treatment(fill, low, high)
    first, middle, last = (o.quantile(p, n, lambda i: min(max(at(i), low), high)) for p in (0.25, 0.5, 0.75))
    return Treatment(fill, low, high, middle, (last - first) or 1.0)


def _columns(batch: pa.RecordBatch, names: list[str], treated: dict[str, Treatment]) -> dict[str, np.ndarray]:
    """The raw columns of a batch of `_rows` that a fold treats, indicators included."""
    values = {n: batch.column(f"v{i}").to_numpy(zero_copy_only=False).astype(float) for i, n in enumerate(names)}
    return values | {f"{n}_missing": np.isnan(values[n]).astype(float) for n in names if f"{n}_missing" in treated}


def _standardised(df: DataFrame, names: list[str], fold: str | None, fits: dict[int, dict[str, Treatment]]) -> dict[int, dict[str, Treatment]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, out = batch.column(0).to_pandas().to_numpy(), []
            for k, treated in fits.items():
                train = (folds != k) | (not fold)
                for name, x in _columns(batch, names, treated).items():
                    z = treated[name].bounded(x[train]) - treated[name].low if treated[name].low > -np.inf else np.zeros(0)
                    out.append((k, name, float(len(z)), float(z.sum()), float((z * z).sum())))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["k", "name", "n", "s", "q"]).astype({"k": "int32"}), preserve_index=False)

    sums = _rows(df, names, fold).mapInArrow(run, "k int, name string, n double, s double, q double").groupBy("k", "name").agg(*[F.sum(c).alias(c) for c in "nsq"])
    out = {k: dict(treated) for k, treated in fits.items()}
    for r in sums.collect():
        t = fits[r["k"]][r["name"]]
        if r["n"]:
            mean = r["s"] / r["n"]
            deviation = float(np.sqrt(max(r["q"] / r["n"] - mean * mean, 0.0)))
            out[r["k"]][r["name"]] = Treatment(t.fill, t.low, t.high, t.low + mean, deviation if deviation > 1e-12 * max(abs(t.low), abs(t.high), 1) else 1.0)
    return out


# --- use -------------------------------------------------------------------------------------------------------------


def treated_names(names: list[str], fits: dict[int, dict[str, Treatment]]) -> list[str]:
    """The columns, then the indicators that any fold has."""
    return [*names, *[f"{n}_missing" for n in names if any(f"{n}_missing" in t for t in fits.values())]]


def _table(df: DataFrame, fits: dict[int, dict[str, Treatment]], every: list[str]) -> DataFrame:
    """(__k, __t): a row of treatments for each fold. A fold without an indicator holds it at zero."""
    none = Treatment(None, 0.0, 0.0)
    rows = [(k, [(t.get(n, none).fill, float(t.get(n, none).low), float(t.get(n, none).high), float(t.get(n, none).centre), float(t.get(n, none).scale)) for n in every]) for k, t in fits.items()]
    return df.sparkSession.createDataFrame(rows, "__k int, __t array<struct<fill:double,low:double,high:double,centre:double,scale:double>>")


def prepared(df: DataFrame, names: list[str], fits: dict[int, dict[str, Treatment]], fold: str | None = None) -> DataFrame:
    """`df` with its columns treated, and the indicators added. With folds, a row is treated as its own fold's training data
    say, which don't hold it."""
    every = treated_names(names, fits)
    key = F.col(fold).cast("int") if fold else F.lit(ALL)
    joined = df.withColumn("__k", key).join(F.broadcast(_table(df, fits, every)), "__k", "left")
    out = {}
    for i, n in enumerate(every):
        t = F.col("__t")[i]
        x = F.coalesce(_double(n), t["fill"]) if n in names else F.isnull(_double(n.removesuffix("_missing"))).cast("double")
        out[n] = F.when(x.isNotNull(), (F.greatest(t["low"], F.least(t["high"], x)) - t["centre"]) / t["scale"])
    return joined.withColumns(out).drop("__k", "__t")


def fold_stats(df: DataFrame, names: list[str], fits: dict[int, dict[str, Treatment]], fold: str, target: str = "soh") -> DataFrame:
    """(k, n, sy, syy, sx, sxy, sxx): of each fold the sums of products of its training rows as it prepares them. One scan;
    every task keeps one set of sums a fold."""
    every = treated_names(names, fits)
    p = len(every)
    upper = np.triu_indices(p)
    width = 3 + 2 * p + len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(width) for k in fits}
        for batch in batches:
            folds, y = batch.column("f").to_pandas().to_numpy(), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            for k, treated in fits.items():
                train = (folds != k) & ~np.isnan(y)
                raw = _columns(batch, names, treated)
                x = np.column_stack([np.nan_to_num(treated[n].applied(raw[n][train])) if n in treated else np.zeros(train.sum()) for n in every])
                t = y[train]
                sums[k] += np.r_[len(t), t.sum(), t @ t, x.sum(0), t @ x, (x.T @ x)[upper]]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], ["k", "s"])

    rows = _rows(df, names, fold, _double(target).alias("y")).mapInArrow(run, "k int, s array<double>")
    total = rows.groupBy("k").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    part = lambda a, b: F.array(*[f"s{i}" for i in range(a, b)])
    return total.select(
        "k", F.col("s0").cast("long").alias("n"), F.col("s1").alias("sy"), F.col("s2").alias("syy"),
        part(3, 3 + p).alias("sx"), part(3 + p, 3 + 2 * p).alias("sxy"), part(3 + 2 * p, width).alias("sxx"),
    )


def models(stats: DataFrame, net: ElasticNet = ElasticNet(), solver: Solver = solve) -> DataFrame:
    """(k, mean, scale, coef, intercept, n_train) of each fold that has training rows; folds are solved side by side."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.n > 0:
                    fit = solver(r.n, *(np.array(a, float) for a in (r.sx, r.sxx)), r.sy, np.array(r.sxy, float), r.syy, net)
                    out.append({"k": r.k, "n_train": r.n} | fit)
            yield pd.DataFrame(out, columns=["k", "mean", "scale", "coef", "intercept", "n_train"])

    return stats.mapInPandas(run, "k int, mean array<double>, scale array<double>, coef array<double>, intercept double, n_train long")


def cross_validated(
    df: DataFrame, names: list[str], fold: str = "fold", target: str = "soh", net: ElasticNet = ElasticNet(), kind: str = "robust", sigma: float = 5.0, solver: Solver = solve
) -> DataFrame:
    """(cell_id, cycle_number, fold, y_true, y_pred) of every row with a target, by the pipeline of its fold, which hasn't
    seen it: imputation, clipping, scaling and model, all fitted on the other folds."""
    fits = fitted(df, names, fold, kind, sigma)
    every = treated_names(names, fits)
    fit = models(fold_stats(df, names, fits, fold, target), net, solver).withColumnRenamed("k", "__m")
    rows = prepared(df.where(finite(F.col(target))), names, fits, fold)
    joined = rows.join(F.broadcast(fit), rows[fold] == fit["__m"])
    y = F.col("intercept")
    for i, n in enumerate(every):
        y = y + (F.coalesce(F.col(n), F.lit(0.0)) - F.col("mean")[i]) / F.col("scale")[i] * F.col("coef")[i]
    return joined.select("cell_id", "cycle_number", fold, F.col(target).alias("y_true"), y.alias("y_pred"))
