"""Preparation and model of every fold against a plain fit of that fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvana.operators import features, folds, model

NAMES = ["a", "b", "c"]


def table(spark, n=400, seed=0, none=False):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        fold = int(rng.choice(4, p=[0.4, 0.3, 0.2, 0.1]))
        a = None if rng.random() < 0.2 else float(rng.normal(fold, 1 + 5 * (rng.random() < 0.05)))
        b = float(np.round(rng.normal(), 1)) if fold != 2 or rng.random() < 0.5 else float("nan")
        c = float(rng.integers(0, 3))
        y = None if k % 50 == 7 else float(1.0 + 0.1 * (a or 0) - 0.2 * np.nan_to_num(b) + rng.normal() * 0.01)
        rows.append((f"cell{fold}", k, fold if k % 97 else None, a, b, c, None, y))
    return spark.createDataFrame(rows, "cell_id string, cycle_number int, fold int, a double, b double, c double, d double, soh double"), rows


def plain(rows, names, k, kind, sigma):
    """Treatment of each column by the rows that aren't in fold k."""
    x = np.array([[np.nan if r[3 + "abcd".index(n)] is None else r[3 + "abcd".index(n)] for n in names] for r in rows])
    train = np.array([r[2] != k for r in rows]) if k is not None else np.ones(len(rows), bool)
    out = []
    columns = [(x[:, i], np.nanmedian(x[train, i]) if (~np.isnan(x[train, i])).any() else None) for i in range(len(names))]
    columns += [(np.isnan(x[:, i]).astype(float), 0.0) for i in range(len(names)) if np.isnan(x[train, i]).any() and (~np.isnan(x[train, i])).any()]
    for v, fill in columns:
        if fill is None:
            out.append(v)
            continue
        v = np.where(np.isnan(v), fill, v)
        m, s = v[train].mean(), v[train].std()
        v = np.clip(v, m - sigma * s, m + sigma * s)
        if kind == "robust":
            q = np.percentile(v[train], [25, 50, 75])
            centre, scale = q[1], q[2] - q[0]
        else:
            centre, scale = v[train].mean(), v[train].std()
        out.append((v - centre) / (scale if scale > 1e-9 else 1.0))
    return np.column_stack(out), train


@pytest.mark.parametrize(("kind", "sigma"), [("robust", 2.0), ("standard", 1.5)])
def test_every_fold_is_prepared_by_the_others(spark, kind, sigma):
    df, rows = table(spark)
    fits = folds.fitted(df.repartition(5), NAMES, "fold", kind, sigma)
    assert sorted(fits) == [0, 1, 2, 3]
    every = folds.treated_names(NAMES, fits)
    got = {r.cycle_number: r for r in folds.prepared(df, NAMES, fits, "fold").collect()}
    for k in range(4):
        want, train = plain(rows, NAMES, k, kind, sigma)
        for i in np.flatnonzero(~train):
            assert np.allclose([got[i][n] for n in every if n in fits[k]], want[i], atol=1e-9), (k, i)


def test_models_of_folds_equal_plain_fits(spark):
    df, rows = table(spark)
    net = model.ElasticNet(alpha=1e-3)
    out = {r.cycle_number: r for r in folds.cross_validated(df.repartition(3), NAMES, "fold", net=net, sigma=3.0).collect()}
    assert set(out) == {r[1] for r in rows if r[7] is not None and r[2] is not None}
    for k in range(4):
        x, train = plain(rows, NAMES, k, "robust", 3.0)
        y = np.array([np.nan if r[7] is None else r[7] for r in rows])
        t = train & ~np.isnan(y)
        p = x.shape[1]
        fit = model.solve(t.sum(), x[t].sum(0), (x[t].T @ x[t])[np.triu_indices(p)], y[t].sum(), y[t] @ x[t], y[t] @ y[t], net)
        pred = (x - fit["mean"]) / fit["scale"] @ fit["coef"] + fit["intercept"]
        for i in np.flatnonzero(~train & ~np.isnan(y)):
            assert abs(out[i].y_pred - pred[i]) < 1e-7


def test_quantiles_are_exact_whatever_the_sketch_says(spark, monkeypatch):
    """Brackets that miss their ranks are widened until they hold them."""
    df, rows = table(spark, 3000, 5)
    values = np.array([r[3] for r in rows if r[3] is not None])
    for sketch, reach in ((2048, 0.004), (8, -2 / len(values))):  # the second sketch is far too small, and its brackets are points
        monkeypatch.setattr(folds, "SKETCH", sketch)
        monkeypatch.setattr(folds, "REACH", reach)
        got = folds.exact_quantiles(df.repartition(4), ["a", "d"], [0.0, 0.1, 0.5, 0.99, 1.0])[folds.ALL]
        assert np.allclose(got[0], np.percentile(values, [0, 10, 50, 99, 100])) and got[1] == [None] * 5
    per = folds.exact_quantiles(df, ["a"], [0.25, 0.5], "fold")
    for k in range(4):
        own = [r[3] for r in rows if r[3] is not None and r[2] != k]
        assert np.allclose(per[k][0], np.percentile(own, [25, 50]))


def test_odd_tables(spark):
    df, rows = table(spark, 40)
    done = features.prepared(df, ["a", "d"], sigma=2.0)
    want, _ = plain(rows, ["a"], None, "robust", 2.0)
    got = np.array([[r.a, r.a_missing] for r in done.orderBy("cycle_number").collect()])
    assert np.allclose(got, want) and done.where("d is not null").count() == 0
    empty = features.prepared(df.limit(0), ["a"])
    assert empty.count() == 0
    with pytest.raises(ValueError, match="scaler"):
        folds.fitted(df, ["a"], kind="none")


def test_preparation_takes_few_jobs(spark):
    """Two scans of the table: the sketches, and the values in brackets."""
    df, _ = table(spark, 400)
    spark.sparkContext.setJobGroup("prep", "prep")
    fits = folds.fitted(df.withColumn("x", F.rand(1)), ["a", "b", "x"], "fold")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("prep"))
    spark.sparkContext.setJobGroup("other", "other")
    assert len(fits) == 4 and jobs < 20
