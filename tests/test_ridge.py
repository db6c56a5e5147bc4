"""Ridge from shared moments against one solution at a time."""

import numpy as np
import pytest

from isotherma.operators import ridge


def plain(x, y, train, alpha=1.0):
    fill = np.nanmedian(x[train], axis=0)
    z = np.where(np.isnan(x), fill, x)
    mean, label = z[train].mean(axis=0), y[train].mean()
    a = z[train] - mean
    slopes = np.linalg.solve(a.T @ a + alpha * np.eye(x.shape[1]), a.T @ (y[train] - label))
    return label + (z - mean) @ slopes


def test_sets_folds_and_missing_values(spark):
    rng = np.random.default_rng(1)
    n = 500
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 5] + [0, 1000, 3, -2]
    base = rng.normal(size=n) * 5
    y = x @ [1, 0.2, 3, 0] + rng.normal(size=n)
    x[rng.random((n, 4)) < 0.1] = np.nan
    fold = rng.integers(1, 4, n)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(base[i] + y[i]), float(base[i]), *["validation" if fold[i] == f else "train" for f in (1, 2, 3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, obs double, base double, role_1 string, role_2 string, role_3 string").repartition(5)
    sets = {"one": ["b"], "two": ["a", "c"], "all": ["a", "b", "c", "d"]}
    names = ["a", "b", "c", "d"]
    want = {}
    for s, columns in sets.items():
        errors = np.concatenate([(plain(x[:, [names.index(c) for c in columns]], y, fold != f) - y)[fold == f] for f in (1, 2, 3)])
        want[s] = (np.abs(errors).mean(), errors.mean())
    got = {r["feature_set"]: r for r in ridge.ablation(df, [1, 2, 3], sets, obs="obs", base="base").collect()}
    for s, (mae, bias) in want.items():
        assert got[s]["rows"] == n and got[s]["mae"] == pytest.approx(mae) and got[s]["bias"] == pytest.approx(bias, abs=1e-9)
    trail = ridge.elimination(df, [1, 2, 3], names, obs="obs", base="base", keep=2).orderBy("step").collect()
    assert trail[0]["mae"] == pytest.approx(want["all"][0]) and [r["n_features"] for r in trail] == [4, 3, 2]
    left = [c for c in names if c not in {r["removed"] for r in trail}]
    errors = np.concatenate([(plain(x[:, [names.index(c) for c in left]], y, fold != f) - y)[fold == f] for f in (1, 2, 3)])
    assert trail[-1]["mae"] == pytest.approx(np.abs(errors).mean())


def test_spark_ml_ridge_has_the_same_penalty(spark):
    from pyspark.sql import functions as F

    from isotherma.operators import models

    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    rows = [(float(a), float(3 * a + e), 0.0) for a, e in zip(x, rng.normal(size=80))]
    df = spark.createDataFrame(rows, "x double, obs double, base double")
    fitted = models.fit_delta(df, ["x"], models.ridge_delta(df, "obs", "base", 20.0), "obs", "base").stages[-1]
    m = ridge.moments(df.withColumn("_delta", F.col("obs") - F.col("base")).withColumn("_all", F.lit(True)), ["x"], "_delta", ["_all"])
    slopes, _ = m.solve(0, ["x"], 20.0)
    assert fitted.coefficients[0] == pytest.approx(slopes[0], rel=1e-9)


def test_held_out_events_are_not_learned_from(spark):
    from isotherma.operators import ridge

    rng = np.random.default_rng(3)
    x = rng.normal(size=90)
    event = np.array(["a", "b", None])[np.arange(90) % 3]
    y = 2 * x + (event == "a") * 5.0
    df = spark.createDataFrame([(float(a), float(b), 0.0, e) for a, b, e in zip(x, y, event.tolist())], "x double, obs double, base double, event string")
    got = {r["held_out"]: r for r in ridge.leave_one_event_out(df, "event", ["x"], obs="obs", base="base").collect()}
    assert set(got) == {"a", "b"} and got["a"]["rows"] == 30
    for e in "ab":
        errors = (plain(x[:, None], y, event != e) - y)[event == e]
        assert got[e]["mae"] == pytest.approx(np.abs(errors).mean())
    with pytest.raises(ValueError):
        ridge.leave_one_event_out(df.where("event = 'a'"), "event", ["x"], obs="obs", base="base")


def test_steps_read_stored_rows_and_do_not_join_again(spark):
    from isotherma.plans import model_queries

    days = spark.range(400).selectExpr("id", "date_add(DATE '2020-01-01', CAST(id % 40 AS INT)) AS obs_date")
    rows, folds = model_queries.with_forward(None, days)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 400 and [f"role_{f}" for f in folds] == rows.columns[2:]
    assert rows.where("role_1 = 'train'").count() > 0 and rows.where("role_1 = 'validation'").count() > 0
