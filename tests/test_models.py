"""Silhouette, imputation, importances and recursion against plain versions."""

import datetime as dt
import random

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from skupulse.operators import forecast as fc
from skupulse.operators import models as md


def plain_silhouette(x, labels):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = far[i][own].sum() / (own.sum() - 1)
        b = min(far[i][labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


def vectors(spark, x, labels):
    rows = [(i, *map(float, v), *map(int, own)) for i, (v, own) in enumerate(zip(x, labels, strict=True))]
    cols = [f"x{j}" for j in range(x.shape[1])]
    names = [f"k{j}" for j in range(labels.shape[1])]
    df = spark.createDataFrame(rows, "sku_ID int, " + ", ".join(f"{c} double" for c in cols) + ", " + ", ".join(f"{c} int" for c in names))
    return md.assemble(df, cols), names


def test_silhouette_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(500, 3)), np.zeros((20, 3))])       # 20 equal points
    labels = np.stack([rng.integers(0, 7, 520), (x[:, 0] > 0).astype(int), np.zeros(520, int),
                       np.r_[np.zeros(519, int), 1]], axis=1)
    df, names = vectors(spark, x, labels)
    got = {r.clustering: r.silhouette for r in md.silhouettes(df, names).collect()}
    for j in (0, 1, 3):
        assert abs(got[names[j]] - plain_silhouette(x, labels[:, j])) < 1e-9
    assert got[names[2]] is None      # one cluster


def test_sweep_takes_the_best_silhouette(spark):
    rng = random.Random(1)
    rows = [(i, 50 * (i % 3) + rng.random(), 50 * (i % 3) + rng.random()) for i in range(90)]
    feats = spark.createDataFrame(rows, "sku_ID int, x double, y double")
    scores, best, assign, _ = md.kmeans_silhouette_sweep(feats, ["x", "y"], 2, 6, 3)
    by = {r.k: r.silhouette for r in scores.collect()}
    assert best == 3 == max(by, key=by.get)
    groups = {}
    for r in assign.collect():
        groups.setdefault(r.sku_cluster_ID, set()).add(r.sku_ID % 3)
    assert sorted(map(len, groups.values())) == [1, 1, 1]


def test_most_frequent_imputation(spark, tmp_path):
    rows = [("10", "b", None), ("9", "a", None), ("9", "b", None), ("10", "a", None), (None, None, None), ("7", "c", None)]
    df = spark.createDataFrame(rows, "warehouse string, dow string, none string")
    model = md.MostFrequentImputer(inputCols=["warehouse", "dow", "none"]).fit(df)
    got = [r for r in model.transform(df).collect() if r.warehouse == "9" and r.dow == "a"]
    assert len(got) == 2 and all(r.none is None for r in got)     # ties: 9 before 10, a before b
    stages, _ = md.preprocess_stages(["warehouse", "x"], "zero")
    train = spark.createDataFrame([("1", 1.0), ("1", 2.0), ("2", 0.5), (None, 3.0)], "warehouse string, x double")
    from pyspark.ml import Pipeline
    fitted = Pipeline(stages=stages).fit(train)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    other = spark.createDataFrame([(None, 1.0), ("1", 1.0), ("5", 1.0)], "warehouse string, x double")
    for m in (fitted, again):
        null, one, unseen = (r.features.toArray().tolist() for r in m.transform(other).collect())
        assert null == one and unseen != one


def test_recursion_follows_its_own_predictions(spark):
    day = dt.date(2018, 3, 1)
    rng = random.Random(2)
    demand = {w: [float(rng.randint(0, 9)) for _ in range(12)] for w in (1, 2)}
    hist = spark.createDataFrame([(day + dt.timedelta(days=i), w, 0, d) for w, ds in demand.items() for i, d in enumerate(ds)],
                                 "date date, warehouse int, sku_cluster_ID int, demand double")
    days = [day + dt.timedelta(days=12 + i) for i in range(4)]
    future = spark.createDataFrame([(d, w, 0) for d in days for w in demand], "date date, warehouse int, sku_cluster_ID int")
    for rule, n in (("lag_1", 1), ("moving_average_3", 3), ("moving_average_7", 7)):
        got = fc.recursive_forecast(hist, future, fc.KEYS, days, lambda f, r=rule: f.withColumn("predicted_demand", fc.rule_prediction(r)))
        for w, known in demand.items():
            known = list(known)
            for d in days:
                known.append(sum(known[-n:]) / n)
            mine = [r.predicted_demand for r in got.where(F.col("warehouse") == w).orderBy("date").collect()]
            assert np.allclose(mine, known[-4:])


def test_importances_cover_all_candidates(spark):
    from skupulse.plans.registry import QUERIES
    rows = QUERIES["feature_importances"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r.model_id, []).append(r)
    assert len(by) == 18
    for own in by.values():
        own.sort(key=lambda r: r["rank"])
        assert len(own) <= 15 and [r.importance for r in own] == sorted((r.importance for r in own), reverse=True)
    assert {r.importance_type for r in by["direct_warehouse__lasso_alpha_0.0100"]} == {"abs_coefficient"}
    assert [(r.feature, r.importance) for r in by["cluster_to_warehouse__blend_50_50"]] == [("lag_1", 0.5), ("rolling_mean_3", 0.5)]


def test_catalogue_says_where_a_sku_was_seen(spark):
    train = spark.createDataFrame([(i, float(i % 2), 1.0 * i) for i in range(1, 9)], "sku_ID long, x double, y double").coalesce(1)
    test = spark.createDataFrame([(1, 0.0, 1.0), (20, 1.0, 8.0), (21, 0.0, 2.0)], "sku_ID long, x double, y double")
    cols = ["x", "y"]
    model = md.fit_kmeans(md.assemble(md.zscore(train, cols), cols), 2, 1, 1)
    own = model.transform(md.assemble(md.zscore(train, cols), cols)).selectExpr("sku_ID", "prediction sku_cluster_ID")
    rows = {r.sku_ID: r for r in md.assign_unseen(test, train, cols, model, own).collect()}
    assert set(rows) == {*range(1, 9), 20, 21}
    assert {i for i, r in rows.items() if r.seen_in_train} == set(range(1, 9))
    assert {i for i, r in rows.items() if r.seen_in_test} == {1, 20, 21}
    assert all(r.assignment_source == ("train_fit" if r.seen_in_train else "test_predict_unseen") for r in rows.values())
