"""The registered k-means sweeps keep the best of ten initialisations."""

import random

from skupulse.operators import models as md
from skupulse.plans import q_models as qm


def test_sweep_keeps_best_of_ten(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"s{i}", 5 * (i % 6) + rng.random(), 5 * (i % 4) + rng.random()) for i in range(60)]
    feats = spark.createDataFrame(rows, "sku_ID string, x double, y double").coalesce(1)
    seen = []
    fit = md.KMeans.fit

    def count(self, *a):
        m = fit(self, *a)
        seen.append(m.summary.trainingCost)
        return m

    monkeypatch.setattr(md.KMeans, "fit", count)
    scores, *_ = md.kmeans_silhouette_sweep(feats, ["x", "y"], 5, 5, qm.QUERY_RESTARTS)
    assert len(seen) == 10 and scores.collect()[0].training_cost == min(seen)
