"""All clusterings of a sweep step together, and end where Spark's own fits end."""

import random

import numpy as np
from pyspark.ml import clustering

from skupulse.operators import models as md


def test_sweep_steps_together_like_single_fits(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"s{i}", 5 * (i % 6) + rng.random(), 5 * (i % 4) + rng.random()) for i in range(90)]
    vec = md.assemble(spark.createDataFrame(rows, "sku_ID string, x double, y double").coalesce(1), ["x", "y"])
    passes, step = [], md.Steps._step
    monkeypatch.setattr(md.Steps, "_step", lambda self, fits: (passes.append(len(fits)), step(self, fits))[1])
    found = md.fit_sweep(vec, [3, 5, 7], 2)
    longest = 0
    for k, m in found.items():
        own = [clustering.KMeans(k=k, seed=md.SEED + i, maxIter=300, tol=1e-4).fit(vec) for i in range(2)]
        longest = max(longest, *(o.summary.numIter for o in own))
        best = min(own, key=lambda o: o.summary.trainingCost)
        assert m.summary.numIter == best.summary.numIter
        assert abs(m.summary.trainingCost - best.summary.trainingCost) < 1e-9
        assert np.allclose(m.clusterCenters(), best.clusterCenters(), atol=1e-12)
        labels = m.transform(vec).select("sku_ID", "prediction")
        assert labels.exceptAll(best.transform(vec).select("sku_ID", "prediction")).isEmpty()
    assert len(passes) == longest and passes[0] == 6   # a pass per step, not per step and fit
