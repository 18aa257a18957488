"""Clusterings of a sweep start and step together and end where Spark's own fits end."""

import numpy as np
import pytest
from pyspark.ml import clustering
from pyspark.sql import functions as F

from skupulse.operators import models as md
from skupulse.operators import starts


def vectors(spark, x, parts):
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    cols = [f"x{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, "sku_ID long, " + ", ".join(f"{c} double" for c in cols))
    return md.assemble(df.repartitionByRange(parts, "sku_ID").sortWithinPartitions("sku_ID"), cols)


def blobs(n, dims=3, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dims)) + 6 * rng.integers(0, 4, (n, dims))


@pytest.mark.parametrize("x", [blobs(700), np.repeat(blobs(6), 40, axis=0), np.zeros((30, 2))], ids=["spread", "repeated", "equal"])
def test_starts_are_sparks_own(spark, x):
    vec = md.share(vectors(spark, x, 3))
    wanted = [(k, seed) for k in (2, 5, 9) for seed in (42, 43)]
    for (k, seed), got in zip(wanted, starts.parallel_starts(vec, wanted), strict=True):
        own = clustering.KMeans(k=k, seed=seed, maxIter=0, solver="row", featuresCol="features").fit(vec).clusterCenters()
        assert got.shape == np.shape(own) and np.allclose(got, own, atol=1e-12)


def test_candidates_a_rounding_error_apart_keep_their_own_rows(spark):
    x = blobs(300)
    x[:3] *= 40   # far off, so both of a pair are drawn
    x = np.concatenate([x, np.nextafter(x[:3], np.inf)])
    vec = md.share(vectors(spark, x, 2))
    wanted = [(k, seed) for k in (6, 12) for seed in range(42, 48)]
    for (k, seed), got in zip(wanted, starts.parallel_starts(vec, wanted), strict=True):
        own = clustering.KMeans(k=k, seed=seed, maxIter=0, solver="row", featuresCol="features").fit(vec).clusterCenters()
        assert got.shape == np.shape(own) and np.allclose(got, own, atol=1e-12)


def plain_steps(x, centers, steps, tol):
    for done in range(1, steps + 1):
        own = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        cost = ((x - centers[own]) ** 2).sum()
        moved = np.array([x[own == j].mean(axis=0) if (own == j).any() else c for j, c in enumerate(centers)])
        still = ((moved - centers) ** 2).sum(axis=1).max() <= tol ** 2
        centers = moved
        if still:
            break
    return centers, cost, done


def test_bounded_steps_equal_plain_steps():
    x = np.concatenate([blobs(3_000, 4), np.repeat(blobs(5, 4, 8), 50, axis=0), [[1e4, 0, 0, 0]]])
    centers = x[np.random.default_rng(1).choice(len(x), 24, replace=False)]
    centers[-1] = 1e9   # used by no row
    for steps in (1, 2, 300):
        got, cost, done = md.lloyd(x, centers, steps, 1e-4, 1_000)
        plain, plain_cost, plain_done = plain_steps(x, centers, steps, 1e-4)
        assert done == plain_done and np.isclose(cost, plain_cost) and np.allclose(got, plain, atol=1e-9)


def test_large_sweep_ends_like_single_fits(spark, monkeypatch):
    vec = md.share(vectors(spark, blobs(900), 3))
    own = {k: [clustering.KMeans(k=k, seed=md.SEED + i, maxIter=300, tol=1e-4).fit(vec) for i in range(2)] for k in (4, 8)}
    monkeypatch.setattr(clustering.KMeans, "fit", None)         # no job of its own for a clustering's start,
    monkeypatch.setattr(md.Steps, "_step", None)                # nor one for a step
    found = md.fit_sweep(vec, [4, 8], 2)
    for k, m in found.items():
        best = min(own[k], key=lambda o: o.summary.trainingCost)
        assert m.summary.numIter == best.summary.numIter
        assert abs(m.summary.trainingCost - best.summary.trainingCost) < 1e-6
        assert np.allclose(m.clusterCenters(), best.clusterCenters(), atol=1e-9)


def test_rows_too_many_to_hand_out_step_in_passes(spark, monkeypatch):
    vec = md.share(vectors(spark, blobs(900), 3))
    whole = md.fit_sweep(vec, [4, 8], 2)
    costs = {k: m.summary.trainingCost for k, m in whole.items()}
    monkeypatch.setattr(md, "WHOLE_BYTES", 1_000)
    monkeypatch.setattr(md, "lloyd", None)
    for k, m in md.fit_sweep(vec, [4, 8], 2).items():
        assert abs(m.summary.trainingCost - costs[k]) < 1e-6


def test_labels_of_all_clusterings_in_one_pass(spark):
    vec = md.share(vectors(spark, blobs(700), 2))
    models = md.fit_sweep(vec, [3, 6], 1)
    got = md.label_all(vec, models)
    for j, m in enumerate(models.values()):
        one = m.transform(vec).select("sku_ID", "prediction")
        assert got.select("sku_ID", F.col("labels")[j].alias("prediction")).exceptAll(one).isEmpty()
