"""The silhouette is that of all rows, however many, and equals a plain version."""

import numpy as np
import pytest

from skupulse.operators import models as md
from skupulse.operators import silhouette as sil


def plain_silhouette(x, labels):
    used = np.unique(labels)
    total = np.empty((len(x), len(used)))
    for i, v in enumerate(x):
        far = np.sqrt(((x - v) ** 2).sum(axis=1))
        total[i] = np.bincount(np.searchsorted(used, labels), far, len(used))
    sizes, at, own = np.array([(labels == c).sum() for c in used]), np.arange(len(x)), np.searchsorted(used, labels)
    inside, mean = total[at, own] / np.maximum(sizes[own] - 1, 1), total / sizes
    mean[at, own] = np.inf
    most = np.maximum(inside, mean.min(axis=1))
    return np.where((sizes[own] > 1) & (most > 0), (mean.min(axis=1) - inside) / np.where(most > 0, most, 1), 0.0).mean()


def frame(spark, x, labels):
    rows = [(i, v.tolist(), own.tolist()) for i, (v, own) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame(rows, "sku_ID long, x array<double>, labels array<int>")


def clustered(n, seed=5):
    """Rows of eight blobs, some of them repeated, and three ways to cluster them."""
    rng = np.random.default_rng(seed)
    own = rng.integers(0, 8, n)
    x = rng.normal(size=(n, 3)) + 5 * rng.normal(size=(8, 3))[own]
    x[: n // 5] = x[n // 5: 2 * (n // 5)]
    labels = np.stack([own, own // 2, np.where(rng.random(n) < 0.1, rng.integers(0, 8, n), own)], axis=1)
    labels[:, 1][labels[:, 1] == 2] = 7   # an unused number in between
    return x, labels


def test_all_rows_are_scored(spark):
    x, labels = clustered(6_200)
    got = {r.clustering: r.silhouette for r in sil.mean_silhouettes(frame(spark, x, labels), ["a", "b", "c"]).collect()}
    for j, c in enumerate("abc"):
        assert abs(got[c] - plain_silhouette(x, labels[:, j])) < 1e-9


def test_slices_give_the_same(spark, monkeypatch):
    x, labels = clustered(900)
    monkeypatch.setattr(sil, "SLICE_ROWS", 250)
    got = {r.clustering: r.silhouette for r in sil.mean_silhouettes(frame(spark, x, labels), ["a", "b", "c"]).collect()}
    for j, c in enumerate("abc"):
        assert abs(got[c] - plain_silhouette(x, labels[:, j])) < 1e-9


@pytest.mark.parametrize("offset", [0.0, 1e4])
def test_distances_of_close_rows(offset):
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(size=(300, 4)), np.full((40, 4), 0.25)]) + offset
    x = np.concatenate([y[:50], y[:50] + 1e-9, np.full((20, 4), 0.25) + offset])
    assert np.allclose(sil.distances(x, y), np.sqrt(((x[:, None] - y) ** 2).sum(axis=2)), rtol=1e-7, atol=1e-12)


def test_sweep_scores_all_rows(spark):
    x, _ = clustered(5_400)
    feats = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "sku_ID long, x double, y double, z double")
    scores, best, assign, _ = md.kmeans_silhouette_sweep(feats, ["x", "y", "z"], 7, 8, 1)
    own = np.array([r.sku_cluster_ID for r in assign.orderBy("sku_ID").collect()])
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    assert abs({r.k: r.silhouette for r in scores.collect()}[best] - plain_silhouette(scaled, own)) < 1e-9
