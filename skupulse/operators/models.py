"""Clustering and forecasting models on Spark ML.

* Feature rows are one per SKU or one per panel cell, assembled into
  ``VectorUDT`` columns; every fit is a distributed Spark ML fit.
* k sweeps draw the starts of all k and restarts in common passes over the rows, then
  run one clustering per task (many rows: step together, one pass per step); the
  demand-objective sweep scores ALL k in one Spark pass, with k as an extra
  grouping key of the demand grid.
* Scaling uses the exact population standard deviation (SQL ``stddev_pop``,
  trap T8) instead of ``StandardScaler`` (sample std).
* Ridge/lasso penalties are converted to Spark's parameterisation (T9).
"""

from __future__ import annotations

import json
import threading
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, clustering
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from skupulse import config
from skupulse.functions.exprs import count_if
from skupulse.operators.grid import attach_one_row, densify, dim_product
from skupulse.operators.silhouette import mean_silhouettes
from skupulse.operators.starts import parallel_starts
from skupulse.session import materialize, share

SEED = 42


# ----------------------------------------------------------------- scaling (M1)

def scale_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std of every feature column."""
    return df.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                  *[F.stddev_pop(c).alias(f"{c}__std") for c in cols])


def zscore(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> DataFrame:
    """M1: (x - mean) / population std, 0 where the std is 0; ``stats`` from
    the train rows can be applied to other rows (M4)."""
    stats = stats if stats is not None else scale_stats(df, cols)
    j = attach_one_row(df, stats)
    out = [F.when(F.col(f"{c}__std") > 0, (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std"))
           .otherwise(F.lit(0.0)).alias(c) for c in cols]
    keep = [c for c in df.columns if c not in cols]
    return j.select(*keep, *out)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


# ----------------------------------------------------------------- k-means (M2-M5)

def _k_range(n: int, k_min: int, k_max: int) -> range:
    """The values of k to try: at least 2 and fewer than the rows; where the wanted
    range leaves none, all that the rows allow."""
    if n < 3:
        raise ValueError(f"k-means over {n} SKUs: three or more are needed")
    most = min(k_max, n - 1)
    least = max(2, k_min)
    return range(least if least <= most else 2, max(2, most if least <= most else n - 1) + 1)


STEP_ROWS = 20_000    # rows of a task in one step, at most about
LEAST_STEP_ROWS = 500  # ... and at least, where the cores allow
WHOLE_BYTES = 192 << 20  # rows up to this size are handed whole to every task


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row (ties to the first), and its squared distance
    without the row's own square."""
    far = (centers ** 2).sum(axis=1) - 2 * (x @ centers.T)
    far[np.isnan(far)] = np.inf
    own = far.argmin(axis=1)
    return own, far[np.arange(len(x)), own]


def _batches(batch: pa.RecordBatch, dims: int, rows: int = 4_096):
    """The vectors of a batch's first column, some rows at a time."""
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows).column(0).flatten().to_numpy().reshape(-1, dims)


def _mean_centers(centers: np.ndarray, sums: np.ndarray, sizes: np.ndarray, tol: float) -> tuple[np.ndarray, bool]:
    """Centers after a step (used ones move to the mean of their rows), and whether all moved by ``tol`` at most."""
    used = sizes > 0
    moved = centers.copy()
    moved[used] = sums[used] / sizes[used, None]
    return moved, bool((((moved - centers) ** 2).sum(axis=1)[used] <= tol ** 2).all())


def lloyd(x: np.ndarray, centers: np.ndarray, max_iter: int, tol: float, rows: int = 32_768) -> tuple[np.ndarray, float, int]:
    """All steps of one clustering over rows without NaN: (centers, cost before the last move, steps).

    A row keeps an upper bound of the distance to its center and a lower bound of
    that to any other; only rows whose bounds meet are compared with the centers
    again (Hamerly).  They are compared in single precision with its error bound,
    and in double precision where that leaves a doubt, so every row's center is the
    one that a comparison with all centers finds."""
    n, dims, k = len(x), x.shape[1], len(centers)
    single = np.concatenate([x, np.ones((n, 1))], axis=1).astype(np.float32)
    square = (x ** 2).sum(axis=1)
    norm = np.sqrt(square)
    own, upper, lower = np.zeros(n, np.intp), np.full(n, np.inf), np.zeros(n)
    sums, sizes = np.zeros((k, dims)), np.zeros(k)
    went, steps, done, before = np.zeros(k), 0, max_iter == 0, centers
    while not done:
        own_square = (centers ** 2).sum(axis=1)
        table = np.concatenate([-2 * centers.T, own_square[None]]).astype(np.float32)
        reach = np.sqrt(own_square.max())
        apart = np.sqrt(((centers[:, None] - centers) ** 2).sum(axis=2))
        np.fill_diagonal(apart, np.inf)
        half = apart.min(axis=1) / 2
        others = np.full(k, went.max())   # the longest way of another center
        if k > 1:
            others[went.argmax()] = np.partition(went, -2)[-2]
        for first in range(0, n, rows):
            part = slice(first, first + rows)
            o, u, low = own[part], upper[part], lower[part]
            u += went[o]
            low -= others[o]
            at = np.flatnonzero(u * (1 + 1e-9) + 1e-12 >= np.maximum(low, half[o])) if steps else np.arange(len(o))
            if not len(at):
                continue
            if len(at) > 0.8 * len(o):
                at, mine = np.arange(len(o)), part
            else:
                mine = first + at
            with np.errstate(over="ignore", invalid="ignore"):
                far = single[mine] @ table
                each = np.arange(len(at))
                now = far.argmin(axis=1)
                best = far[each, now].astype(np.float64)
                far[each, now] = np.inf
                second = far.min(axis=1).astype(np.float64)
                error = (dims + 4) * 2.0 ** -22 * (norm[mine] + reach) ** 2
                best, second = best + error, second - error
                doubt = np.flatnonzero(~(best < second))
            if len(doubt):
                exact = own_square - 2 * (x[first + at[doubt]] @ centers.T)
                now[doubt] = exact.argmin(axis=1)
                best[doubt] = exact[np.arange(len(doubt)), now[doubt]]
                exact[np.arange(len(doubt)), now[doubt]] = np.inf
                second[doubt] = exact.min(axis=1)
                slack = 1e-14 * (norm[first + at[doubt]] + reach) ** 2
                best[doubt] += slack
                second[doubt] -= slack
            u[at] = np.sqrt(np.maximum(best + square[mine], 0.0))
            low[at] = np.sqrt(np.maximum(second + square[mine], 0.0))
            gone = np.flatnonzero(o[at] != now) if steps else each
            if len(gone):
                vectors, left, to = x[first + at[gone]], o[at[gone]], now[gone]
                o[at[gone]] = to
                sizes += np.bincount(to, minlength=k)
                sums += np.stack([np.bincount(to, v, k) for v in vectors.T], axis=1)
                if steps:
                    sizes -= np.bincount(left, minlength=k)
                    sums -= np.stack([np.bincount(left, v, k) for v in vectors.T], axis=1)
        before, (centers, still) = centers, _mean_centers(centers, sums, sizes, tol)
        went, steps = np.sqrt(((centers - before) ** 2).sum(axis=1)), steps + 1
        done = still or steps >= max_iter
    cost = sum(float(((x[first:first + rows] - before[own[first:first + rows]]) ** 2).sum()) for first in range(0, n, rows))
    return centers, cost if steps else 0.0, steps


class Summary(NamedTuple):
    trainingCost: float
    numIter: int


class KMeansFit:
    """One clustering: its start, and its outcome once somebody asks for it."""

    def __init__(self, steps: Steps, k: int, seed: int, max_iter: int, tol: float):
        self.k, self.seed = k, seed
        self._steps, self._centers, self._max_iter, self._tol = steps, None, max_iter, tol
        self._cost, self._iterations, self._done = 0.0, 0, max_iter == 0
        self._prediction = "prediction"

    def _move(self, sums: np.ndarray, sizes: np.ndarray, cost: float) -> None:
        """One step: used centers move to the mean of their rows."""
        self._centers, still = _mean_centers(self._centers, sums, sizes, self._tol)
        self._cost, self._iterations = cost, self._iterations + 1
        self._done = still or self._iterations >= self._max_iter

    @property
    def summary(self) -> Summary:
        self._steps.finish()
        return Summary(self._cost, self._iterations)

    def clusterCenters(self) -> np.ndarray:
        self._steps.finish()
        return self._centers

    def setPredictionCol(self, name: str) -> KMeansFit:
        self._prediction = name
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (``features``) with the number of the nearest center."""
        centers = self.clusterCenters()

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            rows = np.array(x.tolist(), np.float64).reshape(len(x), centers.shape[1])
            return pd.Series(_nearest(rows, centers)[0], dtype="int32")

        return df.withColumn(self._prediction, nearest(vector_to_array("features")))


class Steps:
    """Rows (``features``) on which several clusterings start and step together.

    Rows of ``WHOLE_BYTES`` at most are handed whole to tasks that each take one
    clustering to its end.  More rows (or so few that a pass takes no longer than
    its job) stay where they are: a step is one pass over them for all clusterings
    that still move, and tasks give sums per center."""

    def __init__(self, vec: DataFrame, threads: int = 4):
        self.vec, self.threads, self._waiting, self._lock = vec, threads, [], threading.RLock()
        self._rows = self._n = self._whole = None

    def add(self, fit: KMeansFit) -> None:
        with self._lock:
            self._waiting.append(fit)

    def count(self) -> int:
        if self._n is None:
            self._n = self.vec.count()
        return self._n

    def _spread(self) -> DataFrame:
        """The rows as arrays, spread evenly over tasks."""
        if self._rows is None:
            n, cores = self.count(), self.vec.sparkSession.sparkContext.defaultParallelism
            parts = max(1, min(cores, n // LEAST_STEP_ROWS), n // STEP_ROWS)
            self._rows = materialize(self.vec.select(vector_to_array("features").alias("x")).repartition(parts))
        return self._rows

    def finish(self) -> None:
        """Step until no clustering that waits moves any more."""
        with self._lock:
            new = [f for f in self._waiting if f._centers is None]
            if new:
                for f, centers in zip(new, parallel_starts(self.vec, [(f.k, f.seed) for f in new], self.threads), strict=True):
                    f._centers = centers
            self._waiting = [f for f in self._waiting if not f._done]
            if self._waiting and self._hand_out(self._waiting[0]._centers.shape[1]):
                self._run(self._waiting)
            while self._waiting:
                self._waiting = [f for f in self._waiting if not f._done]
                if self._waiting:
                    self._step(self._waiting)

    def _hand_out(self, dims: int) -> bool:
        """Whether tasks have the whole rows: all finite, not too many and not too few."""
        if self._whole is None and LEAST_STEP_ROWS < self.count() and self._n * dims * 8 <= WHOLE_BYTES:
            told = self.vec.select(vector_to_array("features").alias("x")).toArrow().column("x")
            x = np.concatenate([c.flatten().to_numpy() for c in told.chunks]).reshape(-1, dims)
            del told
            self._whole = self.vec.sparkSession.sparkContext.broadcast(x) if np.isfinite(x).all() else False
        return bool(self._whole)

    def _run(self, fits: list[KMeansFit]) -> None:
        """Take each clustering to its end, one task each, the longest ones first."""
        shared, order = self._whole, sorted(fits, key=lambda f: -f.k)
        jobs = [(i, f._centers, f._max_iter, f._tol) for i, f in enumerate(order)]
        sc = self.vec.sparkSession.sparkContext
        for i, found in sc.parallelize(jobs, len(jobs)).map(lambda j: (j[0], lloyd(shared.value, *j[1:]))).collect():
            order[i]._centers, order[i]._cost, order[i]._iterations = found
            order[i]._done = True

    def _step(self, fits: list[KMeansFit]) -> None:
        rows = self._spread()
        sc = rows.sparkSession.sparkContext
        bounds = np.cumsum([0] + [len(f._centers) for f in fits])
        dims = fits[0]._centers.shape[1]
        names = ["center", "size", "cost", *(f"s{j}" for j in range(dims))]
        shared = sc.broadcast(np.concatenate([f._centers for f in fits]))

        def run(batches):
            centers = shared.value
            found = np.zeros((2 + dims, len(centers)))
            for batch in batches:
                for x in _batches(batch, dims):
                    square = (x ** 2).sum(axis=1)
                    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                        own, far = _nearest(x, centers[low:high])
                        for j, weights in enumerate((None, np.maximum(far + square, 0.0), *x.T)):
                            found[j, low:high] += np.bincount(own, weights, high - low)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers))), *(pa.array(c) for c in found)], names)

        schema = "center long, " + ", ".join(f"{c} double" for c in names[1:])
        sums = rows.mapInArrow(run, schema).groupBy("center").agg(*[F.sum(c).alias(c) for c in names[1:]])
        told = sums.toArrow().sort_by("center")   # one row per center
        shared.destroy()
        size, cost, *own = (told.column(c).to_numpy() for c in names[1:])
        own = np.stack(own, axis=1)
        for f, low, high in zip(fits, bounds[:-1], bounds[1:], strict=True):
            f._move(own[low:high], size[low:high], float(cost[low:high].sum()))


class KMeans:
    """Spark's k-means: its own k-means|| start, then the same steps and the same
    stop, taken together with the other clusterings of the same ``Steps``."""

    def __init__(self, k: int, seed: int, maxIter: int = 300, tol: float = 1e-4):
        self.k, self.seed, self.max_iter, self.tol = k, seed, maxIter, tol

    def fit(self, steps: Steps) -> KMeansFit:
        fit = KMeansFit(steps, self.k, self.seed, self.max_iter, self.tol)
        steps.add(fit)
        return fit


def fit_sweep(vec: DataFrame, ks: list[int], n_init: int = 10, seed: int = SEED, threads: int = 4) -> dict[int, KMeansFit]:
    """Per k the best of ``n_init`` k-means|| fits (lowest training cost), like restarts."""
    steps = Steps(vec, threads)
    jobs = [(k, i) for k in ks for i in range(n_init)]
    fits = [KMeans(k=k, seed=seed + i).fit(steps) for k, i in jobs]
    best: dict[int, KMeansFit] = {}
    for (k, _), m in zip(jobs, fits, strict=True):
        if k not in best or m.summary.trainingCost < best[k].summary.trainingCost:
            best[k] = m
    return best


def fit_kmeans(vec: DataFrame, k: int, n_init: int = 10, seed: int = SEED):
    """Best of ``n_init`` k-means|| fits of one k."""
    return fit_sweep(vec, [k], n_init, seed)[k]


def _parallel(fn, items, threads):
    with ThreadPoolExecutor(max_workers=max(1, threads)) as ex:
        return list(ex.map(fn, items))


def label_all(vec: DataFrame, models: dict[int, KMeansFit]) -> DataFrame:
    """(sku_ID, x, labels): the vectors (``features``) as arrays with the number of the
    nearest center in each of the clusterings, in one pass for all of them."""
    centers = [m.clusterCenters() for m in models.values()]
    rows = vec.select("sku_ID", vector_to_array("features").alias("x"))
    schema = StructType([*rows.schema.fields, StructField("labels", ArrayType(IntegerType()))])

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, centers[0].shape[1])
            own = np.stack([_nearest(x, c)[0] for c in centers], axis=1).astype(np.int32)
            ends = np.arange(0, own.size + 1, len(centers), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, own.ravel())], schema.names)

    return rows.mapInArrow(run, schema)


def silhouettes(labelled: DataFrame, label_cols: list[str]) -> DataFrame:
    """Mean silhouette, by plain Euclidean distance and over all rows, of several
    clusterings (numbers from 0 on) of the same vectors (``features``): (clustering,
    silhouette; null where fewer than two clusters are used)."""
    return mean_silhouettes(labelled.select("sku_ID", vector_to_array("features").alias("x"), F.array(*label_cols).alias("labels")),
                            label_cols)


def kmeans_silhouette_sweep(feats: DataFrame, cols: list[str], k_min: int = 20, k_max: int = 50,
                            n_init: int = 10, seed: int = SEED, threads: int = 4):
    """M2: fit each k, score all of them by silhouette (plain Euclidean distance),
    keep the best, the smallest k where several are; k = 2 where none uses two
    clusters.  Returns (scores frame (k, silhouette, training_cost), best k,
    assignments (sku_ID, sku_cluster_ID), model)."""
    spark = feats.sparkSession
    vec = share(assemble(zscore(feats, cols), cols).select("sku_ID", "features"))
    ks = list(_k_range(vec.count(), k_min, k_max))
    models = fit_sweep(vec, ks, n_init, seed, threads)
    found = {int(r.clustering[1:]): r.silhouette for r in mean_silhouettes(label_all(vec, models), [f"k{k}" for k in ks]).collect()}
    best = max((k for k in ks if found[k] is not None), key=lambda k: (found[k], -k), default=2)
    if best not in models:
        models[best] = fit_kmeans(vec, best, n_init, seed)
    scores = spark.createDataFrame([(k, found[k], models[k].summary.trainingCost) for k in ks],
                                   "k int, silhouette double, training_cost double")
    assign = models[best].transform(vec).select("sku_ID", F.col("prediction").cast("int").alias("sku_cluster_ID"))
    return scores, best, assign, models[best]


def kmeans_objective_sweep(train_feats: DataFrame, cols: list[str], train_lines: DataFrame, start, end,
                           k_min: int = 20, k_max: int = 50, n_init: int = 10, seed: int = SEED, threads: int = 4):
    """M3: for every k the train SKUs are clustered, the dense (date,
    warehouse, cluster) grid built (observed clusters) and scored (A17/A18);
    the best k minimises (objective, zero rate, -cv, majority counts).

    The scoring of all k runs as ONE Spark plan: the assignments of every k
    are unioned with a k column, and k is part of every grouping key."""
    spark = train_feats.sparkSession
    vec = share(assemble(zscore(train_feats, cols), cols).select("sku_ID", "features"))
    ks = list(_k_range(vec.count(), k_min, k_max))
    models = fit_sweep(vec, ks, n_init, seed, threads)
    names = F.array(*[F.lit(k) for k in models])
    assign = share(label_all(vec, models).select("sku_ID", F.inline(F.arrays_zip(names.alias("k"), F.col("labels").alias("sku_cluster_ID")))))
    scores = score_assignments(assign, train_lines, start, end)
    key = [F.col("objective"), F.col("avg_zero_rate"), -F.col("avg_cv"), F.col("clusters_high_sparsity_majority"),
           F.col("clusters_low_variance_majority"), F.col("k")]
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(*key)))
    return ranked, models


def score_assignments(assign: DataFrame, lines: DataFrame, start, end) -> DataFrame:
    """A16-A18 for many cluster schemes at once (scheme id = k)."""
    m = lines.join(assign, "sku_ID", "inner")
    wh = m.select("k", "dc_des").filter(F.col("dc_des").isNotNull()).distinct()
    cl = m.select("k", "sku_cluster_ID").distinct()
    keys = wh.join(cl, "k")  # per-k product (equi-join on k)
    facts = m.select("order_date", "k", "dc_des", "sku_cluster_ID", F.col("quantity").alias("demand"))
    grid = densify(facts, keys, "order_date", start, end, ["demand"], ["k", "dc_des", "sku_cluster_ID"])
    s = grid.groupBy("k", "sku_cluster_ID", "dc_des").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("demand") == 0).alias("z"),
        F.avg("demand").alias("mu"), F.coalesce(F.stddev_samp("demand"), F.lit(0.0)).alias("sd"))
    s = s.withColumns({"zr": F.col("z") / F.col("n"),
                       "cv": F.coalesce(F.try_divide(F.col("sd"), F.nullif(F.col("mu"), F.lit(0.0))), F.lit(0.0))})
    s = s.withColumns({"hs": (F.col("zr") >= config.SPARSITY_THRESHOLD).cast("int"),
                       "lv": ((F.col("sd") == 0) | (F.col("cv") < config.CV_THRESHOLD)).cast("int")})
    c = s.groupBy("k", "sku_cluster_ID").agg(F.avg("zr").alias("azr"), F.avg("cv").alias("acv"),
                                             (F.sum("hs") / F.count(F.lit(1))).alias("hss"),
                                             (F.sum("lv") / F.count(F.lit(1))).alias("lvs"))
    o = c.groupBy("k").agg(
        F.count(F.lit(1)).alias("clusters"), F.avg("azr").alias("avg_zero_rate"), F.avg("acv").alias("avg_cv"),
        F.avg("hss").alias("avg_high_sparsity_share"), F.avg("lvs").alias("avg_low_variance_share"),
        count_if(F.col("hss") >= 0.5).alias("clusters_high_sparsity_majority"),
        count_if(F.col("lvs") >= 0.5).alias("clusters_low_variance_majority"))
    return o.withColumn("objective", F.col("avg_high_sparsity_share") + F.col("avg_low_variance_share"))


def assign_unseen(test_feats: DataFrame, train_feats: DataFrame, cols: list[str], model,
                  train_assign: DataFrame) -> DataFrame:
    """M4 + U3: train SKUs keep their cluster (train_fit); test SKUs never
    seen in train (anti join) are scaled with TRAIN statistics and assigned
    by the train model (test_predict_unseen).  ``seen_in_train`` and
    ``seen_in_test`` say in which split a SKU was ordered."""
    unseen = test_feats.join(train_feats.select("sku_ID"), "sku_ID", "left_anti")
    x = zscore(unseen, cols, scale_stats(train_feats, cols))
    pred = model.transform(assemble(x, cols)).select(
        "sku_ID", F.col("prediction").cast("int").alias("sku_cluster_ID"),
        F.lit("test_predict_unseen").alias("assignment_source"), F.lit(0).alias("seen_in_train"), F.lit(1).alias("seen_in_test"))
    ordered = test_feats.select("sku_ID", F.lit(1).alias("_seen")).distinct()
    seen = train_assign.join(ordered, "sku_ID", "left").select(
        "sku_ID", "sku_cluster_ID", F.lit("train_fit").alias("assignment_source"), F.lit(1).alias("seen_in_train"),
        F.coalesce("_seen", F.lit(0)).alias("seen_in_test"))
    return seen.unionByName(pred)


def cluster_sizes(assign: DataFrame) -> DataFrame:
    """M5: mean / min / max cluster size."""
    s = assign.groupBy("sku_cluster_ID").agg(F.count(F.lit(1)).alias("size"))
    return s.agg(F.count(F.lit(1)).alias("clusters"), F.avg("size").alias("average_cluster_size"),
                 F.min("size").alias("min_cluster_size"), F.max("size").alias("max_cluster_size"))


# ----------------------------------------------------------------- regression models

CATEGORICAL = {"cluster_id", "warehouse_id", "warehouse", "sku_cluster_ID", "dow"}

# Model grid of the warehouse comparison.
MODEL_GRID = {
    "baseline_lag1": None,
    "linear_regression": {"kind": "linear"},
    "ridge_regression": {"kind": "ridge", "alpha": 1.0},
    "random_forest": {"kind": "forest", "trees": 120, "min_leaf": 2},
    "gradient_boosting": {"kind": "gbt", "trees": 150, "depth": 6, "step": 0.05, "subsample": 0.9},
}


class MostFrequentModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Nulls of the input columns set to the fitted most frequent value."""

    modes = Param(Params._dummy(), "modes", "JSON object: column -> value (null: none seen)", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = {c: v for c, v in json.loads(self.getOrDefault(self.modes)).items() if v is not None}
        return dataset.fillna(known) if known else dataset


class MostFrequentImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M6/M7: most frequent value of string columns; ties go to the smallest
    number, then the smallest text.  Values are counted per (column, value) with
    partial sums, then one row per column is kept."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MostFrequentModel:
        cols = self.getInputCols()
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])
        counts = dataset.select(F.inline(pairs)).where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        order = F.struct((-F.col("n")).alias("n"), F.coalesce(F.col("value").try_cast("double"), F.lit(float("inf"))).alias("x"), "value")
        found = {r["name"]: r["value"] for r in counts.groupBy("name").agg(F.min_by("value", order).alias("value")).collect()}
        model = MostFrequentModel()
        return model._set(inputCols=cols, modes=json.dumps({c: found.get(c) for c in cols}))


def preprocess_stages(feature_cols: list[str], numeric_impute: str = "median", scale: bool = False):
    """M6/M7: categorical -> most-frequent impute + one-hot (unseen levels kept
    apart), numeric -> median (M6) or constant-0 (M7) impute; optional
    z-scaling is applied by the caller with exact population std."""
    cats = [c for c in feature_cols if c in CATEGORICAL]
    nums = [c for c in feature_cols if c not in CATEGORICAL]
    stages = []
    idx = [f"{c}__idx" for c in cats]
    ohe = [f"{c}__ohe" for c in cats]
    if cats:
        stages.append(MostFrequentImputer(inputCols=cats))
        stages.append(StringIndexer(inputCols=cats, outputCols=idx, handleInvalid="keep",
                                    stringOrderType="frequencyDesc"))
        # the indexer's extra index already stands for unseen levels
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=False))
    imp = [f"{c}__imp" for c in nums]
    if nums and numeric_impute == "median":
        stages.append(Imputer(inputCols=nums, outputCols=imp, strategy="median"))
    assembled = ohe + (imp if nums and numeric_impute == "median" else nums)
    stages.append(VectorAssembler(inputCols=assembled, outputCol="features", handleInvalid="keep"))
    return stages, assembled


def standardise(train: DataFrame, test: DataFrame, feature_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """M6: numeric features with nulls set to the train median, then scaled by
    train mean and population std, on both frames."""
    nums = [c for c in feature_cols if c not in CATEGORICAL]
    if not nums:
        return train, test
    imputer = Imputer(inputCols=nums, outputCols=nums, strategy="median").fit(train)
    train, test = imputer.transform(train), imputer.transform(test)
    stats = scale_stats(train, nums)
    return zscore(train, nums, stats), zscore(test, nums, stats)


def _estimator(spec: dict, n_rows: int, label_std: float):
    kind = spec["kind"]
    if kind == "linear":
        return LinearRegression(labelCol="label", regParam=0.0, solver="normal", standardization=False)
    if kind == "ridge":
        # sklearn penalises alpha*||w||^2 on the summed loss; Spark scales the
        # loss by 1/(2n) and the L2 term by regParam/2 on standardised labels
        return LinearRegression(labelCol="label", regParam=spec["alpha"] * label_std / max(n_rows, 1),
                                elasticNetParam=0.0, solver="normal", standardization=False)
    if kind == "lasso":
        return LinearRegression(labelCol="label", regParam=spec["alpha"], elasticNetParam=1.0,
                                standardization=False, maxIter=200)
    if kind == "forest":
        return RandomForestRegressor(labelCol="label", numTrees=spec["trees"], minInstancesPerNode=spec["min_leaf"],
                                     maxDepth=spec.get("depth", 12), seed=SEED,
                                     featureSubsetStrategy=spec.get("features", "auto"),
                                     subsamplingRate=spec.get("subsample", 1.0))
    return GBTRegressor(labelCol="label", maxIter=spec["trees"], maxDepth=spec["depth"], stepSize=spec["step"],
                        subsamplingRate=spec["subsample"], minInstancesPerNode=spec.get("min_leaf", 1), seed=SEED)


def fit_predict(train: DataFrame, test: DataFrame, feature_cols: list[str], spec: dict,
                target: str = "demand", numeric_impute: str = "median", clip: bool = True):
    """Fit one model on train rows and predict test rows (clipped at 0
    unless ``clip`` is False)."""
    tr = train.withColumn("label", F.col(target).cast("double"))
    te = test.withColumn("label", F.col(target).cast("double"))
    for c in [c for c in feature_cols if c in CATEGORICAL]:
        tr, te = tr.withColumn(c, F.col(c).cast("string")), te.withColumn(c, F.col(c).cast("string"))
    if numeric_impute == "zero":
        nums = [c for c in feature_cols if c not in CATEGORICAL]
        tr, te = tr.fillna(0.0, subset=nums), te.fillna(0.0, subset=nums)
    st = tr.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).collect()[0]
    stages, names = preprocess_stages(feature_cols, numeric_impute)
    model = Pipeline(stages=stages + [_estimator(spec, st["n"], st["s"] or 1.0)]).fit(tr)
    p = F.greatest(F.col("prediction"), F.lit(0.0)) if clip else F.col("prediction")
    pred = model.transform(te).withColumn("predicted_demand", p)
    return model, pred, names


def feature_importance(model, names: list[str], top: int | None = None):
    """Tree importances or absolute coefficients, one-hot slots named
    from the vector metadata."""
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in est.coefficients.toArray().tolist()]
    return vals


def top_importances(rows: DataFrame, top: int = 15) -> DataFrame:
    """K4: the ``top`` features of each model id by importance, then name."""
    by = Window.partitionBy("model_id").orderBy(F.desc("importance"), "feature")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def elasticity(daily: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Slope of log demand on log price per SKU; 0 when fewer than two
    points or the log price does not vary (var_pop <= 1e-8)."""
    x = F.log(F.greatest(F.col("avg_final_price"), F.lit(0.0)) + eps)
    y = F.log(F.col("daily_demand") + eps)
    d = daily.select("sku_ID", x.alias("x"), y.alias("y")).filter(
        ~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull())
    g = d.groupBy("sku_ID").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("vx"),
                                F.regr_slope("y", "x").alias("slope"))
    return g.select("sku_ID", F.when((F.col("n") < 2) | (F.col("vx") <= 1e-8) | F.col("slope").isNull(), F.lit(0.0))
                    .otherwise(F.col("slope")).alias("elasticity"))
