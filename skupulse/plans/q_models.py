"""Registered queries: scaling, clustering and forecasting models.

Model fits are not bit-comparable with another library, so the fit-based
queries have no SQL oracle (rows-only); the exact statistics (z-score,
elasticity, cluster sizes) have one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skupulse import config
from skupulse.functions.exprs import clean_orders
from skupulse.operators import clicks as ck
from skupulse.operators import evaluate as ev
from skupulse.operators import features as fe
from skupulse.operators import forecast as fc
from skupulse.operators import models as md
from skupulse.operators import panel
from skupulse.operators.grid import dim_product, union_all
from skupulse.plans.oracle import cte, sql
from skupulse.plans.q_demand import SKUFEAT_COLS
from skupulse.plans.q_features import _panel
from skupulse.plans.q_forecast import Inputs
from skupulse.plans.registry import query
from skupulse.session import share
from skupulse.sources.fixtures import DEMAND_COLUMNS, bind, clicks_daily_shifted

# Initialisations per k in the registered sweeps, as many as in the reference.
QUERY_RESTARTS = 10
K_MIN, K_MAX = 20, 50


@query("zscore", sql("select sku_ID, " + ", ".join(
    f"round(case when stddev_pop({c}) over () > 0 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () "
    f"else 0.0 end, 6) as {c}" for c in SKUFEAT_COLS) + " from skufeat", "skufeat"))
def q_zscore(spark, sf_dir):
    """M1: SKU features standardised with the population std (0 if flat)."""
    t = bind(spark, sf_dir)
    lines = share(panel.in_range(clean_orders(t.window_orders(DEMAND_COLUMNS), clip_quantity=True),
                                 config.TRAIN_START, config.TRAIN_END))
    feats = share(panel.sku_demand_features(lines, config.TRAIN_START, config.TRAIN_END, clicks_daily_shifted(t.clicks())))
    return md.zscore(feats, SKUFEAT_COLS)


@query("elasticity", sql("""
with d as (select sku_ID, ln(greatest(avg_final_price, 0.0) + 1e-6) as x, ln(daily_demand + 1e-6) as y
           from daily_sku_all),
g as (select sku_ID, count(*) as n, var_pop(x) as vx, regr_slope(y, x) as slope from d
      where x is not null and y is not null and not isnan(x) and not isnan(y) group by sku_ID)
select sku_ID, round(case when n < 2 or vx <= 1e-8 or slope is null then 0.0 else slope end, 6) as elasticity
from g""", "daily_sku_all"))
def q_elasticity(spark, sf_dir):
    """Log-log price elasticity per SKU over all daily aggregates."""
    return md.elasticity(panel.daily_sku(clean_orders(bind(spark, sf_dir).orders(columns=DEMAND_COLUMNS))))


@query("cluster_sizes", sql("""
select count(*) as clusters, round(avg(size), 6) as average_cluster_size, min(size) as min_cluster_size,
  max(size) as max_cluster_size from (select sku_cluster_ID, count(*) as size from clusters group by 1)""",
                            "clusters"))
def q_cluster_sizes(spark, sf_dir):
    """M5: mean / min / max cluster size of the SKU-cluster mapping."""
    return md.cluster_sizes(bind(spark, sf_dir).clusters())


@query("kmeans_silhouette", round_scale=6)
def q_kmeans_silhouette(spark, sf_dir):
    """M2: k-means sweep (k = 20..50) on SKU price/promo/click features,
    scored by silhouette; returns every k's score with the chosen k flagged."""
    t = bind(spark, sf_dir)
    feats = share(panel.sku_price_features(panel.daily_sku(clean_orders(t.orders(columns=DEMAND_COLUMNS))),
                                                 clicks_daily_shifted(t.clicks())))
    cols = [c for c in feats.columns if c != "sku_ID"]
    scores, best_k, _, _ = md.kmeans_silhouette_sweep(feats, cols, K_MIN, K_MAX, QUERY_RESTARTS)
    return scores.withColumn("chosen", (F.col("k") == best_k).cast("int"))


def _objective(spark, sf_dir):
    t = bind(spark, sf_dir)
    lines = share(panel.in_range(clean_orders(t.window_orders(DEMAND_COLUMNS), clip_quantity=True),
                                       config.TRAIN_START, config.TRAIN_END))
    feats = share(panel.sku_demand_features(lines, config.TRAIN_START, config.TRAIN_END,
                                                  clicks_daily_shifted(t.clicks())))
    ranked, models = md.kmeans_objective_sweep(feats, SKUFEAT_COLS, lines, config.TRAIN_START, config.TRAIN_END,
                                               K_MIN, K_MAX, QUERY_RESTARTS)
    return t, feats, ranked, models


@query("kmeans_objective")
def q_kmeans_objective(spark, sf_dir):
    """M3: k sweep scored by the demand-grid objective (all k in one pass)."""
    return _objective(spark, sf_dir)[2]


def _catalogue(spark, sf_dir):
    """Inputs, chosen k, test lines and the assignment catalogue of the objective sweep."""
    t, feats, ranked, models = _objective(spark, sf_dir)
    best_k = ranked.filter("rank = 1").select("k").collect()[0]["k"]
    model = models[best_k]
    train_assign = model.transform(md.assemble(md.zscore(feats, SKUFEAT_COLS), SKUFEAT_COLS)).select(
        "sku_ID", F.col("prediction").cast("int").alias("sku_cluster_ID"))
    test_lines = panel.in_range(clean_orders(t.window_orders(DEMAND_COLUMNS), clip_quantity=True), config.TEST_START,
                                config.TEST_END)
    test_feats = panel.sku_demand_features(test_lines, config.TEST_START, config.TEST_END,
                                           clicks_daily_shifted(t.clicks()))
    return t, best_k, md.assign_unseen(test_feats, feats, SKUFEAT_COLS, model, train_assign)


@query("assign_unseen")
def q_assign_unseen(spark, sf_dir):
    """M4+U3: train assignments of the best k plus unseen test SKUs, with the splits each SKU is seen in."""
    return _catalogue(spark, sf_dir)[2]


@query("selected_model_summary")
def q_selected_model_summary(spark, sf_dir):
    """A57 over the learned clusters: the chosen k, the split, SKU counts, and the
    score of the clusters that each split's SKUs fall in (observed clusters)."""
    t, best_k, catalogue = _catalogue(spark, sf_dir)
    catalogue = share(catalogue)
    lines = share(clean_orders(t.window_orders(DEMAND_COLUMNS), clip_quantity=True).groupBy(
        "order_date", "sku_ID", "dc_des").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("lines")))
    day = F.col("order_date")
    split = lines.select("order_date").distinct().withColumn(  # the dates that the clusters were learned on
        "split", F.when(day.between(F.lit(config.TRAIN_START), F.lit(config.TRAIN_END)), "train")
        .when(day.between(F.lit(config.TEST_START), F.lit(config.TEST_END)), "test").otherwise("unused"))
    scores = []
    for seen, start, end in (("seen_in_train", config.TRAIN_START, config.TRAIN_END),
                             ("seen_in_test", config.TEST_START, config.TEST_END)):
        mapping = catalogue.filter(F.col(seen) == 1).select("sku_ID", "sku_cluster_ID")
        grid = panel.demand_grid(lines, mapping, start, end, cluster_universe="observed")
        scores.append(panel.cluster_score(panel.cluster_summary(panel.series_metrics(grid))))
    summary = panel.model_summary(panel.split_meta(lines, split), panel.sku_split_counts(lines, split), *scores)
    return summary.withColumn("chosen_k", F.lit(best_k))


# ----------------------------------------------------------------- forecasting models

DIRECT_FEATURES = ["warehouse", "sku_cluster_ID", "dow", "is_weekend", "lag_1", "lag_2", "lag_3", "lag_7",
                   "rolling_mean_3", "rolling_mean_7", "wh_discount_lag_1", "wh_discount_roll_3",
                   "wh_discount_roll_7", "wh_units_lag_1", "wh_units_roll_3", "wh_units_roll_7",
                   "wh_order_count_lag_1", "wh_order_count_roll_7", "wh_gift_rate_lag_1", "wh_gift_rate_roll_7",
                   "global_discount_lag_1", "global_discount_roll_7", "global_units_lag_1", "global_units_roll_7",
                   "global_order_count_lag_1", "global_order_count_roll_7", "global_clicks_lag_1",
                   "global_clicks_roll_7", "global_click_users_lag_1", "global_click_users_roll_7",
                   "global_gift_rate_lag_1", "global_gift_rate_roll_7"]

# Learned candidates of the direct experiment.
CANDIDATES = {
    "linear_regression": {"kind": "linear"},
    "ridge_alpha_1.0": {"kind": "ridge", "alpha": 1.0},
    "lasso_alpha_0.0100": {"kind": "lasso", "alpha": 0.01},
    "random_forest": {"kind": "forest", "trees": 40, "depth": 10, "min_leaf": 4, "features": "sqrt",
                      "subsample": 0.5},
    "gradient_boosting": {"kind": "gbt", "trees": 60, "step": 0.05, "depth": 3, "min_leaf": 20, "subsample": 0.9},
}


CLUSTER_FEATURES = [c for c in DIRECT_FEATURES if c != "warehouse" and not c.startswith("wh_")]


def _fit(train, rows, features, name):
    """(model, predicted rows, feature names) of one learned candidate."""
    spec = CANDIDATES[name]
    if spec["kind"] in ("linear", "ridge", "lasso"):
        nums = [c for c in features if c not in md.CATEGORICAL]
        tr0 = train.fillna(0.0, subset=nums)
        stats = md.scale_stats(tr0, nums)
        train = md.zscore(tr0, nums, stats)
        rows = md.zscore(rows.fillna(0.0, subset=nums), nums, stats)
    return md.fit_predict(train, rows, features, spec, numeric_impute="zero")


def _direct_fit(spark, sf_dir, name):
    i = Inputs(spark, sf_dir)
    m = i.dmat()
    train = m.filter(F.col("date") <= F.lit(config.TRAIN_END))
    test = m.filter(F.col("date") >= F.lit(config.TEST_START))
    model, pred, names = _fit(train, test, DIRECT_FEATURES, name)
    out = pred.select("date", "warehouse", "sku_cluster_ID", "demand", "predicted_demand",
                      F.lit(f"direct_warehouse__{name}").alias("model_id"), F.lit(name).alias("model_name"))
    return model, out, names


def _candidate_predictions(i, start, end, last):
    """All 18 ids, the four rules and the five learned candidates, direct
    and by cluster; the learned ones are fitted on the days up to ``last``."""
    def learned(job):
        frame, keys, features, name = job
        pred = _fit(frame.filter(F.col("date") <= F.lit(last)),
                    frame.filter(F.col("date").between(F.lit(start), F.lit(end))), features, name)[1]
        return pred.select("date", *keys, F.lit(name).alias("model_name"), "predicted_demand")

    direct, cluster = (i.dmat(), fc.KEYS, DIRECT_FEATURES), (i.cmat(), ["sku_cluster_ID"], CLUSTER_FEATURES)
    done = md._parallel(learned, [(*level, name) for level in (direct, cluster) for name in CANDIDATES], 4)
    family = F.when(F.col("model_name").isin("random_forest", "gradient_boosting"), "tree").otherwise("linear")
    shares = fc.allocation_shares(i.train.filter(F.col("date") <= F.lit(last)))
    half = len(CANDIDATES)
    direct = fc.tag(union_all(done[:half]), "direct_warehouse", "direct warehouse-cluster")
    alloc = fc.tag(fc.allocate(share(union_all(done[half:])), shares, i.wh, i.clusters), "cluster_to_warehouse",
                   "cluster total then warehouse allocation")
    rules = i.predictions(start, end, last)
    both = direct.unionByName(alloc).withColumn("family", family)
    return share(rules.unionByName(both.select(*rules.columns)))


def all_candidates(spark, sf_dir):
    """Inputs and the test-week predictions of all 18 ids, labelled like candidate files."""
    i = Inputs(spark, sf_dir)
    pred = _candidate_predictions(i, config.TEST_START, config.TEST_END, config.TRAIN_END)
    return i, pred.withColumns({"feature_set": F.col("approach"), "source_file": F.lit("fitted")})


def _candidate_summary(i, valid):
    if valid:
        actual, span = i.train.filter(F.col("date") >= F.lit(config.VALID_START)), (config.VALID_START, config.VALID_END, config.INNER_TRAIN_END)
    else:
        actual, span = i.test, (config.TEST_START, config.TEST_END, config.TRAIN_END)
    return share(ev.model_summary(ev.join_actual(actual, _candidate_predictions(i, *span), i.cprice())))


@query("candidate_selection")
def q_candidate_selection(spark, sf_dir):
    """M14+E6: validation screening and selection among all 18 candidates
    (``model_selection`` and its SQL rank the rules alone)."""
    return ev.model_selection(_candidate_summary(Inputs(spark, sf_dir), True))


@query("candidate_comparison")
def q_candidate_comparison(spark, sf_dir):
    """M14+E7: validation vs test metrics of all 18 candidates."""
    i = Inputs(spark, sf_dir)
    return ev.model_comparison(_candidate_summary(i, True), _candidate_summary(i, False))


@query("best_learned")
def q_best_learned(spark, sf_dir):
    """M14+E8: the learned candidate with the lowest test WAPE, then RMSE."""
    return ev.best_learned(_candidate_summary(Inputs(spark, sf_dir), False))


def _test_days():
    return [config.TEST_START + dt.timedelta(days=k) for k in range((config.TEST_END - config.TEST_START).days + 1)]


cte("recursive_rules", f"""
with recursive seed as materialized (
  select warehouse, sku_cluster_ID, list(demand order by date) as vals from opt_train
  where date > date '1998-03-24' - 7 group by all),
rule as materialized (select * from (values {", ".join(f"('{m}')" for m in fc.RULE_MODELS)}) r(model_name)),
step as (
  select warehouse, sku_cluster_ID, model_name, 0 as day, null::double as predicted_demand, vals from seed cross join rule
  union all
  select warehouse, sku_cluster_ID, model_name, day + 1, p, list_append(vals[2:7], p)
  from (select *, greatest(case model_name when 'lag_1' then vals[7] when 'moving_average_3' then list_avg(vals[5:7])
                           when 'moving_average_7' then list_avg(vals) else 0.5 * vals[7] + 0.5 * list_avg(vals[5:7]) end, 0.0) as p
        from step where day < 7))
select date '1998-03-24' + day as date, warehouse, sku_cluster_ID, model_name, predicted_demand from step where day > 0""", "opt_train")


@query("recursive_rules", sql("select date, warehouse, sku_cluster_ID, model_name, round(predicted_demand, 6) as predicted_demand "
                              "from recursive_rules", "recursive_rules"))
def q_recursive_rules(spark, sf_dir):
    """The rule forecasts of the test week, each day from the predictions of
    the days before it."""
    i = Inputs(spark, sf_dir)
    series = i.train.select(*fc.KEYS).distinct()
    days = _test_days()
    future = share(dim_product([series, spark.createDataFrame([(d,) for d in days], "date date")]))
    return union_all([fc.recursive_forecast(i.train, future, fc.KEYS, days, lambda f, m=m: f.withColumn(
        "predicted_demand", fc.rule_prediction(m))).withColumn("model_name", F.lit(m)) for m in fc.RULE_MODELS])


@query("recursive_ridge")
def q_recursive_ridge(spark, sf_dir):
    """The test week of the direct ridge model, forecast day by day."""
    i = Inputs(spark, sf_dir)
    model, _, _, scale = _ridge(i)
    context = share(i.whctx().join(i.gctx(), "date", "left"))
    series = share(i.train.select(*fc.KEYS).distinct())
    days = _test_days()
    future = dim_product([series, spark.createDataFrame([(d,) for d in days], "date date")])

    def predict(frame):
        rows = scale(frame).withColumn("label", F.lit(0.0))
        for c in [c for c in DIRECT_FEATURES if c in md.CATEGORICAL]:
            rows = rows.withColumn(c, F.col(c).cast("string"))
        rows = model.transform(rows).withColumnRenamed("prediction", "predicted_demand")
        return rows.withColumns({k: F.col(k).cast("int") for k in fc.KEYS})

    return fc.recursive_forecast(i.train, future, fc.KEYS, days, predict, context, ["date", "warehouse"])


def _ridge(i):
    """The direct ridge model of the train window, and its scaling of other rows."""
    nums = [c for c in DIRECT_FEATURES if c not in md.CATEGORICAL]
    train = i.dmat().filter(F.col("date") <= F.lit(config.TRAIN_END))
    stats = share(md.scale_stats(train.fillna(0.0, subset=nums), nums))
    model, pred, names = _fit(train, train, DIRECT_FEATURES, "ridge_alpha_1.0")
    return model, pred, names, lambda rows: md.zscore(rows.fillna(0.0, subset=nums), nums, stats)


def _register_candidate(key, name):
    @query(key)
    def q(spark, sf_dir):
        return _direct_fit(spark, sf_dir, name)[1]
    q.__doc__ = f"M9-M11+M14: direct warehouse {name} forecasts for the test week."
    return q


_register_candidate("linear_model", "linear_regression")
_register_candidate("ridge_model", "ridge_alpha_1.0")
_register_candidate("lasso_model", "lasso_alpha_0.0100")
_register_candidate("forest_model", "random_forest")
_register_candidate("gbt_model", "gradient_boosting")


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    """M19+K4: top-15 drivers of the boosted direct model."""
    model, _, names = _direct_fit(spark, sf_dir, "gradient_boosting")
    vals = md.feature_importance(model, names)
    rows = [(n, float(v)) for n, v in zip(_expanded_names(model, names), vals, strict=True)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(15)


# What a rule forecast weighs.
RULE_WEIGHTS = {"lag_1": {"lag_1": 1.0}, "moving_average_3": {"rolling_mean_3": 1.0},
                "moving_average_7": {"rolling_mean_7": 1.0}, "blend_50_50": {"lag_1": 0.5, "rolling_mean_3": 0.5}}
APPROACHES = ("direct_warehouse", "cluster_to_warehouse")


@query("feature_importances", round_scale=None)
def q_feature_importances(spark, sf_dir):
    """M19+K4: top-15 drivers of each of the 18 candidates: tree importances,
    absolute coefficients, or a rule's weights."""
    i = Inputs(spark, sf_dir)
    levels = [(APPROACHES[0], i.dmat(), DIRECT_FEATURES), (APPROACHES[1], i.cmat(), CLUSTER_FEATURES)]

    def fitted(job):
        (approach, frame, features), name = job
        train = frame.filter(F.col("date") <= F.lit(config.TRAIN_END))
        model, _, names = _fit(train, train, features, name)
        kind = "feature_importance" if hasattr(model.stages[-1], "featureImportances") else "abs_coefficient"
        return [(f"{approach}__{name}", n, float(v), kind)
                for n, v in zip(_expanded_names(model, names), md.feature_importance(model, names), strict=True)]

    rows = [row for part in md._parallel(fitted, [(level, name) for level in levels for name in CANDIDATES], 4) for row in part]
    rows += [(f"{a}__{rule}", f, w, "rule_weight") for a in APPROACHES for rule, weights in RULE_WEIGHTS.items() for f, w in weights.items()]
    # a row per model and feature slot
    return md.top_importances(spark.createDataFrame(rows, "model_id string, feature string, importance double, importance_type string"))


def _expanded_names(model, names):
    """One-hot slots get '<column>=<level>' names from the indexer labels."""
    from pyspark.ml.feature import StringIndexerModel
    out = []
    idx = [s for s in model.stages if isinstance(s, StringIndexerModel)]
    labels = dict(zip(idx[0].getInputCols(), idx[0].labelsArray)) if idx else {}
    for n in names:
        if n.endswith("__ohe"):
            base = n[:-5]
            # the indexer keeps unseen levels as one more
            out += [f"{base}={lab}" for lab in labels.get(base, [])] + [f"{base}=__unknown"]
        else:
            out.append(n.replace("__imp", ""))
    return out


def _grid(spark, sf_dir):
    """(feature set, model, predicted test rows) of the whole grid."""
    t = bind(spark, sf_dir)
    c2o = fe.cluster_clicks_funnel(ck.click_to_order(ck.first_orders(t.funnel_orders()), t.clicks()), t.clusters())
    frame = share(fe.feature_frame(_panel(spark, sf_dir), c2o))
    train = frame.filter(F.col("dataset_split") == "train")
    test = frame.filter(F.col("dataset_split") == "test")

    def run(job):
        set_name, cols, mname = job
        spec = md.MODEL_GRID[mname]
        if spec is None:
            return set_name, mname, test.withColumn("predicted_demand", F.coalesce("lag_1_demand", F.lit(0.0)))
        pair = md.standardise(train, test, cols) if spec["kind"] in ("linear", "ridge") else (train, test)
        return set_name, mname, md.fit_predict(*pair, cols, spec, clip=False)[1]

    return md._parallel(run, [(s, cols, m) for s, cols in fe.feature_sets(True).items() for m in md.MODEL_GRID], 4)


@query("model_grid")
def q_model_grid(spark, sf_dir):
    """M8+M13+E1: feature sets A-F x (lag-1 baseline, linear, ridge, forest,
    boosted trees) on the warehouse model frame; MAE/RMSE/WAPE/MAPE on the
    test split."""
    return union_all([ev.forecast_metrics(pred).withColumns({"feature_set": F.lit(s), "model": F.lit(m)})
                      for s, m, pred in _grid(spark, sf_dir)])


@query("model_grid_predictions")
def q_model_grid_predictions(spark, sf_dir):
    """Test-split predictions of every cell of the grid."""
    return union_all([pred.select("date", fe.WAREHOUSE, fe.CLUSTER, "demand", "predicted_demand",
                                  F.lit(s).alias("feature_set"), F.lit(m).alias("model"))
                      for s, m, pred in _grid(spark, sf_dir)])


@query("best_vs_baselines")
def q_best_vs_baselines(spark, sf_dir):
    """M21+E1: boosted trees on feature set B vs yesterday's demand and the
    past-7-day mean, on rows with full history (lags 1-3 and a full 7-day
    window), sorted by WAPE, RMSE, MAE."""
    hist = fe.demand_history(_panel(spark, sf_dir)).withColumn(
        "rolling_mean_7_demand", fe.shifted_rolling("demand", [fe.CLUSTER, fe.WAREHOUSE], 7, F.avg))
    df = share(hist.dropna(subset=["lag_1_demand", "lag_2_demand", "lag_3_demand", "rolling_mean_7_demand"]))
    train = df.filter(F.col("dataset_split") == "train")
    test = df.filter(F.col("dataset_split") == "test")
    _, pred, _ = md.fit_predict(train, test, fe.FEATURE_SETS["B"], md.MODEL_GRID["gradient_boosting"], clip=False)
    runs = [("GBT_FeatureSet_B", pred),
            ("Baseline_YesterdayDemand", test.withColumn("predicted_demand", F.col("lag_1_demand"))),
            ("Baseline_Past7DayAverage", test.withColumn("predicted_demand", F.col("rolling_mean_7_demand")))]
    out = None
    for name, frame in runs:
        m = ev.forecast_metrics(frame).withColumn("model_name", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.orderBy(F.col("wape").asc_nulls_last(), "rmse", "mae")
