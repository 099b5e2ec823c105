import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from orrery.estimators import Classifier, MultiTargetRegressor, QuantileRegressor, Ranker, RankRegressor, Regressor, Survival
from orrery.functions import objectives as O
from orrery.operators.splits import Rule, best, candidates
from orrery.plans.boosting import Booster, Params, drop_set


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    x[rng.random(300) < 0.05, 1] = np.nan
    y = 2 * x[:, 0] - np.nan_to_num(x[:, 1]) + 0.1 * rng.normal(size=300)
    pdf = pd.DataFrame({"row_id": range(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y, "era": np.arange(300) // 60})
    return spark.createDataFrame(pdf), pdf


def r2(out):
    return 1 - ((out.label - out.prediction) ** 2).sum() / ((out.label - out.label.mean()) ** 2).sum()


BASE = dict(features=["a", "b", "c"], n_estimators=5, learning_rate=0.5, max_depth=3, max_bins=16)


@pytest.mark.parametrize("more", [{}, {"growth": "symmetric"}, {"growth": "depthwise", "monotone": {0: 1}}, {"growth": "hybrid", "symmetric_depth": 1}, {"goss": True, "colsample": 0.7}, {"dart": True, "drop_rate": 0.3}, {"adaptive": True, "reg_alpha": 0.1}])
def test_regressor_learns(data, more):
    df, _ = data
    model = Regressor(**BASE | more).fit(df)
    out = model.transform(df).toPandas()
    assert r2(out) > 0.5
    assert abs(sum(model.importances().values()) - 1) < 1e-9
    state = model.train_state.select("row", "pred").toPandas().set_index("row").pred
    assert np.allclose(state.sort_index(), out.set_index("row_id").prediction.sort_index(), atol=1e-9)


def test_era_features_run(data):
    df, _ = data
    more = dict(era="era", era_method="hard_era", era_clip=4.0, era_beta=0.1, orthogonal=["c"], exposure_lambda=0.01, temporal_rho=0.01, clip_tau=5.0, noise_eta=0.01)
    out = Regressor(**BASE | more).fit(df).transform(df).toPandas()
    assert np.isfinite(out.prediction).all() and r2(out) > 0.3


def test_early_stop_and_leaf_objectives(data):
    df, _ = data
    model = Regressor(objective="mae", early_stopping=2, **BASE).fit(df.where("row_id < 200"), df.where("row_id >= 200"))
    assert len(model.losses) >= 1 and model.best_round == int(np.argmin(model.losses))
    out = QuantileRegressor(objective_options={"alpha": 0.9}, **BASE).fit(df).transform(df).toPandas()
    assert 0.75 < (out.label <= out.prediction).mean() <= 1


def test_classifier_with_strings(spark, data):
    _, pdf = data
    df = spark.createDataFrame(pdf.assign(label=np.where(pdf.label > 1, "high", np.where(pdf.label < -1, "low", "mid"))))
    out = Classifier(**BASE | {"n_estimators": 4}).fit(df).transform(df).toPandas()
    assert (out.label == out.prediction).mean() > 0.7


def test_best_split_is_the_best():
    rng = np.random.default_rng(0)
    bins, g = rng.integers(0, 6, (200, 2)), rng.normal(size=200)
    G, H, C = (np.zeros((2, 6)) for _ in range(3))
    for f in range(2):
        np.add.at(G[f], bins[:, f], g)
        np.add.at(H[f], bins[:, f], 1)
        np.add.at(C[f], bins[:, f], 1)
    gain = candidates((G, H, C), Rule())[0]
    s = lambda m: g[m].sum() ** 2 / (m.sum() + 1)
    gains = []
    for f in range(2):
        for b in range(5):
            for d in (0, 1):
                left = (bins[:, f] <= b) & (bins[:, f] != 5) | ((bins[:, f] == 5) & (d == 0))
                if 0 < left.sum() < 200:
                    gains.append(0.5 * (s(left) + s(~left) - s(np.ones(200, bool))))
    assert math.isclose(gain[best(gain)], max(gains), rel_tol=1e-9)


def test_levels_as_jobs_and_one_task_give_the_same_model(data):
    df, _ = data
    same = BASE | {"growth": "hybrid", "symmetric_depth": 1, "monotone": {0: 1}}
    one, jobs = (Regressor(**same | {"task_cells": n}).fit(df.repartition(k)) for n, k in ((10**9, 1), (0, 5)))
    assert [r[2:9] for r in one.nodes()] == [r[2:9] for r in jobs.nodes()]
    assert np.allclose([r[9] for r in one.nodes()], [r[9] for r in jobs.nodes()], atol=1e-9)


def test_monotone_bounds_hold_over_whole_trees(data):
    df, pdf = data
    model = Regressor(**BASE | {"max_depth": 5, "n_estimators": 4, "monotone": {0: 1, 1: -1}, "growth": "depthwise"}).fit(df)
    for name, sign in (("a", 1), ("b", -1)):
        base = pdf.iloc[:20].fillna(0.0)
        grid = pd.concat([base.assign(**{name: v, "grid": v}) for v in np.linspace(-3, 3, 13)])
        out = model.transform(df.sparkSession.createDataFrame(grid)).toPandas().sort_values(["row_id", "grid"])
        steps = out.groupby("row_id").prediction.diff().dropna()
        assert (sign * steps >= -1e-9).all()


def test_any_column_names(data):
    df, _ = data
    names = ["x", "bins", "row", "label", "era", "order", "pred", "g", "h", "node", "_row", "_f0"]
    odd = df.select(F.col("row_id").alias("slot"), F.col("label").alias("target"), *[(F.col("a") * (k + 1) + F.col("c")).alias(n) for k, n in enumerate(names)])
    out = Regressor(**BASE | {"features": names, "label": "target", "row": "slot"}).fit(odd).transform(odd).toPandas()
    assert r2(out.rename(columns={"label": "_", "target": "label"})) > 0.3


def test_missing_eras_and_text_ids(data):
    df, _ = data
    odd = df.withColumn("era", F.when(F.col("era") != 2, F.col("era"))).withColumn("row_id", F.concat(F.lit("r"), F.col("row_id")))
    more = dict(era="era", era_method="hard_era", era_clip=4.0, subsample=0.8, noise_eta=0.01)
    model = Regressor(**BASE | more).fit(odd)
    assert model.train_state.count() == 300 and r2(model.transform(odd).toPandas()) > 0.3


def test_saved_models_score_alike(data, tmp_path):
    df, _ = data
    cats = df.withColumn("kind", F.col("row_id") % 7).withColumn("label", F.col("label") + F.col("kind"))
    model = Regressor(**BASE | {"features": ["a", "b", "kind"], "categorical": ["kind"]}).fit(cats)
    model.save(f"{tmp_path}/m", df.sparkSession)
    again = Booster.load(f"{tmp_path}/m", df.sparkSession, O.mse())
    new = cats.withColumn("kind", F.col("kind") + 3)  # kinds 7 to 9 are unseen
    assert np.allclose(*(m.transform(new).orderBy("row_id").toPandas().prediction for m in (model, again)))
    with pytest.raises(ValueError):
        Booster.load(f"{tmp_path}/m", df.sparkSession, O.mae())


def test_bundles_and_drops(data):
    df, _ = data
    sparse = df.select("row_id", *[F.when(F.col("row_id") % 3 == k, F.abs(f) + 1).otherwise(0.0).alias(f) for k, f in enumerate("abc")], (F.col("row_id") % 3 * F.lit(2.0)).alias("label"))
    model = Regressor(**BASE | {"bundle": True, "max_bins": 400}).fit(sparse)
    assert len(model.bundles) == 1 and r2(model.transform(sparse).toPandas()) > 0.9
    p = Params(dart=True, drop_rate=1.0)
    assert all(len(drop_set(p, t, 4, [])) == 3 for t in range(5)) and drop_set(p, 0, 0, []) == []
    steady = Params(era_dart=True, era_dart_scale=1e6, seed=1)
    assert set(drop_set(steady, 1, 3, [0.0, 0.5, 1.0])) <= {1, 2}


def test_sharpe_stops_and_scales(data):
    df, _ = data
    model = Regressor(**BASE | {"n_estimators": 8}, era="era", sharpe_patience=2, sharpe_threshold=0.5, era_dart=True).fit(df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1"))
    assert len(model.losses) >= 2 and len(model.tree_variances) == len(model.trees)


def test_parameters():
    model = Regressor(**BASE)
    assert model.get_params()["max_depth"] == 3 and model.clone(max_depth=4).params.max_depth == 4 and model.set_params(seed=9).params.seed == 9
    for bad in ({"growth": "sideways"}, {"subsample": 0.0}, {"max_bins": 1}, {"monotone": {0: 3}}):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(ValueError):
        Regressor(features=["a"], objective="none")


@pytest.mark.parametrize("kind", ["spearman", "neutral", "max_sharpe"])
def test_rank_regressors_learn_the_order(data, kind):
    df, _ = data
    more = {"era": "era", "reg_lambda": 1e-6, "min_child_weight": 0.0, "learning_rate": 0.01} if kind == "max_sharpe" else {}
    out = RankRegressor(objective=kind, **BASE | more).fit(df).transform(df).toPandas()
    assert out.label.corr(out.prediction, method="pearson") > (0.0 if kind == "neutral" else 0.5)


def test_ranker_survival_and_multi_target(data):
    df, pdf = data
    ranks = df.withColumn("label", (F.col("a") > 0).cast("int") + (F.col("a") > 1).cast("int"))
    out = Ranker(group="era", **BASE | {"min_child_weight": 0.01}).fit(ranks).transform(ranks).toPandas()
    assert out.prediction[out.label == 2].mean() > out.prediction[out.label == 0].mean()
    times = df.withColumn("label", F.exp(-F.col("a"))).withColumn("died", F.col("row_id") % 4 != 0)
    out = Survival(event="died", **BASE).fit(times).transform(times).toPandas()
    assert (out.prediction > 0).all() and np.corrcoef(np.log(out.prediction), out.a)[0, 1] > 0.5
    out = MultiTargetRegressor(aux=["label"], alpha=0.5, **BASE).fit(df).transform(df).toPandas()
    assert r2(out) > 0.5


def test_multiclass_embeddings_reads_all_classes_and_elements(spark, tmp_path):
    from orrery.queries import multiclass_embeddings

    # class k alone has a large element 4 + k; the first four say nothing
    rows = [(i, [float(i % 3)] * 4 + [10.0 + i % 2 if i % 5 == k else float(i % 2) for k in range(5)], i % 5) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r["row_id"]: r["prediction"] for r in multiclass_embeddings(spark, str(tmp_path)).collect()}
    assert out == {i: int(np.argmax(e[4:])) for i, e, _ in rows}
