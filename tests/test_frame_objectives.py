import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.functions import frame_objectives as O
from orrery.functions import objectives
from orrery.operators import bundling, tree


def normed(y):
    r = np.empty(len(y))
    r[np.argsort(y, kind="stable")] = np.arange(len(y))
    return 2 * r / max(len(y) - 1, 1) - 1


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"row_id": range(200), "era": np.arange(200) // 50, "y": np.round(rng.normal(size=200), 1), "p": rng.normal(size=200), "a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf = pd.concat([pdf, pd.DataFrame({"row_id": [200], "era": [9], "y": [0.5], "p": [1.0], "a": [0.1], "b": [0.2]})], ignore_index=True)
    return spark.createDataFrame(pdf), pdf


def by_row(df):
    return df.toPandas().sort_values("row_id").reset_index(drop=True)


def test_global_rank_with_ties(panel):
    df, pdf = panel
    out = by_row(O.rank_target(df, "y", "row_id"))
    assert np.allclose(out.target, normed(pdf.y.to_numpy()))


def test_spearman_gradient(panel):
    df, pdf = panel
    r, p = normed(pdf.y.to_numpy()), pdf.p.to_numpy()
    want = p - r - 0.5 * np.corrcoef(p, r)[0, 1] * (p - p.mean()) / p.std() / r.std()
    got = by_row(O.spearman_gradient(O.rank_target(df, "y", "row_id"), "target", "p"))
    assert np.allclose(got.grad, want, atol=1e-6) and (got.hess == 1).all()


def test_max_sharpe_gradient_is_the_pull_of_weak_eras(panel):
    df, pdf = panel
    got = by_row(O.max_sharpe_gradient(df, "era", "y", "p", "row_id"))
    rho = np.array([np.corrcoef(normed(g.p.to_numpy()), normed(g.y.to_numpy()))[0, 1] if len(g) > 1 else 0.0 for _, g in pdf.groupby("era")])
    mu, sd = rho.mean(), rho.std() + 1e-9
    w = (sd**2 - mu * (rho - mu)) / (len(rho) * sd**3)
    for k, (_, g) in enumerate(pdf.groupby("era")):
        r = normed(g.y.to_numpy())
        want = -w[k] * (r - r.mean()) / (len(g) * (g.p.std(ddof=0) + 1e-9) * (r.std() + 1e-9)) if len(g) > 1 else 0.0
        assert np.allclose(got.grad[g.index], want, atol=1e-6)
        assert np.allclose(got.hess[g.index], 1 / (len(g) * len(rho)))


def test_neutral_gradient(panel):
    df, pdf = panel
    x = pdf[["a", "b"]].to_numpy()
    project = np.eye(len(x)) - x @ np.linalg.solve(x.T @ x + 1e-4 * np.eye(2), x.T)
    want = project @ (project @ pdf.p.to_numpy() - pdf.y.to_numpy())
    assert np.allclose(by_row(O.neutral_gradient(df, "y", "p", ["a", "b"])).grad, want, atol=1e-8)


def test_multi_target(panel):
    df, pdf = panel
    grad, hess = O.multi_target(objectives.mse(), F.col("y"), F.col("p"), [F.col("a"), F.col("b")], 0.7)
    got = by_row(df.select("row_id", grad.alias("g"), hess.alias("h")))
    assert np.allclose(got.g, 0.7 * (pdf.p - pdf.y) + 0.3 * (pdf.p - (pdf.a + pdf.b) / 2))
    assert O.alpha_at(0.8, 0.2, 0, 5) == 0.2 and O.alpha_at(0.8, 0.2, 4, 5) == pytest.approx(0.8)
    with pytest.raises(ValueError):
        O.multi_target(objectives.mse(), F.col("y"), F.col("p"), [], 2)


def test_bundles(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({c: np.where(np.arange(90) // 30 == k, rng.uniform(1, 2, 90), 0.0) for k, c in enumerate("abc")} | {"d": rng.normal(size=90)})
    pdf.loc[0, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    edges = {c: [1.25, 1.5, 1.75] for c in "abcd"}
    assert bundling.find_bundles(df, edges) == [["d"], ["a", "b", "c"]]
    assert bundling.find_bundles(df, edges, max_bins=9) == [["d"], ["a", "b"], ["c"]]
    merged = tree.bin_column([F.col(c) for c in "abc"], [edges[c] for c in "abc"], 255, [[0, 1, 2]])
    got = df.select("*", merged[0].alias("bin")).toPandas()
    for k, c in enumerate("abc"):
        rows = got[got[c].fillna(0) != 0]
        assert (rows.bin == np.digitize(rows[c], edges[c]) + 4 * k + 1).all()
    assert bundling.find_bundles(df.limit(0), edges, max_bins=5) == [["a"], ["b"], ["c"], ["d"]]
