"""Ordered operators: ranges give what windows give, and no plan brings a whole table into one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.functions import metrics as M
from orrery.functions import objectives as O
from orrery.operators import eras as E
from orrery.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"row_id": range(500), "grp": rng.integers(0, 4, 500).astype(float), "x": np.round(rng.normal(size=500), 1), "y": rng.normal(size=500)})
    pdf.loc[pdf.grp == 3, "grp"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("grp", F.when(~F.isnan("grp"), F.col("grp").cast("int")))
    return df.repartition(7), pdf.assign(grp=pdf.grp.fillna(-1))


@pytest.mark.parametrize("small", [True, False])
def test_running_ranks_and_neighbours(rows, small):
    df, pdf = rows
    want = pdf.sort_values(["x", "row_id"])
    out = ordered.running(df, ["grp"], ["x", "row_id"], {"s": F.col("y"), "k": F.lit(1)}, small).toPandas().set_index("row_id")
    assert np.allclose(out.s.sort_index(), (want.groupby("grp").y.cumsum() - want.y).sort_index()) and (out.k.sort_index() == want.groupby("grp").cumcount().sort_index()).all()
    near = ordered.neighbours(df, ["grp"], ["x", "row_id"], "y", small).toPandas().set_index("row_id").sort_index()
    assert np.allclose(near._lag, want.groupby("grp").y.shift(1).sort_index(), equal_nan=True) and np.allclose(near._lead, want.groupby("grp").y.shift(-1).sort_index(), equal_nan=True)
    q = ordered.quantiles(df, ["grp"], F.col("x"), lambda n: F.lit(0.3), "q", small).toPandas()
    got = {(-1 if pd.isna(g) else g): (n, v) for g, n, v in zip(q.grp, q.n, q.q)}
    for g, part in pdf.groupby("grp"):
        assert got[g][0] == len(part) and np.isclose(got[g][1], np.quantile(part.x, 0.3))


def test_cut_and_whole_table_quantile(rows):
    df, pdf = rows
    order = pdf.assign(k=pdf.x.abs()).sort_values(["k", "row_id"], ascending=[False, True])
    for k in (1, 2, 99, 100, 499, 500):
        assert ordered.cut(df.withColumn("k", F.abs("x")), "k", "row_id", k) == (order.k.iloc[k - 1], order.row_id.iloc[k - 1])
    assert ordered.cut(df.withColumn("k", F.lit(1.0)), "k", "row_id", 77) == (1.0, 76)  # all tie
    assert np.isclose(ordered.quantiles(df, [], F.col("y"), lambda n: F.lit(0.9)).first()["q"], np.quantile(pdf.y, 0.9))


def test_rows_without_era_stay(rows):
    df, _ = rows
    assert E.mad_clip(df, "grp", "y", 1.0).count() == E.rank_normalize(df, "x", "row_id", "grp").count() == E.neutralize_by_era(df, "grp", "row_id", "y", ["x"]).count() == 500
    assert E.Conformal(era="grp").calibrate(df, "y", "x").predict_interval(df, "x").where("lower IS NOT NULL AND upper IS NOT NULL").count() == 500
    with pytest.raises(RuntimeError):
        E.Conformal().predict_interval(df, "x")


def test_no_whole_table_in_one_task(rows, tmp_path):
    df, _ = rows
    table = df.withColumn("ds", F.col("y") / 10).withColumn("t", F.abs(F.round("x", 1))).withColumn("e", F.lit(1))
    plans = [
        E.purged_folds(table, ["row_id"], 5, 0.01), E.temporal_gradient(table, "row_id", "y"), O.cox_gradient(table, "t", "e", "ds"), E.goss(table, "y", "row_id"), E.weighted_goss(table, "y", "row_id", "t", 0.1),
        ordered.ranked(table, [], ["y", "row_id"]), ordered.quantiles(table, [], F.col("y"), lambda n: F.lit(0.5)),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        for line in text.split("\n"):
            assert "SinglePartition" not in line or "ENSURE_REQUIREMENTS" in line and "row_id" not in text[text.index(line) : text.index(line) + 400].split("Sort")[0], text


def test_concordance_by_brute_force(spark):
    rng = np.random.default_rng(4)
    t, e, r = rng.integers(0, 30, 200), rng.integers(0, 2, 200), rng.integers(0, 9, 200)
    won = pairs = 0
    for i in range(200):
        for j in range(200):
            if e[i] and t[j] > t[i]:
                pairs += 1
                won += 1.0 if r[i] > r[j] else 0.5 if r[i] == r[j] else 0.0
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "r": r.astype(float)}))
    assert np.isclose(M.concordance(df, "t", "e", "r").first()[0], won / pairs)
    assert M.concordance(df.limit(0), "t", "e", "r").first()[0] == 0.5


def test_streams_score_like_tables(spark, tmp_path):
    from orrery.estimators import Regressor
    from orrery.streaming.scoring import score_stream

    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 * 2.0).alias("label"))
    model = Regressor(features=["a"], n_estimators=3, max_depth=3).fit(df)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = score_stream(model, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", name="scored_rows")
    query.processAllAvailable()
    query.stop()
    got, want = (x.orderBy("row_id").toPandas().prediction for x in (spark.table("scored_rows"), model.transform(df)))
    assert np.allclose(got, want)
