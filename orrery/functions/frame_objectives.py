"""Objectives that need more than a row: ranks, eras, groups, projections or further targets.  Each gives df with
`grad` and `hess`; ties in a rank go by row id, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import eras as E
from ..operators.ordered import ranked
from . import objectives as O
from .safe import div


def rank_target(df: DataFrame, label: str, row: str, name: str = "target") -> DataFrame:
    """df with the label's rank scaled to -1..1.  Ranks stay the same from round to round: make them once."""
    n = df.count()
    return ranked(df, [], [label, row], "_rank").withColumn(name, 2.0 * (F.col("_rank") - 1) / max(n - 1, 1) - 1).drop("_rank")


def spearman_gradient(df: DataFrame, target: str, pred: str, correction: float = 0.5) -> DataFrame:
    """Squared distance to the rank target, less a pull towards predictions that spread along with it."""
    m = df.agg(F.avg(pred).alias("_mp"), F.stddev_pop(pred).alias("_sp"), F.stddev_pop(target).alias("_st"), F.covar_pop(pred, target).alias("_c"))
    apart = div(F.col("_c"), F.col("_sp") * F.col("_st")) * (F.col(pred) - F.col("_mp")) / (F.col("_sp") + 1e-9) / (F.col("_st") + 1e-9)
    pull = F.when(F.col("_sp") > 1e-9, correction * apart).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(m)).withColumn("grad", F.col(pred) - F.col(target) - pull).withColumn("hess", F.lit(1.0)).drop("_mp", "_sp", "_st", "_c")


def max_sharpe_gradient(df: DataFrame, era: str, label: str, pred: str, row: str, eps: float = 1e-9) -> DataFrame:
    """Ascent of mean over spread of the eras' rank correlations; eras of one row have gradient 0."""
    rhos = E.era_spearman(df, era, pred, label, row)
    every = Window.partitionBy(F.lit(1))
    mean, spread, n = F.avg("rho").over(every), F.stddev_pop("rho").over(every) + eps, F.count(F.lit(1)).over(every)
    pull = (spread * spread - mean * (F.col("rho") - mean)) / (n * spread * spread * spread)
    weights = rhos.select(F.col(era).alias("_era"), pull.alias("_w"), n.alias("_eras"))
    normed = E.rank_normalize(df, label, row, era)
    moments = normed.groupBy(F.col(era).alias("_era")).agg(F.count(F.lit(1)).alias("_n"), F.avg("normed").alias("_mr"), (F.stddev_pop("normed") + eps).alias("_sr"), (F.stddev_pop(pred) + eps).alias("_sp"))
    small = weights.withColumnRenamed("_era", "_e").join(moments, F.col("_e").eqNullSafe(F.col("_era"))).drop("_e")
    slope = (F.col("normed") - F.col("_mr")) / (F.col("_n") * F.col("_sp") * F.col("_sr"))
    out = normed.join(small, F.col(era).eqNullSafe(F.col("_era")))
    return out.withColumn("grad", F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(-F.col("_w") * slope)).withColumn("hess", 1.0 / (F.col("_n") * F.col("_eras"))).drop("normed", "_era", "_w", "_eras", "_n", "_mr", "_sr", "_sp")


def neutral_gradient(df: DataFrame, target: str, pred: str, features: list[str], ridge: float = 1e-4) -> DataFrame:
    """Distance of the neutralized prediction to the target, neutralized again: two passes of p x p sums."""
    once = E.neutralize(df, pred, features, 1.0, ridge).withColumn("_off", F.col("neutral") - F.col(target)).drop("neutral")
    return E.neutralize(once, "_off", features, 1.0, ridge).withColumn("grad", F.col("neutral")).withColumn("hess", F.lit(1.0)).drop("neutral", "_off")


def alpha_at(alpha: float, start: float, round_: int, rounds: int, power: float = 1.0) -> float:
    """The main target's share in a round, from `start` in the first to `alpha` in the last."""
    return start + (alpha - start) * min(round_ / max(rounds - 1, 1), 1.0) ** power


def multi_target(objective, label: Column, pred: Column, aux: list[Column], alpha: float) -> tuple[Column, Column]:
    """(grad, hess): alpha of the main target's gradient and the rest from the mean of the further targets'."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in 0..1")
    grad = objective.grad(label, pred)
    if aux:
        grad = alpha * grad + (1 - alpha) * sum((objective.grad(a, pred) for a in aux), F.lit(0.0)) / len(aux)
    return grad, objective.hess(label, pred)


def _whole(name: str, frame, columns: tuple[str, ...] = (), init=F.avg, link=lambda p: p) -> O.Objective:
    """An objective of whole frames; its loss, where rows need one, is the squared distance to the label."""
    square = O.mse()
    return O.Objective(name, square.grad, square.hess, init, square.loss, link=link, frame=frame, columns=columns)


def _zero(y: Column) -> Column:
    return F.coalesce(F.max(F.lit(0.0)), F.lit(0.0))


def spearman(correction: float = 0.5) -> O.Objective:
    """The label is a rank target."""
    return _whole("spearman", lambda df: spearman_gradient(df, "label", "pred", correction))


def max_sharpe() -> O.Objective:
    return _whole("max_sharpe", lambda df: max_sharpe_gradient(df, "era", "label", "pred", "row"), init=_zero)


def neutral(count: int, ridge: float = 1e-4) -> O.Objective:
    """Of a rank target; against all `count` features, missing values as 0."""
    names = [f"_f{i}" for i in range(count)]

    def frame(df: DataFrame) -> DataFrame:
        named = df.select("*", *[F.coalesce(F.col("x")[i], F.lit(0.0)).alias(n) for i, n in enumerate(names)])
        return neutral_gradient(named, "label", "pred", names, ridge).drop(*names)

    return _whole("neutral", frame)


def lambdarank(group: str, sigma: float = 1.0) -> O.Objective:
    def frame(df: DataFrame) -> DataFrame:
        return df.join(O.lambdarank(df, "row", f"with_{group}", "label", "pred", sigma), "row")

    return _whole("lambdarank", frame, (group,), _zero)


def cox(event: str) -> O.Objective:
    """The label is the time; predictions are hazards."""
    return _whole("cox", lambda df: O.cox_gradient(df, "label", f"with_{event}", "pred"), (event,), _zero, F.exp)


def several(base: O.Objective, aux: list[str], alpha: float, start: float | None = None, power: float = 1.0) -> O.Objective:
    """The base objective's gradient on the label and on the further target columns.  With a start the label's share goes
    from there in the first round to alpha in the last."""

    def made(share: float) -> O.Objective:
        def frame(df: DataFrame) -> DataFrame:
            grad, hess = multi_target(base, F.col("label"), F.col("pred"), [F.col(f"with_{a}").cast("double") for a in aux], share)
            return df.withColumn("grad", grad.cast("double")).withColumn("hess", hess.cast("double"))

        return O.Objective(f"multi_{base.name}", base.grad, base.hess, base.init, base.loss, base.leaf, base.link, frame, tuple(aux))

    out = made(alpha)
    if start is not None:
        out.at = lambda round_, rounds: made(alpha_at(alpha, start, round_, rounds, power))
    return out


def exposed(base: O.Objective, count: int, strength: float) -> O.Objective:
    """The base objective with a penalty on the predictions' exposure to all `count` features."""

    def frame(df: DataFrame) -> DataFrame:
        grown = E.exposure_gradient(df, "x", count, "pred")
        return grown.withColumn("grad", (base.grad(F.col("label"), F.col("pred")) + strength * F.col("egrad")).cast("double")).withColumn("hess", base.hess(F.col("label"), F.col("pred")).cast("double")).drop("egrad")

    return O.Objective(f"exposed_{base.name}", base.grad, base.hess, base.init, base.loss, base.leaf, base.link, frame)


#: Name to maker, of rowwise objectives and of those that need more than a row.
OBJECTIVES = {**O.ROWWISE, "softmax": O.softmax_gradient, "lambdarank": lambdarank, "cox": cox, "spearman": spearman, "max_sharpe": max_sharpe, "neutral": neutral}
