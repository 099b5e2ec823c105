"""Objectives as columns: each gives gradient and hessian from label and prediction, and an initial score."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .safe import clip


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


@dataclass
class Objective:
    """leaf: an aggregate of the residual that replaces the Newton step in leaves; link: from raw score to prediction;
    frame: in place of grad and hess, adds both to a frame of row, x, label, era, pred and the input's `columns`;
    at: the objective of a round, from its number and the number of rounds."""

    name: str
    grad: Callable[[Column, Column], Column]
    hess: Callable[[Column, Column], Column]
    init: Callable[[Column], Column]
    loss: Callable[[Column, Column], Column]
    leaf: Callable[[Column], Column] | None = None
    link: Callable[[Column], Column] = lambda p: p
    frame: Callable | None = None
    columns: tuple[str, ...] = ()
    at: Callable | None = None


def _one(y, p):
    return F.lit(1.0)


def mse() -> Objective:
    return Objective("mse", lambda y, p: p - y, _one, F.avg, lambda y, p: F.pow(p - y, F.lit(2)))


def mae() -> Objective:
    return Objective("mae", lambda y, p: F.signum(p - y), _one, F.median, lambda y, p: F.abs(p - y), F.median)


def huber(delta: float = 1.0) -> Objective:
    grad = lambda y, p: clip(p - y, -delta, delta)
    hess = lambda y, p: F.when(F.abs(p - y) <= delta, F.lit(1.0)).otherwise(F.lit(delta) / (F.abs(p - y) + 1e-8))
    loss = lambda y, p: F.when(F.abs(p - y) <= delta, 0.5 * (p - y) * (p - y)).otherwise(delta * (F.abs(p - y) - 0.5 * delta))
    return Objective("huber", grad, hess, F.median, loss, F.avg)


def asymmetric_huber(delta: float = 1.0, kappa: float = 2.0) -> Objective:
    """Over-prediction beyond delta is pushed back kappa times as hard, with constant force."""
    if kappa < 1:
        raise ValueError("kappa must be at least 1")
    grad = lambda y, p: F.when(p - y <= delta, p - y).otherwise(F.lit(kappa * delta))
    hess = lambda y, p: F.when(p - y <= delta, F.lit(1.0)).otherwise(F.lit(1e-3))
    loss = lambda y, p: F.when(p - y <= delta, 0.5 * (p - y) * (p - y)).otherwise(kappa * delta * (p - y - 0.5 * delta))
    return Objective("asymmetric_huber", grad, hess, F.avg, loss)


def logloss() -> Objective:
    grad = lambda y, p: sigmoid(p) - y
    hess = lambda y, p: F.greatest(sigmoid(p) * (1 - sigmoid(p)), F.lit(1e-7))
    mean = lambda y: clip(F.avg(y), 1e-7, 1 - 1e-7)
    loss = lambda y, p: -(y * F.ln(clip(sigmoid(p), 1e-7, 1 - 1e-7)) + (1 - y) * F.ln(1 - clip(sigmoid(p), 1e-7, 1 - 1e-7)))
    return Objective("binary_logloss", grad, hess, lambda y: F.ln(mean(y) / (1 - mean(y))), loss, link=sigmoid)


def quantile(alpha: float = 0.5) -> Objective:
    grad = lambda y, p: F.when(y < p, F.lit(1 - alpha)).otherwise(F.lit(-alpha))
    loss = lambda y, p: F.when(y >= p, alpha * (y - p)).otherwise((alpha - 1) * (y - p))
    q = lambda r: F.percentile(r, F.lit(alpha))
    return Objective("quantile", grad, _one, q, loss, q)


def cvar(alpha: float = 0.5, compat: bool = False) -> Objective:
    """Expected shortfall; the gradient is its loss's derivative, compat gives the opposite sign."""
    sign = 1 if compat else -1
    grad = lambda y, p: sign * (1 - F.when(y < p, F.lit(1 / alpha)).otherwise(F.lit(0.0)))
    loss = lambda y, p: -p + F.greatest(p - y, F.lit(0.0)) / alpha
    return Objective("cvar", grad, _one, lambda y: F.percentile(y, F.lit(alpha)), loss)


#: Objectives that are columns of label and prediction alone.
ROWWISE = {"mse": mse, "mae": mae, "huber": huber, "asymmetric_huber": asymmetric_huber, "binary_logloss": logloss, "quantile": quantile, "cvar": cvar}


def cox_gradient(df, time: str, event: str, score: str):
    """df with grad and hess of the Cox partial likelihood, Breslow ties.  Rows are summed by time first; the risk sets are
    running sums over distinct times, in ranges, so neither a busy time nor the whole table is one task."""
    from ..operators.ordered import running

    r, e = F.exp(F.col(score)), F.col(event).cast("double")
    times = df.groupBy(F.col(time).alias("_time")).agg(F.sum(r).alias("_r"), F.sum(e).alias("_e"))
    later = running(times.withColumn("_down", -F.col("_time").cast("double")), [], ["_down"], {"_beyond": F.col("_r")})
    at_risk = later.withColumn("_risk", F.col("_r") + F.col("_beyond"))
    a, b = F.col("_e") / F.col("_risk"), F.col("_e") / (F.col("_risk") * F.col("_risk"))
    past = running(at_risk, [], ["_time"], {"_pa": a, "_pb": b}).select("_time", (F.col("_pa") + a).alias("_a"), (F.col("_pb") + b).alias("_b"))
    met = df.join(past, F.col(time) == F.col("_time"))
    return met.withColumn("grad", r * F.col("_a") - e).withColumn("hess", F.greatest(r * F.col("_a") - r * r * F.col("_b"), F.lit(1e-7))).drop("_time", "_a", "_b")


def softmax(values: Column) -> Column:
    """Of an array column, against its largest value."""
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def softmax_gradient(label: Column, scores: Column) -> tuple[Column, Column]:
    """Gradients and hessians of all classes as arrays: probabilities less the one-hot label (a class number)."""
    p = softmax(scores)
    return F.transform(p, lambda v, k: v - F.when(k == label, 1.0).otherwise(0.0)), F.transform(p, lambda v: F.greatest(v * (1 - v), F.lit(1e-7)))


def log_priors(df, label: str):
    """(label, init): the log of each class's share."""
    n = df.where(F.col(label).isNotNull()).count()
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.ln(F.count(F.lit(1)) / float(max(n, 1))).alias("init"))


def lambdarank(df, row: str, group: str, relevance: str, score: str, sigma: float = 1.0, block: int = 2048):
    """(row, grad, hess): pairs of differing relevance within a group pull apart, weighted by the change in NDCG.  Places come
    from ordered ranks; the pairs of a large group are dealt to (its rows / block) tasks, each with all rows on one side
    and one block on the other."""
    from ..operators.ordered import ranked, small_groups

    rows = df.select(F.col(row).alias("_id"), F.col(group).alias("_grp"), F.col(relevance).alias("rel"), F.col(score).alias("s"))
    rows = rows.withColumn("_ds", -F.col("s")).withColumn("_dr", -F.col("rel"))
    small = small_groups(rows, ["_grp"])
    placed = ranked(ranked(rows, ["_grp"], ["_ds", "_id"], "_i", small), ["_grp"], ["_dr", "_id"], "_j", small)
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    gained = placed.select("_id", "_grp", "rel", "s", gain.alias("gain"), (1 / F.log2(F.col("_i") + F.lit(1.0))).alias("disc"), (1 / F.log2(F.col("_j") + F.lit(1.0))).alias("best"))
    totals = gained.groupBy(F.col("_grp").alias("_g")).agg(F.sum(F.col("gain") * F.col("best")).alias("idcg"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    whole = gained.join(totals, F.col("_grp").eqNullSafe(F.col("_g"))).drop("_g").where("idcg > 0")
    a = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    b = whole.select(F.col("_grp").alias("_grp2"), F.pmod(F.xxhash64("_id"), F.col("blocks").cast("long")).cast("int").alias("part2"), F.col("rel").alias("rel2"), F.col("s").alias("s2"), F.col("gain").alias("gain2"), F.col("disc").alias("disc2"))
    pairs = a.join(b, F.col("_grp").eqNullSafe(F.col("_grp2")) & (F.col("part") == F.col("part2")) & (F.col("rel") != F.col("rel2")))
    up = F.when(F.col("rel") > F.col("rel2"), F.lit(1.0)).otherwise(F.lit(-1.0))
    rho = sigmoid(-sigma * up * (F.col("s") - F.col("s2")))
    delta = F.abs((F.col("gain") - F.col("gain2")) * (F.col("disc") - F.col("disc2"))) / F.col("idcg")
    summed = pairs.groupBy("_id").agg(F.sum(-sigma * up * rho * delta).alias("grad"), F.sum(sigma * sigma * rho * (1 - rho) * delta).alias("hess"))
    return df.select(row).join(summed, F.col(row) == F.col("_id"), "left").select(row, F.coalesce("grad", F.lit(0.0)).alias("grad"), F.when(F.col("hess").isNull(), F.lit(1.0)).otherwise(F.greatest("hess", F.lit(1e-7))).alias("hess"))
