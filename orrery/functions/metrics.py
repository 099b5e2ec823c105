"""Metrics as aggregates over label and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked, running, small_groups
from .safe import clip, div


def rmse(y, p):
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2))))


def mae(y, p):
    return F.avg(F.abs(y - p))


def r2(y, p):
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - div(F.sum(F.pow(y - p, F.lit(2))), total)).otherwise(F.lit(0.0))


def logloss(y, p):
    q = clip(p, 1e-7, 1 - 1e-7)
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def accuracy(y, p):
    """Predictions are probabilities if all lie in [0, 1], else classes."""
    share = F.avg(F.when((p >= 0.5).cast("int") == y.cast("int"), 1.0).otherwise(0.0))
    exact = F.avg(F.when(p.cast("int") == y.cast("int"), 1.0).otherwise(0.0))
    return F.when((F.min(p) >= 0) & (F.max(p) <= 1), share).otherwise(exact)


def pinball(y, p, alpha: float):
    return F.avg(F.when(y >= p, alpha * (y - p)).otherwise((alpha - 1) * (y - p)))


def sharpe(r, periods: int = 252):
    return div(F.avg(r), F.stddev_pop(r)) * (periods**0.5)


def auc(df: DataFrame, y: str, p: str, row: str) -> DataFrame:
    """Rank sum over distinct scores, ties counted half.  Counts per score are summed before they are ordered, and
    ordered in ranges, so the running count never needs one task for all rows."""
    scores = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    below = running(scores, [], ["p"], {"below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg")))
    return below.agg(F.coalesce(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")), F.lit(0.5)).alias("auc"))


def ndcg(df: DataFrame, group: str, relevance: str, score: str, row: str, k: int = 10) -> DataFrame:
    """(group, ndcg): exponential gains, 1 where nothing is relevant."""
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    rows = df.select(group, gain.alias("g"), (-F.col(score)).alias("_s"), (-F.col(relevance)).alias("_r"), F.col(row).alias("_row"))
    small = small_groups(rows, [group])
    placed = ranked(ranked(rows, [group], ["_s", "_row"], "i", small), [group], ["_r", "_row"], "j", small)
    part = lambda i: F.sum(F.when(F.col(i) <= k, F.col("g") / F.log2(F.col(i) + F.lit(1.0))).otherwise(0.0))
    return placed.groupBy(group).agg(part("i").alias("dcg"), part("j").alias("idcg")).select(group, F.when(F.col("idcg") > 0, div("dcg", "idcg")).otherwise(1.0).alias("ndcg"))


def concordance(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Share of comparable pairs in which the earlier event has the higher risk, ties half.

    Rows are counted by (time, event, risk).  Distinct times are numbered and paired through a binary tree over the
    numbers: an earlier and a later time part at exactly one level, in the two halves of one block.  Within each block
    events of the first half count the rows of the second with lower risk by a running sum in the order of risk, so the
    work is n log n and no task holds a block."""
    c = df.groupBy(F.col(time).alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    numbered = ranked(c.select("t").distinct(), [], ["t"], "k")
    count = numbered.agg(F.max("k")).first()[0] or 0
    cells = c.join(numbered, "t").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(count, 1).bit_length()))))
    side = F.call_function("shiftright", F.col("k"), F.col("level")).bitwiseAND(1)
    placed = cells.select("level", F.call_function("shiftright", F.col("k"), F.col("level") + 1).alias("block"), "r", F.when(side == 0, F.col("n") * F.col("e")).otherwise(0).alias("events"), F.when(side == 1, F.col("n")).otherwise(0).alias("later"))
    sums = placed.groupBy("level", "block", "r").agg(F.sum("events").alias("events"), F.sum("later").alias("later"))
    met = running(sums, ["level", "block"], ["r"], {"below": F.col("later")})
    totals = sums.groupBy("level", "block").agg(F.sum("events").alias("all_events"), F.sum("later").alias("all_later"))
    won = met.agg(F.sum(F.col("events") * (F.col("below") + 0.5 * F.col("later"))).alias("won"))
    pairs = totals.agg(F.sum(F.col("all_events") * F.col("all_later")).alias("pairs"))
    return won.crossJoin(pairs).select(F.coalesce(F.try_divide("won", F.col("pairs").cast("double")), F.lit(0.5)).alias("c_index"))


def max_drawdown(df: DataFrame, time: str, value: str) -> DataFrame:
    from ..operators.eras import drawdown

    return drawdown(df, time, value)


#: Name to aggregate, or to function of a DataFrame.
METRICS = {"rmse": rmse, "mae": mae, "r2": r2, "logloss": logloss, "accuracy": accuracy, "auc": auc, "ndcg": ndcg, "concordance_index": concordance, "sharpe": sharpe, "max_drawdown": max_drawdown, "pinball": pinball}
