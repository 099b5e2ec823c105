"""Era-aware operators: rank correlation, weights, clipping, exposure, neutralization, intervals, series.

An era without value is an era like any other.  Ranks, medians and quantiles of eras of any size go through
operators/ordered.py; tables by era are joined without a hint, as eras may be as fine as rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import div, pearson
from .ordered import cut, mixed, neighbours, quantiles, ranked, small_groups


def by_era(df: DataFrame, table: DataFrame, era: str, how: str = "inner") -> DataFrame:
    """df with the columns of a table by era; rows without era meet the entry without era."""
    renamed = table.withColumnRenamed(era, "_by_era")
    return df.join(renamed, F.col(era).eqNullSafe(F.col("_by_era")), how).drop("_by_era")


def rank_normalize(df: DataFrame, x: str, row: str, era: str, small: bool | None = None) -> DataFrame:
    counts = df.groupBy(era).agg(F.count(F.lit(1)).alias("_n"))
    out = by_era(ranked(df, [era], [x, row], "_rank", small), counts, era)
    return out.withColumn("normed", 2.0 * (F.col("_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)) - 1).drop("_rank", "_n")


def era_spearman(df: DataFrame, era: str, x: str, y: str, row: str, small: bool | None = None) -> DataFrame:
    """(era, n, rho); 0 for eras of one row."""
    rows = df.select(F.col(era).alias(era), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(row).alias("_row"))
    small = small_groups(rows, [era]) if small is None else small
    both = ranked(ranked(rows, [era], ["_x", "_row"], "rx", small), [era], ["_y", "_row"], "ry", small)
    return both.groupBy(era).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("rx").cast("double"), F.col("ry").cast("double")).alias("rho"))


def era_sharpe(rhos: DataFrame) -> DataFrame:
    """Mean, spread and ratio of the eras' correlations, and the worst era; eras of one row don't count."""
    return rhos.where("n >= 2").agg(F.avg("rho").alias("mean_corr"), F.stddev_pop("rho").alias("std_corr"), (F.avg("rho") / (F.stddev_pop("rho") + 1e-9)).alias("sharpe"), F.min_by("era", F.struct("rho", "era")).alias("worst_era"))


def era_history(rounds: list[DataFrame]) -> DataFrame:
    """era_sharpe of each round's (era, n, rho), with its number."""
    every = [r.select(F.lit(k).alias("round"), "era", "n", "rho") for k, r in enumerate(rounds)]
    table = every[0]
    for more in every[1:]:
        table = table.unionByName(more)
    return table.where("n >= 2").groupBy("round").agg(F.avg("rho").alias("mean_corr"), F.stddev_pop("rho").alias("std_corr"), (F.avg("rho") / (F.stddev_pop("rho") + 1e-9)).alias("sharpe"), F.min_by("era", F.struct("rho", "era")).alias("worst_era"))


def era_weights(rhos: DataFrame, method: str = "hard_era", temperature: float = 1.0, floor: float = 0.0) -> DataFrame:
    """(era, weight, row_weight): row weights sum to the number of rows; no era weighs less than floor / eras before
    weights are scaled to one."""
    every = Window.partitionBy(F.lit(1))
    n = F.count(F.lit(1)).over(every)
    if method == "hard_era":
        logit = -F.col("rho") / temperature
    elif method == "sharpe_reweight":
        mean, std = F.avg("rho").over(every), F.stddev_pop("rho").over(every) + 1e-9
        logit = (1 / (n * std) - mean * (F.col("rho") - mean) / (n * std * std * std)) / temperature
    else:
        logit = None
    raw = rhos.withColumn("_z", logit) if logit is not None else rhos
    if logit is not None:
        raw = raw.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(every)))
    else:
        raw = raw.withColumn("_e", F.greatest(1 - F.abs("rho"), F.lit(1e-6)))
    weighted = raw.withColumn("_w", F.greatest(F.col("_e") / F.sum("_e").over(every), F.lit(floor) / n))
    total = F.sum("n").over(every)
    weight = F.col("_w") / F.sum("_w").over(every)
    return weighted.select("era", weight.alias("weight"), (weight * total / F.col("n")).alias("row_weight"))


def mad(df: DataFrame, era: str, g: str, small: bool | None = None) -> DataFrame:
    """(era, n, mad): median absolute deviation from the era's median."""
    small = small_groups(df, [era]) if small is None else small
    half = lambda n: F.lit(0.5)
    middle = quantiles(df, [era], F.col(g), half, "_m", small).select(era, "_m")
    return quantiles(by_era(df.select(era, g), middle, era).withColumn("_d", F.abs(F.col(g) - F.col("_m"))), [era], F.col("_d"), half, "mad", small)


def mad_clip(df: DataFrame, era: str, g: str, multiple: float = 4.0, small: bool | None = None, least: float = 0.0) -> DataFrame:
    """df with `clipped`: |g| at most multiple times its era's median absolute deviation; eras of one row stay."""
    spread = mad(df, era, g, small).select(era, F.col("n").alias("_n"), F.greatest("mad", F.lit(least)).alias("_mad"))
    kept = F.least(F.abs(g), F.col("_mad") * multiple)
    return by_era(df, spread, era, "left").withColumn("clipped", F.when(F.coalesce("_n", F.lit(0)) < 2, F.col(g)).otherwise(F.signum(g) * kept)).drop("_mad", "_n")


def clip_stats(df: DataFrame, era: str, g: str, multiple: float = 4.0) -> DataFrame:
    """(era, mad, threshold, frac_clipped); eras of one row clip nothing."""
    spread = mad(df, era, g).select(era, "n", "mad", (F.col("mad") * multiple).alias("threshold"))
    share = by_era(df.select(era, g), spread, era).groupBy(era, "n", "mad", "threshold").agg(F.avg((F.abs(g) > F.col("threshold")).cast("double")).alias("frac_clipped"))
    alone = F.col("n") < 2
    return share.select(era, F.when(alone, 0.0).otherwise(F.col("mad")).alias("mad"), F.when(alone, F.lit(float("inf"))).otherwise(F.col("threshold")).alias("threshold"), F.when(alone, 0.0).otherwise(F.col("frac_clipped")).alias("frac_clipped"))


def exposure(df: DataFrame, pred: str, features: list[str], by: list[str] = ()) -> DataFrame:
    """Correlation of the prediction with every feature, as columns."""
    return df.groupBy(*by).agg(*[div(F.covar_pop(pred, f), (F.stddev_pop(pred) + 1e-9) * (F.stddev_pop(f) + 1e-9)).alias(f"exposure_{f}") for f in features])


def max_exposure(df: DataFrame, pred: str, features: list[str]) -> DataFrame:
    """The largest absolute exposure."""
    largest = [F.abs(f"exposure_{f}") for f in features]
    return exposure(df, pred, features).select((F.greatest(*largest) if len(largest) > 1 else largest[0]).alias("max_exposure"))


def mean_exposure(df: DataFrame, pred: str, features: list[str], era: str) -> DataFrame:
    """Mean absolute exposure over eras, as columns; eras of one row count as 0."""
    n = df.groupBy(era).agg(F.count(F.lit(1)).alias("_n"))
    rows = by_era(exposure(df, pred, features, [era]), n, era)
    return rows.agg(*[F.coalesce(F.avg(F.when(F.col("_n") < 2, 0.0).otherwise(F.abs(f"exposure_{f}"))), F.lit(0.0)).alias(f"exposure_{f}") for f in features])


def exposure_gradient(df: DataFrame, x: str, count: int, pred: str) -> DataFrame:
    """df with `egrad`, the gradient of the summed squared exposures to the `count` entries of the array column x (missing
    entries count as the mean), times the number of rows."""
    entry = lambda i: F.get(x, F.lit(i))
    stats = df.agg(F.avg(pred).alias("mp"), F.stddev_pop(pred).alias("sp"), *[a for i in range(count) for a in (F.avg(entry(i)).alias(f"m{i}"), F.stddev_pop(entry(i)).alias(f"s{i}"), F.covar_pop(pred, entry(i)).alias(f"c{i}"))]).first()
    spread, mean, out = (stats["sp"] or 0.0) + 1e-9, stats["mp"] or 0.0, F.lit(0.0)
    for i in range(count):
        s = (stats[f"s{i}"] or 0.0) + 1e-9
        z = (F.coalesce(entry(i), F.lit(stats[f"m{i}"] or 0.0)) - (stats[f"m{i}"] or 0.0)) / s
        corr = (stats[f"c{i}"] or 0.0) / (spread * s)
        out = out + 2 * corr * (z - corr * (F.col(pred) - mean) / spread)
    return df.withColumn("egrad", out)


def gram(df: DataFrame, pred: str, features: list[str]) -> tuple[list[list[float]], list[float]]:
    """X'X and X'p from one pass of sums."""
    p = len(features)
    cols = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    row = df.agg(*cols, *[F.sum(F.col(f) * F.col(pred)).alias(f"v{i}") for i, f in enumerate(features)]).first()
    return [[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)], [row[f"v{i}"] or 0.0 for i in range(p)]


def neutralize(df: DataFrame, pred: str, features: list[str], proportion: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """df with `neutral`: the prediction less its projection on the features; the same call projects gradients."""
    import numpy as np

    m, v = gram(df, pred, features)
    beta = np.linalg.solve(np.array(m) + eps * np.eye(len(features)), np.array(v))
    fitted = sum((F.col(f) * float(b) for f, b in zip(features, beta, strict=True)), F.lit(0.0))
    return df.withColumn("neutral", F.col(pred) - proportion * fitted)


def neutralize_by_era(df: DataFrame, era: str, row: str, pred: str, features: list[str], proportion: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """(row, neutral) with an own projection per era, from per-era sums; eras of fewer than features + 1 rows stay."""
    import numpy as np
    from pyspark.sql.types import ArrayType, DoubleType

    p = len(features)
    sums = df.groupBy(era).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in features for b in features]).alias("_m"), F.array(*[F.sum(F.col(a) * F.col(pred)) for a in features]).alias("_v"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(n, m, v):
        import pandas as pd

        return pd.Series([list(np.linalg.solve(np.reshape(a, (p, p)) + eps * np.eye(p), b)) if k > p else [0.0] * p for k, a, b in zip(n, m, v)])

    betas = sums.select(era, solve("_n", "_m", "_v").alias("_beta"))
    fitted = sum((F.col(f) * F.col("_beta")[i] for i, f in enumerate(features)), F.lit(0.0))
    return by_era(df, betas, era).select(row, (F.col(pred) - proportion * fitted).alias("neutral"))


def _conformal_level(alpha: float):
    return lambda n: F.least(F.ceil((n + 1) * F.lit(1 - alpha)) / n, F.lit(1.0))


def conformal(df: DataFrame, y: str, pred: str, alpha: float = 0.1, by: list[str] = (), min_rows: int = 20) -> DataFrame:
    """Half width of intervals of coverage 1 - alpha: (by, n, q); with groups, those of fewer than min_rows rows have none."""
    out = quantiles(df, list(by), F.abs(F.col(y) - F.col(pred)), _conformal_level(alpha), "q")
    return out.where(F.col("n") >= min_rows) if by else out


class Conformal:
    """Prediction intervals: calibrate on one frame, predict_interval on another.  Asymmetric intervals take alpha / 2 on
    each side; with an era, eras of at least min_rows rows have a width of their own and all others the global one."""

    def __init__(self, alpha: float = 0.1, asymmetric: bool = False, era: str | None = None, min_rows: int = 20):
        self.alpha, self.asymmetric, self.era, self.min_rows = alpha, asymmetric, era, min_rows
        self.lower: float | None = None
        self.upper: float | None = None
        self.widths: DataFrame | None = None

    def calibrate(self, df: DataFrame, y: str, pred: str) -> "Conformal":
        residual = F.col(y) - F.col(pred)
        if self.asymmetric:
            level = _conformal_level(self.alpha / 2)
            self.upper = quantiles(df, [], F.greatest(residual, F.lit(0.0)), level).first()["q"]
            self.lower = quantiles(df, [], F.greatest(-residual, F.lit(0.0)), level).first()["q"]
        else:
            self.upper = self.lower = conformal(df, y, pred, self.alpha).first()["q"]
        if self.era:
            self.widths = conformal(df, y, pred, self.alpha, [self.era], self.min_rows).select(self.era, F.col("q").alias("_q"))
        return self

    @property
    def coverage_level(self) -> float:
        return 1.0 - self.alpha

    def width(self) -> float:
        self._ready()
        return self.lower + self.upper

    def _ready(self) -> None:
        if self.upper is None:
            raise RuntimeError("calibrate first")

    def predict_interval(self, df: DataFrame, pred: str) -> DataFrame:
        """df with `lower` and `upper`."""
        self._ready()
        if self.widths is None:
            return df.withColumn("lower", F.col(pred) - self.lower).withColumn("upper", F.col(pred) + self.upper)
        met = by_era(df, self.widths, self.era, "left")
        return met.withColumn("lower", F.col(pred) - F.coalesce("_q", F.lit(self.lower))).withColumn("upper", F.col(pred) + F.coalesce("_q", F.lit(self.upper))).drop("_q")

    def coverage(self, df: DataFrame, y: str, pred: str, by: list[str] = ()) -> DataFrame:
        """(by, n, coverage): the share of rows inside their interval."""
        inside = (F.col(y) >= F.col("lower")) & (F.col(y) <= F.col("upper"))
        return self.predict_interval(df, pred).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"))


def temporal_gradient(df: DataFrame, t: str, f: str, rho: float = 0.1, by: list[str] = (), small: bool | None = None) -> DataFrame:
    """df with `tgrad`, the gradient of rho times the sum of squared first differences."""
    near = neighbours(df, list(by), [t], f, small)
    return near.withColumn("tgrad", 2 * rho * (2 * F.col(f) - F.coalesce("_lag", f) - F.coalesce("_lead", f))).drop("_lag", "_lead")


def temporal_penalty(df: DataFrame, t: str, f: str, rho: float = 0.1, by: list[str] = ()) -> DataFrame:
    """(by, penalty): rho times the sum of squared first differences."""
    return neighbours(df, list(by), [t], f).groupBy(*by).agg((rho * F.coalesce(F.sum(F.pow(F.col(f) - F.col("_lag"), F.lit(2))), F.lit(0.0))).alias("penalty"))


def gain_variance(gains: DataFrame, by: list[str], gain: str, psi: float = 0.5) -> DataFrame:
    """(by, penalty): psi times the variance of a split's gains over permutations; 0 for a single gain."""
    return gains.groupBy(*by).agg((psi * F.coalesce(F.var_pop(gain), F.lit(0.0))).alias("penalty"))


def rolling_std(df: DataFrame, t: str, x: str, window: int) -> DataFrame:
    """df with `vol`; of an era-sized series, in one window."""
    w = Window.orderBy(t)
    return df.withColumn("vol", F.when(F.row_number().over(w) >= window, F.stddev_pop(x).over(w.rowsBetween(1 - window, 0))))


def regime_thresholds(df: DataFrame, count: int = 3, vol: str = "vol") -> list[float]:
    """Quantiles of the volatility that part it into `count` regimes; zeros where there is none."""
    found = [quantiles(df, [], F.col(vol), lambda n, k=k: F.lit(k / count)).first() for k in range(1, count)]
    return [r["q"] if r else 0.0 for r in found]


def regimes(df: DataFrame, thresholds: list[float], vol: str = "vol") -> DataFrame:
    """df with `regime`: the number of thresholds below the volatility; missing: 0."""
    return df.withColumn("regime", sum((F.when(F.col(vol) > t, 1).otherwise(0) for t in thresholds), F.lit(0)))


def drawdown(df: DataFrame, t: str, v: str) -> DataFrame:
    """The largest fall from a peak; of an era-sized series, in one window."""
    peak = F.max(v).over(Window.orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    return df.select(t, peak.alias("peak"), v).agg(F.max((F.col("peak") - F.col(v)) / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)).alias("max_drawdown"))


def purged_folds(df: DataFrame, order: list[str], splits: int, embargo: float = 0.01) -> DataFrame:
    """df once for each fold that it belongs to, with rn, fold and part: a fold's test rows, and as training rows all others
    but the embargo, that share of all rows, right after the test rows."""
    n = df.count()
    size, gap = n // splits, int(n * embargo)
    numbered = ranked(df, [], order, "rn").withColumn("rn", F.col("rn") - 1)
    every = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    start, stop = F.col("fold") * size, F.least((F.col("fold") + 1) * size, F.lit(n))
    part = F.when((F.col("rn") >= start) & (F.col("rn") < stop), "test").when((F.col("rn") < start) | (F.col("rn") >= stop + gap), "train")
    return every.withColumn("part", part).where("part IS NOT NULL")


def _above(key: Column, row: Column, at: tuple) -> Column:
    return (key > at[0]) | ((key == at[0]) & (row <= at[1]))


def goss(df: DataFrame, g: str, row: str, top: float = 0.2, other: float = 0.1, seed: int = 0) -> DataFrame:
    """The largest gradients, and of the rest those of the smallest row hashes, with `weight` making up for it.  Both cuts
    are single rows found by ordered.cut, so no task orders all rows; ties go by row."""
    n = df.count()
    keyed = df.withColumn("_key", F.abs(g)).withColumn("_hash", -mixed(df, row, seed).cast("double"))
    k, want = max(1, int(n * top)), max(1, int(n * other))
    first = _above(F.col("_key"), F.col(row), cut(keyed, "_key", row, k)) if k < n else F.lit(True)
    rest = keyed.where(~first)
    want = min(want, n - k)
    if want <= 0:
        return keyed.where(first).withColumn("weight", F.lit(1.0)).drop("_key", "_hash")
    second = _above(F.col("_hash"), F.col(row), cut(rest, "_hash", row, want))
    marked = keyed.withColumn("weight", F.when(first, 1.0).when(second, (n - k) / want))
    return marked.where("weight IS NOT NULL").drop("_key", "_hash")


def weighted_goss(df: DataFrame, g: str, row: str, time: str, decay: float, top: float = 0.2, other: float = 0.1, seed: int = 0) -> DataFrame:
    """GOSS by |g| * exp(-decay * age): the largest, and of the rest a draw without replacement in proportion to it, with
    weight (1 - top) / other.  The draw takes the largest of ln(u) / key, u being uniform by row hash."""
    n = df.count()
    last = df.agg(F.max(F.col(time).cast("double"))).first()[0]
    keyed = df.withColumn("_key", F.abs(g) * F.exp(-decay * (F.lit(last) - F.col(time).cast("double"))))
    if (keyed.agg(F.sum("_key")).first()[0] or 0.0) < 1e-12:
        keyed = keyed.withColumn("_key", F.lit(1.0))
    u = (mixed(df, row, seed) + 0.5) / float(1 << 32)
    keyed = keyed.withColumn("_draw", F.when(F.col("_key") > 0, F.ln(u) / F.col("_key")).otherwise(F.lit(-1e300)))
    k, want = max(1, int(n * top)), max(1, int(n * other))
    first = _above(F.col("_key"), F.col(row), cut(keyed, "_key", row, k)) if k < n else F.lit(True)
    want = min(want, n - k)
    if want <= 0:
        return keyed.where(first).withColumn("weight", F.lit(1.0)).drop("_key", "_draw")
    second = _above(F.col("_draw"), F.col(row), cut(keyed.where(~first), "_draw", row, want))
    return keyed.withColumn("weight", F.when(first, 1.0).when(second, (1 - top) / other)).where("weight IS NOT NULL").drop("_key", "_draw")
