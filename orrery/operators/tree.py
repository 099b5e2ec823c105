"""Binning, histograms and split search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import distinct_sketch, div, null_nan
from .ordered import mixed, running
from .splits import Nodes, Rule, Sums, candidates
from .splits import leaf_value as leaf_value_of


def bin_edges(df: DataFrame, features: list[str], max_bins: int = 255, exact: bool = False) -> dict[str, list[float]]:
    """Distinct inner quantiles of every feature, missing values aside; a feature with fewer than max_bins values has as
    many bins as values.  By sketches of bounded size, which are exact on small tables; exact=True keeps all distinct
    values of a feature in one task."""
    clean = df.select(*[null_nan(f).alias(f) for f in features])
    counts = clean.agg(*[distinct_sketch(f).alias(f) for f in features]).first()
    few = [f for f, k in counts.asDict().items() if (k or 0) < 2 * max_bins]
    # near max_bins the sketch's error would matter; sets of so few values are small
    few = clean.agg(*[F.size(F.collect_set(f)).alias(f) for f in few]).first().asDict() if few else {}
    bins = {f: min(max_bins, few.get(f, max_bins)) for f in features}
    ranks = {f: [k / n for k in range(1, n)] for f, n in bins.items() if n > 1}
    if not ranks:
        return {f: [] for f in features}
    row = clean.agg(*[(F.percentile(f, q) if exact else F.percentile_approx(f, q, 10_000)).alias(f) for f, q in ranks.items()]).first()
    return {f: sorted(set(row[f] or [])) if f in ranks else [] for f in features}


def to_bins(columns: list[np.ndarray], edges: list[np.ndarray], missing: int, bundles: list[list[int]]) -> np.ndarray:
    """Bins of rows, a column for each bundle: the number of edges at or below the value, `missing` for NaN.

    A bundle of several features has bin 0 where all of them are 0 or NaN, else the bin of the last that isn't, behind
    the bins of the features before it."""
    out = np.empty((len(columns[0]) if columns else 0, len(bundles)), np.int16)
    for k, bundle in enumerate(bundles):
        if len(bundle) == 1:
            x = columns[bundle[0]]
            out[:, k] = np.where(np.isnan(x), missing, np.searchsorted(edges[bundle[0]], x, side="right"))
            continue
        merged, offset = np.zeros(len(out), np.int16), 1
        for f in bundle:
            x = columns[f]
            there = ~np.isnan(x) & (x != 0)
            merged[there] = np.searchsorted(edges[f], x[there], side="right") + offset
            offset += len(edges[f]) + 1
        out[:, k] = merged
    return out


def bin_column(features: list[Column], edges: list[list[float]], missing: int, bundles: list[list[int]] | None = None) -> Column:
    """to_bins as an array column."""
    import pandas as pd

    cuts, groups = [np.array(e, float) for e in edges], bundles or [[k] for k in range(len(features))]

    @F.pandas_udf("array<smallint>")
    def bins(*cols):
        return pd.Series(list(to_bins([np.asarray(c, float) for c in cols], cuts, missing, groups)))

    return bins(*[c.cast("double") for c in features])


def digitize(x: Column, edges: list[float], missing: int) -> Column:
    """Number of edges at or below x; missing values have a bin of their own."""
    if not edges:
        return F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(F.lit(0))
    return F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)))


def histogram(df: DataFrame, bins: str, keys: list[str], grad: str = "g", hess: str = "h") -> DataFrame:
    """(keys, feature, bin, g, h, c) from an array of bins; partial sums are made before the shuffle."""
    rows = df.select(*keys, F.posexplode(bins).alias("feature", "bin"), grad, hess)
    return rows.groupBy(*keys, "feature", "bin").agg(F.sum(grad).alias("g"), F.sum(hess).alias("h"), F.count(F.lit(1)).alias("c"))


PARTIAL = "slot int, feature int, g array<double>, h array<double>, c array<double>"


def node_histograms(df: DataFrame, tree: Nodes, wanted: list[int], features: int, direct: int = 1 << 26) -> dict[int, tuple]:
    """(G, H, C) arrays [feature, bin] of the wanted nodes, from columns bins, g and h.

    Every task adds its rows up in arrays and returns one row per node and feature.  Where all of these together are
    small (`direct` bytes) the driver sums them, else tasks by feature do; what reaches the driver is one histogram of
    each node either way."""
    import pyarrow as pa

    width = tree.missing + 1

    def run(batches):
        sums, any_rows = Sums(wanted, features, width, len(tree.feature)), False
        for batch in batches:
            any_rows = any_rows or batch.num_rows > 0
            bins, g, h = arrays(batch, features)
            sums.add(tree.reach(bins), bins, g, h)
        if any_rows:
            yield partial(sums.arrays, range(len(wanted)), features, width)

    partials = df.select("bins", "g", "h").mapInArrow(run, PARTIAL)
    if df.rdd.getNumPartitions() * len(wanted) * features * width * 24 > direct:
        slots = len(wanted)

        def add(table: pa.Table) -> pa.Table:
            total = [np.zeros((slots, features, width)) for _ in range(3)]
            at = table["slot"].to_numpy(), table["feature"].to_numpy()
            for x, name in zip(total, "ghc", strict=True):
                np.add.at(x, at, table[name].combine_chunks().flatten().to_numpy().reshape(-1, width))
            here = np.unique(at[1])
            cells = [(s, f) for s in range(slots) for f in here]
            cols = {"slot": pa.array([s for s, _ in cells], pa.int32()), "feature": pa.array([f for _, f in cells], pa.int32())}
            return pa.table(cols | {name: pa.array([x[s, f] for s, f in cells], pa.list_(pa.float64())) for x, name in zip(total, "ghc", strict=True)})

        partials = partials.groupBy(F.pmod("feature", F.lit(64)).alias("part")).applyInArrow(add, PARTIAL)
    table = partials.toArrow()
    total = [np.zeros((len(wanted), features, width)) for _ in range(3)]
    if table.num_rows:
        at = table["slot"].to_numpy(), table["feature"].to_numpy()
        for x, name in zip(total, "ghc", strict=True):
            np.add.at(x, at, table[name].combine_chunks().flatten().to_numpy().reshape(-1, width))
    return {node: tuple(x[k] for x in total) for k, node in enumerate(wanted)}


def arrays(batch, features: int):
    """bins (rows by features), g and h of an Arrow batch."""
    bins = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
    return bins, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def partial(sums: list, slots, features: int, width: int):
    import pyarrow as pa

    cells = len(slots) * features
    offsets = pa.array(np.arange(cells + 1, dtype=np.int32) * width)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in sums]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(slots), dtype=np.int32), features)), pa.array(np.tile(np.arange(features, dtype=np.int32), len(slots))), *lists], ["slot", "feature", "g", "h", "c"])


def gain_table(spark, hist: tuple, rule: Rule, penalty=None) -> DataFrame:
    """(feature, nan_dir, bin, gain, gl, hl, cl, left_value, right_value) of the allowed splits of one node, as the
    boosting loop sees them."""
    gain, g, h, c = candidates(hist, rule, None, penalty)
    gt, ht = hist[0][0].sum(), hist[1][0].sum()
    f, d, b = np.nonzero(np.isfinite(gain))
    at = (f, d, b)
    values = leaf_value_of(g[at], h[at], rule), leaf_value_of(gt - g[at], ht - h[at], rule)
    rows = list(zip(f.tolist(), d.tolist(), b.tolist(), gain[at].tolist(), g[at].tolist(), h[at].tolist(), c[at].astype(int).tolist(), values[0].tolist(), values[1].tolist(), strict=True))
    return spark.createDataFrame(rows, "feature int, nan_dir int, bin int, gain double, gl double, hl double, cl long, left_value double, right_value double")


def era_penalty(hist: DataFrame, reg_lambda: float = 1.0, missing: int = 255, keys: list[str] = ()) -> DataFrame:
    """(keys, feature, bin, nan_dir, penalty): variance over eras of the left and of the right leaf value, summed.
    hist has an era key; eras whose hessian on a side is at most 1e-6 don't count there."""
    eras = hist.select("era").distinct()
    cells = hist.select(*keys, "feature", "bin").distinct()
    met = F.col("a.era").eqNullSafe(F.col("b.era"))
    for k in (*keys, "feature", "bin"):
        met = met & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    full = cells.crossJoin(eras).alias("a").join(hist.alias("b"), met, "left")  # cells by eras: no more than bins allow
    both = full.select("a.era", *[f"a.{k}" for k in (*keys, "feature", "bin")], *[F.coalesce(f"b.{x}", F.lit(0.0)).alias(x) for x in "gh"])
    cell = Window.partitionBy("era", *keys, "feature")
    run = cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.col("bin") == missing
    s = both.select("era", *keys, "feature", "bin", *[F.sum(F.when(~held, F.col(x)).otherwise(0)).over(run).alias(f"{x}l") for x in "gh"], *[F.sum(x).over(cell).alias(f"{x}t") for x in "gh"], *[F.sum(F.when(held, F.col(x)).otherwise(0)).over(cell).alias(f"{x}n") for x in "gh"])
    s = s.where(~held).withColumn("nan_dir", F.explode(F.array(F.lit(0), F.lit(1))))
    gl, hl = (F.col(f"{x}l") + F.when(F.col("nan_dir") == 0, F.col(f"{x}n")).otherwise(0) for x in "gh")
    value = lambda g, h: F.when(h > 1e-6, -div(g, h + reg_lambda))
    spread = lambda v: F.coalesce(F.var_pop(v), F.lit(0.0))
    return s.groupBy(*keys, "feature", "bin", "nan_dir").agg((spread(value(gl, hl)) + spread(value(F.col("gt") - gl, F.col("ht") - hl))).alias("penalty"))


def ordered_target(df: DataFrame, cat: str, y: str, row: str, smoothing: float = 10.0, seed: int | None = None, name: str = "encoded") -> DataFrame:
    """df with the smoothed mean of the category's earlier rows: in the order of `row`, or with a seed in a hashed
    permutation.  Missing categories get the global mean.  A category that fills the table is not one task."""
    order = [F.col(row)] if seed is None else [mixed(df, row, seed), F.col(row)]
    mean = df.agg(F.avg(y)).first()[0] or 0.0
    run = running(df, [cat], order, {"_s": F.coalesce(F.col(y).cast("double"), F.lit(0.0)), "_c": F.when(F.col(y).isNotNull(), 1.0).otherwise(0.0)})
    known = F.col(cat).isNotNull()
    return run.withColumn(name, F.when(known, (F.col("_s") + mean * smoothing) / (F.col("_c") + smoothing)).otherwise(F.lit(mean))).drop("_s", "_c")


def target_table(df: DataFrame, cat: str, y: str, smoothing: float = 10.0) -> DataFrame:
    """(cat, encoded) over all rows."""
    mean = df.agg(F.avg(y)).first()[0] or 0.0
    sums = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.sum(y).alias("s"), F.count(y).alias("c"))
    return sums.select(cat, ((F.coalesce("s", F.lit(0.0)) + mean * smoothing) / (F.col("c") + smoothing)).alias("encoded"))


def target_lookup(df: DataFrame, table: DataFrame, cat: str, default: float, name: str = "encoded") -> DataFrame:
    """df with its categories' entries of a target table; categories that it lacks, and missing ones, get the default."""
    entries = table.select(F.col(cat).alias("_cat"), F.col("encoded").alias("_encoded"))
    return df.join(entries, F.col(cat) == F.col("_cat"), "left").withColumn(name, F.coalesce("_encoded", F.lit(default))).drop("_cat", "_encoded")
