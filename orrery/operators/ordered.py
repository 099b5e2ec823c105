"""Ordered operators that no group, however large, sends to one task.

A group that is known to be small (its rows are counted first) is one window.  Otherwise, and always where the whole
table is one group, rows are cut into ranges of (group, order), each range is a window of its own, and what comes
before it, one small row for each range and group, is added.  The ranges are written once, as a range computed anew
might be cut elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

#: Rows of a group that one task may order.
FEW = 2_000_000
#: Fixed value: the multiplier of a published 32-bit integer hash.
_MULTIPLIER = 0x45D9F3B
_LOW = (1 << 32) - 1


def mix(key: Column, seed: int) -> Column:
    """A 32-bit hash of a long, in arithmetic that any SQL engine has."""
    x = key.bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseAND(_LOW).bitwiseXOR(F.lit((seed * 2654435761 + 12345) & _LOW).cast("long"))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * _MULTIPLIER).bitwiseAND(_LOW)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def mixed(df: DataFrame, row: str, seed: int) -> Column:
    """mix of a row id; ids that are no whole numbers are hashed first."""
    whole = df.schema[row].dataType.typeName() in ("byte", "short", "integer", "long")
    return mix(F.col(row).cast("long") if whole else F.xxhash64(row), seed)


def small_groups(df: DataFrame, by: list[str], few: int = FEW) -> bool:
    """Whether no group has over `few` rows."""
    return bool(by) and (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= few


def _ranges(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df in written ranges: _range and _group are new."""
    group = F.struct(*by) if by else F.lit(0)
    keyed = df.select("*", group.alias("_group"), *[_column(o).alias(f"_o{k}") for k, o in enumerate(order)])
    cut = keyed.repartitionByRange(F.col("_group"), *[F.col(f"_o{k}") for k in range(len(order))])
    return written(cut.withColumn("_range", F.spark_partition_id()))


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, Column], small: bool | None = None) -> DataFrame:
    """df with, for each name, the sum of the column over the rows of the group that come before.  `order` is ascending
    and must tell the rows of a group apart."""
    if small_groups(df, by) if small is None else small and by:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(x).over(window), F.lit(0)).alias(n) for n, x in sums.items()])
    cut = _ranges(df.select("*", *[x.alias(f"_m{k}") for k, x in enumerate(sums.values())]), by, order)
    names = range(len(sums))
    window = Window.partitionBy("_range", "_group").orderBy(*[f"_o{k}" for k in range(len(order))]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy("_range", "_group").agg(*[F.sum(f"_m{k}").alias(f"_t{k}") for k in names])
    before = per.select("_range", "_group", *[F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in names])
    within = cut.select("*", *[F.coalesce(F.sum(f"_m{k}").over(window), F.lit(0)).alias(f"_w{k}") for k in names])
    return within.join(before, ["_range", "_group"]).select(*df.columns, *[(F.col(f"_w{k}") + F.col(f"_b{k}")).alias(n) for k, n in zip(names, sums, strict=True)])


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank", small: bool | None = None) -> DataFrame:
    """df with the row's number in its group, from 1."""
    return running(df, by, order, {name: F.lit(1).cast("long")}, small).withColumn(name, F.col(name) + 1)


def neighbours(df: DataFrame, by: list[str], order: list, x: str, small: bool | None = None) -> DataFrame:
    """df with _lag and _lead, the column's values in the rows before and after."""
    if small_groups(df, by) if small is None else small and by:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.select("*", F.lag(x).over(window).alias("_lag"), F.lead(x).over(window).alias("_lead"))
    cut = _ranges(df, by, order)
    keys = F.struct(*[f"_o{k}" for k in range(len(order))])
    window = Window.partitionBy("_range", "_group").orderBy(*[f"_o{k}" for k in range(len(order))])
    along = Window.partitionBy("_group").orderBy("_range")
    ends = cut.groupBy("_range", "_group").agg(F.min_by(x, keys).alias("_first"), F.max_by(x, keys).alias("_last"))
    edges = ends.select("_range", "_group", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    within = cut.select("*", F.lag(x).over(window).alias("_l"), F.lead(x).over(window).alias("_r"))
    return within.join(edges, ["_range", "_group"]).select(*df.columns, F.coalesce("_l", "_before").alias("_lag"), F.coalesce("_r", "_after").alias("_lead"))


def quantiles(df: DataFrame, by: list[str], x: Column, level, name: str = "q", small: bool | None = None) -> DataFrame:
    """(by, n, name): the linearly interpolated quantile of a column in each group, exactly; level(n) gives the level as a
    column of the group's count.  Null values don't count."""
    rows = df.select(*by, x.cast("double").alias("_x")).where("_x IS NOT NULL")
    order = ["_x"]
    if not by or not (small_groups(rows, by) if small is None else small):
        rows = rows.withColumn("_id", F.monotonically_increasing_id())  # equal values are dealt to several ranges
        order = ["_x", "_id"]
    place = ranked(rows, by, order, "_k", small)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    at = level(F.col("n")) * (F.col("n") - 1)
    counts = counts.select(F.struct(*by, F.lit(0)).alias("_g"), *by, "n", F.floor(at).alias("_lo"), (at - F.floor(at)).alias("_part"))
    met = place.select(F.struct(*by, F.lit(0)).alias("_h"), "_x", "_k").join(counts, F.col("_g") == F.col("_h"))
    near = met.where((F.col("_k") - 1 == F.col("_lo")) | (F.col("_k") - 1 == F.least(F.col("_lo") + 1, F.col("n") - 1)))
    low, high = F.min("_x"), F.max("_x")
    return near.groupBy("_g", *by).agg(F.first("n").alias("n"), (low + (high - low) * F.first("_part")).alias(name)).drop("_g")


def cut(df: DataFrame, key: str, row: str, k: int) -> tuple:
    """The (key, row) of the k-th row by descending key, then row; k from 1 to the number of rows.  Sketched quantiles
    bound a band that holds it, and only the band is ordered, in ranges."""
    n = df.count()
    share = 1 - k / n
    low, high = df.agg(F.percentile_approx(key, [max(0.0, share - 3e-4), min(1.0, share + 3e-4)], 10_000)).first()[0]
    above = df.where(F.col(key) > high).count()
    if above >= k:  # the sketch was off
        low, high, above = high, float("inf"), 0
    band = df.where((F.col(key) <= high) & (F.col(key) >= low)).select(key, row)
    if above + band.count() < k:
        band = df.where(F.col(key) <= high).select(key, row)
    found = ranked(band.withColumn("_down", -F.col(key)), [], ["_down", row], "_k").where(F.col("_k") == k - above).first()
    return found[key], found[row]
