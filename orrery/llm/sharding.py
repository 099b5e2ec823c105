"""Jump consistent hashing in SQL expressions.

A key's shard follows from the key and the number of shards alone; one more shard takes only the
rows that move into it.  The published generator (a 64-bit linear congruential one) is computed in
two 32-bit halves, as SQL integers must not overflow.  Slots are numbered within a shard without
one task per shard: rows are numbered within (shard, block), a block being the key modulo a fixed
number, and blocks start at a running count.

Null keys hash like key 0, keys that are no whole numbers by their 64-bit hash; null texts have
size 1; texts of any length are summed whole; rows with equal keys lie in one shard, ordered by
their texts' checksum and size; equal rows get slots in a row; an empty table stays empty; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1


def _product32(a: Column, c: int) -> Column:
    """a * c modulo 2^32 for a in 0 .. 2^32-1, in 64-bit integers that cannot overflow."""
    return ((a.bitwiseAND(0xFFFF) * c) + F.shiftleft((F.shiftrightunsigned(a, 16) * c).bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64, as (high, low) halves."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    l0, l1 = lo.bitwiseAND(0xFFFF) * c_lo, F.shiftrightunsigned(lo, 16) * c_lo
    low = l0 + F.shiftleft(l1.bitwiseAND(0xFFFF), 16) + 1
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(l1, 16) + _product32(lo, c_hi) + _product32(hi, c_lo)
    return high.bitwiseAND(_LOW), low.bitwiseAND(_LOW)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key.  Each step jumps ahead, so `shards` steps always suffice."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(state: Column, _: Column) -> Column:
        hi, lo = _step(state["hi"], state["lo"])
        # key >> 33 is hi >> 1; the quotient is taken in doubles as in the published form
        jump = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double"))).cast("long")
        live = state["j"] < shards
        return F.struct(
            F.when(live, hi).otherwise(state["hi"]).alias("hi"), F.when(live, lo).otherwise(state["lo"]).alias("lo"),
            F.when(live, state["j"]).otherwise(state["b"]).alias("b"), F.when(live, jump).otherwise(state["j"]).alias("j"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def number(df: DataFrame, id_col: str) -> Column:
    """An id as a long; ids that are no whole numbers are hashed."""
    kind = df.schema[id_col].dataType.typeName()
    return F.col(id_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(id_col)


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", blocks: int = 1021) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard); slots run from 0 in every shard.

    Equal rows are counted before anything is ordered, so an id that fills a third of the table is one row until its
    slots are dealt.  Slots follow the rows alone, not how they are partitioned."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), number(df, id_col)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(key, F.lit(0).cast("long")).alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    distinct = rows.groupBy("id", "key", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    placed = distinct.select("*", jump_hash(F.col("key"), shards).alias("shard"), jump_hash(F.col("key"), shards + 1).alias("grown"), F.pmod("key", F.lit(blocks)).cast("int").alias("block"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "block").agg(F.sum("n").alias("rows")).select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("nth", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), ["shard", "block"])  # shards * blocks rows at most
    # copies are dealt their slots in two steps, so that no array is longer than 65,536
    lots = numbered.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 65_536))))
    dealt = lots.withColumn("copy", F.explode(F.sequence(F.col("lot") * 65_536, F.least(F.col("n") - 1, F.col("lot") * 65_536 + 65_535))))
    return dealt.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") + F.col("copy")).alias("slot"), F.col("grown").alias("grown_shard"))
