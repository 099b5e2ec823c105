"""SimHash fingerprints and Hamming search, in DataFrame operations only.

Terms are pairs of neighbouring words (a single word alone where there is one), weighted by their
length.  Each term's 64-bit hash votes on 64 bits.  Votes are summed four bits to a long, 16 bits
each, over blocks of at most 10,922 terms, so that a plain hash aggregate does the work; the block
sums are then unpacked and added up per document.

The search side keeps permuted block tables: the 64 bits are cut into `radius + extra` blocks, and
one table per choice of `extra` blocks holds the fingerprints by those bits.  Two fingerprints
within the radius agree on at least `extra` whole blocks, so they meet in a table.

Null texts count as empty; a text without words has fingerprint 0; equal texts have equal
fingerprints; any text length is covered; rows with equal ids are ordered by their text, rows without
id come first; repeated rows are handled one by one; an empty table gives an empty one; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

BITS, LANES = 64, 4
WORDS = BITS // LANES
#: Terms weigh 3 at most and the top lane of a signed long holds 32,767.
BLOCK = 10_922


def terms(text: Column) -> Column:
    """Array of the text's terms: lower-cased neighbouring words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, fp): the fingerprint of each row's text as a long; keys must tell rows apart."""
    exploded = df.select(*keys, F.posexplode_outer(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("at", "term"))
    votes = exploded.select(*keys, F.coalesce(F.floor(F.col("at") / BLOCK), F.lit(0)).cast("int").alias("block"), F.xxhash64("term").alias("h"), F.when(F.col("term").isNull(), 0).otherwise(F.least(F.lit(3), F.floor(F.length("term") / 6) + 1)).cast("long").alias("w"))
    spread = 1 | (1 << 16) | (1 << 32) | (1 << 48)
    packed = [F.sum(F.shiftrightunsigned(F.col("h"), k).bitwiseAND(spread) * F.col("w")).alias(f"s{k}") for k in range(WORDS)]
    blocks = votes.groupBy(*keys, "block").agg(*packed, F.sum("w").alias("w"))
    lanes = F.array(*[F.shiftrightunsigned(F.col(f"s{b % WORDS}"), 16 * (b // WORDS)).bitwiseAND(0xFFFF) for b in range(BITS)])
    opened = blocks.select(*keys, "block", "w", lanes.alias("lanes"))
    whole = opened.groupBy(*keys).agg(F.sum("w").alias("w"), F.collect_list("lanes").alias("lanes"))
    total = F.aggregate(F.col("lanes"), F.array_repeat(F.lit(0).cast("long"), BITS), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    summed = whole.select(*keys, "w", total.alias("v"))
    # sums are permuted: lane l of word k holds bit 16 * l + k
    fp = F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(F.col("v")[b] * 2 > F.col("w"), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))
    return summed.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def id_ranges(df: DataFrame, id_col: str, text_col: str, quantiles: int = 255, portion: int = 1 << 25) -> tuple[list, int, DataFrame]:
    """Bounds of the ids, the number of equal parts between two bounds, so that a part has about `portion` bytes of
    text, and a table of the first id of each part that has rows with the part before it (of the first: the last).
    The table has one small row per `portion` of the input."""
    steps = [k / (quantiles + 1) for k in range(1, quantiles + 1)]
    row = df.agg(F.percentile_approx(id_col, steps, 10_000).alias("q"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    bounds = sorted({row["lo"], row["hi"], *(row["q"] or [])} - {None})
    numeric = isinstance(row["lo"], (int, float))
    parts = max(1, -(-(row["bytes"] or 0) // (portion * (quantiles + 1)))) if numeric else 1
    firsts = df.where(F.col(id_col).isNotNull()).groupBy(_part(id_col, bounds, parts).alias("r")).agg(F.min(id_col).alias("first"))
    order = Window.orderBy("r")
    before = F.coalesce(F.lag("r").over(order), F.max("r").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return bounds, parts, firsts.select(F.col("first").alias("_first"), before.alias("_before"))


def _part(id_col: str, bounds: list, parts: int) -> Column:
    """The number of the part that an id lies in; ids without value are in part 0."""
    if not bounds:
        return F.lit(0).cast("long")
    edges = F.array(*[F.lit(b) for b in bounds])
    coarse = F.greatest(F.array_size(F.filter(edges, lambda b: b <= F.col(id_col))) - 1, F.lit(0))
    if parts == 1:
        return F.coalesce(coarse, F.lit(0)).cast("long")
    low, high = F.get(edges, coarse).cast("double"), F.coalesce(F.get(edges, coarse + 1), F.get(edges, coarse)).cast("double")
    fine = F.coalesce(F.floor(F.try_divide((F.col(id_col).cast("double") - low) * parts, high - low)), F.lit(0))
    return F.coalesce(coarse.cast("long") * parts + F.least(F.greatest(fine, F.lit(0)), F.lit(parts - 1)), F.lit(0)).cast("long")


def with_successor(df: DataFrame, id_col: str, ranges: tuple, order: list[str], columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows by (id, order), after the last of the first row, and
    nth, the row's number in its part.  Each part's first rows also go, as sentinels, to the part
    before it, so every window is one part and no task sees all rows."""
    bounds, parts, firsts = ranges
    own = F.struct(_part(id_col, bounds, parts).alias("r"), F.lit(0).alias("sentinel"))
    also = F.struct(F.col("_before").alias("r"), F.lit(1).alias("sentinel"))
    met = df.join(F.broadcast(firsts), F.col(id_col) == F.col("_first"), "left")
    spread = met.withColumn("_to", F.explode(F.when(F.col("_before").isNotNull(), F.array(own, also)).otherwise(F.array(own)))).drop("_first", "_before")
    window = Window.partitionBy("_to.r").orderBy("_to.sentinel", id_col, *order)
    out = spread.select("*", F.row_number().over(window).alias("nth"), *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return out.where("_to.sentinel = 0").drop("_to")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = F.length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 4).cast("int")), F.substring(following, F.lit(1), F.floor(n / 4).cast("int")))


def near_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to each other and to the next text's; fp
    is the text's fingerprint as a long."""
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds, parts, firsts = id_ranges(df, id_col, text_col)
    ranges = bounds, parts, written(firsts)
    linked = with_successor(docs, id_col, ranges, ["text"], ["text"])
    both = linked.select(id_col, "nth", F.length("text").cast("long").alias("n_chars"), F.array("text", edited(F.col("text"), F.coalesce("next_text", "text"))).alias("bodies"))
    keys = [id_col, "nth", "n_chars", "edited_sha256"]
    facts = both.select(id_col, "nth", "n_chars", F.sha2(F.col("bodies")[1], 256).alias("edited_sha256"), F.posexplode("bodies").alias("which", "body"))
    prints = fingerprints(facts, [*keys, "which"], "body")
    paired = prints.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    out = with_successor(paired.withColumnRenamed("nth", "at"), id_col, ranges, ["at"], ["fp"])
    out = out.select(id_col, "n_chars", "edited_sha256", "fp", "efp", "next_fp")
    shown = lambda c: F.lpad(F.lower(F.hex(c)), BITS // 4, "0")
    return out.select(id_col, "n_chars", "edited_sha256", shown("fp").alias("fingerprint"), shown("efp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("next_fp", "fp")).alias("near_next"), "fp")


def block_masks(radius: int = 3, extra: int = 3) -> list[int]:
    """The masks of the permuted tables, one per choice of `extra` of the radius + extra blocks, as signed longs."""
    count = radius + extra
    edges = [BITS * k // count for k in range(count + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in combinations(range(count), extra)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def block_tables(prints: DataFrame, fp_col: str = "fp", radius: int = 3, extra: int = 3) -> DataFrame:
    """prints once per table, with the table's number and the bits it is sorted by."""
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col(fp_col).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(block_masks(radius, extra))])
    return prints.select("*", F.inline(tables))


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3, extra: int = 3) -> DataFrame:
    """(query fp, fp, distance): all distinct fingerprints of prints.fp within the radius of each distinct queries.fp.
    A pair that meets in several tables is taken from the first of them, within the join.  A block that many
    fingerprints share is a skewed key of an inner join, which adaptive execution splits; a query meets at most
    the distinct fingerprints of its blocks."""
    left = block_tables(queries.select(F.col("fp").alias("query")).distinct(), "query", radius, extra)
    right = block_tables(prints.select("fp").distinct(), "fp", radius, extra).withColumnsRenamed({"table": "t", "bits": "b"})
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius, extra)])
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    earlier = F.exists(F.slice(masks, F.lit(1), F.col("t")), lambda m: apart.bitwiseAND(m) == 0)
    near = left.join(right, (F.col("table") == F.col("t")) & (F.col("bits") == F.col("b")) & (F.bit_count(apart) <= radius) & ~earlier)
    return near.select("query", "fp", F.bit_count(apart).alias("distance"))


def with_neighbours(rows: DataFrame, chosen: Column, name: str = "n_within", radius: int = 3) -> DataFrame:
    """rows with the number of other distinct fingerprints within the radius of theirs, for the chosen rows; else null."""
    found = within_radius(rows.select("fp"), rows.where(chosen).select("fp"), radius).groupBy("query").agg((F.count(F.lit(1)) - 1).alias("_near"))
    return rows.join(found.withColumnRenamed("query", "_query"), F.col("fp") == F.col("_query"), "left").withColumn(name, F.when(chosen, F.col("_near"))).drop("_query", "_near")
