"""Near-duplicate documents by bottom-k sketches from one hash function.

Each whole text becomes a set of hashed word shingles; equal sets are one class from then on.  A
class retains the KEPT smallest values of its set, its sketch.  Two sets of the wanted likeness have
a least number of retained values in common (see least_common), so it is enough to look at the
retained values in order of how many sketches have them, rarest first, and to leave out the last
least - 1 of them: the first common value is among the rest.  These values key the inverted lists;
a class of whose values too few occur elsewhere has no entry at all, and a value that many sketches
share is an entry only where nothing rarer is left.

A short list compares all its members.  A long list compares every member with its first and its
last.  Candidates are filtered by the Jaccard estimate from the bottom-k sketch of their union, five
standard errors below the threshold, and confirmed on full sets.  Long lists that then hold several
components are compared in square blocks, so that no link inside them is lost; no list is ever
gathered in one task or spelled out in pairs.  Components come from alternating large-star and
small-star steps.

Null texts and texts without words have an empty set and link with nothing.  Repeated rows are one
class.  Rows that share an id but not a text are documents of their own, with that id.  Rows without
an id link with nothing, have no component and are kept.  Ids must be whole numbers.  Texts of any
length are hashed whole.  Ties among retained values of one frequency go by value.  An empty table
gives an empty one, and further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import forget, written

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Values that a sketch retains.
KEPT = 64
#: Values that are looked at where long lists are compared in blocks.
FINE = 384
#: Bound of the chance that a linked pair has fewer retained values in common than least_common says.
MISSED = 1e-6
#: Edges that the driver may join to components: a few MB there.
FEW = 1 << 16
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles; words of at most `longest` bytes keep their hashes
    in a cache of at most `most` words."""

    def __init__(self, width: int = 5, most: int = 500_000, longest: int = 32):
        self.width, self.most, self.longest, self.known = width, most, longest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.most:
            self.known = {}
        known, long = self.known, {}
        for w in words:
            if w not in known:
                (known if len(w) <= self.longest else long)[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map((known | long if long else known).__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for j in range(width):
            out += h[j : j + n] * _STEPS[j % 5] + np.uint64(j // 5)
            out ^= out >> np.uint64(31)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
        return np.unique(out)


def least_common(n: int, percent: int) -> int:
    """How many retained values a set of n values has in common with any set of the wanted likeness.

    A set so small that its partners are retained whole shares that percentage of its values, for certain.  Else, of
    the KEPT smallest values of the union each is common with the chance of the likeness at least: the number that
    falls short with chance MISSED or less.  Both sketches have all of these."""
    certain = -(-n * percent // 100)
    if 100 * n <= percent * KEPT:
        return certain
    j, below = percent / 100, 0.0
    for c in range(KEPT + 1):
        below += math.comb(KEPT, c) * j**c * (1 - j) ** (KEPT - c)
        if below > MISSED:
            return max(1, min(certain, c))
    return certain


def union_overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two matrices of sketches (ascending, filled up with _NONE): how many of the smallest values of the
    union, as many as the matrices are wide at most, both have, and how many there are."""
    z = np.concatenate([a, b], 1)
    z.sort(1)
    new = z != _NONE
    twin = (z[:, 1:] == z[:, :-1]) & new[:, 1:]
    new[:, 1:] &= ~twin
    inside = new.cumsum(1) <= a.shape[1]
    return (twin & inside[:, 1:]).sum(1), (new & inside).sum(1)


def matrix(column, width: int = KEPT) -> np.ndarray:
    """Sketches of an Arrow list column as rows of `width` values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), width), _NONE)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return out


def plausible(same: np.ndarray, filled: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the share of common values among the `filled` smallest of the union allows the link: at most five standard
    errors (of a draw without replacement from the union) below the threshold."""
    j = percent / 100
    union = np.maximum(sizes / (1 + j), 1)
    error = np.sqrt(j * (1 - j) / np.maximum(filled, 1) * np.clip(1 - filled / union, 0, 1))
    return same >= filled * (j - 5 * error - 0.01) - 1


def sketches(df: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 85) -> DataFrame:
    """(id, n, d1, d2, least, sketch): set size, 128-bit digest of the set, least_common and the retained values."""
    table = [least_common(n, percent) for n in range(2 * KEPT)]

    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                digest = xxhash.xxh128_digest(s.tobytes())
                rows.append((len(s), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), table[min(len(s), 2 * KEPT - 1)], s[:KEPT].view(np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | {n: pa.array(c, t) for n, c, t in zip(("n", "d1", "d2", "least", "sketch"), cols, kinds, strict=True)})

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n long, d1 long, d2 long, least int, sketch array<long>")


def fine_sketches(nodes: DataFrame, reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, fine): the FINE smallest values of the sets of some classes, made from their texts once more."""
    wanted = reps.select("node", "id", "d1").join(nodes, "node", "left_semi")

    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            found = []
            for node, d, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingles(text)
                if int.from_bytes(xxhash.xxh128_digest(s.tobytes())[:8], "little", signed=True) == d:
                    found.append((node, s[:FINE].view(np.int64)))
            yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in found], pa.int64()), "fine": pa.array([f for _, f in found], pa.list_(pa.int64()))})

    return texts.join(wanted, "id").select("node", "d1", "text").mapInArrow(run, "node long, fine array<long>").dropDuplicates(["node"])


def classes(base: DataFrame) -> DataFrame:
    """(node, id, copies, n, d1, d2, least, sketch): one row per distinct set, with its smallest id.  To be written at
    once: node only tells classes apart within what is written."""
    grouped = base.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "least", "sketch")])
    return grouped.withColumn("node", F.monotonically_increasing_id())


def list_entries(reps: DataFrame) -> DataFrame:
    """(node, key): of each sketch the values that occur in others too, rarest first, without the last least - 1."""
    values = reps.select("node", F.explode("sketch").alias("key"))
    shared = values.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = values.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("own"))
    kept = own.join(reps.select("node", "least"), "node").where(F.size("own") >= F.col("least"))
    return kept.select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("least") + 1)).alias("e")).select("node", "e.key")


def candidate_pairs(postings: DataFrame, lists: DataFrame, short: int) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of short lists, first and last against all of long lists."""
    small = postings.join(lists.where(F.col("len") <= short).select("key"), "key")
    within = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    long = postings.join(lists.where(F.col("len") > short).select("key", "first", "last"), "key")
    star = long.select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("last").alias("b")))).alias("p")).select("p.a", "p.b").where("a < b")
    return within.unionByName(star).distinct()


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and union sketch allow the link."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for batch in batches:
            same, filled = union_overlap(matrix(batch.column(3)), matrix(batch.column(4)))
            keep = plausible(same, filled, batch.column(2).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union, as a written table.  A text stands
    for a class if it has the class's id and digest."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = reps.select("node", "id", "d1").join(nodes, "node", "left_semi")
    found = texts.join(wanted.hint("merge"), "id").select("id", "node", "d1", "text", F.xxhash64("text").alias("h"))
    needed = written(found.dropDuplicates(["id", "node", "h"]).select("node", "d1", "text"))
    side = lambda x: needed.select(F.col("node").alias(x), F.col("d1").alias(f"d{x}"), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "da", "db", "ta", "tb")

    def run(batches):
        shingles = Shingles(width)
        digest = lambda s: int.from_bytes(xxhash.xxh128_digest(s.tobytes())[:8], "little", signed=True)
        last, sa, da = None, None, None
        for batch in batches:
            keep = []
            for a, d, e, ta, tb in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if (a, ta) != last:
                    last, sa = (a, ta), shingles(ta)
                    da = digest(sa)
                sb = shingles(tb)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * common >= percent * (len(sa) + len(sb) - common) and da == d and digest(sb) == e)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = written(both.mapInArrow(run, "a long, b long"))
    forget(needed)
    return out


def few_components(edges: pa.Table) -> pa.Table:
    """components of edges that fit in memory."""
    known: dict[int, int] = {}

    def top(x: int) -> int:
        while known.setdefault(x, x) != x:
            known[x] = known[known[x]]
            x = known[x]
        return x

    for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True):
        a, b = top(a), top(b)
        known[max(a, b)] = min(a, b)
    nodes = list(known)
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([top(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.  Up to `few` edges are
    joined by the driver, which saves a table for each step; more never reach it."""
    head = edges.select("a", "b").limit(few + 1).toArrow()
    if head.num_rows <= few:
        return edges.sparkSession.createDataFrame(few_components(head), "node long, root long")
    state = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct()
        before, state = state, written(small)
        forget(before)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    found = state.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def shared_counts(kept: np.ndarray, left: np.ndarray, right: np.ndarray, often: int = 2048, at_once: int = 1 << 20) -> np.ndarray:
    """How many values each of the rows `left` of a matrix of sketches has in common with each of the rows `right`.

    Values that more than `often` pairs of rows share are counted by matrix products, 1024 of them at once, and the
    others pair by pair, about `at_once` pairs at once: memory goes by the rows, not by how many values they share."""
    codes = np.unique(kept, return_inverse=True)[1].reshape(kept.shape)

    def places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, place = np.nonzero(kept[rows] != _NONE)
        own = codes[rows[at], place]
        order = np.argsort(own, kind="stable")
        return own[order], at[order]

    (a, at_a), (b, at_b) = places(left), places(right)
    times_a, times_b = (np.bincount(x, minlength=kept.size + 1) for x in (a, b))
    pairs = times_a * times_b
    out = np.zeros((len(left), len(right)), np.int32)

    seldom = np.flatnonzero((pairs[a] > 0) & (pairs[a] <= often))
    rows, times, first = at_a[seldom], times_b[a[seldom]], (times_b.cumsum() - times_b)[a[seldom]]
    for part in np.split(np.arange(len(seldom)), np.flatnonzero(np.diff(times.cumsum() // at_once)) + 1):
        n = times[part]
        met = np.arange(n.sum()) + np.repeat(first[part] - n.cumsum() + n, n)
        out += np.bincount(np.repeat(rows[part], n) * len(right) + at_b[met], minlength=out.size).reshape(out.shape)

    common = np.flatnonzero(pairs > often)
    for k in range(0, len(common), 1024):
        part = common[k : k + 1024]
        has = []
        for x, at, n in ((a, at_a, len(left)), (b, at_b, len(right))):
            inside = slice(np.searchsorted(x, part[0]), np.searchsorted(x, part[-1], "right"))
            place = np.searchsorted(part, x[inside])
            known = part[place] == x[inside]
            has.append(np.zeros((n, len(part)), np.float32))
            has[-1][at[inside][known], place[known]] = 1
        out += (has[0] @ has[1].T).astype(np.int32)
    return out


def compared(table: pa.Table, percent: int) -> pa.Table:
    """(a, b), a < b: the pairs of one square of block_pairs that pass the sketch filter."""
    key, j = table["key"][0].as_py(), percent / 100
    nodes, roots, sizes, least = (table[x].to_numpy() for x in ("node", "root", "n", "least"))
    side = table["left"].to_numpy(zero_copy_only=False).astype(bool)
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    n, m = sizes[left][:, None], sizes[right][None, :]
    ok = (roots[left][:, None] != roots[right][None, :]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
    ok &= shared_counts(matrix(table["sketch"]), left, right) >= np.maximum(least[left][:, None], least[right][None, :])
    fine = matrix(table["fine"], FINE)
    common = shared_counts(fine, left, right)
    likeness = common / np.maximum(np.minimum(n, FINE) + np.minimum(m, FINE) - common, 1)
    whole = (n <= FINE) & (m <= FINE)
    # of sets known whole this is their likeness; of others no linked pair falls below, see least_common
    ok &= likeness >= np.where(whole, j - 0.001, (j - 0.1) / (2 - j + 0.1))
    at_left, at_right = np.nonzero(ok)
    a, b, sure = left[at_left], right[at_right], whole[at_left, at_right]
    opens = {int(i): set(table["open"][int(i)].as_py()) for i in np.union1d(a, b)}
    found = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(a), 4096):
        x, y, passed = (v[k : k + 4096] for v in (a, b, sure))
        rest = np.flatnonzero(~passed)
        if len(rest):
            same, filled = union_overlap(fine[x[rest]], fine[y[rest]])
            passed[rest] = plausible(same, filled, sizes[x[rest]] + sizes[y[rest]], percent)
        x, y = x[passed], y[passed]
        own = np.fromiter((min(opens[p] & opens[q]) == key for p, q in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
        found.append(np.sort(np.stack([nodes[x[own]], nodes[y[own]]], 1), 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def block_pairs(members: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """Pairs of different components inside long lists that pass the sketch filter, found block against block.

    members: (key, len, minor, major, node, root, n, least, sketch, fine, open): minor says how many members of the list lie outside
    its largest component, major is that component's root, and open holds all keys of the node's open lists; a pair
    comes from the smallest key that both have.  Two members of the largest component need no comparison, so blocks of
    the others meet blocks of all members: a row of the largest component goes to minor / block squares, one of the
    others to len / block more.  Pairs with enough common retained values are estimated from `fine`, which is exact for
    sets of up to FINE shingles together; a square returns only the pairs that pass."""
    lots, cells = F.ceil(F.col("minor") / block).cast("int"), F.ceil(F.col("len") / block).cast("int")
    cell = lambda count: F.pmod(F.xxhash64("node"), count.cast("long")).cast("int")
    lefts = F.transform(F.sequence(F.lit(0), cells - 1), lambda j: F.struct(cell(lots).alias("r"), j.alias("c"), F.lit(True).alias("left")))
    rights = F.transform(F.sequence(F.lit(0), lots - 1), lambda j: F.struct(j.alias("r"), cell(cells).alias("c"), F.lit(False).alias("left")))
    squares = F.when(F.col("root") == F.col("major"), rights).otherwise(F.concat(lefts, rights))
    dealt = members.withColumn("square", F.explode(squares)).select("key", "square.r", "square.c", "square.left", "node", "root", "n", "least", "sketch", "fine", "open")

    def compare(table: pa.Table) -> pa.Table:
        return compared(table, percent)

    return dealt.groupBy("key", "r", "c").applyInArrow(compare, "a long, b long").distinct()


def linked(reps: DataFrame, texts: DataFrame, width: int, percent: int, short: int) -> DataFrame:
    """(node, root) of every class that links with another."""
    entries = written(list_entries(reps))
    lists = written(entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("len")).where("len > 1"))
    pairs = written(estimated(candidate_pairs(entries, lists, short), reps, percent))
    edges = confirmed(pairs, reps, texts, width, percent)
    roots = components(edges)
    long = lists.where(F.col("len") > short).select("key", "len")
    labelled = entries.join(long, "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"), F.count(F.lit(1)).alias("roots"))
    opened = written(labelled.join(by_root.where("roots > 1"), "key").select("key", "len", (F.col("len") - F.col("most")).alias("minor"), "major", "node", "root"))
    per_node = reps.select("node", "n", "least", "sketch").join(opened.groupBy("node").agg(F.collect_list("key").alias("open")), "node")
    fine = written(fine_sketches(opened.select("node").distinct(), reps, texts, width))
    left = written(block_pairs(opened.join(per_node, "node").join(fine, "node"), percent).join(pairs, ["a", "b"], "left_anti"))
    if not left.isEmpty():
        roots = components(edges.unionByName(confirmed(left, reps, texts, width, percent)))
    forget(entries, lists, pairs, opened, fine, left)
    return roots


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, short: int = 8) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row."""
    base = written(sketches(df, id_col, text_col, width, percent))
    reps = written(classes(base))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    roots = linked(reps, texts, width, percent, short)
    joined = reps.select("node", "id").join(roots, "node")
    named = joined.join(joined.groupBy("root").agg(F.min("id").alias("component")), "root").select("node", "component")
    found = written(reps.select("node", "d1", "d2", "id", "copies").join(named, "node", "left").select("d1", "d2", "copies", F.coalesce("component", "id").alias("component")))
    # classes with over 1/4096 of all rows, of which there are less than 4096, are broadcast; no class fills one task
    total = found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    large = F.broadcast(found.where(F.col("copies") > total / 4096).select("d1", "d2", "component"))
    rows = base.select("id", "n", "d1", "d2")
    few = rows.join(large, ["d1", "d2"], "left_anti").join(found.where(F.col("copies") <= total / 4096).select("d1", "d2", "component"), ["d1", "d2"], "left")
    out = few.unionByName(rows.join(large, ["d1", "d2"]))
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
