"""Line deduplication by exact runs of lines and content-defined chunks, in DataFrame operations only.

A run of neighbouring lines that has `passage_words` words or more and occurs earlier, by (id, line), goes
whole, wherever it starts and whatever surrounds it; it begins and ends in lines that have words.  It is enough to look at the shortest such runs from each
line on and up to each line: they cover every longer one.  Besides, a document's lines are cut into chunks: a
rolling hash over the last `window` line hashes ends a chunk wherever it is 0 modulo `modulus`, and a line of at
least `passage_words` words is a chunk alone.  A chunk of several lines (or of one such line) is kept only where
it occurs first, however short.

Chunks of one hash are compared byte by byte: the hash aggregate that finds the first place of each groups them by
their text as well, so chunks of equal hashes and different texts are different chunks.  Runs overlap from line to
line and would be shipped many times; they meet by two 64-bit hashes of their lines alone.  A run or chunk that
fills a third of all rows is reduced before it is shuffled.  First places are gathered per document, and the texts,
shuffled once, lose what isn't first; nothing is joined on a run.

A document is an id and a text: equal rows are one document and each keeps its row, rows that share an id but not
a text are told apart by 20 bits of the text's hash, which also order them.  Ids that are no whole numbers are
hashed, and the hash is their order.  A row without id keeps its text and counts as no one's first occurrence.  A
null text stays null and an empty text empty; a document of which nothing is left keeps its row with an empty
text.  A run that overlaps its own copy (lines over and over) leaves what the copy doesn't cover.  A document's
lines keep their order and the newlines between them.  Texts of any length are cut whole.  An empty table gives an
empty one.  Further columns of the input are kept under any name; only a column `_chunks` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sharding import number

#: Places within a document are counted below this.
PLACES = 1 << 31
#: Texts that share an id are told apart by hashes below this.
VARIANTS = 1 << 20
#: The same for runs and chunks in one: chunks are counted from CHUNKS on.
SPOTS, CHUNKS = 1 << 41, 1 << 40


def document(df: DataFrame, id_col: str, text_col: str) -> Column:
    """The number of a document, in the order of ids; null without id."""
    return number(df, id_col).cast("decimal(20,0)") * F.lit(VARIANTS).cast("decimal(8,0)") + F.pmod(F.xxhash64(text_col), F.lit(VARIANTS))


def _settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    # a generator of one row: else the optimizer moves the value into the lambdas, which then make it anew for each element
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _cut(lined: DataFrame, window: int, modulus: int, passage_words: int) -> DataFrame:
    """lined with hashes of its lines and cuts, the last line of each chunk."""

    def hashed(line: Column) -> Column:
        words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
        return F.struct(F.xxhash64(line).alias("h"), (words >= passage_words).alias("long"))

    def ends(x: Column, i: Column) -> Column:
        rolled = x["h"]
        for k in range(1, window):
            rolled = F.xxhash64(rolled, F.coalesce(F.get("hashes", i - k)["h"], F.lit(0).cast("long")))
        return (F.pmod(rolled, F.lit(modulus)) == 0) | x["long"] | F.coalesce(F.get("hashes", i + 1)["long"], F.lit(True))

    with_hashes = _settled(lined, "hashes", F.transform("lines", hashed))
    return _settled(with_hashes, "cuts", F.filter(F.transform("hashes", lambda x, i: F.when(ends(x, i), i)), lambda i: i.isNotNull()))


def _first_line(k: Column) -> Column:
    return F.when(k == 0, F.lit(0)).otherwise(F.get("cuts", k - 1) + 1)


def chunk_rows(df: DataFrame, id_col: str, text_col: str, window: int = 2, modulus: int = 3, passage_words: int = 50) -> DataFrame:
    """(id_col, place, body, shared): the chunks of every text that is not null; shared ones may be removed."""

    def chunk(last: Column, k: Column) -> Column:
        first = _first_line(k)
        shared = (last > first) | F.get("hashes", last)["long"]
        return F.struct(k.cast("long").alias("place"), F.array_join(F.slice("lines", first + 1, last - first + 1), "\n").alias("body"), shared.alias("shared"))

    lined = _settled(df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_t")), "lines", F.split("_t", "\n"))
    return _cut(lined.drop("_t"), window, modulus, passage_words).select(id_col, F.inline(F.transform("cuts", chunk)))


def kept_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, place, body, copies): the chunks that stay; copies counts the occurrences of each."""
    rows = chunk_rows(df, id_col, text_col, **how)
    at = F.col(id_col).cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(10,0)") + F.col("place")
    keyed = rows.select(at.cast("decimal(38,0)").alias("at"), "body", "shared").withColumn("own", F.when(~F.col("shared"), F.col("at")))
    first = keyed.groupBy(F.xxhash64("body", "own").alias("h"), "body", "own").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"))
    key = F.floor(F.col("at") / F.lit(PLACES).cast("decimal(10,0)"))
    placed = first.select(key.cast(df.schema[id_col].dataType).alias(id_col), "at", "body", "copies")
    return placed.select(id_col, (F.col("at") - F.col(id_col).cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(10,0)")).cast("long").alias("place"), "body", "copies")


def _runs(lined: DataFrame, passage_words: int) -> DataFrame:
    """lined with filled, the lines that have words, and spans: the shortest runs of passage_words words or more from
    each of them on and up to each of them, as place in filled * reach + further lines."""
    bits = passage_words.bit_length()
    words = lambda i: F.least(F.regexp_count(F.get("lines", i), F.lit(r"\S+")), F.lit(passage_words))
    counted = _settled(lined, "words", F.transform("lines", lambda _, i: words(i)))
    filled = _settled(counted, "filled", F.filter(F.transform("words", lambda w, i: F.when(w > 0, i)), lambda i: i.isNotNull()))
    # sums[k][i]: words of the 2^k filled lines from i on
    one = F.transform("filled", lambda i: F.get("words", i))

    def doubled(sums: Column, step: Column) -> Column:
        last = F.element_at(sums, -1)
        return F.concat(sums, F.array(F.transform(last, lambda w, i: w + F.coalesce(F.get(F.element_at(sums, -1), i + step), F.lit(0)))))

    summed = _settled(filled, "sums", F.aggregate(F.array(*[F.lit(1 << k) for k in range(bits - 1)]), F.array(one), doubled))
    levels = F.array(*[F.lit(k) for k in reversed(range(bits))])
    size = lambda k: F.call_function("shiftleft", F.lit(1), k)
    start = lambda i: F.struct(i.alias("at"), F.lit(passage_words).alias("left"))

    def on(i: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            w = F.get(F.get("sums", k), s["at"])
            return F.when(w < s["left"], F.struct((s["at"] + size(k)).alias("at"), (s["left"] - w).alias("left"))).otherwise(s)

        return F.aggregate(levels, start(i), step, lambda s: F.when(s["at"] < F.size("filled"), i.cast("long") * (1 << bits) + s["at"] - i))

    def back(i: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            w = F.get(F.get("sums", k), s["at"] - size(k))
            return F.when(w < s["left"], F.struct((s["at"] - size(k)).alias("at"), (s["left"] - w).alias("left"))).otherwise(s)

        return F.aggregate(levels, start(i + 1), step, lambda s: F.when(s["at"] > 0, (s["at"] - 1).cast("long") * (1 << bits) + i - s["at"] + 1))

    both = F.concat(F.transform("filled", lambda _, i: on(i)), F.transform("filled", lambda _, i: back(i)))
    spans = F.array_distinct(F.filter(both, lambda s: s.isNotNull()))
    return _settled(summed, "spans", spans).drop("words", "sums")


def _span(s: Column, bits: int) -> tuple[Column, Column]:
    """First and last place in filled."""
    first = F.shiftright(s, bits).cast("int")
    return first, first + s.bitwiseAND((1 << bits) - 1).cast("int")


def _meeting(kind: int, marks: Column) -> tuple[Column, Column]:
    """Two hashes of the lines of a run (kind 0); one of a chunk (kind 1), whose text is compared too."""
    return F.xxhash64(F.lit(kind), marks), F.lit(0).cast("long") if kind else F.xxhash64(F.lit(2), marks)


def first_places(df: DataFrame, id_col: str, text_col: str, window: int = 2, modulus: int = 3, passage_words: int = 50) -> DataFrame:
    """(_id, _firsts): per document the places of the runs and chunks that occur there first."""
    bits = passage_words.bit_length()
    lined = _settled(df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(document(df, id_col, text_col).cast("decimal(28,0)").alias("_id"), F.col(text_col).alias("_t")), "lines", F.split("_t", "\n")).drop("_t")
    ready = _settled(_runs(_cut(lined, window, modulus, passage_words), passage_words), "marks", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))))

    def keyed(kind: int, place: Column, first: Column, last: Column, body: Column) -> Column:
        k, l = _meeting(kind, F.slice("marks", first + 1, last - first + 1))  # noqa: E741
        return F.struct(place.cast("long").alias("place"), k.alias("k"), l.alias("l"), body.alias("body"))

    def run(s: Column) -> Column:
        first, last = _span(s, bits)
        return keyed(0, s, F.get("filled", first), F.get("filled", last), F.lit(None).cast("string"))

    def chunk(last: Column, k: Column) -> Column:
        first = _first_line(k)
        body = F.array_join(F.slice("lines", first + 1, last - first + 1), "\n")
        return F.when((last > first) | F.get("hashes", last)["long"], keyed(1, k.cast("long") + CHUNKS, first, last, body))

    parts = F.concat(F.transform("spans", run), F.filter(F.transform("cuts", chunk), lambda c: c.isNotNull()))
    rows = ready.select("_id", F.inline(parts))
    # an id of 63 bits, 20 bits of its text and 41 of the place are less than 10^38
    at = F.col("_id").cast("decimal(38,0)") * F.lit(SPOTS).cast("decimal(13,0)") + F.col("place")
    first = rows.select("k", "l", "body", at.cast("decimal(38,0)").alias("at")).groupBy("k", "l", "body").agg(F.min("at").alias("at"))
    spots = F.lit(SPOTS).cast("decimal(38,0)")
    placed = first.select("at", F.pmod("at", spots).cast("long").alias("place"))
    owner = ((F.col("at") - F.col("place")) / spots).cast("decimal(28,0)")
    return placed.select(owner.alias("_id"), "place").groupBy("_id").agg(F.collect_list("place").alias("_firsts"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, modulus: int = 3, passage_words: int = 50) -> DataFrame:
    """df with its texts cut down to what occurs first, columns in their order, and `_chunks`, the number of chunks of which lines are kept."""
    bits = passage_words.bit_length()
    firsts = first_places(df, id_col, text_col, window, modulus, passage_words)
    columns = [c for c in df.columns if c != "_chunks"]
    packed = df.select(F.struct(*columns).alias("_row"), document(df, id_col, text_col).cast("decimal(28,0)").alias("_key"))
    joined = packed.join(firsts, F.col("_key") == F.col("_id"), "left").drop("_id")
    lined = _settled(joined, "lines", F.split(F.col(f"_row.`{text_col}`"), "\n"))
    ready = _runs(_cut(lined, window, modulus, passage_words), passage_words)
    repeated = lambda places: F.when(F.col("_key").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_except(places, F.coalesce("_firsts", F.array().cast("array<bigint>"))))
    shared = F.filter(F.transform("cuts", lambda last, k: F.when((last > _first_line(k)) | F.get("hashes", last)["long"], k.cast("long") + CHUNKS)), lambda k: k.isNotNull())

    # a filled line is at twice its place in filled, the blank lines after it one further
    def covered(s: Column) -> Column:
        first, last = _span(s, bits)
        return F.sequence(first * 2, last * 2)

    def lines_at(x: Column) -> Column:
        line = F.get("filled", F.shiftright(x, 1))
        after = F.coalesce(F.get("filled", F.shiftright(x, 1) + 1), F.size("lines"))
        return F.when(x % 2 == 0, F.array(line)).when(after > line + 1, F.sequence(line + 1, after - 1)).otherwise(F.array().cast("array<int>"))

    count = F.size("filled")
    left = F.when(count > 0, F.array_except(F.sequence(F.lit(0), count * 2 - 1), F.flatten(F.transform(repeated(F.col("spans")), covered))))
    head = F.coalesce(F.get("filled", F.lit(0)), F.size("lines"))
    leading = F.when(head > 0, F.sequence(F.lit(0), head - 1)).otherwise(F.array().cast("array<int>"))
    by_runs = F.concat(leading, F.flatten(F.transform(F.coalesce(left, F.array().cast("array<int>")), lines_at)))
    in_chunks = F.flatten(F.transform(repeated(shared), lambda p: F.sequence(_first_line((p - CHUNKS).cast("int")), F.get("cuts", (p - CHUNKS).cast("int")))))
    kept = _settled(ready, "kept", F.array_except(by_runs, in_chunks)).drop("spans", "filled")
    chunk_of = _settled(kept, "chunk_of", F.flatten(F.transform("cuts", lambda last, k: F.array_repeat(k, last - _first_line(k) + 1))))
    text = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    chunks = F.size(F.array_distinct(F.transform("kept", lambda i: F.get("chunk_of", i))))
    none = F.col(f"_row.`{text_col}`").isNull()
    return chunk_of.select(*[F.when(~none, text).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns], F.when(none, 0).otherwise(chunks).alias("_chunks"))
