"""Token counts by a map-side two-tier lookup.

Tier one is a compact broadcast hash table: the token counts of the most frequent pre-tokens of the
whole input, at most `table_size` of them and each of at most `longest` characters, so its size is
bounded whatever the input.  Every pre-token is looked up there first.  Tier two takes the misses:
they are encoded, and a worker keeps what it has encoded in a bounded cache.

To find the frequent ones, each task counts all its pre-tokens in a bounded summary and writes its
`per_task` most frequent as a small table in the shared folder.  Only 64-bit hashes and counts of
these are added up across tasks; the strings of the winners are then picked up where they were
written.  So no pre-token is ever shuffled, and as the table only saves work, neither a summary's
rounding nor two equal hashes can change a count.

Null texts count as empty: 0 bytes, 0 tokens.  Special strings inside a text are one token.  Very
long texts are counted whole; pre-tokens of any length are counted, only short ones are kept.
Repeated rows are counted one by one and alike, an empty table gives an empty one, ids of any type
(null too) come back as they are, and further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .bpe import Encoder, Shipped, merge_words, worker_encoder


class _Table(dict):
    """Tier one; what it lacks is asked of tier two and not stored here."""

    def __init__(self, frequent: dict[str, int], rest):
        super().__init__(frequent)
        self.rest = rest

    def __missing__(self, token: str) -> int:
        return self.rest[token]


class _Lengths(Encoder):
    """Pre-tokens stand for their number of tokens."""

    def __init__(self, automaton):
        merge = merge_words(automaton)
        super().__init__(automaton, sum, most=2_000_000, word_value=lambda w: len(merge(w)))

    def special_value(self, token: str) -> int:
        return 1

    def parts(self, text: str):
        """The pre-tokens of a text and the number of special tokens in it."""
        if not text:
            return (), 0
        if not self.cut or not any(s in text for s in self.automaton.special):
            return self.find(text), 0
        between = self.cut(text)
        return [t for part in between[::2] if part for t in self.find(part)], len(between) // 2

    def count(self, text: str, table) -> int:
        tokens, specials = self.parts(text)
        return sum(map(table.__getitem__, tokens), specials)


def frequent_tokens(df: DataFrame, shipped: Shipped, text_col: str = "text", per_task: int = 2048, held: int = 150_000, longest: int = 32, table_size: int = 16_384) -> list[str]:
    """The most frequent pre-tokens of all texts.  A task's summary loses its rare half, and its long pre-tokens,
    when it has over `held` entries or has read another 16 million characters."""

    def run(batches):
        enc = worker_encoder(shipped, "lengths", _Lengths)
        seen, read = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(enc.parts(text or "")[0])
                read += len(text or "")
                if len(seen) > held or read > 16_000_000:
                    seen, read = Counter(dict([x for x in seen.most_common(held // 2) if len(x[0]) <= longest])), 0
        top = [x for x in seen.most_common(2 * per_task) if len(x[0]) <= longest][:per_task]
        yield pa.RecordBatch.from_pydict({
            "task": pa.array([TaskContext.get().partitionId()] * len(top), pa.int32()),
            "key": pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in top], pa.int64()),
            "n": pa.array([n for _, n in top], pa.int64()),
            "token": pa.array([t for t, _ in top], pa.string()),
        })

    summaries = written(df.select(text_col).mapInArrow(run, "task int, key long, n long, token string"))
    best = summaries.groupBy("key").agg(F.sum("n").alias("n"), F.min("task").alias("task")).orderBy(F.desc("n"), "key").limit(table_size)
    picked = summaries.join(F.broadcast(best.select("key", "task")), ["key", "task"]).select("token").collect()  # at most table_size rows
    return [r.token for r in picked]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, table_size: int = 16_384) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every whole text."""
    shipped = Shipped(df.sparkSession, path)
    counter = _Lengths(shipped.automaton())
    shared = df.sparkSession.sparkContext.broadcast({t: counter.word_value(t) for t in frequent_tokens(df, shipped, text_col, table_size=table_size)})

    def run(batches):
        enc = worker_encoder(shipped, "lengths", _Lengths)
        table = _Table(shared.value, enc.words)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [enc.count(t, table) for t in texts]
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0),
                "n_bytes": pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            })

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
