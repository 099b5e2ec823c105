"""Hierarchical multi-length packing of token streams, without a shuffle.

A document is routed to the smallest context-size tier that holds it; of a document beyond the
longest tier, full windows are cut off first and the rest is routed.  Within a buffer of documents
each tier is packed in windows of its own size, longest tier first: a window opens with the longest
item of its tier, its gap takes the longest whole item of its own or a shorter tier that fits, again
and again, and a part cut off an item closes it; the rest of that item is routed anew.  So every
window is full, tiers are powers of two and nothing is padded; the one window that a buffer's last
items leave partly filled is cut at powers of two.

Sequences of one tier are dealt to step groups of equal tokens, balanced by attention cost (the sum
of the squared piece lengths), and the groups of all tiers are numbered in turns, so that every
stretch of steps has the tiers in their shares.

Every task packs its own input partition and holds the ids of at most `buffer` items or 4 million
tokens besides those of the text at hand, which is held whole however long.  Pieces, not rows, are
what is fixed: every id lies in exactly one piece whatever the order of the rows, while sequence ids
follow the partition (its number is in their upper bits) and the order of its rows.  A lost task of
an input that is read again in the same order gives the same rows.  Items of equal length are taken
in the order they came.  Null and empty texts are one piece with the end token alone, repeated rows
are packed one by one, an empty table gives an empty one, ids of any type (null too) come back as
they are, and further columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Encoder, Shipped, merge_words, worker_encoder

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Items are (length, serial, document, start); a document is (id, ids as uint32, total)."""

    def __init__(self, tiers=(128, 256, 512, 1024), step_tokens: int = 8192, first_id: int = 0):
        if sorted(tiers) != list(tiers) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be ascending powers of two")
        self.tiers, self.window, self.step_tokens = tiers, tiers[-1], step_tokens
        self.next_sequence, self.next_group, self.serial = first_id, first_id, 0
        self.by_tier: dict[int, list] = {t: [] for t in tiers}
        self.held = 0
        self.full: list[tuple[int, list]] = []

    def route(self, document, start: int, length: int) -> None:
        tier = next(t for t in self.tiers if length <= t)
        insort(self.by_tier[tier], (length, self.serial, document, start))
        self.serial += 1
        self.held += 1

    def add(self, document) -> None:
        total = document[2]
        for start in range(0, total - self.window + 1, self.window):
            self.full.append((self.window, [(self.window, 0, document, start)]))
        if total % self.window:
            self.route(document, total - total % self.window, total % self.window)

    def _fill(self, tier: int, gap: int):
        """The longest item of this or a shorter tier that fits into the gap; else a part of the shortest that doesn't."""
        at = self.tiers.index(tier)
        for t in reversed(self.tiers[: at + 1]):
            items = self.by_tier[t]
            if items and items[0][0] <= gap:
                self.held -= 1
                return items.pop(bisect_right(items, gap, key=lambda x: x[0]) - 1)
        for t in self.tiers[: at + 1]:
            if self.by_tier[t]:
                self.held -= 1
                length, serial, document, start = self.by_tier[t].pop(0)
                self.route(document, start + gap, length - gap)
                return gap, serial, document, start
        return None

    def flush(self) -> list[tuple[int, list]]:
        """All sequences held, as (length, pieces)."""
        out, self.full = self.full, []
        for tier in reversed(self.tiers):
            while self.by_tier[tier]:
                pieces, gap = [], tier
                while gap and (item := self._fill(tier, gap)):
                    pieces.append(item)
                    gap -= item[0]
                out += [(tier, pieces)] if not gap else _at_powers(pieces, tier - gap)
        return out

    def grouped(self):
        """Flushed sequences with their ids, tiers and step groups: (sequence, group, tier, pieces)."""
        by_tier: dict[int, list] = {}
        for size, pieces in self.flush():
            by_tier.setdefault(next(t for t in self.tiers if size <= t), []).append((sum(p[0] ** 2 for p in pieces), size, pieces))
        groups = {t: -(-sum(x[1] for x in found) // self.step_tokens) for t, found in by_tier.items()}
        turns = sorted(((k + 0.5) / n, t, k) for t, n in groups.items() for k in range(n))
        number = {(t, k): self.next_group + at for at, (_, t, k) in enumerate(turns)}
        for tier, found in sorted(by_tier.items()):
            found.sort(key=lambda x: -x[0])
            for k, (_, _, pieces) in enumerate(found):
                lap, at = divmod(k, groups[tier])
                yield self.next_sequence, number[tier, groups[tier] - 1 - at if lap % 2 else at], tier, pieces
                self.next_sequence += 1
        self.next_group += len(turns)


def _at_powers(pieces: list, length: int) -> list[tuple[int, list]]:
    """A partly filled window as sequences of powers of two; pieces are cut where a sequence ends."""
    out = []
    for size in powers(length):
        part, room = [], size
        while room:
            n, serial, document, start = pieces.pop(0)
            if n > room:
                pieces.insert(0, (n - room, serial, document, start + room))
                n = room
            part.append((n, serial, document, start))
            room -= n
        out.append((size, part))
    return out


def pack_ids(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Bytes(Encoder):
    """Units stand for their ids as little-endian 32-bit integers."""

    def __init__(self, automaton):
        merge = merge_words(automaton)
        super().__init__(automaton, b"".join, word_value=lambda w: pack_ids(merge(w)))

    def special_value(self, token: str) -> bytes:
        return pack_ids((self.automaton.special[token],))


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers=(128, 256, 512, 1024), step_tokens: int = 8192, buffer: int = 4096) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, tier and step group."""
    shipped = Shipped(df.sparkSession, path)
    names = [c.split()[0] for c in PIECE.split(", ")]

    def rows(packer, kind):
        cols: list[list] = [[] for _ in range(9)]
        for sequence, group, tier, pieces in packer.grouped():
            offset = 0
            for length, _, (key, ids, total), start in pieces:
                crc = zlib.crc32(ids[start : start + length].tobytes())
                for col, v in zip(cols, (key, start, length, crc, total, sequence, offset, tier, group), strict=True):
                    col.append(v)
                offset += length
        return pa.RecordBatch.from_pydict({id_col: pa.array(cols[0], kind)} | {n: pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, cols[1:], strict=True)})

    def run(batches):
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 40)
        enc = worker_encoder(shipped, "bytes", _Bytes)
        end = np.array([end_id], "<u4").tobytes()
        tokens, kind = 0, None
        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(enc.pieces(text or "")) + end, "<u4")
                packer.add((key, ids, len(ids)))
                tokens += len(ids)
                if packer.held >= buffer or tokens > 4_000_000:
                    yield rows(packer, kind)
                    tokens = 0
        if kind is not None:
            yield rows(packer, kind)

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, {PIECE}")
