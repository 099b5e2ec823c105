"""BPE encoding and decoding with a tokenization automaton compiled from the merge list.

The automaton reads tokens; its states are "the last token was a" plus a start state.  It starts
as one state per byte with an arc for every byte.  Each merge (a, b) -> c, in rank order, applies
one merge gadget:

* every state with an arc a whose target still has an arc b gets an arc c;
* the state entered by c is a copy of the state that b enters at that moment;
* the state entered by a loses its arc b.

After the last merge, the paths that are left are exactly the segmentations that greedy merging
gives, one per byte string, so the automaton is deterministic: after any prefix of a word it is in
one state.  Its table is compiled with default transitions: a state's row is kept as the row that
it was copied from, the moment of the copy, and the arcs that it lost since (`_right`, `_born`,
`_cut`); an arc's column is kept as the column of its left part (`_left`).  The table so has the
size of the vocabulary, not its square.  A second table, the byte trie of all labels with failure
links, says which arcs end at a byte.

Encoding reads a pre-split word once, byte by byte: of the arcs that end there, longest first, the
one that the state at its start has is taken, and its target is the state there.  Nothing is tried
twice; the path is read from the last state back.  Decoding emits the labels of the arcs.

Null texts count as empty, empty texts have no tokens, words of any length are encoded in linear
time, repeated rows give repeated results, an empty table gives an empty one, ids of any type (null
too) come back as they are, and further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_SHIFT = 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Fixed value: the pattern that the byte-level vocabularies were made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_spec(path: str) -> dict:
    """Vocabulary, merges and special tokens of a byte-level BPE file in the tokenizers JSON format."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    to_byte = byte_alphabet()
    special = {t["content"]: t["id"] for t in raw["added_tokens"]}
    as_bytes = lambda s: bytes(to_byte[c] for c in s)
    vocab = {as_bytes(s): i for s, i in raw["model"]["vocab"].items() if s not in special}
    merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in raw["model"]["merges"]]
    return {"vocab": vocab, "merges": merges, "special": special}


class MergeAutomaton:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.special = special or {}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for label, i in vocab.items():
            self.labels[i] = label
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.digits = [str(i) for i in range(size)]
        self._left, self._right, self._born = [0] * size, [0] * size, [-1] * size
        self._cut: dict[int, int] = {}
        self._arcs: dict[int, bool] = {}
        self._token = {label: i for label, i in vocab.items() if len(label) == 1}
        for rank, (x, y) in enumerate(merges):
            self._gadget(vocab, x, y, rank)
        self._sizes = [len(label) for label in self.labels]
        self._trie()

    def _gadget(self, vocab: dict[bytes, int], x: bytes, y: bytes, rank: int) -> None:
        a, b, c = self._token.get(x), self._token.get(y), vocab.get(x + y)
        if c is None or x + y in self._token:
            raise ValueError(f"merge {rank} makes no new token of the vocabulary: {x!r} {y!r}")
        if a is None or b is None or not self._arc_before(a, b, rank):
            return  # no path has this arc any more: the merge never applies
        self._left[c], self._right[c], self._born[c] = a, b, rank
        self._cut[a << _SHIFT | b] = rank
        self._token[x + y] = c

    def _arc_before(self, a: int, b: int, time: int) -> bool:
        """Whether arc b leaves the state of a just before merge `time`: default transitions are followed to the
        entry that decides, through as many copies as the two labels have merges.  Arcs met are kept unfolded."""
        born, cut = self._born, self._cut
        while True:
            if cut.get(a << _SHIFT | b, time) < time:
                return False
            at, bt = born[a], born[b]
            if bt >= at:
                if bt < 0:
                    return True
                b, time = self._left[b], bt + 1  # arc b was added where its left part's arc was
            else:
                a, time = self._right[a], at  # the state of a is a copy of its right part's

    def _trie(self) -> None:
        """Tables over bytes: `_next` (node << 8 | byte to node), `_fail`, `_longest` (the longest label that ends in a
        node, which every byte has) and `_shorter` (the next shorter label that ends a label)."""
        self._next: dict[int, int] = {}
        ends, parents = [-1], [(0, 0)]
        at = {}
        for label, t in sorted(self._token.items(), key=lambda x: len(x[0])):
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = self._next.get(key, -1)
                if node < 0:
                    node = self._next[key] = len(ends)
                    ends.append(-1)
                    parents.append((key >> 8, byte))
            ends[node], at[t] = t, node
        depth = [0] * len(ends)
        for node in range(1, len(ends)):
            depth[node] = depth[parents[node][0]] + 1
        self._fail, self._longest = [0] * len(ends), [-1] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            parent, byte = parents[node]
            if parent:
                self._fail[node] = self._step(self._fail[parent], byte)
            self._longest[node] = ends[node] if ends[node] >= 0 else self._longest[self._fail[node]]
        self._shorter = [-1] * len(self.labels)
        for t, node in at.items():
            self._shorter[t] = self._longest[self._fail[node]]

    def _step(self, node: int, byte: int) -> int:
        """The node of the longest suffix that the trie has."""
        follow = self._next.get
        while (found := follow(node << 8 | byte, -1)) < 0:
            if not node:
                return 0
            node = self._fail[node]
        return found

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The path of one pre-split word."""
        whole = self._token.get(word)
        if whole is not None:
            return (whole,)
        follow, fail, longest, shorter, sizes, arcs = self._next.get, self._fail, self._longest, self._shorter, self._sizes, self._arcs
        states = [-1] * (len(word) + 1)
        node, pos = 0, 0
        for byte in word:
            pos += 1
            found = follow(node << 8 | byte, -1)
            while found < 0 and node:
                node = fail[node]
                found = follow(node << 8 | byte, -1)
            if found < 0:
                raise ValueError(f"the vocabulary lacks byte {byte}")
            node, t = found, longest[found]
            while (prev := states[pos - sizes[t]]) >= 0:
                key = prev << _SHIFT | t
                ok = arcs.get(key)
                if ok is None:
                    if len(arcs) > 600_000:
                        arcs.clear()
                    ok = arcs[key] = self._arc_before(prev, t, 1 << 62)
                if ok:
                    break
                t = shorter[t]
            else:
                if pos > sizes[t]:
                    raise AssertionError("a state that is never entered")
            states[pos] = t
        path = []
        while pos:
            path.append(states[pos])
            pos -= sizes[states[pos]]
        return tuple(reversed(path))

    def token_ids(self) -> dict[bytes, int]:
        """Every token that a text can have."""
        return dict(self._token)

    def born(self, token: int) -> int:
        """The rank of the merge that makes a token; -1: a byte."""
        return self._born[token]

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def merge_words(automaton: MergeAutomaton, longest: int = 256):
    """A function from words to ids by tiktoken's merge loop over the automaton's tokens, for operators whose
    method isn't the automaton; both give the same ids (tests compare them on either side of `longest`).  Without
    merge-ordered ids, and for words of over `longest` characters, for which the loop is quadratic, the automaton
    itself runs."""
    import tiktoken

    ranks, born = automaton.token_ids(), automaton.born
    by_birth = sorted(ranks.values(), key=born)
    if len(ranks) < 256 or any(a >= b for a, b in zip(by_birth, by_birth[1:], strict=False) if born(a) >= 0):
        return lambda w: automaton.encode_word(w.encode())
    merge = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return lambda w: merge(w.encode()) if len(w) <= longest else automaton.encode_word(w.encode())


class _Kept(dict):
    """A bounded cache that fills itself: when it is full it becomes the old generation, from which hits come back.
    Keys of more than `longest` characters are made anew each time, so bytes are bounded along with entries."""

    def __init__(self, make, most: int, longest: int = 32):
        self.make, self.half, self.longest, self.old = make, max(1, most // 2), longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Encoder:
    """Whole texts to ids.  Texts are cut at single spaces first, where a pre-token always begins;
    the units between are looked up whole, and split by the pattern only when they are new."""

    #: Below this, the pattern engine and the library agree on the class of every code point; above it
    #: their Unicode versions differ, so such units are split by the library's own pre-tokenizer.
    AGREED = "\u0530"

    def __init__(self, automaton: MergeAutomaton, value=None, most: int = 1_000_000, word_value=None):
        self.automaton = automaton
        self._find = regex.compile(SPLIT).findall
        self.gap = regex.compile(r"\s ")
        self.value = value or (lambda words: tuple(chain.from_iterable(words)))
        self.word_value = word_value or (lambda w: automaton.encode_word(w.encode()))
        self.words = _Kept(self.word_value, most // 4)
        self.spaced = _Kept(lambda u: self._unit(" " + u), most)
        self.plain = _Kept(self._unit, most // 20)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, automaton.special)) + ")").split if automaton.special else None
        self._library = None

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or max(text) < self.AGREED:
            return self._find(text)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False).pre_tokenize_str
        return [text[i:j] for _, (i, j) in self._library(text)]

    def _unit(self, unit: str):
        body = unit[1:]
        if unit[0] == " " and self._one_word(body):
            return self.value((self.word_value(unit),))
        return self.value(map(self._word, self.find(unit)))

    def _one_word(self, body: str) -> bool:
        return body.isalpha() and (body.isascii() or max(body) < self.AGREED)

    def _word(self, word: str):
        """A space-led word of letters is a unit itself and is kept once, among the units."""
        return self.spaced[word[1:]] if word[0] == " " and self._one_word(word[1:]) else self.words[word]

    def special_value(self, token: str):
        return self.value(((self.automaton.special[token],),))

    def pieces(self, text: str):
        """The cached values of a text's units, in order; a special token comes as its own unit."""
        if not text:
            return ()
        if self.cut and any(s in text for s in self.automaton.special):
            return self._with_special(text)
        return self._plain_pieces(text)

    def _with_special(self, text: str):
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                yield self.special_value(part)
            elif part:
                yield from self._plain_pieces(part)

    def _plain_pieces(self, text: str):
        if "  " in text or "\n " in text or not text.isascii() and self.gap.search(text) or any(c in text for c in self.BLANKS):
            return map(lambda w: self.value((self._word(w),)), self.find(text))
        first, *rest = text.split(" ")
        return chain((self.plain[first],) if first else (), map(self.spaced.__getitem__, rest))

    #: White space before a space joins it into one run, so such texts are split as a whole.
    BLANKS = [c + " " for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text or "")))


_built: dict[str, MergeAutomaton] = {}


def automaton_of(spec: dict, key: str) -> MergeAutomaton:
    """Each worker process compiles a vocabulary once."""
    if key not in _built:
        _built.clear()
        _built[key] = MergeAutomaton(spec["vocab"], spec["merges"], spec["special"])
    return _built[key]


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(shipped, kind: str, make=Encoder) -> Encoder:
    """A worker process keeps its encoder, and so its bounded caches, from task to task."""
    key = (shipped.key, kind)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = make(shipped.automaton())
    return _encoders[key]


class Shipped:
    """A vocabulary read on the driver and broadcast (its size is that of the file, a few MB)."""

    def __init__(self, spark, path: str):
        spec = read_spec(path)
        self.key = hashlib.sha256(repr((path, len(spec["vocab"]), len(spec["merges"]))).encode()).hexdigest()
        self.spec = spark.sparkContext.broadcast(spec)

    def automaton(self) -> MergeAutomaton:
        return automaton_of(self.spec.value, self.key)


def _batches(df: DataFrame, shipped: Shipped, columns: list[str], schema: str, rows):
    """rows(encoder, list of the second column) gives the further output columns of one Arrow batch."""

    def run(batches):
        state = worker_encoder(shipped, "ids")
        for batch in batches:
            yield pa.RecordBatch.from_pydict({columns[0]: batch.column(0)} | rows(state, batch.column(1).to_pylist()))

    return df.select(*columns).mapInArrow(run, f"{columns[0]} {df.schema[columns[0]].dataType.simpleString()}, {schema}")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of every whole text."""
    rows = lambda enc, texts: {"ids": pa.array([enc.ids(t) for t in texts], pa.list_(pa.int32()))}
    return _batches(df, Shipped(df.sparkSession, path), [id_col, text_col], "ids array<int>", rows)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the arc labels of the ids, joined; bytes that are no UTF-8 become U+FFFD; null ids: empty."""
    rows = lambda enc, ids: {"text": pa.array([enc.automaton.decode(x or ()) for x in ids], pa.string())}
    return _batches(df, Shipped(df.sparkSession, path), [id_col, ids_col], "text string", rows)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, so that ids need not travel; returns digests of both."""

    def rows(enc, texts):
        counts, ids_sha, text_sha = [], [], []
        digits = enc.automaton.digits.__getitem__
        for t in texts:
            ids = enc.ids(t)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(enc.automaton.decode(ids).encode()).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}

    return _batches(df, Shipped(df.sparkSession, path), [id_col, text_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
