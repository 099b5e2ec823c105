"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, word pairs and character n-grams, hashed
into `buckets`; a softmax on the average gives the classes.  Vectors and softmax are trained with
plain stochastic gradient descent in numpy, on the driver, over a bounded sample of labelled rows.
A pair of equal words shares one bucket, so that repetition itself can be learned.

Scoring is one map over whole texts: as the softmax is linear, each bucket shrinks to one number,
a word to the sum of its buckets, and a worker keeps the words it has met in a bounded cache.
Null and empty texts, and texts of white space, have no features and get the prior's score.  Texts of any
length are scored whole, 64 at a time.  Repeated rows are scored one by one and alike, an empty table gives an
empty one, and further columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """Per bucket: by how much it speaks for class 1, if it were alone."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket 1 .. buckets-1 of a hash; 0 is kept for repetition."""
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return ((h >> np.uint64(11)) % np.uint64(buckets - 1) + np.uint64(1)).astype(np.int64)


def word_features(words: list[str], buckets: int, shortest: int = 3, longest: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, and all their buckets as (number of the word, bucket): each word itself and its
    character n-grams, with its edges marked."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, found = [np.arange(len(words))], [_bucket(hashes, buckets)]
    rolled = chars * _MIX
    for n in range(2, longest + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :] * _MIX
        if n >= shortest:
            within = owner[: len(rolled)] == owner[n - 1 :]
            owners.append(owner[: len(rolled)][within])
            found.append(_bucket(rolled[within] + np.uint64(n), buckets))
    return hashes, np.concatenate(owners), np.concatenate(found)


def pair_features(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of neighbouring words; 0 for a word that follows itself."""
    a, b = hashes[:-1], hashes[1:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    return np.where(a == b, 0, (mixed >> np.uint64(11)) % np.uint64(buckets - 1) + np.uint64(1)).astype(np.int64)


class _Words:
    """Hash, sum of margins and number of buckets of every word met; at `most` words or `chars` characters it
    starts anew, so texts without spaces, whose words are whole paragraphs, don't fill the memory either."""

    def __init__(self, margins: np.ndarray, most: int = 400_000, chars: int = 8_000_000):
        self.margins, self.most, self.chars = margins, most, chars
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.hashes, self.sums, self.counts = np.zeros(1024, np.uint64), np.zeros(1024), np.zeros(1024)

    def add(self, words: list[str]) -> None:
        k, n = len(self.place), len(words)
        while k + n > len(self.sums):
            self.hashes, self.sums, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.sums, self.counts))
        self.hashes[k : k + n], owner, found = word_features(words, len(self.margins))
        self.sums[k : k + n] = np.bincount(owner, self.margins[found], n)
        self.counts[k : k + n] = np.bincount(owner, minlength=n)
        self.place.update(zip(words, range(k, k + n)))
        self.held += sum(map(len, words))

    def means(self, texts: list[str]) -> np.ndarray:
        """The mean margin over every text's features; 0 for a text without words."""
        split = [t.split() for t in texts]
        words = [w for ws in split for w in ws]
        if not words:
            return np.zeros(len(texts))
        if len(self.place) > self.most or self.held > self.chars:
            self.reset()
        place = self.place
        if new := [w for w in dict.fromkeys(words) if w not in place]:
            self.add(new)
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        inside = owner[1:] == owner[:-1]
        pairs = self.margins[pair_features(self.hashes[at], len(self.margins))][inside]
        sums = np.bincount(owner, self.sums[at], len(texts)) + np.bincount(owner[1:][inside], pairs, len(texts))
        counts = np.bincount(owner, self.counts[at], len(texts)) + np.bincount(owner[1:][inside], minlength=len(texts))
        return sums / np.maximum(counts, 1)


def _vocabulary(words: list[str], buckets: int, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, and their buckets one word after the other: word k has those from first[k] to first[k + 1]."""
    hashes, sizes, found = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for k in range(0, len(words), at_once):
        h, owner, ids = word_features(words[k : k + at_once], buckets)
        hashes.append(h)
        sizes.append(np.bincount(owner, minlength=len(h)))
        found.append(ids[np.argsort(owner, kind="stable")].astype(np.int32))
    return np.concatenate(hashes), np.concatenate(sizes).cumsum(), np.concatenate(found)


def _shares(at: np.ndarray, hashes: np.ndarray, first: np.ndarray, grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct buckets and the share of its features in each, in four bytes each."""
    words, times = np.unique(at, return_counts=True)
    sizes = first[words + 1] - first[words]
    ends = sizes.cumsum()
    own = grams[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[words] - ends + sizes, sizes)]
    pairs = pair_features(hashes[at], buckets).astype(np.int32) if len(at) > 1 else np.zeros(0, np.int32)
    where, back = np.unique(np.concatenate([own, pairs]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([np.repeat(times, sizes), np.ones(len(pairs))]), len(where))
    return where, (counts / max(1.0, counts.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 4, rate: float = 0.4, seed: int = 11) -> Model:
    """The bias is the labels' log odds and stays: a text that says nothing gets the prior."""
    rng = np.random.default_rng(seed)
    share1 = (sum(labels) + 1) / (len(labels) + 2)
    model = Model(rng.uniform(-1 / dim, 1 / dim, (buckets, dim)), np.zeros((dim, 2)), np.log([1 - share1, share1]))
    number: dict[str, int] = {}
    split = [np.fromiter((number.setdefault(w, len(number)) for w in t.split()), np.int32) for t in texts]
    hashes, first, grams = _vocabulary(list(number), buckets)
    docs = [_shares(at, hashes, first, grams, buckets) for at in split]
    del number, split, hashes, first, grams
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            where, share = docs[k]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ model.vectors[where]
            z = mean @ model.weights + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = model.weights @ p
            model.weights -= lr * np.outer(mean, p)
            model.vectors[where] -= lr * len(where) ** 0.5 * share[:, None] * back
    return model


def fit(documents: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000, longest: int = 50_000, budget: int = 4_000_000) -> Model:
    """Trains on a bounded sample of the labelled rows that are allowed: those of the smallest id hashes, at most
    `sample` of them, with texts of at most `longest` characters and `budget` characters together, so the driver's
    memory is bounded too.  Equal rows count once; rows that share an id but not a text or label are rows of their
    own.  Labels of other rows are never read into the model.  Without any row the model gives the prior 0.5."""
    marked = labels.where(allowed & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label"))
    first = marked.distinct().orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample)  # bounded by `sample`
    short = documents.where(F.length(text_col) <= longest).select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    rows = short.join(F.broadcast(first), "_key").select(F.xxhash64("_key").alias("_h"), F.xxhash64("_text", "_label").alias("_k"), "_text", "_label")
    return train(*sampled(rows, "_label", sample, budget))


def sampled(rows: DataFrame, label_col: str, sample: int, budget: int) -> tuple[list[str], list]:
    """Texts and labels of the first rows by (_h, _k), up to `sample` rows and `budget` characters; sizes are
    collected first, so no more text than that reaches the driver."""
    sizes = rows.select("_h", "_k", F.length("_text").alias("n")).distinct().orderBy("_h", "_k").limit(sample).collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > budget and last is not None:
            break
        last = r
    if last is None:
        return [], []
    inside = (F.col("_h") < last["_h"]) | ((F.col("_h") == last["_h"]) & (F.col("_k") <= last["_k"]))
    found = rows.where(inside).dropDuplicates(["_h", "_k"]).select("_h", "_k", "_text", label_col).collect()
    found.sort(key=lambda r: (r["_h"], r["_k"]))
    return [r["_text"] for r in found], [r[label_col] for r in found]


class _Scorer:
    """Scores of batches of texts; words stay in the cache from batch to batch."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.words, self.bias = _Words(margins), bias

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        whole = [t or "" for t in texts]
        z = np.concatenate([self.words.means(whole[k : k + 64]) for k in range(0, len(whole), 64)] or [np.zeros(0)])
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -50, 50)))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score): the probability of class 1 for every whole text; ids of any type, null too, come back."""
    shared = df.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0])))

    def run(batches):
        scorer = _Scorer(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "score": pa.array(scorer(batch.column(1).to_pylist()), pa.float64())})

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double")


def keep(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df that score `least` or more, with all their columns, in one map: no row is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0])))
    at = df.columns.index(text_col)

    def run(batches):
        scorer = _Scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at).to_pylist()) >= least, pa.bool_()))

    return df.mapInArrow(run, df.schema)
