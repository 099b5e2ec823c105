"""Language identification with a byte convolutional network.

Texts are read as UTF-8 bytes in windows of fixed length.  Filters of several widths slide over a
window (a filter's weights are one learned row per byte value and offset, that is, byte vectors and
filter in one table), each filter's largest response is kept, and a softmax gives the languages.
Training is Adam in numpy on windows of a bounded sample; prediction runs over batches of windows of
whole texts and averages their log odds, weighted by their bytes.

Texts that are null or have no letter are `und` with score 0.  With no labelled row at all, every
text is `und`.  Ties go to the first language in alphabetical order.  Texts of any length are read whole.
Repeated rows are read one by one and alike, an empty table gives an empty one, and further columns,
whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import sampled

WIDTHS = (2, 3, 4)


@dataclass
class Network:
    languages: list[str]
    window: int
    filters: list[np.ndarray]  # by width: (width, 256, number of filters)
    weights: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest responses of every filter in windows x (n, window), and where."""
        tops, ats = [], []
        for table in self.filters:
            n = x.shape[1] - len(table) + 1
            out = np.take(table[0], x[:, :n], axis=0)
            for j in range(1, len(table)):
                out += np.take(table[j], x[:, j : j + n], axis=0)
            if places:
                at = out.argmax(1)
                ats.append(at)
                tops.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
            else:
                tops.append(out.max(1))
        top = np.maximum(np.concatenate(tops, 1), 0)
        return (top, np.concatenate(ats, 1)) if places else top

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.weights + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(raw: bytes, size: int) -> np.ndarray:
    """All windows of a text, the last filled with zeros; every byte is in one."""
    data = np.frombuffer(raw, np.uint8)
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, size)


def train(texts: list[str], langs: list[str], window: int = 128, filters: int = 12, per_text: int = 6, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    xs, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        found = windows(text.encode(), window)
        keep = rng.permutation(len(found))[:per_text]
        xs.append(found[keep])
        ys += [languages.index(lang)] * len(keep)
        short = found[keep[:1], : window // 4]  # short texts are to be known too
        xs.append(np.pad(short, ((0, 0), (0, window - short.shape[1]))))
        ys += [languages.index(lang)]
    x, y = (np.concatenate(xs), np.array(ys)) if xs else (np.zeros((0, window), np.uint8), np.zeros(0, int))
    net = Network(languages, window, [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in WIDTHS], rng.normal(0, 0.1, (len(WIDTHS) * filters, max(1, len(languages)))).astype(np.float32), np.zeros(max(1, len(languages)), np.float32))
    params = [*net.filters, net.weights, net.bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            xb, yb = x[rows], y[rows]
            top, at = net.pooled(xb, places=True)
            z = top @ net.weights + net.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), yb] -= 1
            p /= len(rows)
            back = (p @ net.weights.T) * (top > 0)
            grads = []
            for k, table in enumerate(net.filters):
                grad = np.zeros_like(table)
                mine = slice(k * filters, (k + 1) * filters)
                for j in range(len(table)):
                    bytes_ = xb[np.arange(len(rows))[:, None], at[:, mine] + j]
                    np.add.at(grad[j], (bytes_, np.arange(filters)[None, :]), back[:, mine])
                grads.append(grad)
            grads += [top.T @ p, p.sum(0)]
            t += 1
            for param, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                param -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fit(documents: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1500, longest: int = 20_000, budget: int = 4_000_000, per_text: int = 6) -> Network:
    """Trains on a bounded sample of the rows that are allowed and have a language and a text: those of the smallest
    id hashes, at most `sample` of them, with texts of at most `longest` characters and `budget` characters together,
    and on at most `per_text` windows of each.  Equal rows count once.  Rows that are not allowed are never read."""
    usable = documents.where(allowed & F.col(lang_col).isNotNull() & (F.length(text_col) <= longest))
    hashed = usable.select(F.xxhash64(id_col).alias("_h"), F.xxhash64(text_col, lang_col).alias("_k"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    texts, langs = sampled(hashed, "_lang", sample, budget)
    return train(texts, langs, per_text=per_text)


_LETTER = regex.compile(r"\p{L}")


class _Reader:
    """Language and score of batches of texts; windows of many texts go through the network `at_once` at a time."""

    def __init__(self, net: Network, at_once: int = 128):
        self.net, self.at_once = net, at_once

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        net = self.net
        found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not net.languages:
            return found
        used = [(k, t.encode()) for k, t in enumerate(texts) if t and _LETTER.search(t)]
        pending, owners, held, sums = [], [], 0, np.zeros((len(texts), len(net.languages)))

        def go():
            x, who = np.concatenate(pending), np.concatenate(owners)
            weight = (x != 0).sum(1)
            for k in range(0, len(x), self.at_once):
                part = slice(k, k + self.at_once)
                np.add.at(sums, who[part], net.log_odds(x[part]) * weight[part, None])
            pending.clear(), owners.clear()

        for k, raw in used:
            pending.append(windows(raw, net.window))
            owners.append(np.full(len(pending[-1]), k))
            held += len(pending[-1])
            if held > 10_000:
                go()
                held = 0
        if pending:
            go()
        for k, raw in used:
            z = sums[k] / len(raw)
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            found[k] = (net.languages[best], float(p[best]))
        return found


def predict(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every whole text; ids of any type, null too, come back."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        reader = _Reader(shared.value)
        for batch in batches:
            found = reader(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep(df: DataFrame, net: Network, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of df whose language can be told with a score of `least` or more, with all their columns, in one map."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    at = df.columns.index(text_col)

    def run(batches):
        reader = _Reader(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in reader(batch.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)
