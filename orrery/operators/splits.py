"""Histograms and split search on arrays: one implementation for the boosting loop and for the queries that check it.

A histogram has the sums of gradients and hessians and the row counts of a node by [feature, bin]; the last bin holds
missing values.  Rows go left whose bin is at most the threshold; direction 0 sends missing values left too."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_child_weight: float = 1.0
    min_child_samples: int = 1
    adaptive: bool = False
    adaptive_alpha: float = 0.5
    adaptive_mu: float = 1.0
    progress: float = 0.0  # rounds done by rounds wanted
    monotone: tuple[tuple[int, int], ...] = ()
    era_beta: float = 0.0


def score(g, h, rule: Rule, lam=None):
    return np.maximum(np.abs(g) - rule.reg_alpha, 0) ** 2 / np.maximum(h + (rule.reg_lambda if lam is None else lam), 1e-12)


def leaf_value(g, h, rule: Rule):
    return np.where(np.abs(g) <= rule.reg_alpha, 0.0, -(g - np.sign(g) * rule.reg_alpha) / np.maximum(h + rule.reg_lambda, 1e-12))


def child_lambda(n, rule: Rule):
    """Adaptive regularization: stronger late and in small children."""
    if not rule.adaptive:
        return rule.reg_lambda
    return rule.reg_lambda * (1 + rule.adaptive_alpha * rule.progress) + rule.adaptive_mu / np.sqrt(np.maximum(n, 1))


def candidates(hist, rule: Rule, features=None, penalty=None):
    """(gain, g, h, c) of every split as arrays [feature, direction, bin]; the sums are those of the left side and the
    gain of a split that is not allowed is -inf."""
    G, H, C = hist[:3]
    last = G.shape[1] - 1
    left = []
    for x in (G, H, C):
        run = np.cumsum(x[:, :last], 1)
        left.append(np.stack([run + x[:, last:], run], 1))
    g, h, c = left
    gt, ht, ct = G[0].sum(), H[0].sum(), C[0].sum()
    gain = 0.5 * (score(g, h, rule, child_lambda(c, rule)) + score(gt - g, ht - h, rule, child_lambda(ct - c, rule)) - score(gt, ht, rule))
    least = max(1, rule.min_child_samples)
    ok = (h >= rule.min_child_weight) & (ht - h >= rule.min_child_weight) & (c >= least) & (ct - c >= least)
    for f, sign in rule.monotone:
        ok[f] &= sign * (leaf_value(gt - g[f], ht - h[f], rule) - leaf_value(g[f], h[f], rule)) >= 0
    if penalty is not None:
        gain = gain - rule.era_beta * penalty
    if features is not None:
        chosen = np.zeros(len(G), bool)
        chosen[list(features)] = True
        ok &= chosen[:, None, None]
    return np.where(ok, gain, -np.inf), g, h, c


def rounded(gain):
    """Gains to 12 digits, so that sums made in another order tie alike."""
    with np.errstate(all="ignore"):
        unit = 10.0 ** (np.floor(np.log10(np.abs(gain))) - 11)
        return np.where(np.isfinite(gain) & (gain != 0), np.round(gain / unit) * unit, gain)


def best(gain):
    """(feature, direction, bin) of the largest gain above zero, else None; ties go to the smaller feature, direction and bin."""
    flat = rounded(gain).ravel()
    at = int(flat.argmax())
    if not np.isfinite(flat[at]) or flat[at] <= 1e-12:
        return None
    return tuple(int(k) for k in np.unravel_index(at, gain.shape))


class Nodes:
    """A tree as arrays, to send rows down by their bins."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]], missing: int):
        """rows: (feature or -1, bin, direction, left, right) by node."""
        self.feature, self.bin, self.direction, self.left, self.right = (np.array(x) for x in zip(*rows, strict=True))
        self.missing = missing

    def reach(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            node = at[live]
            b = bins[live, self.feature[node]]
            go = np.where(b == self.missing, self.direction[node] == 0, b <= self.bin[node])
            at[live] = np.where(go, self.left[node], self.right[node])
            live = live[self.feature[at[live]] >= 0]
        return at


class Sums:
    """Histograms of several nodes, filled batch by batch."""

    def __init__(self, wanted: list[int], features: int, width: int, nodes: int):
        self.wanted, self.features, self.width = wanted, features, width
        self.slot = np.full(nodes, -1)
        self.slot[wanted] = np.arange(len(wanted))
        self.arrays = [np.zeros(len(wanted) * features * width) for _ in range(3)]

    def add(self, at: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        slot = self.slot[at]
        mine = slot >= 0
        if not mine.all():
            slot, bins, g, h = slot[mine], bins[mine], g[mine], h[mine]
        if not len(slot):
            return
        n = self.features * self.width
        for first in range(0, len(slot), 65_536):
            part = slice(first, first + 65_536)
            cell = (slot[part, None] * n + np.arange(self.features) * self.width + bins[part]).ravel()
            counts = np.bincount(cell, minlength=len(self.arrays[2]))
            self.arrays[2] += counts
            self.arrays[0] += np.bincount(cell, np.repeat(g[part], self.features), len(counts))
            self.arrays[1] += counts if (h[part] == 1).all() else np.bincount(cell, np.repeat(h[part], self.features), len(counts))

    def by_node(self) -> dict[int, tuple]:
        shape = (len(self.wanted), self.features, self.width)
        g, h, c = (x.reshape(shape) for x in self.arrays)
        return {node: (g[k], h[k], c[k]) for k, node in enumerate(self.wanted)}
