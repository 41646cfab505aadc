"""Regression trees on binned columns, grown level by level (numpy only: Python workers import this).

A tree follows from the rows in their order, the seed and the tree's number: its bag is drawn from (seed, tree) and the
features its nodes may split on from (seed, tree, level).  Nothing else is drawn, so a tree of depth d is the top of the
same tree grown deeper, and the first T trees of a forest are the forest of T trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: A level's cells (node x bin) up to which, for each row and in any case, they are counted in a table; beyond, keys are sorted.
CELLS_PER_ROW, LEAST_CELLS = 4, 1 << 16
#: Gains below this part of a node's squared error are rounding.
LEAST_GAIN = 1e-9


def subset_size(strategy: str, features: int, trees: int) -> int | None:
    """Features that a node may split on, by the names of ``pyspark.ml``; None for what is not named here."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    sizes = {"all": features, "onethird": math.ceil(features / 3), "sqrt": math.ceil(math.sqrt(features)),
             "log2": max(1, math.ceil(math.log2(max(features, 1))))}
    return sizes.get(strategy)


def cuts(values: np.ndarray, counts: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds of a feature from its distinct values, ascending, and how often each is there.

    Between all neighbours if they fit ``max_bins``, else as near to equal counts as the values allow.
    """
    most, between = min(max_bins, int(counts.sum())) - 1, (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between
    upto = np.cumsum(counts, dtype=np.float64)
    half, stride, at, found = (upto[:-1] + upto[1:]) / 2, upto[-1] / (most + 1), 0, []
    while (at := max(at, int(np.searchsorted(half, stride * (len(found) + 1), "right")))) < len(between):
        found.append(at)
        at += 1
    return between[found]


def binned(x: np.ndarray, thresholds: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The columns of ``x`` as bins: ``x <= thresholds[b]`` is ``bin <= b``."""
    return [np.searchsorted(t, x[:, f], "left").astype(bin_type(t)) for f, t in enumerate(thresholds)]


def bin_type(thresholds: np.ndarray) -> type:
    return np.uint8 if len(thresholds) < 256 else np.uint16 if len(thresholds) < 65536 else np.uint32


@dataclass
class Level:
    """The nodes of one level; ``feature`` is -1 at leaves.  Rows with ``bin <= cut`` go to node ``child`` of the next level, others to the one after."""
    value: np.ndarray
    rows: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    gain: np.ndarray

    def down(self, columns: Sequence[np.ndarray], rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The node of the next level for each of ``rows``, -1 below a leaf."""
        by, to = self.feature[node], self.child[node]
        for f in np.unique(self.feature[self.feature >= 0]):
            i = np.flatnonzero(by == f)
            to[i] += columns[f][rows[i]] > self.cut[node[i]]
        return to


def _cells(node, column, bins, rows, w, wy, nodes):
    """(key, weight, weighted sum) of each (node, bin) that holds rows, by key = node * bins + bin."""
    key = node * np.int64(bins) + column[rows]
    if nodes * bins <= max(CELLS_PER_ROW * len(rows), LEAST_CELLS):
        count, total = np.bincount(key, w, nodes * bins), np.bincount(key, wy, nodes * bins)
        key = np.flatnonzero(count)
        return key, count[key], total[key]
    shift = np.int64(len(rows)).item().bit_length()
    both = np.sort((key << shift) | np.arange(len(rows)))  # equal keys by position, so sums are the same anywhere
    key, at = both >> shift, both & ((1 << shift) - 1)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(w[at], first), np.add.reduceat(wy[at], first)


def bag(n: int, seed: int, tree: int, bootstrap: bool = True, rate: float = 1.0) -> np.ndarray:
    """How often each of ``n`` rows is in the tree's bag."""
    draw = np.random.default_rng([seed & (2 ** 64 - 1), tree])
    if bootstrap:
        return np.concatenate([draw.poisson(rate, min(1 << 18, n - i)).astype(np.uint16) for i in range(0, n, 1 << 18)] or [np.zeros(0, np.uint16)])
    return np.ones(n, np.uint16) if rate >= 1 else (draw.random(n) < rate).astype(np.uint16)


def grow(columns: Sequence[np.ndarray], bins: Sequence[int], y: np.ndarray, depth: int, subset: int, seed: int,
         tree: int, bootstrap: bool = True, rate: float = 1.0) -> Iterator[Level]:
    """One tree by the largest decrease of variance, at most ``depth`` levels below the root."""
    d, w = len(columns), bag(len(y), seed, tree, bootstrap, rate)
    rows = np.flatnonzero(w).astype(np.int32 if len(w) < 2 ** 31 else np.int64)
    w, node, nodes = w[rows].astype(np.float64), np.zeros(len(rows), np.int64), 1
    for level in range(depth + 1):
        own = y[rows]
        wy = w * own
        count, total, square = (np.bincount(node, x, nodes) for x in (w, wy, wy * own))
        value = np.divide(total, count, out=np.zeros(nodes), where=count > 0)
        base = total * value
        error = square - base
        out = Level(value, count, np.full(nodes, -1, np.int16), np.zeros(nodes, np.int64), np.full(nodes, -1, np.int64), np.zeros(nodes))
        wide = np.flatnonzero((error > 1e-12 * square) & (count > 1)) if level < depth else np.zeros(0, np.int64)
        if not len(wide):
            yield out
            return
        # from here nodes are numbered among those that may split
        number = np.full(nodes, -1, np.int64)
        number[wide] = np.arange(len(wide))
        node = number[node]
        i = np.flatnonzero(node >= 0)
        rows, node, w, wy = rows[i], node[i], w[i], wy[i]
        may = None
        if subset < d:
            draw = np.random.default_rng([seed & (2 ** 64 - 1), tree, level + 1])  # with 0 for level it would be the bag's
            may = np.zeros((d, len(wide)), bool)
            may[draw.random((len(wide), d), np.float32).argpartition(subset - 1, 1)[:, :subset].T, np.arange(len(wide))] = True
        count, total, base, error = count[wide], total[wide], base[wide], error[wide]
        best, feature, cut = base + LEAST_GAIN * error, np.full(len(wide), -1, np.int16), np.zeros(len(wide), np.int64)
        for f in range(d):
            if bins[f] < 2:
                continue
            some = np.arange(len(wide)) if may is None else np.flatnonzero(may[f])
            if not len(some):
                continue
            if len(some) == len(wide):
                key, c, s = _cells(node, columns[f], bins[f], rows, w, wy, len(some))
            else:
                number = np.cumsum(may[f]) - 1
                i = np.flatnonzero(may[f][node])
                key, c, s = _cells(number[node[i]], columns[f], bins[f], rows[i], w[i], wy[i], len(some))
            of = key // bins[f]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            last = np.concatenate((first[1:], [len(of)])) - 1
            c, s = np.cumsum(c), np.cumsum(s)
            left, left_sum = c - np.concatenate(([0.0], c[last[:-1]]))[of], s - np.concatenate(([0.0], s[last[:-1]]))[of]
            right, right_sum = count[some][of] - left, total[some][of] - left_sum
            right[last] = 1.0
            score = left_sum * left_sum / left + right_sum * right_sum / right
            score[last] = -np.inf
            top = np.maximum.reduceat(score, first)
            better = np.flatnonzero(top > best[some])
            if not len(better):
                continue
            hit = np.flatnonzero(score == top[of])[::-1]
            first[of[hit]] = hit  # the lowest of equal ones stays
            best[some[better]], feature[some[better]] = top[better], f
            cut[some[better]] = key[first[better]] % bins[f]
        split = np.flatnonzero(feature >= 0)
        out.feature[wide], out.cut[wide] = feature, cut
        out.child[wide[split]] = 2 * np.arange(len(split))
        out.gain[wide[split]] = (best - base)[split] / count[split]
        yield out
        if not len(split):
            return
        node = out.down(columns, rows, wide[node])
        i = np.flatnonzero(node >= 0)
        rows, node, w, nodes = rows[i], node[i], w[i], 2 * len(split)


def score(levels: Iterator[Level], columns: Sequence[np.ndarray], n: int, depths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, prediction of ``n`` rows) for each of ``depths``, ascending; the arrays are used again."""
    value, rows, node, todo = np.zeros(n), np.arange(n), np.zeros(n, np.int64), sorted(set(depths))
    for at, level in enumerate(levels):
        value[rows] = level.value[node]
        if todo and at == todo[0]:
            yield todo.pop(0), value
        node = level.down(columns, rows, node)
        i = np.flatnonzero(node >= 0)
        rows, node = rows[i], node[i]
    for depth in todo:
        yield depth, value
