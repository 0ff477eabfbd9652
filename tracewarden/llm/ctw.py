"""The context-tree weighting model over sorted tables of byte strings: training, weights and predictions, for numpy arrays.

A symbol (a byte of the text, or END after it) is coded as eight binary decisions, most significant bit first. Each of the 255 decisions has a context tree of its own, whose
depth-d nodes are the last d bytes. A node mixes, half and half before any data, its Krichevsky-Trofimov estimate with the product of its children; after training
the weight is the share of the estimate in that mixture, so a prediction mixes the estimates of all depths of the path. A context that training never reached predicts as its parent does.

A gram is a number with the bytes c1 .. cD, x from the top: c1 is the byte just before x.
"""

from __future__ import annotations

import numpy as np

#: Bytes that UTF-8 never has: before the text, and after it.
START, END = 0xFE, 0xFF
LOG_PI = float(np.log(np.pi))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5: Stirling's series after a shift by four."""
    y = x + 4.0
    z = 1.0 / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(x * (x + 1) * (x + 2) * (x + 3))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - LOG_PI


def grams(text: bytes, depth: int) -> np.ndarray:
    """The gram of each symbol of the text and of its end."""
    raw = np.frombuffer(bytes([START]) * depth + text + bytes([END]), dtype=np.uint8)
    n = len(text) + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(1, depth + 1):
        out = (out << np.uint64(8)) | raw[depth - k : depth - k + n]
    return (out << np.uint64(8)) | raw[depth:]


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = runs(keys)
    return (keys[begin], *[np.add.reduceat(v[order], begin) for v in values])


class Level:
    """The nodes of one depth: key (context above, decision node below), counts of zeros and ones, log of the estimate and of the mixture."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: distinct (context, symbol), in order."""
        nodes, zeros, ones = [], [], []
        context, symbol = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64)
        for j in range(8):
            node = (context << np.uint64(8)) | ((1 << j) | (symbol >> (8 - j))).astype(np.uint64)
            bit = symbol >> (7 - j) & 1
            begin = runs(node)
            nodes.append(node[begin])
            zeros.append(np.add.reduceat(counts * (1 - bit), begin))
            ones.append(np.add.reduceat(counts * bit, begin))
        node = np.concatenate(nodes)
        order = np.argsort(node)
        self.node, self.zeros, self.ones = node[order], np.concatenate(zeros)[order].astype(float), np.concatenate(ones)[order].astype(float)
        self.estimate = log_kt(self.zeros, self.ones)
        self.mixture = self.estimate

    @classmethod
    def of_counts(cls, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> Level:
        out = cls.__new__(cls)
        out.node, out.zeros, out.ones = node, zeros, ones
        out.estimate = out.mixture = log_kt(zeros, ones)
        return out

    def weigh(self, children: np.ndarray) -> None:
        """children: log of the product of the children's mixtures, for each node."""
        self.children = children
        self.mixture = np.logaddexp(self.estimate, children) - np.log(2.0)

    def own(self) -> np.ndarray:
        """The weight of the node's own estimate; 1 at the greatest depth."""
        return 1.0 / (1.0 + np.exp(np.clip(self.children - self.estimate, -700, 700))) if hasattr(self, "children") else np.ones(len(self.node))


def parents(level: Level) -> tuple[np.ndarray, ...]:
    """The keys of the level's parents (without the oldest byte), in order, and sums over their children: log mixtures, zeros, ones."""
    parent = (level.node >> np.uint64(16) << np.uint64(8)) | (level.node & np.uint64(255))
    return summed(parent, level.mixture, level.zeros, level.ones)


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[Level]:
    """The levels from least to depth, weighted from below. keys: distinct trained grams of that depth."""
    tables = {depth: (keys, counts)}
    for d in range(depth - 1, least - 1, -1):
        k, c = tables[d + 1]
        tables[d] = summed((k >> np.uint64(16) << np.uint64(8)) | (k & np.uint64(255)), c)
    out = {d: Level(*tables[d]) for d in tables}
    for d in range(depth - 1, least - 1, -1):
        keys_up, total, _, _ = parents(out[d + 1])
        assert len(keys_up) == len(out[d].node)
        out[d].weigh(total)
    return [out[d] for d in sorted(out)]


class Weights:
    """What predictions need of a level: node keys, the chance of a one, the own weight."""

    def __init__(self, node: np.ndarray, chance: np.ndarray, own: np.ndarray):
        self.node, self.chance, self.own = node, chance, own

    @classmethod
    def of(cls, level: Level) -> Weights:
        return cls(level.node, (level.ones + 0.5) / (level.zeros + level.ones + 1.0), level.own())

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.node):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.node, keys), len(self.node) - 1)
        return at, self.node[at] == keys


def log2_chances(keys: np.ndarray, depth: int, weights: list[Weights]) -> np.ndarray:
    """log2 of the chance of each gram's symbol after its context. keys: distinct grams in order; weights: of depths 0 to depth."""
    total = np.zeros(len(keys))
    symbol = (keys & np.uint64(255)).astype(np.int64)
    context = keys >> np.uint64(8)
    for j in range(8):
        # Grams that share context and decision node share predictions.
        node = (context << np.uint64(8)) | ((1 << j) | (symbol >> (8 - j))).astype(np.uint64)
        begin = runs(node)
        size = np.diff(np.append(begin, len(node)))
        # From the root down; a node keeps its own share of what is left and hands on the rest.
        left, mixed = np.ones(len(begin)), np.zeros(len(begin))  # the chance not yet given away, and what it was given to
        alive = np.ones(len(begin), dtype=bool)
        c, decision = context[begin], (node[begin] & np.uint64(255))
        last = np.full(len(begin), 0.5)
        for d, w in enumerate(weights):
            key = (c >> np.uint64(8 * (depth - d)) << np.uint64(8)) | decision
            at, there = w.find(key)
            alive &= there
            own = np.where(alive, w.own[at] if len(w.node) else 0.0, 0.0)
            chance = w.chance[at] if len(w.node) else last
            mixed += left * own * chance
            left *= 1 - own
            last = np.where(alive, chance, last)
        one = mixed + left * last  # what is left belongs to contexts never reached
        bit = symbol >> (7 - j) & 1
        p = np.repeat(one, size)
        total += np.log2(np.where(bit == 1, p, 1 - p))
    return total
