"""Decision trees of many weightings and settings at once, grown level by level from class counts in bins.

One pass over the units counts, for every node of a level, the classes by feature and bin; the driver sees only these
counts and chooses the splits.  Trees of all settings of a weighting share the counts of nodes that hold the same rows, and
smaller depths and stronger pruning are read off the tree of the largest depth, so 120 settings cost ten trees at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .refit import Weightings
from .resample import _matrix, _sliced

#: Depths, least units of a leaf, and costs of complexity that are tried.
DEPTHS = (1, 2, 3, 4)
LEAVES = (3, 4, 5, 6, 8)
ALPHAS = (0.0, 0.005, 0.01)
#: Cuts of a feature among which splits are looked for.
BINS = 64

#: A node is the way to it: (feature, cut, right) of every split above.
Path = tuple[tuple[int, int, bool], ...]


@dataclass
class Tree:
    """Class counts of every node, and the splits of the inner ones."""

    balanced: bool
    nodes: dict[Path, tuple[float, float]] = field(default_factory=dict)
    splits: dict[Path, tuple[int, int]] = field(default_factory=dict)

    def children(self, path: Path) -> tuple[Path, Path]:
        f, cut = self.splits[path]
        return (*path, (f, cut, False)), (*path, (f, cut, True))

    def leaves(self) -> list[Path]:
        return [p for p in self.nodes if p not in self.splits]

    def class_weights(self) -> np.ndarray:
        n = np.array(self.nodes[()], float)
        return n.sum() / (2 * n) if self.balanced else np.ones(2)

    def probability(self, path: Path) -> float:
        n = np.array(self.nodes[path]) * self.class_weights()
        return float(n[1] / n.sum())

    def pruned(self, depth: int, alpha: float) -> Tree:
        """The tree cut at ``depth``, less the branches that lower the weighted impurity by no more than ``alpha`` a leaf."""
        out = Tree(self.balanced, {p: n for p, n in self.nodes.items() if len(p) <= depth}, {p: s for p, s in self.splits.items() if len(p) < depth})
        w0, w1 = self.class_weights().tolist()
        total = self.nodes[()][0] * w0 + self.nodes[()][1] * w1

        def risk(path: Path) -> float:
            a, b = out.nodes[path][0] * w0, out.nodes[path][1] * w1
            return 2 * a * b / (a + b) / total

        def branch(path: Path, told: dict) -> tuple[float, int]:
            if path not in out.splits:
                return risk(path), 1
            (a, m), (b, n) = (branch(c, told) for c in out.children(path))
            told[path] = (risk(path) - a - b) / (m + n - 1)
            return a + b, m + n

        while alpha > 0 and out.splits:
            gains: dict[Path, float] = {}
            branch((), gains)
            weakest = min(gains, key=lambda p: (gains[p], len(p), p))
            if gains[weakest] > alpha:
                break
            below = [p for p in out.nodes if len(p) > len(weakest) and p[: len(weakest)] == weakest]
            out.nodes = {p: n for p, n in out.nodes.items() if p not in below}
            out.splits = {p: s for p, s in out.splits.items() if p != weakest and p not in below}
        return out

    def stop(self, path: Path) -> Path:
        """The leaf of this tree that a leaf of the whole tree falls into."""
        return next(path[:k] for k in range(len(path) + 1) if path[:k] not in self.splits)

    def score(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for p in self.leaves():
            out[rows_of(p, x, edges)] = self.probability(p)
        return out


def pruned_trees(grown: dict[tuple[int, bool], Tree], tried: dict[int, dict]) -> dict[int, Tree]:
    """The tree of every setting; equal trees are pruned once."""
    done: dict[tuple, Tree] = {}
    out = {}
    for i, s in tried.items():
        tree = grown[s["leaf"], s["balanced"]]
        key = (frozenset(tree.splits.items()), s["balanced"], s["depth"], s["alpha"])
        if key not in done:
            done[key] = tree.pruned(s["depth"], s["alpha"])
        out[i] = done[key]
    return out


def rows_of(path: Path, x: np.ndarray, edges: np.ndarray, memo: dict | None = None) -> np.ndarray:
    """Rows that reach a node: at most an edge goes left, above it right."""
    if memo is not None and path in memo:
        return memo[path]
    if not path:
        found = np.arange(len(x))
    else:
        f, cut, right = path[-1]
        above = rows_of(path[:-1], x, edges, memo)
        found = above[(x[above, f] > edges[f][cut]) == right]
    if memo is not None:
        memo[path] = found
    return found


def bin_edges(w: Weightings, bins: int = BINS) -> np.ndarray:
    """Quantiles of each standardised feature under the first weighting that has a fit: (feature, cut), rising.

    A quantile is a unit's value; a cut lies a trifle above it, so that rounding does not send that unit the other way.
    """
    turn, names = w.turn[w.fitted()[0]], [f"f_{i}" for i in range(len(w.features))]

    def features(batches):
        for batch in _sliced(batches):
            x = _matrix(batch, "x") @ turn
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], names=names)

    rows = w.units.select("x").mapInArrow(features, ", ".join(f"{c} double" for c in names))
    found = rows.agg(*[F.percentile_approx(c, F.array(*[F.lit(i / bins) for i in range(1, bins)]), 10_000).alias(c) for c in names]).first()
    return np.array([found[c] for c in names], float) + 1e-9


def best_split(counts: np.ndarray, weights: np.ndarray, least: int) -> tuple[int, int] | None:
    """Feature and cut of the lowest weighted Gini impurity with ``least`` units on each side; of equals, the first.

    ``counts`` is (feature, bin, class); a pure or small node has none.
    """
    total = counts[0].sum(axis=0)
    if not total.all() or total.sum() < 2 * least:
        return None
    left = counts[:, :-1].cumsum(axis=1)
    right = total - left
    fine = (left.sum(axis=-1) >= least) & (right.sum(axis=-1) >= least)
    if not fine.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = sum(((s * weights) ** 2).sum(axis=-1) / (s * weights).sum(axis=-1) for s in (left, right))
    worth = np.where(fine, np.round(worth, 9), -np.inf)
    return tuple(int(v) for v in np.unravel_index(worth.argmax(), worth.shape))


def grow(w: Weightings, edges: np.ndarray, kinds: list[tuple[int, bool]], depth: int = max(DEPTHS), ids: np.ndarray | None = None) -> dict[int, dict[tuple[int, bool], Tree]]:
    """Trees of every weighting for each kind (least units of a leaf, balanced), to ``depth``: one pass over the units a level."""
    ids = w.fitted() if ids is None else ids
    shape = (edges.shape[0], edges.shape[1] + 1, 2)
    trees = {int(k): {kind: Tree(kind[1]) for kind in kinds} for k in ids}
    frontier: dict[int, list[Path]] = {int(k): [()] for k in ids}
    for level in range(depth):

        def count(k, x, y, weight, role, frontier=frontier):
            binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
            memo: dict = {}
            out = np.zeros((len(frontier[k]), *shape))
            for i, path in enumerate(frontier[k]):
                rows = rows_of(path, x, edges, memo)
                rows = rows[weight[rows] > 0]
                for f in range(shape[0]):
                    out[i, f] = np.bincount(2 * binned[f, rows] + y[rows], weight[rows], 2 * shape[1]).reshape(shape[1:])
            return out.ravel()

        todo = np.array([k for k, paths in frontier.items() if paths], np.int64)
        if not len(todo):
            break
        after: dict[int, list[Path]] = {k: [] for k in frontier}
        for k, v in w.summed(count, todo).items():
            counts = dict(zip(frontier[k], v.reshape(-1, *shape), strict=True))
            for (least, _), tree in trees[k].items():
                open_ = [()] if not level else [c for p in tree.splits if len(p) == level - 1 for c in tree.children(p)]
                for path in open_:
                    total = counts[path][0].sum(axis=0)
                    tree.nodes.setdefault(path, tuple(total.tolist()))
                    split = best_split(counts[path], tree.class_weights(), least)
                    if split:
                        tree.splits[path] = split
                        left = counts[path][split[0], : split[1] + 1].sum(axis=0)
                        for child, n in zip(tree.children(path), (left, total - left), strict=True):
                            tree.nodes[child] = tuple(n.tolist())
                            after[k] += [child] * (child not in after[k])
        frontier = after
    return trees


def leaf_counts(w: Weightings, edges: np.ndarray, trees: dict[int, dict[tuple, Tree]]) -> dict[int, tuple[list[Path], np.ndarray]]:
    """For every weighting: its trees' leaves, and the classes of the units held out, (leaf, role 1 or 2, class)."""
    leaves = {k: sorted({p for t in own.values() for p in t.leaves()}) for k, own in trees.items()}

    def count(k, x, y, weight, role):
        memo: dict = {}
        out = np.zeros((len(leaves[k]), 2, 2))
        for i, path in enumerate(leaves[k]):
            rows = rows_of(path, x, edges, memo)
            rows = rows[role[rows] > 0]
            out[i] = np.bincount(2 * (role[rows] - 1) + y[rows], minlength=4).reshape(2, 2)
        return out.ravel()

    found = w.summed(count, np.array(list(trees), np.int64))
    return {k: (leaves[k], v.reshape(-1, 2, 2)) for k, v in found.items()}
