"""Preparations and features fitted anew under many weightings of the same units: folds left out, bootstrap replicates.

A balance is linear in the logs of a unit's parts, and a filled or replaced cell adds the log of its replacement.  So a unit
is summed once: for each level of the group, its observed logs, missing cells and zero cells.  What a weighting fits
(medians by level with the global one where a level has too few values, zero replacements, the features' means and
deviations) becomes one small matrix, and a task turns its block of units into features by a product.  No point is copied
by weighting; what leaves a task has the size of the sums of each weighting.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import CHUNK, REACH, Poisson, _matrix, _sliced, _vector, folded, replicate_medians, replicate_sums, word

#: A level with fewer values of a part is filled with the median of all levels.
MIN_OBS = 5
#: Levels of the group of medians; their number is checked, because each has parameters of its own.
MOST_LEVELS = 64


class Drawn(Poisson):
    """Bootstrap of all units together: each is drawn Poisson(1) times; nothing is held out."""

    def __init__(self):
        super().__init__(1)

    def roles(self, a, b, ids):
        (_, _, weights), = self(np.zeros(len(a), np.int64), a, b, ids)
        return weights, np.zeros(weights.shape, np.int8)


class FoldsOut:
    """Every pair of folds of every repeat out, ``fold_a <= fold_b`` (equal: one fold); a unit's word holds its folds."""

    groups, bits = 1, 3

    def __init__(self, folds: int, repeats: int):
        if folds > 1 << self.bits or repeats * self.bits > 62:
            raise ValueError("a word holds at most 8 folds of 20 repeats")
        pairs = [(a, b) for a in range(folds) for b in range(a, folds)]
        self.keys = [(r, a, b) for r in range(repeats) for a, b in pairs]
        self.rep, self.first, self.second = np.array(self.keys).T

    def folds(self, a, ids):
        return a[:, None] >> (self.bits * self.rep[ids])[None, :] & (1 << self.bits) - 1

    def roles(self, a, b, ids):
        """Weights, and 0 for training, 1 for ``fold_a`` and 2 for ``fold_b`` otherwise."""
        fold = self.folds(a, ids)
        role = np.where(fold == self.first[ids], 1, np.where(fold == self.second[ids], 2, 0)).astype(np.int8)
        return (role == 0).astype(float), role

    def __call__(self, g, a, b, ids):
        yield 0, np.arange(len(a)), self.roles(a, b, ids)[0]


def fold_words(folds: DataFrame) -> DataFrame:
    """``unit_id, a_, b_``: the folds of all repeats in one word."""
    placed = F.expr(f"shiftleft(cast(fold as bigint), cast({FoldsOut.bits} * rep as int))")
    return folds.select("unit_id", placed.alias("f_")).groupBy("unit_id").agg(F.sum("f_").cast("long").alias("a_"), F.lit(0).cast("long").alias("b_"))


def drawn_words(units: DataFrame, salt: str) -> DataFrame:
    """``unit_id, a_, b_``: two words of the unit's hash."""
    return units.select("unit_id").distinct().select("unit_id", word(salt, "unit_id", 0).alias("a_"), word(salt, "unit_id", 1).alias("b_"))


def _mask(group: str, level) -> Column:
    return F.lit(True) if level is Ellipsis else F.col(group).isNull() if level is None else F.coalesce(F.col(group) == level, F.lit(False))


def _balance_weights(library, parts) -> np.ndarray:
    """Coefficients of log parts (part, feature)."""
    out = np.zeros((len(parts), len(library)))
    for j, (num, den) in enumerate(library.values()):
        scale = math.sqrt(len(num) * len(den) / (len(num) + len(den)))
        for side, sign in ((num, 1), (den, -1)):
            for p in side:
                out[parts.index(p), j] += sign * scale / len(side)
    return out


class Weightings:
    """Units (``unit_id, y, a_, b_, x``; persisted) and, of every weighting, what turns a unit's row into features.

    ``turn`` is (weighting, column, feature) and gives standardised features; ``counts``, ``means`` and ``covs`` are those
    of the two classes; ``failed`` names the reason of weightings that have no fit.
    """

    def __init__(self, units, draw, count, features):
        self.units, self.draw, self.count, self.features = units, draw, count, features
        self.turn = self.counts = self.means = self.covs = self.scale = None
        self.fill = self.delta = None
        self.failed: dict[int, str] = {}

    def close(self) -> None:
        self.units.unpersist()

    def fitted(self) -> np.ndarray:
        return np.array([k for k in range(self.count) if k not in self.failed], np.int64)

    def summed(self, each, ids: np.ndarray, raw: bool = False) -> dict[int, np.ndarray]:
        """``each(k, features, y, weights, roles)`` added up over blocks of units, for every weighting of ``ids``."""
        turn, draw = self.turn, self.draw

        def add(batches):
            total: dict = {}
            for batch in _sliced(batches):
                x, y, a, b = _matrix(batch, "x"), *(_vector(batch, c) for c in ("y", "a_", "b_"))
                for at in range(0, len(ids), CHUNK):
                    own = ids[at : at + CHUNK]
                    weights, roles = draw.roles(a, b, own)
                    for j, k in enumerate(own.tolist()):
                        v = each(k, x if raw else x @ turn[k], y, weights[:, j], roles[:, j])
                        total[k] = total[k] + v if k in total else v
            if total:
                yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()), "x": pa.array([v.tobytes() for v in total.values()], pa.binary())})

        blocks = self.units.select("y", "a_", "b_", "x").mapInArrow(add, "k int, x binary")
        return {r["k"]: np.frombuffer(bytes(r["x"])) for r in folded(blocks, ["k"]).collect()}


def weightings(df: DataFrame, parts, library, draw, count: int, words: DataFrame, group: str = "state", zero_c: float = 0.5, positive: str | None = "PB") -> Weightings:
    """Fit ``count`` preparations of the points ``df(unit_id, label, group, *parts)``, one for each weighting of ``draw``.

    Features are the balances of ``library``, or, for ``None``, the centred log parts.  Without a ``positive`` label all
    units are one class.

    ``words`` are the numbers that ``draw`` works with, one row a unit.  A weighting with units of one class, or with a
    part that has no value, is named in ``failed``.  Points whose group is null are filled with global medians.
    """
    parts, n = list(parts), len(parts)
    points = df.select("unit_id", "label", group, *parts).join(words, "unit_id").persist()
    try:
        sizes = {r[group]: r["n"] for r in points.groupBy(group).agg(F.count_distinct("unit_id").alias("n")).limit(MOST_LEVELS + 1).collect()}
        if len(sizes) > MOST_LEVELS:
            raise ValueError(f"more than {MOST_LEVELS} levels of {group}")
        known = sorted(s for s in sizes if s is not None)
        masks = [_mask(group, s) for s in known]
        every = [*masks, F.lit(True)]
        least = [*[sizes[s] for s in known], max(1, sum(sizes.values()))]
        cells = [(g, p) for g in range(len(every)) for p in parts]
        for reach in (REACH, 4 * REACH, 16 * REACH, None):
            half = [0.5 if reach is None else min(0.5, reach / math.sqrt(m)) for m in least]
            low, high = _band(points, every, parts, half)
            shape = [*[F.sum((every[g] & (F.col(p) < low[g, p])).cast("double")) for g, p in cells], *[F.count(F.when(every[g], F.col(p))).cast("double") for g, p in cells], *[F.max((_mask(group, s) & F.col(p).isNull()).cast("double")) for s in [*known, None] for p in parts]]
            lows = [F.coalesce(F.min(F.when(F.col(p) > 0, F.col(p))), F.lit(np.finfo(float).max)) for p in parts]
            own = points.groupBy("unit_id", "a_", "b_").agg(F.array(*[F.coalesce(c, F.lit(0.0)) for c in shape]).alias("x"), F.array(*lows).alias("low")).withColumn("g_", F.lit(0))
            sums, lowest = replicate_sums(own, draw, count)
            m = len(cells)
            below, total, missing = sums[..., :m], sums[..., m : 2 * m], sums[0, :, 2 * m :].reshape(count, -1, n)
            near = F.array(*[F.struct(F.lit(i).alias("part_"), F.col(p).alias("value"), (every[g] & F.col(p).between(low[g, p], high[g, p])).alias("near")) for i, (g, p) in enumerate(cells)])
            rows = points.select("a_", "b_", F.explode(near).alias("e")).where("e.near").select(F.lit(0).alias("s_"), F.lit(0).alias("g_"), "a_", "b_", "e.part_", "e.value")
            medians = replicate_medians(rows, draw, count, below, total)
            if not (np.isnan(medians) & (total > 0)).any():
                break
        medians, total = (v[0].reshape(count, -1, n) for v in (medians, total))
        fill = np.concatenate([np.where(total[:, :-1] >= MIN_OBS, medians[:, :-1], medians[:, -1:]), medians[:, -1:]], axis=1)
        least_ = lowest[0]
        for g in range(fill.shape[1]):
            least_ = np.where((missing[:, g] > 0) & (fill[:, g] > 0), np.fmin(least_, fill[:, g]), least_)
        delta = np.where(least_ < np.finfo(float).max, zero_c * least_, np.nan)
        units = points.groupBy("unit_id", "a_", "b_").agg((F.lit(True) if positive is None else F.min("label") == positive).cast("int").alias("y"), F.array(*[c / F.count("*") for s in [*known, None] for k in range(3) for p in parts for c in [_sums(_mask(group, s), p)[k]]], F.lit(1.0)).alias("x")).persist()
        units.count()
    finally:
        points.unpersist()
    out = Weightings(units, draw, count, list(library) if library is not None else parts)
    out.fill, out.delta = fill, delta
    out.failed = {k: "part_without_values" for k in np.flatnonzero(np.isnan(fill).any(axis=(1, 2)) | np.isnan(delta).any(axis=1)).tolist()}
    _turn(out, _balance_weights(library, parts) if library is not None else np.eye(n) - 1 / n)
    _moments(out, (0, 1) if positive is not None else (1,))
    return out


def _sums(mine: Column, p: str) -> list[Column]:
    """Log sum, missing cells and zero cells of a part over the points of a unit that are meant."""
    return [F.sum(F.when(mine & (F.col(p) > 0), F.log(p)).otherwise(0.0)), F.sum((mine & F.col(p).isNull()).cast("double")), F.sum(F.when(mine & (F.col(p) == 0), 1.0).otherwise(0.0))]


def _band(points: DataFrame, masks, parts, half) -> tuple[dict, dict]:
    """Bounds of each (level, part) among which the medians of all weightings are looked for."""
    whole = np.finfo(float).max
    asked = [g for g, h in enumerate(half) if h < 0.5]
    told = {}
    if asked:
        columns = [F.percentile_approx(F.when(masks[g], F.col(p)), F.array(F.lit(0.5 - half[g]), F.lit(0.5 + half[g])), 2_000).alias(f"q_{g}_{p}") for g in asked for p in parts]
        told = points.agg(*columns).first().asDict()
    low, high = {}, {}
    for g in range(len(half)):
        for p in parts:
            low[g, p], high[g, p] = told.get(f"q_{g}_{p}") or (-whole, whole)
    return low, high


def _turn(out: Weightings, weights: np.ndarray) -> None:
    """Rows of logs, missing and zero cells of each level, and the constant one, to features that are not yet standardised."""
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.nan_to_num(np.log(out.delta))
        blocks = []
        for g in range(out.fill.shape[1]):
            value = np.log(np.where(out.fill[:, g] == 0, out.delta, out.fill[:, g]))
            blocks += [np.broadcast_to(weights, (out.count, *weights.shape)), np.nan_to_num(value)[:, :, None] * weights, delta[:, :, None] * weights]
    out.turn = np.concatenate([*blocks, np.zeros((out.count, 1, weights.shape[1]))], axis=1)


def _moments(out: Weightings, needed=(0, 1)) -> None:
    """Moments of the classes; the features are standardised by the deviation (``scale``) of all training units."""
    n = len(out.features)

    def each(k, x, y, w, role):
        return np.concatenate([v for c in (0, 1) for m in [w * (y == c)] for v in ([m.sum()], m @ x, ((m[:, None] * x).T @ x).ravel())])

    own = np.zeros((out.count, 2, 1 + n + n * n))
    for k, v in out.summed(each, out.fitted()).items():
        own[k] = v.reshape(2, -1)
    counts, first, second = own[..., 0], own[..., 1 : 1 + n], own[..., 1 + n :].reshape(out.count, 2, n, n)
    out.failed |= {k: "single_class" for k in out.fitted().tolist() if not counts[k][list(needed)].all()}
    with np.errstate(divide="ignore", invalid="ignore"):
        size = counts.sum(axis=1)[:, None]
        mean = first.sum(axis=1) / size
        var = np.diagonal(second.sum(axis=1), axis1=1, axis2=2) / size - mean**2
        sd = np.where(var > 1e-20, np.sqrt(np.maximum(var, 0)), 1.0)
        means = first / counts[..., None]
        covs = second / counts[..., None, None] - means[..., :, None] * means[..., None, :]
    out.counts, out.means = counts, (means - mean[:, None]) / sd[:, None]
    out.scale = sd
    out.covs = covs / (sd[:, None, :, None] * sd[:, None, None, :])
    out.turn = out.turn / sd[:, None, :]
    out.turn[:, -1] = -np.nan_to_num(mean / sd)
