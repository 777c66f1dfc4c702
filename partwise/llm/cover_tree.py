"""Exact cosine threshold pairs of embeddings: cover trees compared by dual traversal, block by block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialise

#: Vectors that one tree holds on average, and at most so many pivots over all labels (64 doubles each: 2 MB).
BLOCK = 1024
MAX_PIVOTS = 4096
#: Radii of the nested levels below the root (chords of the unit sphere reach 2).
RADII = (1.0, 0.5, 0.25, 0.125)
#: Room for rounding in bounds on distances; pairs inside it are decided by the cosine itself.
SLACK = 1e-7


@dataclass(frozen=True)
class CoverTree:
    """Levels of nested centres with halving radii over unit vectors; the last level is all points.

    ``centres[l]`` are row numbers, ``parents[l]`` the position of each in level ``l - 1`` (its nearest centre there,
    within the level's radius), ``reach[l]`` the distance from each centre to the farthest point below it.
    """

    points: np.ndarray
    centres: list[np.ndarray]
    parents: list[np.ndarray]
    reach: list[np.ndarray]

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        n = len(points)
        levels = [np.zeros(1, np.int64)]
        nearest = _distances(points, points[:1])[:, 0]
        owner = np.zeros(n, np.int64)
        owners = [owner]
        for radius in RADII:
            chosen = levels[-1].tolist()
            nearest, owner = nearest.copy(), owner.copy()
            while len(chosen) < n:
                far = int(np.argmax(nearest))
                if nearest[far] <= radius:
                    break
                d = _distances(points, points[far : far + 1])[:, 0]
                closer = d < nearest
                nearest[closer], owner[closer] = d[closer], len(chosen)
                nearest[far], owner[far] = 0, len(chosen)
                chosen.append(far)
            levels.append(np.array(chosen))
            owners.append(owner)
            if len(chosen) == n or len(chosen) > n // 2:
                break
        levels.append(np.arange(n))
        parents = [np.zeros(1, np.int64)] + [owners[k][level] for k, level in enumerate(levels[1:])]
        reach = [np.zeros(n)]
        for k in range(len(levels) - 1, 0, -1):
            step = np.linalg.norm(points[levels[k]] - points[levels[k - 1]][parents[k]], axis=1)
            up = np.zeros(len(levels[k - 1]))
            np.maximum.at(up, parents[k], step + reach[0])
            reach.insert(0, up)
        return cls(points, levels, parents, reach)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def dual_pairs(x: CoverTree, y: CoverTree, raw_x: np.ndarray, raw_y: np.ndarray, cosine: float) -> np.ndarray:
    """Which points of ``x`` and ``y`` have a cosine of at least ``cosine``: a boolean matrix of one pair of blocks.

    Both trees are descended together.  A pair of nodes is dropped when the distance of their centres exceeds their
    reaches and the threshold together; points below pairs that remain are decided by the cosine in double precision.
    """
    most = np.sqrt(2 - 2 * cosine) + SLACK
    depth = max(len(x.centres), len(y.centres))
    alive = np.ones((1, 1), bool)
    for k in range(1, depth):
        i, j = min(k, len(x.centres) - 1), min(k, len(y.centres) - 1)
        if k < len(x.centres):
            alive = alive[x.parents[i]]
        if k < len(y.centres):
            alive = alive[:, y.parents[j]]
        if k == depth - 1:
            break
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return np.zeros((len(raw_x), len(raw_y)), bool)
        d = _distances(x.points[x.centres[i][rows]], y.points[y.centres[j][columns]])
        near = d <= x.reach[i][rows][:, None] + y.reach[j][columns][None, :] + most
        alive[np.ix_(rows, columns)] &= near
    rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    if len(rows) and len(columns):
        a, b = raw_x[rows], raw_y[columns]
        cos = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
        alive[np.ix_(rows, columns)] &= cos >= cosine
    return alive


def forest(links: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of a block pair's links; ``same``: columns are the rows again."""
    new_rows = links.any(axis=1)
    new_columns = new_rows if same else links.any(axis=0)
    edges = []
    for start in np.flatnonzero(new_rows).tolist():
        if not new_rows[start]:
            continue
        new_rows[start] = False
        todo = [(start, True)]
        while todo:
            at, is_row = todo.pop()
            fresh = np.flatnonzero(links[at] & new_columns if is_row or same else links[:, at] & new_rows).tolist()
            (new_columns if is_row or same else new_rows)[fresh] = False
            edges += [(at, x) if is_row else (x, at) for x in fresh]
            todo += [(x, same or not is_row) for x in fresh]
    return edges


def near_vectors(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Two vectors are linked if their labels are equal and not null and their cosine in double precision is at least
    ``cosine``.  Equal vectors of a label collapse to one class with a count first.  Classes go to the nearest of
    their label's pivots (the trees' top level, at most MAX_PIVOTS over all labels, so they are broadcast) and, where
    a pivot has more than ``block`` classes, to parts by hash.  Pairs of blocks whose pivots are farther apart than
    their covering radii and the threshold allow are dropped; each remaining pair is one task's dual traversal of two
    cover trees.  A task returns link counts and a spanning forest, never its pairs.

    Cases: a vector that is null, empty, zero or holds a null or non-finite component, or whose label is null, links
    with nothing and is its own component; vectors of different length are never linked; a null ``vec_id`` links with
    nothing, has no component and is kept; rows that repeat count as links of each other; other columns are dropped;
    an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    good = base.where(sound)
    classes = materialise(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cells = _cells(classes, sizes, total, block, seed)
    blocks = materialise(cells, "blocks")
    stats = blocks.groupBy("label", "dim", "cell").agg(F.max("far").alias("radius"), F.first("pivot").alias("pivot"))
    stats = materialise(stats, "cells")
    x, y = stats.alias("x"), stats.alias("y")
    apart = F.sqrt(F.aggregate(F.zip_with("x.pivot", "y.pivot", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t))
    most = float(np.sqrt(2 - 2 * cosine)) + SLACK
    met = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.cell") <= F.col("y.cell"))).where((F.col("x.cell") == F.col("y.cell")) | (apart <= F.col("x.radius") + F.col("y.radius") + most))
    met = met.select(F.col("x.label").alias("label"), F.col("x.dim").alias("dim"), F.col("x.cell").alias("i"), F.col("y.cell").alias("j"))
    sides = met.select("label", "dim", F.col("i").alias("cell"), "i", "j").unionByName(met.where("i <> j").select("label", "dim", F.col("j").alias("cell"), "i", "j"))
    tasks = blocks.select("label", "dim", "cell", "rep", "copies", "v").join(sides, ["label", "dim", "cell"])

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key[2], key[3]
        same = i == j
        rows = rows.sort_values("rep", kind="stable")
        a, b = rows[rows.cell == i], rows[rows.cell == j]
        raw_a, raw_b = np.stack(a.v.to_list()), np.stack(b.v.to_list())
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        tree = CoverTree.build(unit(raw_a))
        links = dual_pairs(tree, tree if same else CoverTree.build(unit(raw_b)), raw_a, raw_b, cosine)
        ids_a, ids_b = a.rep.to_numpy(), b.rep.to_numpy()
        if same:
            np.fill_diagonal(links, False)
            links |= links.T
        out = [pd.DataFrame({"id": ids_a, "links": links @ b.copies.to_numpy(), "to": ids_a})]
        if not same:
            out.append(pd.DataFrame({"id": ids_b, "links": links.T @ a.copies.to_numpy(), "to": ids_b}))
        edges = forest(links, same)
        out.append(pd.DataFrame({"id": [ids_a[p] for p, _ in edges], "links": 0, "to": [ids_b[q] for _, q in edges]}))
        told = pd.concat(out)
        return told[(told.links > 0) | (told.id != told.to)].astype({"id": "int64", "links": "int64", "to": "int64"})

    found = materialise(tasks.groupBy("label", "dim", "i", "j").applyInPandas(compare, "id long, links long, to long"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    of_class = classes.select("label", "v", "rep", "copies").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    told = good.join(of_class, ["label", "v"]).select("vec_id", "links", "component")
    rest = base.where(~sound).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return told.unionByName(rest).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component"))).alias("kept"))


def _cells(classes: DataFrame, sizes: DataFrame, total: int, block: int, seed: int) -> DataFrame:
    """Every class with its unit vector's nearest pivot: ``label, dim, cell, pivot, far, rep, copies, v``."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("v", lambda x: x / F.col("norm"))
    rows = classes.withColumn("dim", F.size("v")).withColumn("norm", norm).withColumn("unit", unit).drop("norm")
    share = min(1.0, MAX_PIVOTS * block / max(total, 1))
    wanted = F.ceil(F.col("n") / block * share)
    draw = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1_000_000_007))
    first = rows.join(F.broadcast(sizes.limit(MAX_PIVOTS)), ["label", "dim"]).where(draw < 2 * wanted / F.col("n") * 1_000_000_007)
    drawn = first.select("label", "dim", F.struct(draw.alias("draw"), F.col("rep").alias("rep"), F.col("unit").alias("unit")).alias("p")).orderBy("p.draw", "p.rep").limit(MAX_PIVOTS)
    pivots = drawn.groupBy("label", "dim").agg(F.sort_array(F.collect_list("p")).alias("pivots"))
    with_pivots = rows.join(F.broadcast(pivots), ["label", "dim"], "left")
    gap = lambda p: F.sqrt(F.aggregate(F.zip_with(p["unit"], F.col("unit"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t))
    near = F.array_min(F.transform("pivots", lambda p, k: F.struct(gap(p).alias("far"), k.alias("k"))))
    placed = with_pivots.withColumn("near", near)
    origin = F.transform("unit", lambda x: F.lit(0.0))
    placed = placed.select("label", "dim", "rep", "copies", "v", F.coalesce("near.k", F.lit(-1)).alias("k"), F.coalesce("near.far", F.lit(2.0)).alias("far"), F.coalesce(F.element_at(F.col("pivots"), F.col("near.k") + 1)["unit"], origin).alias("pivot"))
    counted = placed.groupBy("label", "dim", "k").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / block)
    return placed.join(counted, ["label", "dim", "k"]).withColumn("cell", F.concat_ws("/", "k", F.pmod(F.xxhash64(F.lit(seed), F.lit("part"), "rep"), parts))).select("label", "dim", "cell", "pivot", "far", "rep", "copies", "v")
