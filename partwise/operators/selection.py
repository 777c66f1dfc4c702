"""Exact quantiles of columns by group without gathering a group: a sketch brackets each, counts narrow it, few values are ranked.

No row is shuffled and no task holds a group's values: every pass is one aggregation of sketches or counts by group, and
passes go on until what lies between the brackets is few enough to be ranked; each narrows them about hundredfold.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values between all brackets that are ranked together at the end, groups, and steps and accuracy of a sketch.
FEW, MOST_GROUPS, GRID, ACCURACY = 50_000, 256, 256, 4_000


def _of_group(values: dict[int, float]):
    """A literal of each group, by its number ``g_``."""
    return F.create_map(*[x for g, v in values.items() for x in (F.lit(g), F.lit(float(v)))])[F.col("g_")]


def select(df: DataFrame, columns, by, shares, cached: bool = False) -> dict[tuple, dict[str, tuple[int, list[float | None]]]]:
    """Of every group (tuple of ``by``; null is a level) and column: the number of values and their ``shares`` quantiles.

    Quantiles lie between neighbours by their distance; nulls are left out.  ``cached`` says that the caller keeps ``df``.
    """
    columns, by, shares = list(columns), list(by), list(shares)
    df = df if cached else df.select(*by, *columns).persist()
    try:
        counted = df.groupBy(*by).agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)]).limit(MOST_GROUPS + 1).collect()
        if len(counted) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
        levels = [tuple(r[b] for b in by) for r in counted]
        size = {(g, i): r[f"n_{i}"] for g, r in enumerate(counted) for i in range(len(columns))}
        same = lambda level: [F.col(b).eqNullSafe(F.lit(v)) for b, v in zip(by, level, strict=True)]
        number = F.lit(0)
        if by and levels:
            number = F.coalesce(*[F.when(_all(same(level)), F.lit(g)) for g, level in enumerate(levels)])
        rows = df.select(number.cast("int").alias("g_"), *columns)
        found = _ranked(rows, columns, shares, size)
        return {level: {c: (size[g, i], found[g, i]) for i, c in enumerate(columns)} for g, level in enumerate(levels)}
    finally:
        if not cached:
            df.unpersist()


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _ranked(rows: DataFrame, columns, shares, size) -> dict[tuple[int, int], list]:
    top = 1.7976931348623157e308
    jobs = [(g, i, k) for (g, i), n in size.items() if n for k in range(len(shares))]
    place = {(g, i, k): shares[k] * (size[g, i] - 1) for g, i, k in jobs}
    low, high, below = dict.fromkeys(jobs, -top), dict.fromkeys(jobs, top), dict.fromkeys(jobs, 0)
    inside = {j: size[j[:2]] for j in jobs}
    groups = sorted({g for g, _, _ in jobs})

    def between(i, k):
        bounds = [{g: b.get((g, i, k), x) for g in groups} for b, x in ((low, top), (high, -top))]
        return F.coalesce((F.col(columns[i]) >= _of_group(bounds[0])) & (F.col(columns[i]) <= _of_group(bounds[1])), F.lit(False))

    pairs = sorted({(i, k) for _, i, k in jobs})
    while sum(inside.values()) > FEW * len(shares) and any(low[j] < high[j] for j in jobs):
        asked, spots = {}, {}
        for g, i, k in jobs:
            ends = (math.floor(place[g, i, k]) - below[g, i, k], math.ceil(place[g, i, k]) - below[g, i, k])
            slack = 2 * inside[g, i, k] / ACCURACY + 2
            spots[g, i, k] = [min(max(s, 0.0), 1.0) for s in ((e + d) / inside[g, i, k] for e, d in zip(ends, (-slack, slack), strict=True))]
            asked.setdefault((i, k), set()).update(spots[g, i, k])
        steps = {ik: sorted(v) if len(v) <= GRID else [s / GRID for s in range(GRID + 1)] for ik, v in asked.items()}
        sketch = {r["g_"]: r for r in rows.groupBy("g_").agg(*[F.percentile_approx(F.when(between(i, k), F.col(columns[i])), F.array(*map(F.lit, steps[i, k])), ACCURACY).alias(f"q_{i}_{k}") for i, k in pairs]).collect()}
        before = dict(low), dict(high)
        for g, i, k in jobs:
            values, at = sketch[g][f"q_{i}_{k}"], steps[i, k]
            a, b = spots[g, i, k]
            low[g, i, k] = max(low[g, i, k], values[bisect_right(at, a) - 1]) if a > 0 else low[g, i, k]
            high[g, i, k] = min(high[g, i, k], values[bisect_left(at, b)]) if b < 1 else high[g, i, k]
        counted = {r["g_"]: r for r in rows.groupBy("g_").agg(*[c for i, k in pairs for c in (F.sum((F.col(columns[i]) < _of_group({g: low.get((g, i, k), top) for g in groups})).cast("long")).alias(f"b_{i}_{k}"), F.sum(between(i, k).cast("long")).alias(f"n_{i}_{k}"))]).collect()}
        for g, i, k in jobs:
            below[g, i, k], inside[g, i, k] = counted[g][f"b_{i}_{k}"] or 0, counted[g][f"n_{i}_{k}"]
            if not below[g, i, k] <= math.floor(place[g, i, k]) or not math.ceil(place[g, i, k]) < below[g, i, k] + inside[g, i, k]:
                raise ValueError("a sketch was worse than its bound")
        if (low, high) == before:
            break
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.when(between(i, k), F.col(columns[i])).alias("v")) for i, k in pairs]) if pairs else None
    values: dict[tuple, list] = {j: [] for j in jobs}
    if pairs:
        for r in rows.select("g_", F.explode(cells).alias("c")).where("c.v is not null").groupBy("g_", "c.i", "c.k", "c.v").agg(F.count("*").alias("n")).collect():
            values[r["g_"], r["i"], r["k"]].append((r["v"], r["n"]))
    out: dict[tuple[int, int], list] = {(g, i): [None] * len(shares) for g, i in size}
    for g, i, k in jobs:
        p, at, ends = place[g, i, k], below[g, i, k], []
        for v, n in sorted(values[g, i, k]):
            at += n
            while len(ends) < 2 and at > (math.floor(p), math.ceil(p))[len(ends)]:
                ends.append(v)
        out[g, i][k] = ends[0] + (ends[1] - ends[0]) * (p - math.floor(p))
    return out
