"""Bootstrap and permutation of units with thousands of replicates, from sums per unit.

Log-ratio statistics are linear (effects) or quadratic (edges) in a point's observed logs, its missing cells and its
zero cells once a replicate's medians and zero replacements are known.  So points are summed per unit once; a task turns
its units into a matrix, draws the units' weights in all replicates from a hash and adds up ``weights' x sums``.  Work is
units x replicates; what leaves a task, and what reaches the driver, has the size replicates x labels x parts squared
whatever the number of rows.  Medians are exact: values near the median are ranked under all replicates' weights, those
below are only counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import POISSON, helmert

#: Constants of the draws; plain SQL makes the same ones (see ``plans.sql.drawn``).
STEP, FACTOR, WORD = 2654435769, 73244475, 2**32 - 1
#: Replicates that are drawn together, and units of a matrix.
CHUNK, ROWS = 250, 4096
#: Weights (values x replicates) that a task ranks at a time: the more values lie near a median, the fewer replicates.
WEIGHTS = 1 << 21
#: Standard deviations (at least) of a replicate's median that are ranked on both sides of the median of all rows.
REACH = 7.0
#: Tasks whose blocks one task may add up; with more, blocks are added up in two levels.
FAN = 32


def word(salt: str, key: str, k: int) -> Column:
    """The ``k``-th 32-bit word of a unit's hash."""
    text = F.concat_ws("|", F.lit(salt), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1 + 8 * k, 8), 16, 10).cast("long")


def drawn(a: np.ndarray, b: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """A 32-bit number of every unit (by its two words) and replicate."""
    x = a[:, None] + reps[None, :] * STEP & WORD
    for other in (b[:, None], 0):
        for _ in range(2):
            x = (x ^ x >> 16) * FACTOR & WORD
        x = (x ^ x >> 16) ^ other
    return x


class Poisson:
    """Weights of the bootstrap: each unit stays in its group and is drawn Poisson(1) times."""

    cuts = np.array([int(np.ceil(p * 2**32)) for p in POISSON], np.int64)

    def __init__(self, groups: int):
        self.groups = groups

    def __call__(self, g, a, b, reps):
        for c in range(self.groups):
            rows = np.flatnonzero(g == c)
            if len(rows):
                yield c, rows, np.searchsorted(self.cuts, drawn(a[rows], b[rows], reps), "right").astype(float)


class Dealt:
    """Weights of a permutation of two groups: the units with the smallest numbers of a replicate form group 0."""

    groups = 2

    def __init__(self, last: np.ndarray):
        self.last = last

    def __call__(self, g, a, b, reps):
        first = (drawn(a, b, reps) << 31 | (b >> 1)[:, None]) <= self.last[reps][None, :]
        rows = np.arange(len(a))
        yield 0, rows, first.astype(float)
        yield 1, rows, (~first).astype(float)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _vector(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def _sliced(batches):
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            yield batch.slice(i, ROWS)


def folded(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks' arrays of doubles added up by ``keys``: ``x`` summed and, if there, ``low`` by its least values.

    Blocks are added up as they stream in, so a task holds one array for each of its keys, whatever the number of blocks;
    first by key and residue of the task that made them, then by key, so that no task reads more than about the root of all.
    """
    spark = blocks.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in ("x", "low") if c in blocks.columns]
    schema = blocks.select(*keys, *names).schema

    def merge(batches):
        held: dict = {}
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (*keys, *names)]
            for row in zip(*columns, strict=True):
                key = tuple(v.as_py() for v in row[: len(keys)])
                own = [np.frombuffer(v.as_buffer()) for v in row[len(keys) :]]
                if key in held:
                    held[key] = [np.minimum(a, b) if n == "low" else a + b for n, a, b in zip(names, held[key], own, strict=True)]
                else:
                    held[key] = own
        for key, own in held.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v], f) for v, f in zip(key, kinds, strict=True)], *[pa.array([v.tobytes()], pa.binary()) for v in own]], names=[*keys, *names])

    kinds = [pa.int32() if schema[k].dataType.simpleString() == "int" else pa.string() for k in keys]
    if tasks > FAN:
        root = int(np.ceil(np.sqrt(tasks)))
        dealt = blocks.withColumn("task_", F.pmod(F.spark_partition_id(), F.lit(root)))
        blocks = dealt.repartition(*keys, "task_").select(*keys, *names).mapInArrow(merge, schema)
    return blocks.select(*keys, *names).repartition(*keys).mapInArrow(merge, schema)


def replicate_sums(units: DataFrame, draw, reps: int, lows: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of ``units.x`` and least ``units.low`` of drawn units: arrays (group, replicate, column).

    ``units`` has ``g_`` (group), ``a_, b_`` (words), ``x`` and ``low`` (arrays of doubles of one length each).
    """
    parts = [(k, np.arange(k, min(k + CHUNK, reps))) for k in range(0, reps, CHUNK)]

    def add(batches):
        total: dict = {}
        least: dict = {}
        for batch in _sliced(batches):
            x, g, a, b = _matrix(batch, "x"), *(_vector(batch, c) for c in ("g_", "a_", "b_"))
            low = _matrix(batch, "low") if lows else None
            for k, ids in parts:
                for c, rows, w in draw(g, a, b, ids):
                    own = w.T @ x[rows]
                    total[k, c] = total[k, c] + own if (k, c) in total else own
                    if lows:
                        there = w > 0
                        own = np.stack([np.where(there, low[rows, p, None], np.inf).min(axis=0) for p in range(low.shape[1])], axis=1)
                        least[k, c] = np.minimum(least[k, c], own) if (k, c) in least else own
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in keys], pa.int32()), "c": pa.array([c for _, c in keys], pa.int32()), "x": pa.array([total[i].tobytes() for i in keys], pa.binary())} | ({"low": pa.array([least[i].tobytes() for i in keys], pa.binary())} if lows else {}))

    schema = "k int, c int, x binary" + ", low binary" * lows
    columns = units.select("g_", "a_", "b_", "x", *["low"] * lows)
    rows = folded(columns.mapInArrow(add, schema), ["k", "c"]).collect()
    out = [None, None]
    for r in rows:
        n = len(parts[r["k"] // CHUNK][1])
        for i, name in enumerate(("x", "low")[: 1 + lows]):
            own = np.frombuffer(bytes(r[name])).reshape(n, -1)
            if out[i] is None:
                out[i] = np.full((draw.groups, reps, own.shape[1]), np.inf if i else 0.0)
            out[i][r["c"], r["k"] : r["k"] + n] = own
    return out[0], out[1]


def last_of_first(units: DataFrame, reps: int, first: dict[int, int], counts: dict[int, int]) -> dict[int, np.ndarray]:
    """For each stratum ``g_``: every replicate's ``first[g]``-th smallest number of its units, exactly.

    Numbers are uniform, so only those near the expected place are kept; those before it are counted.
    """
    bounds = {}
    for g, n in counts.items():
        reach = 10 * np.sqrt(n) / 2 + 10
        bounds[g] = tuple(int(min(max(v / n, 0.0), 1.0) * 2**63) for v in (first[g] - reach, first[g] + reach))
    parts = [np.arange(k, min(k + CHUNK, reps)) for k in range(0, reps, CHUNK)]

    def near(batches):
        for batch in _sliced(batches):
            g, a, b = (_vector(batch, c) for c in ("g_", "a_", "b_"))
            for s, (low, high) in bounds.items():
                rows = np.flatnonzero(g == s)
                for ids in parts if len(rows) else ():
                    x = drawn(a[rows], b[rows], ids) << 31 | (b[rows] >> 1)[:, None]
                    some = (x >= low) & (x <= high)
                    values = x.T[some.T]
                    ends = np.concatenate([[0], np.cumsum(some.sum(axis=0))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), s, np.int32)), pa.array(ids.astype(np.int32)), pa.array((x < low).sum(axis=0)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["g_", "rep", "below", "near"])

    found = units.select("g_", "a_", "b_").mapInArrow(near, "g_ int, rep int, below long, near array<long>")
    told = found.groupBy("g_", "rep").agg(F.sum("below").alias("below"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    wanted = F.create_map(*[v for g, n in first.items() for v in (F.lit(g), F.lit(n))])
    place = wanted[F.col("g_")] - F.col("below")
    rows = told.select("g_", "rep", F.when((place >= 1) & (place <= F.size("near")), F.get("near", (place - 1).cast("int"))).alias("last")).collect()
    out = {g: np.full(reps, -1, np.int64) for g in counts}
    for r in rows:
        if r["last"] is None and first[r["g_"]] > 0:
            raise ValueError("the place of a permuted group was not found")
        out[r["g_"]][r["rep"]] = -1 if r["last"] is None else r["last"]
    return out


def replicate_medians(cells: DataFrame, draw, reps: int, below: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weighted medians (group, replicate, part) of ``cells(s_, part_, g_, a_, b_, value)``, the values near them.

    ``s_`` is the stratum whose cells are ranked together.  ``below`` is the weight of smaller values of a part, ``total``
    the weight of all.  NaN where the median is not among the cells.
    """

    def rank(table: pa.Table) -> pa.Table:
        value = table["value"].to_numpy()
        order = np.argsort(value, kind="stable")
        value = value[order]
        g, a, b = (table[c].to_numpy()[order].astype(np.int64) for c in ("g_", "a_", "b_"))
        k, p = table["k"][0].as_py(), table["part_"][0].as_py()
        out: dict[str, list] = {"c": [], "k": [], "p": [], "m": []}
        last = min(k + CHUNK, reps)
        step = max(1, min(CHUNK, WEIGHTS // max(1, len(value))))
        for first in range(k, last, step):
            ids = np.arange(first, min(first + step, last))
            for c, rows, w in draw(g, a, b, ids):
                own = value[rows]
                up_to = np.cumsum(w, axis=0, out=w)
                up_to += below[c, ids, p]
                n, base = total[c, ids, p], below[c, ids, p]
                at = [np.floor((n - 1) / 2), np.ceil((n - 1) / 2)]
                i, j = ((up_to <= x).sum(axis=0) for x in at)
                fine = (n > 0) & (base <= at[0]) & (j < len(own))
                i, j = np.minimum(i, len(own) - 1), np.minimum(j, len(own) - 1)
                for name, v in (("c", c), ("k", first), ("p", p), ("m", np.where(fine, (own[i] + own[j]) / 2, np.nan).tobytes())):
                    out[name].append(v)
        return pa.table({"c": pa.array(out["c"], pa.int32()), "k": pa.array(out["k"], pa.int32()), "p": pa.array(out["p"], pa.int32()), "m": pa.array(out["m"], pa.binary())})

    many = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(CHUNK))))
    medians = np.full(total.shape, np.nan)
    for r in many.groupBy("s_", "part_", "k").applyInArrow(rank, "c int, k int, p int, m binary").collect():
        own = np.frombuffer(bytes(r["m"]))
        medians[r["c"], r["k"] : r["k"] + len(own), r["p"]] = own
    return medians


class Replicates:
    """Parameters and sums of all replicates: ``fill`` and ``delta`` (group, replicate, part) and ``sums``."""

    def __init__(self, groups: list[str], medians, deltas, sums):
        self.groups, self.medians, self.deltas, self.sums = groups, medians, deltas, sums
        self.fill = np.where(medians == 0, deltas, medians)


def _counts(p: str, state: str | None) -> list[Column]:
    """Log sum, missing cells and zero cells of a part over a unit's points (of one state)."""
    mine = F.lit(True) if state is None else F.col("state") == state
    return [F.sum(F.when(mine & (F.col(p) > 0), F.log(p)).otherwise(0.0)), F.sum((mine & F.col(p).isNull()).cast("double")), F.sum(F.when(mine & (F.col(p) == 0), 1.0).otherwise(0.0))]


def effect_sums(parts) -> list[Column]:
    """Of every state: the unit weight of its points and the sums that its mean coordinates are made of."""
    n = F.count("*")
    return [c / n for s in ("U", "W") for c in [F.sum((F.col("state") == s).cast("double")), *[x for p in parts for x in _counts(p, s)]]]


def edge_sums(parts) -> list[Column]:
    """One, a unit's mean logs, missing and zero shares, and their products."""
    means = [c / F.count("*") for k in range(3) for c in [_counts(p, None)[k] for p in parts]]
    return [F.lit(1.0), *means]


def _products(x: Column, n: int) -> Column:
    """A unit's row with the products of all pairs of its ``n`` means behind it."""
    own = lambda i: F.get(x, F.lit(i + 1))
    return F.concat(x, F.array(*[own(i) * own(j) for i in range(n) for j in range(i, n)]))


def resample(df: DataFrame, parts, reps: int, stats, squares: bool = False, permute: bool = False, salt: str = "boot", zero_c: float = 0.5) -> Replicates:
    """Replicates of units with medians and zero replacements fitted anew in each group of each replicate.

    Groups are the labels: bootstrap (``permute=False``) draws the units of a label, a permutation deals the labels
    anew to all units, as often as they occur.
    """
    df = df.select("unit_id", "label", "state", *parts).persist()
    try:
        sizes = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count_distinct("unit_id").alias("n")).collect()}
        groups = sorted(sizes)
        code = F.array_position(F.array(*map(F.lit, groups)), F.col("label")).cast("int") - 1
        strata = {0: sum(sizes.values())} if permute else {i: sizes[g] for i, g in enumerate(groups)}
        key = F.lit(0) if permute else code
        smallest = {s: min(sizes.values()) if permute else n for s, n in strata.items()}
        tagged = df.withColumns({"s_": key, "g_": F.lit(0) if permute else code})
        own = [F.col(c) for c in ("unit_id", "g_", "s_")]
        draw = Poisson(len(groups))
        if permute:
            if len(groups) != 2:
                raise ValueError("two groups are dealt")
            ids = tagged.select("unit_id", "g_").distinct().select("g_", word(salt, "unit_id", 0).alias("a_"), word(salt, "unit_id", 1).alias("b_"))
            draw = Dealt(last_of_first(ids, reps, {0: sizes[groups[0]]}, strata)[0])
        for reach in (REACH, 4 * REACH, 16 * REACH, None):
            brackets = _brackets(tagged, parts, strata, smallest, reach)
            low, high = ({p: F.create_map(*[v for s, b in brackets.items() for v in (F.lit(s), F.lit(b[p][k]))])[F.col("s_")] for p in parts} for k in (0, 1))
            lows = [F.coalesce(F.min(F.when(F.col(p) > 0, F.col(p))), F.lit(np.finfo(float).max)) for p in parts]
            shape = [*[F.sum((F.col(p) < low[p]).cast("double")) for p in parts], *[F.count(p).cast("double") for p in parts], *[F.max(F.col(p).isNull().cast("double")) for p in parts]]
            units = tagged.groupBy(*own).agg(F.array(*[F.coalesce(c, F.lit(0.0)) for c in shape]).alias("h"), F.array(*lows).alias("low"), F.array(*stats).alias("x"))
            x = _products(F.col("x"), 3 * len(parts)) if squares else F.col("x")
            units = units.select("g_", word(salt, "unit_id", 0).alias("a_"), word(salt, "unit_id", 1).alias("b_"), F.concat("h", x).alias("x"), "low")
            sums, least = replicate_sums(units, draw, reps)
            n = len(parts)
            below, total, missing, sums = (sums[..., a:b] for a, b in ((0, n), (n, 2 * n), (2 * n, 3 * n), (3 * n, None)))
            each = F.array(*[F.struct(F.lit(i).alias("part_"), F.col(p).alias("value"), F.col(p).between(low[p], high[p]).alias("near")) for i, p in enumerate(parts)])
            cells = tagged.select(*own, F.explode(each).alias("e")).where("e.near").select("s_", "g_", word(salt, "unit_id", 0).alias("a_"), word(salt, "unit_id", 1).alias("b_"), "e.part_", "e.value")
            medians = replicate_medians(cells, draw, reps, below, total)
            if not (np.isnan(medians) & (total > 0)).any():
                break
        least = np.where((missing > 0) & (medians > 0), np.fmin(least, medians), least)
        deltas = np.where(least < np.finfo(float).max, zero_c * least, np.nan)
        return Replicates(groups, medians, deltas, sums)
    finally:
        df.unpersist()


def _brackets(df: DataFrame, parts, strata, smallest, reach) -> dict[int, dict[str, tuple[float, float]]]:
    """Bounds of the values of a stratum's part among which all replicates' medians are looked for."""
    whole = (-np.finfo(float).max, np.finfo(float).max)
    half = {s: 0.5 if reach is None else min(0.5, reach / np.sqrt(n)) for s, n in smallest.items()}
    out = {s: dict.fromkeys(parts, whole) for s in strata}
    wanted = {h for h in half.values() if h < 0.5}
    if wanted:
        q = sorted({x for h in wanted for x in (0.5 - h, 0.5 + h)})
        for r in df.groupBy("s_").agg(*[F.percentile_approx(p, F.array(*map(F.lit, q)), 2_000).alias(p) for p in parts]).collect():
            h = half[r["s_"]]
            if h < 0.5:
                out[r["s_"]] = {p: (r[p][q.index(0.5 - h)], r[p][q.index(0.5 + h)]) if r[p] else whole for p in parts}
    return out


def effects(found: Replicates, parts) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients ``a`` and ``b`` (group, replicate, coordinate) of the state effect; NaN where a state is missing."""
    n = len(parts)
    basis = np.array(helmert(n))
    means = []
    with np.errstate(divide="ignore", invalid="ignore"):
        fill, delta = np.log(found.fill), np.log(found.deltas)
        for own in (found.sums[..., : 3 * n + 1], found.sums[..., 3 * n + 1 :]):
            weight, cells = own[..., :1], own[..., 1:].reshape(*own.shape[:2], n, 3)
            logs = cells[..., 0] + np.where(cells[..., 1] > 0, cells[..., 1] * fill, 0.0) + np.where(cells[..., 2] > 0, cells[..., 2] * delta, 0.0)
            means.append(np.where(weight > 0, logs @ basis.T / weight, np.nan))
    return means[0], means[1] - means[0]


def edge_rhos(found: Replicates, parts) -> np.ndarray:
    """rho (group, replicate, part, part) of units' centred log parts, from first and second moments."""
    n = len(parts)
    out = np.full((*found.sums.shape[:2], n, n), np.nan)
    centre = np.eye(n) - 1.0 / n
    upper = np.triu_indices(3 * n)
    for g, r in np.ndindex(found.sums.shape[:2]):
        own = found.sums[g, r]
        count = own[0]
        if count < 2:
            continue
        first, second = own[1 : 3 * n + 1], np.zeros((3 * n, 3 * n))
        second[upper] = own[3 * n + 1 :]
        second = second + second.T - np.diag(np.diag(second))
        with np.errstate(divide="ignore", invalid="ignore"):
            fill, delta = (np.where(first[k * n : (k + 1) * n] > 0, np.log(v[g, r]), 0.0) for k, v in ((1, found.fill), (2, found.deltas)))
        turn = centre @ np.hstack([np.eye(n), np.diag(fill), np.diag(delta)])
        mean = turn @ first
        cov = (turn @ second @ turn.T - np.outer(mean, mean) / count) / (count - 1)
        var = np.diag(cov)
        out[g, r] = 2 * cov / (var[:, None] + var[None, :])
    return out
