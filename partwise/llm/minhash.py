"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import bound_batches, materialise
from .words import give_back, keyed, mix64, shingle_sets, slices

#: Samples of a document, bands of BAND samples each, bits of an odd sketch.  A pair at similarity 0.8 misses all 32
#: bands with probability (1 - 0.8**4)**32 = 5e-8.
SAMPLES, BANDS, BAND, BITS = 1024, 32, 4, 4096
#: Two sketches may differ in so many bits.  At similarity 0.8 they differ in 371 (standard deviation 23); a pair
#: beyond this number has an estimate below 0.73, five standard deviations away.
MOST_BITS = 485
#: Candidate ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Buckets of at most so many documents are compared by a join, larger ones in blocks of BLOCK by BLOCK.
SMALL, BLOCK = 32, 512
#: Texts are signed in runs of so many bytes, and sketched so many rows at once: this bounds a worker's arrays.
RUN, ROWS = 1 << 20, 64


def minhash(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """MinHash samples, one row a set: the least of (a x + b) mod 2**32 for each of SAMPLES pairs (a, b)."""
    high = np.uint64(32)
    a, b = (keyed(SAMPLES, seed) >> high).astype(np.uint32) | np.uint32(1), (keyed(SAMPLES, seed + 1) >> high).astype(np.uint32)
    out = np.full((len(sets), SAMPLES), np.uint32(2**32 - 1))
    room = np.empty((256, SAMPLES), np.uint32)
    for row, s in zip(out, sets, strict=True):
        x = (s >> high).astype(np.uint32)[:, None]
        for at in range(0, len(s), 256):
            part = x[at : at + 256]
            y = np.multiply(part, a, out=room[: len(part)])
            y += b
            np.minimum(row, y.min(axis=0), out=row)
    return out.astype(np.uint64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of BITS bits, as signed 64-bit words: every (position, sample) flips one bit."""
    return np.concatenate([_parities(samples[at : at + ROWS]) for at in range(0, max(len(samples), 1), ROWS)])


def _parities(samples: np.ndarray) -> np.ndarray:
    n, k = samples.shape
    bit = mix64(samples ^ keyed(k, 5)) % np.uint64(BITS)
    flat = (np.arange(n, dtype=np.int64)[:, None] * BITS + bit.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1).view(np.int64).reshape(n, BITS // 64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key a band; the band's number is part of the key."""
    weights = keyed(BAND, 9) | np.uint64(1)
    first = samples[:, : BANDS * BAND].reshape(len(samples), BANDS, BAND)
    return mix64((first * weights).sum(axis=2, dtype=np.uint64) + keyed(BANDS, 10)).view(np.int64)


def similarity_of_bits(differing: float) -> float:
    """Similarity that so many differing bits stand for: d changed samples leave BITS/2 (1 - exp(-4 d / BITS)) bits."""
    x = max(1 - 2 * differing / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * float(np.log(x))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())


def signatures(docs: DataFrame, width: int, seed: int = 1) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: set size, 128-bit fingerprint of the set, band keys and odd sketch."""

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in slices(texts, RUN):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(texts.slice(i, j - i).cast(pa.binary()).to_pylist(), width)
                    samples = minhash(sets, seed)
                    prints = np.array([[mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), _lists(band_keys(samples)), _lists(odd_sketch(samples))], schema=_SIGNED)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``(id, items)``: the whole shingle sets of the documents in ``ids(id)``."""

    def items(batches):
        for batch in batches:
            for i, j in slices(batch.column(1), RUN):
                sets = shingle_sets(batch.column(1).slice(i, j - i).cast(pa.binary()).to_pylist(), width)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, np.concatenate(sets).view(np.int64))], names=["id", "items"])
        give_back()

    wanted = ids.select(F.col("id").alias("doc_id"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi").mapInArrow(items, "id long, items array<long>")


def _alike(x: str, y: str) -> Column:
    """Sketches and set sizes leave a similarity of the threshold possible."""
    bits = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(BITS // 64)), F.lit(0))
    return bits <= MOST_BITS


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes and odd sketches allow the threshold."""
    side = classes.select(F.col("rep"), "n_shingles", "sketch")
    joined = pairs.join(side.alias("x"), F.col("a") == F.col("x.rep")).join(side.alias("y"), F.col("b") == F.col("y.rep"))
    size = 100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles")
    return joined.where(size & _alike("x", "y")).select("a", "b").distinct()


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the candidate pairs, those whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = materialise(full_sets(docs, ids, width), "sets")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("xs")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("ys")), "b")
    both = joined.select("a", "b", F.size(F.array_intersect("xs", "ys")).cast("long").alias("both"), (F.size("xs") + F.size("ys")).cast("long").alias("all"))
    return both.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b")


def _compare_blocks(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one block against another that are in different components and have near sketches."""
    kind, i, j = key[1], key[2], key[3]
    if kind == "x":
        x, y = rows[rows.major], rows[~rows.major]
    else:
        x, y = rows[rows.block == i], rows[rows.block == j]
    if not len(x) or not len(y):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    bits = np.zeros((len(x), len(y)), np.uint16)
    for u, v in zip(np.stack(x.sketch.to_list()).T.astype(np.int64), np.stack(y.sketch.to_list()).T.astype(np.int64), strict=True):
        bits += np.bitwise_count((u[:, None] ^ v[None, :]).view(np.uint64))
    left, right = np.nonzero((bits <= MOST_BITS) & (x.comp.to_numpy()[:, None] != y.comp.to_numpy()[None, :]))
    band = int(rows.band.iloc[0])
    if band and len(left):  # a pair that shares an earlier band meets in that band's bucket
        earlier = np.stack(x.bands.to_list())[left, :band] == np.stack(y.bands.to_list())[right, :band]
        left, right = left[~earlier.any(axis=1)], right[~earlier.any(axis=1)]
    a, b = x.rep.to_numpy()[left], y.rep.to_numpy()[right]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _across(buckets: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs that a bucket's first document has not settled.

    The first round compared every member with the bucket's smallest id.  Left are pairs of other members that are
    still in different components; members of one component need no comparison.  Small buckets meet by a join, larger
    ones in bounded blocks: those of the bucket's largest component against the rest, and the rest against itself.
    """
    rest = buckets.where("rep <> centre").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    rest = rest.select("key", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    parts = rest.groupBy("key", "comp").agg(F.count("*").alias("n"))
    stats = parts.groupBy("key").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    sketches = classes.select("rep", "n_shingles", "sketch", "bands")
    left = materialise(rest.join(stats, "key").join(sketches, "rep"), "unsettled")
    small = left.where(F.col("total") <= SMALL)
    joined = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")))
    near = joined.where(_alike("x", "y")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    large = left.where(F.col("total") > SMALL).withColumn("major", F.col("comp") == F.col("main"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    large = large.withColumn("mains", blocks(F.col("most"))).withColumn("others", F.greatest(blocks(F.col("total") - F.col("most")), F.lit(1)))
    large = large.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("major"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("others") - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    cells = F.when(F.col("major"), F.transform(others, lambda j: cell("x", F.col("block"), j))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: cell("x", i, F.col("block"))), F.transform(others, lambda j: cell("m", F.least(j, F.col("block")), F.greatest(j, F.col("block")))))
    )
    kept = ["key", "band", "rep", "comp", "sketch", "bands", "major", "block"]
    tasks = large.select(*kept, F.explode(cells).alias("cell")).select(*kept, "cell.*")
    return near.unionByName(tasks.groupBy("key", "kind", "i", "j").applyInPandas(_compare_blocks, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, seed: int = 1) -> DataFrame:
    """Groups of documents whose sets of distinct ``width``-word shingles have similarity of ``percent`` per cent.

    ``docs`` has ``doc_id`` (a key) and ``text``; other columns are ignored.  Returns one row per row of ``docs``:
    ``doc_id, n_shingles, component_id, kept``.  Words are runs free of ASCII white space with A-Z in lower case.

    Equal sets collapse to one class first (a third of all rows may be copies).  Classes meet in MinHash bands: each
    is compared with the smallest id of every bucket, then those still in different components with each other, so
    copies of copies never become all pairs.  Candidates pass the XOR population count of their odd sketches and are
    confirmed on whole shingle sets; no bucket is capped.

    Cases: a null or empty text, or one of spaces, has an empty set, links with nothing and is kept; fewer words than
    ``width`` form one shingle; a null ``doc_id`` links with nothing, has no component and is kept; rows that repeat
    an id and text get the same answer; an empty table gives an empty result; a text of any length is taken whole.
    """
    if percent < 80:
        raise ValueError("bands and the bound on differing bits are made for a similarity of 80 per cent or more")
    docs = bound_batches(docs).select("doc_id", "text")
    signed = materialise(signatures(docs, width, seed), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(some.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    members = classes.select(F.posexplode("bands").alias("band", "key"), "rep")
    shared = members.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    buckets = materialise(members.join(shared, "key"), "buckets")
    stars = _near(buckets.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), classes, percent)
    edges = materialise(_confirm(materialise(stars, "stars"), docs, width, percent), "links")
    labels = materialise(connected_components(edges), "labels")
    more = materialise(_near(_across(buckets, labels, classes), classes, percent), "across")
    if not more.isEmpty():
        late = materialise(_confirm(more, docs, width, percent), "links")
        if not late.isEmpty():
            known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
            labels = materialise(connected_components(known.unionByName(late)), "labels")
    of_class = classes.select("f1", "f2", "n_shingles", "rep").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("group_id"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
