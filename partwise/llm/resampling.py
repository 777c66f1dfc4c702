"""Importance resampling towards a target: hashed word windows of both sides, gains of buckets, seeded Gumbel draws.

Words come from the ``tokenizers`` library: its Regex Split pre-tokenizer, which has nothing to train, over text whose A-Z
are lower-cased.  A window of k words is the pair of the first word's start and the last one's end in the words joined by
one space.  Texts are split once: a table in the shared folder holds the buckets of each document's windows, and both the
histogram and the weights read that.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_totals
from .storage import materialise
from .words import parts, slices

#: Fixed value: what stands in a word (after lower-casing): ASCII digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are split in one call; a longer text is read in pieces that end at white space.
_RUN = 1 << 20
#: Distinct features whose buckets a worker remembers.
_REMEMBERED = 200_000


@lru_cache(maxsize=1)
def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD), "removed", invert=True)


def split_words(text: str | None) -> list[str]:
    """Words of a whole text, A-Z lower-cased."""
    if not text:
        return []
    low = pc.ascii_lower(pa.scalar(text)).as_py()
    if len(low) <= _RUN:
        return [w for w, _ in splitter().pre_tokenize_str(low)]
    return [w for piece in parts(low.encode(), _RUN) for w, _ in splitter().pre_tokenize_str(piece.decode())]


def windows(words: list[str], longest: int) -> list[str]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space: slices between offset pairs."""
    if longest == 1:
        return words
    ends = np.cumsum([len(w) + 1 for w in words]).tolist() if words else []
    starts = [0, *ends]
    joined = " ".join(words)
    return [joined[starts[i] : ends[i + k - 1] - 1] for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


class BucketsOf:
    """Buckets of features: unsigned crc32 of the UTF-8 bytes modulo their number; distinct features are hashed once."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, features: list[str]) -> np.ndarray:
        coded = pa.array(features, pa.string()).dictionary_encode()
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        known, own = self.known, []
        for f in coded.dictionary.to_pylist():
            at = known.get(f)
            if at is None:
                at = known[f] = zlib.crc32(f.encode()) % self.buckets
            own.append(at)
        return np.array(own, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(features) else np.empty(0, np.int64)


def feature_buckets(docs: DataFrame, keys: list[str], longest: int, buckets: int) -> DataFrame:
    """``keys, n_words, n_features, found``: the sorted buckets of all windows of ``text``, 16 or 32 bits each."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    schema = docs.select(*keys).withColumns({"n_words": F.lit(0).cast("long"), "n_features": F.lit(0).cast("long"), "found": F.lit(None).cast("binary")}).schema

    def split(batches):
        of = BucketsOf(buckets)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i, j in slices(texts, _RUN):
                words = [split_words(t) for t in texts.slice(i, j - i).to_pylist()]
                features = [windows(w, longest) for w in words]
                flat = of([f for x in features for f in x])
                sizes = np.array([len(x) for x in features], np.int64)
                order = np.lexsort((flat, np.repeat(np.arange(len(sizes)), sizes)))
                raw, ends = flat[order].astype(width).tobytes(), np.cumsum(sizes) * np.dtype(width).itemsize
                found = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                kept = batch.slice(i, j - i).columns[:-1]
                columns = [*kept, pa.array([len(w) for w in words], pa.int64()), pa.array(sizes), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keys, F.col("text").cast("string")).mapInArrow(split, schema)


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket: every task adds up its rows, so a few numbers a bucket and task are shuffled."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=buckets)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["bucket", "n"])

    summed = found.select("found").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # at most ``buckets`` rows, whatever the input
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of the target's share of a bucket to the source's)."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((int(b) + 1) * (s + n)) / float((int(a) + 1) * (t + n)))) for a, b in zip(source, target, strict=True)], np.int64)


def weigh(found: DataFrame, keys: list[str], gains: np.ndarray) -> DataFrame:
    """``keys, n_words, n_features, weight``: the mean gain of a document's features, rounded down; 0 without features."""
    width = "<u2" if len(gains) <= 1 << 16 else "<u4"
    schema = found.drop("found").withColumn("weight", F.lit(0).cast("long")).schema

    def add(batches):
        for batch in batches:
            sums = [int(gains[np.frombuffer(x.as_buffer(), width)].sum()) if x.as_py() else 0 for x in batch.column(batch.num_columns - 1)]
            sizes = batch.column(batch.num_columns - 2).to_pylist()
            weights = pa.array([a // n if n else 0 for a, n in zip(sums, sizes, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], weights], names=schema.names)

    return found.select(*keys, "n_words", "n_features", "found").mapInArrow(add, schema)


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``: importance resampling of ``docs`` towards ``target``.

    The weight is the mean gain of a document's windows of 1 to ``longest`` words over ``buckets`` hashed buckets; the
    score adds Gumbel noise keyed by ``seed`` and id.  Of the N documents with at least ``least_words`` words the
    floor(percent * N / 100) highest scores are drawn and ranked from 1, ties to the smaller id; others have a null rank.
    Counts cover all rows; ranks come from ranges of scores in many tasks.

    Cases: a null or empty text has no features, weight 0 and no rank; a text of any length is split whole; a null
    ``doc_id`` is hashed like an empty one and ranked before other ids of its score; rows that repeat an id have its
    noise and each a rank of its own; an empty ``target`` or empty ``docs`` give gains from the smoothing alone (and no
    rows); other columns are dropped.
    """
    own = materialise(feature_buckets(docs, ["doc_id"], longest, buckets), "buckets")
    gains = bucket_gains(histogram(own, buckets), histogram(feature_buckets(target, [], longest, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialise(weigh(own, ["doc_id"], gains).withColumn("score", F.col("weight") + noise), "scored")
    fit = F.col("n_words") >= least_words
    quota = scored.where(fit).count() * percent // 100
    # rows that are equal in all columns are one row with a count, so no run of repeated rows has to fit in a task
    copies = scored.where(fit).groupBy("doc_id", "n_features", "weight", "score").agg(F.count("*").alias("copies"))
    ranked = running_totals(copies, [], [F.desc("score"), "doc_id", "n_features", "weight"], ["copies"])
    block = 1_000_000
    blocks = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))).alias("block"))
    each = blocks.select("*", F.explode(F.sequence(F.col("block") * block + 1, F.least("copies", (F.col("block") + 1) * block))).alias("copy"))
    place = F.col("below_copies") + F.col("copy")
    drawn = each.select("doc_id", "n_features", "weight", "score", F.when(place <= quota, place).alias("rank"))
    return drawn.unionByName(scored.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
