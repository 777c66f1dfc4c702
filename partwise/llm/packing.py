"""Packing of documents into sequences: first-fit decreasing on a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, materialise
from .tokens import chunk_ids
from .words import give_back

#: Pieces that are packed together; groups are drawn by hash, so each is a random sample of all lengths.
GROUP = 8192
#: Sequence ids of group g start at g times this; a group cannot fill more sequences than it has pieces.
SPAN = 1 << 32


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, taken from the longest to the shortest (ties in the order given).

    A tournament tree holds, above the bins, the largest room of each subtree: the first bin with enough room is
    found from the root in one step a level, and the path above it is played again after the piece is placed.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            left, right = room[2 * at], room[2 * at + 1]
            top = left if left >= right else right
            if room[at] == top:
                break
            room[at] = top
    return bins, offsets


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("piece", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Every document's ids with ``end_id``, cut every ``capacity`` ids: one row a piece, numbered, optionally with its ids."""
    schema = _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES

    def cut(batches):
        store, number = chunk_ids(tokenizer_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, ids, totals in store.runs(batch.column(1), end_id):
                many = -(-totals // capacity)
                row = np.repeat(np.arange(len(totals)), many)
                start = capacity * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
                length = np.minimum(totals[row] - start, capacity)
                at = np.cumsum(length) - length
                raw = memoryview(ids.astype("<u4")).cast("B")
                own = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row + first)), start, length, [zlib.crc32(x) for x in own], totals[row], number + np.arange(len(row)), [bytes(x) for x in own] if with_ids else None]
                number += len(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=False)], schema=schema)
        store.forget()
        give_back()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long" + (", ids binary" if with_ids else "")
    return bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, kinds)


def pack(cut: DataFrame, capacity: int, seed: int = 1, group: int = GROUP) -> DataFrame:
    """``cut`` (doc_id, start, length, piece, ...; a written table) with ``sequence_id`` and ``offset`` in place of ``piece``.

    Pieces go to groups of about ``group`` by a seeded hash of their numbers, which differ between rows that repeat an id,
    and each group is packed first-fit decreasing by itself, so no task's work grows with the input; a full piece fills a
    sequence alone.
    """
    n = cut.count()
    groups = max(1, -(-n // group))
    dealt = cut.withColumn("group_", F.pmod(F.xxhash64(F.lit(seed), "piece"), F.lit(groups)))
    columns = [c for c in cut.columns if c != "piece"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "piece") + ", sequence_id long, offset long"

    def fill(key, rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("piece", "ascending")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), capacity)
        return rows.select(columns).append_column("sequence_id", pa.array(key[0].as_py() * SPAN + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("group_").applyInArrow(fill, kinds)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, seed: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.  Each id of a document,
    its end id included, lies in exactly one piece; pieces of a sequence stand one after another from offset 0.

    Cases: a null or empty text is one piece of the end id alone; a long document fills whole sequences and leaves
    one shorter piece; rows that repeat, or have no id, are packed each by itself and spread over all groups; a null
    ``doc_id`` stays null and every id keeps its bits; which pieces meet in a group depends on how the input is split; other columns are
    dropped; an empty table gives an empty result.
    """
    return pack(materialise(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, seed)
