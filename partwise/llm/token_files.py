"""Token-id files with keyed access: raw id payloads and a minimal perfect hash index.

A file holds the documents of one range of keys, in ascending order::

    magic  b"PWTOKEN1"
    ids    the documents' token ids, one after another, unsigned little-endian of ``width`` bytes
    index  bit levels, ranks, fingerprints, offsets, keys (arrays described by the header)
    header JSON: document count, id count, width, place and type of every array
    tail   header length (unsigned 64-bit little-endian), magic
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import running_least, running_totals
from .storage import bound_batches, open_fs, shared_path, write_atomically
from .tokens import chunk_ids
from .words import give_back, keyed, mix64

MAGIC = b"PWTOKEN1"
#: Positions of a level for each key that is still without a place.
GAMMA = 2.0
LEVELS = 64


def _spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys + keyed(1, 100 + level)[0]) % np.uint64(size)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys ^ keyed(1, 99)[0]) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each key alone at its spot on one level.

    A key's number is the count of set bits before its spot, over all levels: 0 to n - 1, each used once.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum([-(-s // 64) for s in sizes])]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys.astype(np.uint64), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(GAMMA * len(left)))
            spots = _spots(left, len(sizes), size).astype(np.int64)
            alone = np.bincount(spots, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[:size] = alone
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[spots]]
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, "<u8"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some (not all) keys that are not in the set."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            spot = _spots(keys[open_], level, size).astype(np.int64)
            word, bit = self.starts[level] + spot // 64, (spot % 64).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[here]] = (self.ranks[word] + np.bitwise_count(below))[here]
            open_ = open_[~here]
        return out


def write_file(stream, keys: list[int | None], counts, payloads, width: int) -> None:
    """Write documents in the order given (ascending keys, nulls first); ``payloads`` yields their packed ids.

    ``keys`` and ``counts`` are read after the payloads, so a generator may fill them meanwhile.
    """
    stream.write(MAGIC)
    for payload in payloads:
        stream.write(payload)
    counts = np.asarray(counts, np.int64)
    known = np.array([k is not None for k in keys], bool)
    plain = np.array([k or 0 for k in keys], np.int64)
    ends = np.cumsum(counts)
    first = known & np.concatenate([[True], (plain[1:] != plain[:-1]) | ~known[:-1]])[: len(keys)]
    distinct = plain[first].view(np.uint64)
    table = PerfectHash.build(distinct)
    number = table.numbers(distinct)
    arrays = {"keys": plain, "known": known.astype(np.uint8), "counts": counts.astype("<i8"), "levels": table.words.astype("<u8")}
    for name, values in (("prints", fingerprints(distinct)), ("rows", np.flatnonzero(first).astype("<u4"))):
        slot = np.empty(len(values), values.dtype)
        slot[number] = values
        arrays[name] = slot
    arrays["offsets"] = np.concatenate([[0], ends]).astype("<i8")
    places, at = {}, len(MAGIC) + width * int(ends[-1] if len(ends) else 0)
    for name, values in arrays.items():
        places[name] = (at, len(values), values.dtype.str)
        stream.write(values.tobytes())
        at += values.nbytes
    header = json.dumps({"documents": len(keys), "ids": int(ends[-1]) if len(ends) else 0, "width": width, "sizes": table.sizes, "arrays": places}).encode()
    stream.write(header + struct.pack("<Q", len(header)) + MAGIC)


class TokenFile:
    """One file opened for reading: by key in constant time, or in order."""

    def __init__(self, path: str):
        system, name = open_fs(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.head = json.loads(self.file.read_at(n, size - 16 - n))
        array = {k: np.frombuffer(self.file.read_at(c * np.dtype(t).itemsize, at), t) for k, (at, c, t) in self.head["arrays"].items()}
        self.keys, self.known, self.counts, self.offsets = array["keys"], array["known"].astype(bool), array["counts"], array["offsets"]
        self.prints, self.rows = array["prints"], array["rows"]
        self.index = PerfectHash(self.head["sizes"], array["levels"])
        self.width = self.head["width"]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key's (first) document, -1 where the fingerprint tells that the key is absent."""
        unsigned = np.asarray(keys, np.int64).view(np.uint64)
        number = self.index.numbers(unsigned)
        out = np.full(len(number), -1, np.int64)
        there = np.flatnonzero(number >= 0)
        same = self.prints[number[there]] == fingerprints(unsigned[there])
        out[there[same]] = self.rows[number[there[same]]]
        return out

    def ids(self, row: int, after: int | None = None) -> np.ndarray:
        """The ids of the documents from ``row`` up to ``after`` (one document if not given)."""
        a, b = self.offsets[row], self.offsets[row + 1 if after is None else after]
        return np.frombuffer(self.file.read_at(int(b - a) * self.width, len(MAGIC) + int(a) * self.width), f"<u{self.width}")

    def get(self, key: int) -> np.ndarray | None:
        row = int(self.find(np.array([key]))[0])
        return None if row < 0 else self.ids(row)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, file_bytes: int = 64 << 20) -> tuple[str, DataFrame]:
    """Encode ``docs(doc_id, text)`` and write them in ascending ``doc_id`` order as token files below a new folder.

    Texts are range-partitioned by key before they are encoded, so that each is encoded once, in the task that
    writes its file; ids go to the file as they are made, the index follows them.  Returns the folder and its manifest
    table: ``file, path, first_key, documents, ids`` and ``base`` (the ids of all files before it).
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    some = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // file_bytes), min(size // (1 << 20), spark.sparkContext.defaultParallelism))
    # rows that share id and text are equal, so any of them may stand first; their number splits a hot key
    order = [F.col("doc_id").asc_nulls_first(), F.col("print_"), F.col("copy_")]
    ranged = some.withColumns({"print_": F.xxhash64("text"), "copy_": F.pmod(F.monotonically_increasing_id(), F.lit(4096))}).repartitionByRange(files, *order)
    ordered = ranged.sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        store = chunk_ids(tokenizer_path)
        width = 2 if store.tokenizer.get_vocab_size() <= 65_536 and end_id < 65_536 else 4
        keys, counts = [], []
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return

        def payloads():
            """Packed ids, one run after another; keys and counts fill up as they are written."""
            for batch in chain([first], batches):
                keys.extend(batch.column(0).to_pylist())
                for _, ids, sizes in store.runs(batch.column(1), end_id):
                    counts.extend(sizes.tolist())
                    yield ids.astype(f"<u{width}").tobytes()
            store.forget()
            give_back()

        number = TaskContext.get().partitionId()
        path = f"{folder}/{number:06d}.tok"
        write_atomically(path, lambda out: write_file(out, keys, counts, payloads(), width))
        yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int64()), "path": [path], "first_key": pa.array([keys[0]], pa.int64()), "documents": [len(keys)], "ids": [sum(counts)]})

    manifest = f"{folder}/manifest"
    ordered.mapInArrow(write, "file long, path string, first_key long, documents long, ids long").write.parquet(manifest)
    return folder, running_totals(spark.read.parquet(manifest), [], ["file"], ["ids"]).withColumnRenamed("below_ids", "base")


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, found boolean"


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of the files of a manifest: ``doc_id, start, n_tokens, ids_crc32`` and ``found``.

    The first document of a key is fetched at the row to which the index leads (``found``), and a key that is not
    found there is an error; repeated and null keys are read at their place in the file.
    """

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for a in range(0, len(file.keys), 4096):
                    b = min(a + 4096, len(file.keys))
                    place, keys, known = np.arange(a, b), file.keys[a:b], file.known[a:b]
                    first = known & ((place == 0) | (keys != file.keys[place - 1]) | ~file.known[place - 1])
                    place[first] = file.find(keys[first])
                    if (place < 0).any() or (file.keys[place] != keys).any():
                        raise ValueError(f"the index of {path} does not lead to key {keys[(place < 0) | (file.keys[place] != keys)][0]}")
                    crcs, i = [], 0
                    breaks = np.append(np.flatnonzero(np.diff(place) != 1) + 1, len(place)).tolist()
                    for stop in breaks:
                        while i < stop:  # documents that the index puts side by side, of about a million ids, are one read
                            at = int(place[i])
                            end = max(at + 1, min(at + stop - i, int(np.searchsorted(file.offsets, file.offsets[at] + (1 << 20), "right")) - 1))
                            run = file.ids(at, end).astype("<u4")
                            cuts = (file.offsets[at : end + 1] - file.offsets[at]).tolist()
                            crcs += [zlib.crc32(run[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                            i += end - at
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=~known), pa.array(file.offsets[place] + base), pa.array(file.counts[place]), pa.array(crcs, pa.int64()), pa.array(first)], names=["doc_id", "start", "n_tokens", "ids_crc32", "found"])

    spread = manifest.select("path", "base")
    return spread.repartition(max(1, spread.sparkSession.sparkContext.defaultParallelism), "path").mapInArrow(read, _READ)


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: for ``keys(doc_id)``, ``doc_id, ids`` of each key's first document; absent keys give no row.

    A key may stand at the end of the last file that starts below it, or in the first that starts with it.  The former is
    a running maximum over keys and files' first keys in order, by ranges in many tasks; from there the index leads.
    """
    asked = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    starts = manifest.where("first_key is not null").groupBy(F.col("first_key").alias("doc_id")).agg(F.min("file").alias("file"), F.max("file").alias("last"))
    marks = starts.select("doc_id", F.lit(1).alias("kind"), (-F.col("last")).alias("back"))
    both = asked.select("doc_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("back")).unionByName(marks)
    below = running_least(both, [], ["doc_id", "kind"], "back").where("kind = 0 and least_back is not null").select("doc_id", (-F.col("least_back")).alias("file"))
    routed = below.unionByName(asked.join(starts.select("doc_id", "file"), "doc_id")).join(manifest.select("file", "path"), "file")

    def fetch(batches):
        opened: dict[str, TokenFile] = {}
        for batch in batches:
            rows = []
            for path, key, number in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if path not in opened:
                    opened = {path: TokenFile(path)}
                ids = opened[path].get(key)
                if ids is not None:
                    rows.append((number, key, ids.astype(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "doc_id", "ids"])

    sorted_ = routed.select("path", "doc_id", "file").repartition("path").sortWithinPartitions("path", "doc_id")
    fetched = sorted_.mapInArrow(fetch, "file long, doc_id long, ids array<long>")
    return fetched.groupBy("doc_id").agg(F.min_by("ids", "file").alias("ids"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files and read every document back from them.

    Cases: a null or empty text is its end id alone; rows that repeat a key are stored one after another, the index
    leads to the first; null keys come first and are not indexed; other columns are dropped; a text of any length is
    encoded whole; an empty table writes no file and gives an empty result.
    """
    _, manifest = write_token_files(docs, tokenizer_path, end_id)
    return read_documents(manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "found")
