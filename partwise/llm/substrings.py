"""Removal of passages that stand earlier in the corpus: a count-min prefilter, then exact groups of what it lets through.

Pass one hashes every window of ``width`` consecutive words into a count-min sketch.  Tasks send the cells that their
windows touch, once or more often; parts of the sketch are merged in many tasks, and a merged cell only says whether its
count is two or more.  A count is never estimated too low, so a window whose cells are not all set occurs once and is done.
Pass two hashes the windows again and sends only those that are estimated repeated: their 96-bit hashes are grouped by
ranges of the hash, and all but the first occurrence of each are removed.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import joined_back
from .storage import open_fs, shared_path
from .words import mix64, parts, slices, word_hashes

#: Cells of all rows of the sketch together: four a word, up to a sketch of 128 MB.  Beyond it more windows pass the filter
#: than are repeated; results stay the same.
MAX_CELLS = 1 << 30
ROWS = 2
#: Windows that a task gathers before it sends them.
FLUSH = 1_000_000
#: Cells of a part of the sketch that is merged by itself.
SEGMENT = 1 << 23
_STEP = 1 << 19
_RUN = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.full(n, np.uint64(b)), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))


def _rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every window of ``width`` word hashes: sums of powers, taken apart and shifted to the same power."""
    up, down = _powers(base, _STEP + width)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
        return mix64((sums[width:] - sums[:-width]) * down[: len(words) - width + 1])


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int):
    """Two 64-bit hashes, text number and first word of every window that lies in one text, in steps of bounded size."""
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(words) - width + 1, _STEP):
        own = words[at : at + _STEP + width - 1]
        n = len(own) - width + 1
        inside = np.flatnonzero(text[at : at + n] == text[at + width - 1 : at + width - 1 + n])
        h1, h2 = (_rolling(own, width, b)[inside] for b in _BASES)
        which = text[at + inside]
        yield h1, h2, which, at + inside - first[which]


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each window in a row of 2 ** ``bits`` cells."""
    with np.errstate(over="ignore"):
        return (mix64(h + np.uint64(row) * np.uint64(_BASES[0])) >> np.uint64(64 - bits)).astype(np.int64)


def _pack(places: np.ndarray) -> bytes:
    """Rising places as compressed steps, byte by byte."""
    raw = np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(places).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    steps = pa.decompress(raw[4:], 4 * n, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(steps, np.uint8).reshape(4, n).T.copy().view("<u4").ravel(), dtype=np.int64)


def _texts(batches):
    """Rows of (doc_id, text, key) in runs of bounded bytes: ids, keys and UTF-8 texts (null: empty)."""
    for batch in batches:
        for i, j in slices(batch.column(1), _RUN):
            run = batch.slice(i, j - i)
            yield run.column(0), run.column(2), [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in run.column(1)]


def _touched(hashes: list[np.ndarray], bits: int):
    """Rows (row, segment, once, often): the cells that windows touch, and those that they touch twice or more."""
    h = np.concatenate(hashes)
    for row in range(ROWS):
        at = np.sort(cells(h, row, bits))
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        once, often = at[new], at[new][np.diff(np.append(new, len(at))) > 1]
        segments = np.unique(once // SEGMENT)
        cut = lambda x: [_pack(x[a:b] - s * SEGMENT) for s, a, b in zip(segments, np.searchsorted(x, segments * SEGMENT), np.searchsorted(x, (segments + 1) * SEGMENT), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([row] * len(segments), pa.int32()), pa.array(segments, pa.int32()), pa.array(cut(once), pa.binary()), pa.array(cut(often), pa.binary())], names=["row", "segment", "once", "often"])


def build_sketch(docs: DataFrame, width: int, bits: int) -> str:
    """The merged sketch as a table (row, segment, a bit for each cell counted twice or more) in the shared folder."""

    def touch(batches):
        held, n = [], 0
        for _, _, texts in _texts(batches):
            for h, _, _, _ in window_hashes(*word_hashes(texts, False), width):
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield from _touched(held, bits)
                    held, n = [], 0
        if n:
            yield from _touched(held, bits)

    def merge(batches):
        size, seen = min(SEGMENT, 1 << bits), {}
        for batch in batches:
            for row, segment, once, often in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                one, two = seen.setdefault((row, segment), (np.zeros(size, bool), np.zeros(size, bool)))
                at = _unpack(once)
                two[at[one[at]]] = True
                one[at] = True
                two[_unpack(often)] = True
        for (row, segment), (_, two) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([segment], pa.int32()), pa.array([np.packbits(two).tobytes()], pa.binary())], names=["row", "segment", "bits"])

    path = shared_path(docs.sparkSession, "sketch")
    many = ROWS * max(1, (1 << bits) // SEGMENT)
    touched = docs.mapInArrow(touch, "row int, segment int, once binary, often binary")
    touched.repartition(many, "row", "segment").mapInArrow(merge, "row int, segment int, bits binary").write.parquet(path)
    return path


@lru_cache(maxsize=1)
def read_sketch(path: str, bits: int) -> np.ndarray:
    """The sketch of the shared folder, read once by each worker: at most MAX_CELLS bits."""
    system, name = open_fs(path)
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    step = min(SEGMENT, 1 << bits) // 8
    for file in system.get_file_info(fs.FileSelector(name)):
        if file.base_name.endswith(".parquet"):
            with system.open_input_file(file.path) as source:
                for row, segment, found in zip(*[c.to_pylist() for c in pq.read_table(source, columns=["row", "segment", "bits"]).columns], strict=True):
                    out[row, segment * step : (segment + 1) * step] = np.frombuffer(found, np.uint8)
    return out


def repeated(sketch: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch estimates two or more occurrences."""
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        at = cells(h, row, bits)
        out &= (sketch[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


class Occurrences:
    """Windows (hash, document, first word) beside the table of their documents (id or null, key of the text)."""

    _KINDS = (("h1", "<u8"), ("h2", "<u4"), ("doc", "<u4"), ("start", "<u4"))

    def __init__(self, h1, h2, doc, start, ids, known, keys):
        self.h1, self.h2, self.doc, self.start, self.ids, self.known, self.keys = h1, h2, doc, start, ids, known, keys

    def take(self, at) -> Occurrences:
        return Occurrences(self.h1[at], self.h2[at], self.doc[at], self.start[at], self.ids, self.known, self.keys)

    def later(self) -> np.ndarray:
        """Whether an equal window starts earlier here: at a smaller id (null: after all) or in one document further left."""
        by_id = np.lexsort((self.ids, ~self.known))
        change = (np.diff(self.ids[by_id]) != 0) & self.known[by_id][1:] | (np.diff(self.known[by_id].astype(np.int8)) != 0)
        rank = np.empty(len(self.ids), np.int64)
        rank[by_id] = np.concatenate([[0], np.cumsum(change)])[: len(by_id)]
        place = (rank[self.doc] << 32) | self.start
        order = np.lexsort((place, self.h2, self.h1))
        a, b = self.h1[order], self.h2[order]
        heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
        first = np.repeat(place[order][heads], np.diff(np.append(heads, len(order))))
        out = np.empty(len(order), bool)
        out[order] = place[order] > first
        return out

    def one_per_document(self) -> Occurrences:
        """The same windows beside a table that holds each document once."""
        order = np.lexsort((self.keys, self.ids, self.known))
        same = [x[order][1:] == x[order][:-1] for x in (self.keys, self.ids, self.known)]
        new = np.concatenate([[True], ~(same[0] & same[1] & same[2])])[: len(order)]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        kept = order[new]
        return Occurrences(self.h1, self.h2, place[self.doc], self.start, self.ids[kept], self.known[kept], self.keys[kept])

    def starts_by_document(self) -> tuple[np.ndarray, pa.Array]:
        """Documents that hold windows, and their windows' first words as 32-bit integers."""
        order = np.argsort(self.doc, kind="stable")
        doc, start = self.doc[order], self.start[order].astype("<u4")
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
        ends = np.append(heads, len(doc)).astype("<i4") * 4
        return doc[heads].astype(np.int64), pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(start.tobytes())])

    def blob(self) -> bytes:
        """All of it, compressed, with the documents that occur alone."""
        used, doc = np.unique(self.doc, return_inverse=True)
        self = Occurrences(self.h1, self.h2, doc.astype("<u4"), self.start, self.ids[used], self.known[used], self.keys[used])
        columns = [getattr(self, k).astype(t) for k, t in self._KINDS] + [np.diff(self.ids, prepend=0), self.known, self.keys]
        planes = [x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns]
        raw = b"".join(planes)
        return len(self.h1).to_bytes(4, "little") + len(used).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def from_blobs(cls, blobs: list[bytes]) -> Occurrences:
        told, base = [[] for _ in range(7)], 0
        for blob in blobs:
            n, m, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little"), int.from_bytes(blob[8:16], "little")
            raw, at = pa.decompress(blob[16:], size, "zstd", asbytes=True), 0
            for k, (t, many) in enumerate([*[(t, n) for _, t in cls._KINDS], ("<i8", m), ("?", m), ("<i8", m)]):
                wide = np.dtype(t).itemsize
                told[k].append(np.frombuffer(raw, np.uint8, many * wide, at).reshape(wide, many).T.copy().view(t).ravel())
                at += many * wide
            told[2][-1] = told[2][-1] + np.uint32(base)
            told[4][-1] = np.cumsum(told[4][-1])
            base += m
        return cls(*[np.concatenate(x) for x in told])


_FOUND = pa.schema([("bucket", pa.int32()), ("windows", pa.binary()), ("part", pa.int32()), ("decided", pa.binary())])


def _decided(found: Occurrences, parts_: int) -> tuple[list[int], list[bytes]]:
    """Windows that go, packed by part of the documents: a hash of id and text says which."""
    with np.errstate(over="ignore"):
        own = mix64(mix64(found.ids.astype(np.uint64)) + found.keys.astype(np.uint64)) >> np.uint64(32)
    part = (own * np.uint64(parts_) >> np.uint64(32)).astype(np.int64)[found.doc]
    order = np.lexsort((found.start, found.doc, part))
    edges = np.searchsorted(part[order], np.arange(parts_ + 1))
    there = np.flatnonzero(np.diff(edges)).tolist()
    none = np.zeros(len(found.h1), np.uint64)
    bare = Occurrences(none, none, found.doc, found.start, found.ids, found.known, found.keys)
    return there, [bare.take(order[edges[p] : edges[p + 1]]).blob() for p in there]


def _sent(held: list[tuple], docs: dict, buckets: int):
    """What a task sends of the windows it holds: those that one of its own precedes are decided, of the rest the first."""
    ids = np.array([i or 0 for i, _ in docs], np.int64)
    known, keys = np.array([i is not None for i, _ in docs], bool), np.array([k for _, k in docs], np.int64)
    h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
    all_ = Occurrences(h1, h2, doc, start, ids, known, keys)
    later = all_.later()
    bucket = ((h1 >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    through, decided = _decided(all_.take(later), buckets)
    if through:
        yield pa.RecordBatch.from_arrays([pa.array(through, pa.int32()), pa.nulls(len(through), pa.binary()), pa.array(through, pa.int32()), pa.array(decided, pa.binary())], schema=_FOUND)
    rest = np.flatnonzero(~later)
    rest = rest[np.lexsort((start[rest], doc[rest], bucket[rest]))]
    edges = np.searchsorted(bucket[rest], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        blob = all_.take(rest[edges[b] : edges[b + 1]]).blob()
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], schema=_FOUND)


def removed_windows(docs: DataFrame, width: int, sketch: str, bits: int, buckets: int) -> DataFrame:
    """``doc_id, key, starts``: the windows of each document that start earlier elsewhere, as 32-bit integers."""

    def look_up(batches):
        cells_ = read_sketch(sketch, bits)
        held, known, n = [], {}, 0
        for ids, keys, texts in _texts(batches):
            words, counts = word_hashes(texts, False)
            place = np.zeros(len(texts), np.int64)
            for i, row in enumerate(zip(ids.to_pylist(), keys.to_pylist(), strict=True)):
                # a row that repeats id and text has the same windows at the same places: they are held once
                place[i] = -1 if counts[i] < width or row in known else known.setdefault(row, len(known))
            for h1, h2, which, start in window_hashes(words, counts, width):
                at = np.flatnonzero((place[which] >= 0) & repeated(cells_, h1, bits))
                held.append((h1[at], (h2[at] >> np.uint64(32)).astype(np.uint32), place[which[at]].astype(np.uint32), start[at].astype(np.uint32)))
                n += len(at)
            if n >= FLUSH:
                yield from _sent(held, known, buckets)
                held, known, n = [], {}, 0
        if n:
            yield from _sent(held, known, buckets)

    def decide(rows: pa.Table) -> pa.Table:
        done = rows.filter(pc.is_valid(rows.column("decided"))).select(["part", "decided"])
        blobs = [x for x in rows.column("windows").to_pylist() if x is not None]
        if not blobs:
            return done
        found = Occurrences.from_blobs(blobs)
        part, decided = _decided(found.take(found.later()), buckets)
        return pa.concat_tables([done, pa.table({"part": pa.array(part, pa.int32()), "decided": pa.array(decided, pa.binary())})])

    def gather(rows: pa.Table) -> pa.Table:
        found = Occurrences.from_blobs(rows.column("decided").to_pylist()).one_per_document()
        docs_, starts = found.starts_by_document()
        return pa.table({"doc_id": pa.array(found.ids[docs_], pa.int64(), mask=~found.known[docs_]), "key": pa.array(found.keys[docs_], pa.int64()), "starts": starts})

    sent = docs.mapInArrow(look_up, "bucket int, windows binary, part int, decided binary")
    decided = sent.groupBy("bucket").applyInArrow(decide, "part int, decided binary")
    return decided.groupBy("part").applyInArrow(gather, "doc_id long, key long, starts binary")


def keep_words(text: bytes, starts: np.ndarray, width: int) -> tuple[int, int, str]:
    """Words, removed words, and the SHA-256 of the words left, joined by one space."""
    digest, n, gone, empty = hashlib.sha256(), 0, 0, True
    starts = np.sort(starts)
    for piece in parts(text):
        words = piece.split()
        own = starts[np.searchsorted(starts, n - width, "right") : np.searchsorted(starts, n + len(words))] - n
        if len(own):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, np.maximum(own, 0), 1)
            np.add.at(change, np.minimum(own + width, len(words)), -1)
            covered = (np.cumsum(change[:-1]) > 0).tolist()
            kept = [w for w, c in zip(words, covered, strict=True) if not c]
        else:
            kept = words
        n, gone = n + len(words), gone + len(words) - len(kept)
        if kept:
            digest.update((b"" if empty else b" ") + b" ".join(kept))
            empty = False
    return n, gone, digest.hexdigest()


def remove_repeats(docs: DataFrame, width: int = 20, cells_a_word: int = 4) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document after removal of repeated passages.

    Words are runs free of ASCII white space, taken as they are.  A word goes if a window of ``width`` words covers it
    whose words also stand earlier: in a document of a smaller id, or further left in the same one.  Windows are judged
    on the input.

    Cases: a null or empty text has no words (the digest is that of nothing); a text of fewer than ``width`` words
    stays; a text of any length is read in pieces; a null ``doc_id`` comes after all others, and documents without id do
    not precede each other; rows that share an id do not precede each other at the same place, so repeated rows have
    equal results; an empty table gives an empty result; other columns are dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("key"))
    # a word and its space have six bytes on average; the number only sizes the sketch and the ranges of hashes
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = max(12, (min(MAX_CELLS, cells_a_word * words) // ROWS - 1).bit_length()) if words else 12
    buckets = max(16, words // 1_000_000)
    decided = removed_windows(docs, width, build_sketch(docs, width, bits), bits, buckets)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def clean(batches):
        for batch in batches:
            told = []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                own = np.frombuffer(starts.as_py() or b"", "<u4").astype(np.int64)
                told.append(keep_words(text.as_buffer().to_pybytes() if text.is_valid else b"", own, width))
            n, gone, digest = zip(*told, strict=True) if told else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined_back(docs, decided, ["doc_id", "key"], ["starts"]).select("doc_id", "text", "starts").mapInArrow(clean, schema)
