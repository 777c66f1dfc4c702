"""SentencePiece encoding with seeded merge-dropout, and its decoding."""

from __future__ import annotations

import zlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import places
from .words import mix64, slices

SPACE = "▁"
#: Stands in units for a literal SPACE sign, which has no piece of its own.
_SIGN = "\ud800"
_MASK = 2**64 - 1
_BASE, _PLACE, _PIECE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LAST = 2**31 - 1
#: Code points below this have a table of pairs; a unit's row of code points is filled up with _FILL.
_NEAR, _FILL = 0x250, 0xFFFFFFFF
#: Units of like lengths are segmented together, longer ones one by one.
_SIZES = (0, 4, 7, 10, 14, 20, 32, 64)


class Pieces:
    """Vocabulary of a merge-type (BPE) model file with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if not all(model.id_to_piece(i) for i in range(n)) or not any(model.is_byte(i) for i in range(n)):
            raise ValueError("a model with byte fallback is needed")
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in normal}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.joined = {x for p in self.ids for x in zip(p, p[1:], strict=False)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces may hold spaces at their start only")
        self.plain = [b""] * n
        for p, i in self.ids.items():
            self.plain[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.plain[i] = bytes([b])

    def decode(self, ids) -> bytes:
        """The text of ids: pieces and bytes one after another, without the space put in front."""
        return b"".join(map(self.plain.__getitem__, ids))[1:]


def _scramble(x: int) -> int:
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & _MASK
    return x ^ x >> 32


class MergeDropout:
    """Segmentation by an agenda of merges, best score first, each skipped with a probability by a keyed hash.

    A text is cut into units where no piece of the vocabulary joins two characters.  The key of a decision is the
    seed, the document, the unit's place in its text, the merge's place in the unit and its piece: every occurrence
    draws its own skips, and equal seeds give equal ids on any partitioning.  Workers remember only each unit's plain
    segmentation and the merges it takes; an occurrence that skips none of these has it, all others are segmented anew.
    """

    def __init__(self, path: str, dropout: float, seed: int, most: int = 300_000):
        self.pieces = Pieces(path)
        self.limit = min(int(dropout * 2**64), _MASK)
        self.seed, self.most = seed, most
        self._tables()
        self.names = pa.array([], pa.string())
        self.ids, self.merges = Ragged("<u4"), Ragged(np.uint64)

    def _tables(self) -> None:
        """Symbols, pairs of symbols that merge, and the pieces' ranks (equal scores share one), as arrays."""
        ids, n = self.pieces.ids, len(self.pieces.plain)
        symbols = dict(ids)
        for x in sorted({c for p in ids for c in p}.difference(ids)):
            symbols[x] = n + len(symbols) - len(ids)
        self.unknown = n + len(symbols)
        self.width = self.unknown + 1
        self.symbol_of = np.full(0x110000, self.unknown, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        merges = {symbols[p[:k]] * self.width + symbols[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.pair_keys = np.array(sorted(merges), np.int64)
        self.pair_ids = np.array([merges[k] for k in self.pair_keys.tolist()], np.int32)
        order = {s: k for k, s in enumerate(sorted({-x for x in self.pieces.scores.values()}))}
        self.rank = np.full(n, _LAST, np.int32)
        for p, i in ids.items():
            self.rank[i] = order[-self.pieces.scores[p]]
        # In units a space is a space; the sign that pieces have for it is an ordinary character without a piece.
        self.symbol_of[ord(" ")], self.symbol_of[ord(SPACE)] = self.symbol_of[ord(SPACE)], self.unknown
        point = lambda c: ord(" ") if c == SPACE else ord(c)
        joined = [(point(x), point(y)) for x, y in self.pieces.joined]
        self.near = np.zeros((_NEAR, _NEAR), bool)
        for x, y in joined:
            if x < _NEAR and y < _NEAR:
                self.near[x, y] = True
        self.far = np.array(sorted(x << 21 | y for x, y in joined if x >= _NEAR or y >= _NEAR), np.int64)
        self.raw = pa.array(self.pieces.plain, pa.binary())

    def _joined(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether some piece of the vocabulary holds the two characters one after another."""
        out = self.near[np.minimum(x, _NEAR - 1), np.minimum(y, _NEAR - 1)]
        far = np.flatnonzero((x >= _NEAR) | (y >= _NEAR))
        wanted = x[far].astype(np.int64) << 21 | y[far]
        at = np.minimum(np.searchsorted(self.far, wanted), max(len(self.far) - 1, 0))
        out[far] = self.far[at] == wanted if len(self.far) else False
        return out

    def skipped(self, key: int, left: int, piece: int) -> bool:
        return _scramble((key ^ (left * _PLACE + piece * _PIECE)) & _MASK) < self.limit

    def segment(self, unit: str, key: int | None, taken: list | None = None) -> list[str]:
        """Pieces and left-over characters of one unit: the agenda as a heap.  Without a key nothing is skipped."""
        scores = self.pieces.scores
        symbols: list[str] = [{" ": SPACE, SPACE: _SIGN}.get(c, c) for c in unit]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                heappush(agenda, (-scores[pair], i, i + 1, pair))
        while agenda:
            _, left, right, pair = heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != pair:
                continue
            if key is not None and self.skipped(key, left, self.pieces.ids[pair]):
                continue
            if taken is not None:
                taken.append((left, self.pieces.ids[pair]))
            symbols[left], symbols[right] = pair, ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                if (new := pair + symbols[follow]) in scores:
                    heappush(agenda, (-scores[new], left, follow, new))
            if (ahead := before[left]) >= 0 and (new := symbols[ahead] + pair) in scores:
                heappush(agenda, (-scores[new], ahead, left, new))
        return [s for s in symbols if s]

    def piece_ids(self, symbols: list[str]) -> list[int]:
        """Ids of pieces; a character without a piece goes as its bytes."""
        known, bytes_ = self.pieces.ids, self.pieces.bytes
        return [i for s in symbols for i in ((known[s],) if s in known else map(bytes_.__getitem__, (SPACE if s == _SIGN else s).encode()))]

    def segment_many(self, points: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of units (rows of code points, filled up with _FILL), each with its own agenda.

        A round takes the best merge of every unit.  Returns the symbols left, which of them are alive, and the rows
        and salts of the merges that were taken.
        """
        count, n = points.shape
        symbols = np.where(points == _FILL, self.unknown, self.symbol_of[np.where(points == _FILL, 0, points)])
        with np.errstate(over="ignore"):

            def candidates(rows, left, right, place):
                """Merged piece and rank of neighbours; none where no piece joins them or the merge is skipped."""
                wanted = left.astype(np.int64) * self.width + right
                at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
                piece = np.where(self.pair_keys[at] == wanted, self.pair_ids[at], 0)
                rank = np.where(self.pair_keys[at] == wanted, self.rank[piece], _LAST)
                if keys is not None:
                    rank[_scrambled(keys[rows] ^ _salt(place, piece)) < np.uint64(self.limit)] = _LAST
                return piece, rank

            pieces, ranks = np.zeros((count, n), np.int32), np.full((count, n), _LAST, np.int32)
            after = np.broadcast_to(np.arange(1, n + 1), (count, n)).copy()
            before = np.broadcast_to(np.arange(-1, n - 1), (count, n)).copy()
            alive = points != _FILL
            rows = np.repeat(np.arange(count), max(n - 1, 0))
            place = np.tile(np.arange(max(n - 1, 0)), count)
            if n > 1:
                some = alive[rows, place + 1]
                rows, place = rows[some], place[some]
                pieces[rows, place], ranks[rows, place] = candidates(rows, symbols[rows, place], symbols[rows, place + 1], place)
            rows, taken = np.arange(count), []
            while len(rows):
                part = ranks[rows]
                left = part.argmin(axis=1)
                go = part[np.arange(len(rows)), left] < _LAST
                rows, left = rows[go], left[go]
                taken.append((rows, _salt(left, pieces[rows, left])))
                right = after[rows, left]
                symbols[rows, left] = pieces[rows, left]
                alive[rows, right] = False
                ranks[rows, right] = _LAST
                follow = after[rows, left] = after[rows, right]
                some = follow < n
                some[some] = alive[rows[some], follow[some]]
                ranks[rows[~some], left[~some]] = _LAST
                r, x, y = rows[some], left[some], follow[some]
                before[r, y] = x
                pieces[r, x], ranks[r, x] = candidates(r, symbols[r, x], symbols[r, y], x)
                ahead = before[rows, left]
                some = ahead >= 0
                r, x, y = rows[some], ahead[some], left[some]
                pieces[r, x], ranks[r, x] = candidates(r, symbols[r, x], symbols[r, y], x)
        return symbols, alive, *(np.concatenate([t[k] for t in taken]) if taken else np.empty(0, kind) for k, kind in enumerate((np.int64, np.uint64)))

    def _segmented(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None):
        """Ids of units at places of a text's code points: a Ragged of ids and one of the merges taken, in order."""
        ids, merges, order = [], [], []
        for low, high in zip(_SIZES, _SIZES[1:], strict=False):
            mine = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(mine), 1 << 14):
                own = mine[k : k + (1 << 14)]
                matrix = np.full((len(own), high), _FILL, np.uint32)
                inside = np.arange(high) < sizes[own][:, None]
                matrix[inside] = points[places(starts[own], sizes[own])]
                symbols, alive, rows, salts = self.segment_many(matrix, None if keys is None else keys[own])
                odd = np.flatnonzero((alive & (symbols >= len(self.pieces.plain))).any(axis=1))
                counts = alive.sum(axis=1)
                flat = symbols[alive].astype("<u4")
                if len(odd):
                    split = np.split(flat, np.cumsum(counts)[:-1])
                    for r in odd.tolist():
                        split[r] = np.array([i for p, s, on in zip(matrix[r].tolist(), symbols[r].tolist(), alive[r].tolist(), strict=True) if on for i in ([s] if s < len(self.pieces.plain) else map(self.pieces.bytes.__getitem__, chr(p).encode()))], "<u4")
                    flat, counts = np.concatenate(split), np.array([len(x) for x in split])
                order.append(own)
                ids.append((flat, counts))
                by = np.argsort(rows, kind="stable")
                merges.append((salts[by], np.bincount(rows, minlength=len(own))))
        for u in np.flatnonzero(sizes > _SIZES[-1]).tolist():
            taken: list = []
            text = points[starts[u] : starts[u] + sizes[u]].astype("<u4").tobytes().decode("utf-32-le")
            own = self.piece_ids(self.segment(text, None if keys is None else int(keys[u]), taken))
            order.append(np.array([u]))
            ids.append((np.array(own, "<u4"), np.array([len(own)])))
            with np.errstate(over="ignore"):
                merges.append((_salt(np.array([x for x, _ in taken], np.int64), np.array([x for _, x in taken], np.int64)), np.array([len(taken)])))
        back = np.argsort(np.concatenate(order), kind="stable") if order else np.empty(0, np.int64)
        out = []
        for parts_, kind in ((ids, "<u4"), (merges, np.uint64)):
            both = Ragged(kind)
            if parts_:
                both.append(np.concatenate([f for f, _ in parts_]), np.concatenate([c for _, c in parts_]))
            out.append(both.take(back))
        return out

    def encode(self, texts: pa.Array, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (no nulls), one text after another, and the number of ids of each."""
        joined = "".join([" " + t if t else "" for t in texts.to_pylist()])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if not len(points):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.where(lengths > 0, lengths + 1, 0))
        cut = np.ones(len(points), bool)
        cut[1:] = ~self._joined(points[:-1], points[1:])
        cut[ends[:-1][ends[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(points))
        text = np.searchsorted(ends, starts, "right")
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        bytes_at = np.concatenate([[0], np.cumsum(wide)])[np.append(starts, len(points))]
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(joined.encode()))
        at = self._known(units, points, starts, sizes)
        flat, counts = self.ids.parts(at)
        if self.limit:
            with np.errstate(over="ignore"):
                origin = np.concatenate([[0], ends])[text]
                keys = mix64(mix64(doc_ids.astype(np.int64).view(np.uint64) * np.uint64(_BASE) + np.uint64(self.seed))[text] + (starts - origin).astype(np.uint64))
                salts, many = self.merges.parts(at)
                hit = _scrambled(np.repeat(keys, many) ^ salts) < np.uint64(self.limit)
            changed = np.unique(np.repeat(np.arange(len(at)), many)[hit])
            if len(changed):
                other, _ = self._segmented(points, starts[changed], sizes[changed], keys[changed])
                both = Ragged("<u4")
                both.append(flat, counts)
                both.append(other.flat, np.diff(other.ends))
                pick = np.arange(len(at))
                pick[changed] = len(at) + np.arange(len(changed))
                flat, counts = both.parts(pick)
        per = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.searchsorted(text, np.arange(len(texts)), "right")])]
        return flat, np.diff(per)

    def _known(self, units: pa.Array, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each unit in the store of plain segmentations, to which new ones are added."""
        if len(self.names) >= self.most:
            self.names = pa.array([], pa.string())
            self.ids, self.merges = Ragged("<u4"), Ragged(np.uint64)
        found = pc.index_in(units, value_set=self.names)
        unknown = found.is_null().to_numpy(zero_copy_only=False)
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        where = np.flatnonzero(unknown)
        if len(where):
            coded = units.filter(pa.array(unknown)).dictionary_encode()
            number = coded.indices.to_numpy()
            _, first = np.unique(number, return_index=True)
            ids, merges = self._segmented(points, starts[where[first]], sizes[where[first]], None)
            at[where] = len(self.names) + number
            self.names = pa.concat_arrays([self.names, coded.dictionary])
            self.ids.append(ids.flat, np.diff(ids.ends))
            self.merges.append(merges.flat, np.diff(merges.ends))
        return at

    def lossless(self, texts: pa.Array, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether decoding each text's ids gives the text again."""
        back = self.raw.take(pa.array(ids))
        ends = np.concatenate([[0], np.frombuffer(back.buffers()[1], np.int32)[1 : len(back) + 1]])[np.concatenate([[0], np.cumsum(counts)])] if len(back) else np.zeros(len(counts) + 1, int)
        data = memoryview(back.buffers()[2]) if len(back) else memoryview(b"")
        return np.array([bytes(data[a + 1 : b]) == t for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts.cast(pa.binary()).to_pylist(), strict=True)], bool)


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, kind):
        self.flat, self.ends = np.empty(0, kind), np.zeros(1, np.int64)

    def append(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(self.ends)[rows]
        return self.flat[places(self.ends[rows], counts)], counts

    def take(self, rows: np.ndarray) -> Ragged:
        out = Ragged(self.flat.dtype)
        out.append(*self.parts(rows))
        return out


def _salt(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """What a merge's place and piece add to the key of a unit's occurrence."""
    return place.astype(np.uint64) * np.uint64(_PLACE) + piece.astype(np.uint64) * np.uint64(_PIECE)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=2)
def encoder(path: str, dropout: float, seed: int) -> MergeDropout:
    """One encoder per worker and setting."""
    return MergeDropout(path, dropout, seed)


ENCODED = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, lossless boolean, ids array<int>"


def encode_documents(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` as piece ids with merge-dropout: one row (ENCODED) per row, in the scan that reads it.

    ``lossless`` tells that decoding the ids gives the text again (it is true for every text; a literal U+2581, which
    the vocabulary uses for spaces, goes through byte pieces).  With ``dropout=0`` the ids are the library's own.

    Cases: a null or empty text has no ids; skips depend on ``doc_id`` (a null one counts as 0) and on the place in
    the text, so copies under other ids are segmented differently, occurrences of a word too, and repeated rows alike;
    a text of any length is encoded whole; other columns are dropped; an empty table gives an empty result.
    """

    def encode(batches):
        coder = encoder(model_path, dropout, seed)
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                ids, texts = batch.column(0).slice(i, j - i), pc.fill_null(batch.column(1).slice(i, j - i), "")
                flat, counts = coder.encode(texts, pc.fill_null(ids, 0).to_numpy())
                offsets = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(flat).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [ids, pa.array(counts), pc.binary_length(texts).cast(pa.int64()), pa.array(crcs, pa.int64()), pa.array(coder.lossless(texts, flat, counts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "lossless", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, ENCODED)


def decode_documents(coded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of ``coded(doc_id, ids)``; null ids give a null text, ids outside the vocabulary an error."""

    def decode(batches):
        pieces = Pieces(model_path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, text string")
