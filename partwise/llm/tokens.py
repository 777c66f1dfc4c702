"""Token ids of a ``tokenizers`` file at the speed of a dictionary.

The file's pre-tokenizer drops white space, so a text's ids are those of its white-space-separated chunks, one after
another, and a chunk's ids are those of its parts under the pre-tokenizer's pattern.  Both levels are remembered per
worker, and a run of texts looks up its distinct chunks together.  New parts of plain Latin letters and signs go
straight to the library's BPE model; whatever normalisation could change, or join to a neighbour, goes through the
whole tokenizer.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .words import parts, slices

#: The pre-tokenizer's pattern, over lower-case ASCII and over any lower-case text.
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+|\n")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: the normalizer that parts are made for; with another one every text goes through the whole tokenizer.
NORMALIZER = 'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])'
_ANY = regex.compile(PATTERN + r"|\n")
#: Letters and signs that normalisation may change, and hidden ones, go through the whole tokenizer.
_OTHER = re.compile("[^\n\x20-\x7e¡-¬®-įı-ɏ]")
#: Bytes of text that are encoded together; a longer text is read in pieces.
_RUN = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_LATIN1 = [_LETTERS[b] for b in range(256)]


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start ... start + size - 1`` of every pair, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Store:
    """Remembered strings and their ids in arrays; when ``most`` are held, the half that was used last stays."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.string())
        self.ends, self.ids, self.used, self.clock = np.zeros(1, np.int64), np.empty(0, "<u4"), np.empty(0, np.int64), 0

    def _make_room(self) -> None:
        kept = np.sort(np.argpartition(-self.used, self.most // 2)[: self.most // 2])
        sizes = np.diff(self.ends)[kept]
        self.names, self.used, self.ids = self.names.take(pa.array(kept)), self.used[kept], self.ids[places(self.ends[kept], sizes)]
        self.ends = np.concatenate([[0], np.cumsum(sizes)])

    def find(self, wanted: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``wanted`` strings, one after another, and the number of each.

        ``learn(new)`` gives the new strings in an order of its own, their ids and the number of each.
        """
        if len(self.names) >= self.most:
            self._make_room()
        found = pc.index_in(wanted, value_set=self.names)
        unknown = found.is_null()
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = wanted.filter(unknown)
        if len(rest):
            base = len(self.names)
            names, ids, sizes = learn(pc.unique(rest))
            self.names = pa.concat_arrays([self.names, names])
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.used = np.concatenate([self.used, np.zeros(len(names), np.int64)])
            at[unknown.to_numpy(zero_copy_only=False)] = base + pc.index_in(rest, value_set=names).to_numpy()
        self.clock += 1
        self.used[at] = self.clock
        sizes = np.diff(self.ends)[at]
        return self.ids[places(self.ends[at], sizes)], sizes


class ChunkIds:
    """Ids of texts as unsigned 32-bit integers, by way of remembered chunks and parts."""

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks, self.units = Store(most), Store(most)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = PATTERN in repr(self.tokenizer.pre_tokenizer) and self.tokenizer.post_processor is None and repr(self.tokenizer.normalizer) == NORMALIZER

    def forget(self) -> None:
        """Empty both stores: a worker that waits for its next task holds no memory for them."""
        self.chunks.clear()
        self.units.clear()

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn_units(self, new: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids, sizes, model = [], [], self.model
        for part in new.to_pylist():
            seen = part if part.isascii() else "".join([_LATIN1[b] for b in part.encode()])
            own = [t.id for t in model.tokenize(seen)] if part != "\n" else []
            ids += own
            sizes.append(len(own))
        return new, np.array(ids, "<u4"), np.array(sizes, np.int64)

    def _learn_chunks(self, new: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        plain = pc.string_is_ascii(new)
        names, ids, sizes = [], [], []
        for chunks, pattern in ((new.filter(plain), _ASCII), (new.filter(pc.invert(plain)), _ANY)):
            text = "\n".join(chunks.to_pylist())
            if _OTHER.search(text):
                odd = np.array([_OTHER.search(t) is not None for t in chunks.to_pylist()])
                own = [self.library(t) for t in chunks.filter(pa.array(odd)).to_pylist()]
                names.append(chunks.filter(pa.array(odd)))
                ids.append(np.array([i for x in own for i in x], "<u4"))
                sizes.append(np.array([len(x) for x in own], np.int64))
                chunks = chunks.filter(pa.array(~odd))
                text = "\n".join(chunks.to_pylist())
            if len(chunks):
                found = pa.array(pattern.findall(text.lower() + "\n"), pa.string())
                flat, each = self.units.find(found, self._learn_units)
                last = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
                names.append(chunks)
                ids.append(flat)
                sizes.append(np.diff(np.cumsum(each)[last], prepend=0))
        return pa.concat_arrays(names), np.concatenate(ids), np.concatenate(sizes)

    def encode_many(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, equal to the library's, one text after another, and the number of ids of each.

        With ``end`` every text is followed by that id.
        """
        last = [] if end is None else [end]
        if not self.apart or any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            own = [self.library(t or "") + last for t in texts.to_pylist()]
            return np.array([i for x in own for i in x], "<u4"), np.array([len(x) for x in own], np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, sizes = self.chunks.find(split.flatten(), self._learn_chunks)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        after = np.concatenate([[0], np.cumsum(sizes)])[ends]
        if end is not None:
            flat = np.insert(flat, after, end)
        return flat, np.diff(after, prepend=0) + len(last)

    def runs(self, texts: pa.Array, end: int | None = None):
        """For each run of rows of a batch, in order: first row, ids, number of ids of each row.

        A long text is read in pieces that end at white space.
        """
        for i, j in slices(texts, _RUN):
            if j - i == 1 and (pc.binary_length(texts[i]).as_py() or 0) > _RUN and self.apart and not any(s in texts[i].as_py() for s in self.special):
                done = [self.encode_many(pa.array([p], pa.binary()).cast(pa.string()))[0] for p in parts(texts[i].as_py().encode())]
                done += [] if end is None else [np.array([end], "<u4")]
                yield i, np.concatenate(done), np.array([sum(map(len, done))])
            else:
                yield i, *self.encode_many(texts.slice(i, j - i), end)


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """One store of chunks per worker and tokenizer file."""
    return ChunkIds(path)
