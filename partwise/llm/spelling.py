"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists, and the form each stands for.

Words are counted over the corpus first.  Two words one edit apart share their first or their last half, so the vocabulary
is dealt into blocks by either half; a block above a bound is cut again at the middle of what is still open, so no block
grows with the vocabulary.  A block's words lie sorted in one task.  Each is compared with those after it: a row of the
edit matrix holds three cells around the diagonal, rows up to the common prefix of neighbours stay, and where every cell
of a row exceeds one, all words with that prefix are passed over.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import joined_back
from .storage import materialise
from .words import parts, slices

#: Fixed value: letters of a run, after A-Z are lower-cased.
_RUN_OF_LETTERS = re.compile("[a-zÀ-ÿ]+")
_BYTES = 1 << 20
#: Distinct words that a task gathers before it sends their counts.
_GATHERED = 300_000
#: Longest words, in bytes, whose hashes are put together from that of the id and that of the word.
_SHORT = 64


def _byte_steps() -> np.ndarray:
    """What a zero byte does to the low byte of a crc32, from its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_STEPS = _byte_steps()


def keyed_crc32(prefixes: np.ndarray, which: np.ndarray, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of ``prefix + word`` from the crc32 of both: the prefix's is carried over as many zero bytes as the word has."""
    longest = int(lengths.max(initial=0))
    carried = np.empty((longest + 1, len(prefixes)), np.uint32)
    carried[0] = prefixes
    for k in range(longest):
        carried[k + 1] = (carried[k] >> np.uint32(8)) ^ _STEPS[carried[k] & np.uint32(255)]
    return carried[lengths, which] ^ crcs


def count_run(ids: list, texts: list[str | None], every: int) -> pa.Table:
    """``word, n`` of some texts: where ``every`` divides the hash of id and word, the word loses one letter."""
    words = [_RUN_OF_LETTERS.findall(t) if t else [] for t in texts]
    coded = pa.array([w for x in words for w in x], pa.string()).dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    raw = [w.encode() for w in names]
    lengths, crcs = np.array([len(w) for w in raw], np.int64), np.array([zlib.crc32(w) for w in raw], np.uint32)
    prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    which = np.repeat(np.arange(len(ids)), [len(x) for x in words])
    hashes = np.empty(len(codes), np.int64)
    short = lengths[codes] <= _SHORT
    hashes[short] = keyed_crc32(prefixes, which[short], crcs[codes[short]], lengths[codes[short]])
    for at in np.flatnonzero(~short).tolist():
        hashes[at] = zlib.crc32(raw[codes[at]], int(prefixes[which[at]]))
    hit = hashes % every == 0
    n = np.bincount(codes[~hit], minlength=len(names))
    changed = []
    for at in np.flatnonzero(hit).tolist():
        word = names[codes[at]]
        p = int(hashes[at]) % len(word)
        changed.append(word[:p] + word[p + 1 :])
    both = pa.table({"word": pa.concat_arrays([coded.dictionary, pa.array(changed, pa.string())]), "n": np.concatenate([n, np.ones(len(changed), np.int64)])})
    return both.filter(pc.greater(both.column("n"), 0))


def count_words(docs: DataFrame, every: int) -> DataFrame:
    """``word, n`` over whole texts; every task adds up its own words first."""

    def together(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def count(batches):
        held = []
        for batch in batches:
            for i, j in slices(batch.column(1), _BYTES):
                ids, texts = batch.column(0).slice(i, j - i).to_pylist(), pc.ascii_lower(batch.column(1).slice(i, j - i)).to_pylist()
                if len(texts) == 1 and len(texts[0] or "") > _BYTES:
                    for piece in parts(texts[0].encode(), _BYTES):
                        held.append(count_run(ids, [piece.decode()], every))
                else:
                    held.append(count_run(ids, texts, every))
                if sum(t.num_rows for t in held) > _GATHERED:
                    held = [together(held)]
                    if held[0].num_rows > _GATHERED // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from together(held).to_batches()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def near_pairs(words: list[str]):
    """Pairs (i, j), i < j, of a sorted list of distinct words that differ by one inserted, deleted or replaced letter."""
    n = len(words)
    shared = [0] + [common_prefix(a, b) for a, b in zip(words, words[1:], strict=False)]
    far = 2
    for i in range(n - 1):
        q = words[i]
        size = len(q)
        j = i + 1
        have = shared[j]
        # a row: cells left of, on and right of the diagonal; equal prefixes leave the diagonal at 0
        rows = [(1, 0, 1)] * (have + 1)
        while j < n:
            word = words[j]
            last = len(word)
            del rows[have + 1 :]
            left, here, right = rows[have]
            d = have
            while d < last:
                c = word[d]
                d += 1
                x = min(here + 1, left + (c != q[d - 2])) if 1 < d <= size + 1 else here + 1 if d == 1 else far
                y = min(right + 1, x + 1, here + (c != q[d - 1])) if d <= size else far
                z = min(y + 1, right + (c != q[d])) if d < size else far
                if x > 1 and y > 1 and z > 1:
                    break
                left, here, right = x, y, z
                rows.append((x, y, z))
            else:
                gap = size - last
                if gap == 0 and here == 1 or gap == -1 and left == 1 or gap == 1 and right == 1:
                    yield i, j
                have = last
                j += 1
                if j < n:
                    have = min(have, shared[j])
                continue
            # the prefix of length d is too far: so is every word that shares it
            j += 1
            while j < n and shared[j] >= d:
                j += 1
            if j < n:
                have = min(d - 1, shared[j])


def is_home(p: int, m: int, head: int, tail: int) -> bool:
    """Whether a pair with ``p`` equal first letters belongs to this block of the cuts at the middle, and to no other."""
    lo = hi = 0
    while (lo, hi) != (head, tail):
        middle = lo + (m - lo - hi) // 2
        if m - lo - hi < 2 or lo > head or hi > tail:
            return False
        lo, hi = (middle, hi) if p >= middle else (lo, m - middle)
    return True


def blocks(vocabulary: DataFrame, most: int) -> DataFrame:
    """``m, head, tail, first, last, word, n``: words of m or m + 1 letters that share ``head`` first and ``tail`` last letters."""

    def cut(rows: DataFrame) -> DataFrame:
        middle = F.col("head") + F.floor((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
        halves = F.array(F.struct(middle.alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("m") - middle).alias("tail")))
        told = rows.select("word", "n", "m", F.explode(halves).alias("h")).select("word", "n", "m", "h.head", "h.tail")
        ends = F.when(F.col("tail") > 0, F.substring("word", -F.col("tail"), F.col("tail"))).otherwise("")
        return told.select("m", "head", "tail", F.substring("word", F.lit(1), F.col("head")).alias("first"), ends.alias("last"), "word", "n")

    keys = ["m", "head", "tail", "first", "last"]
    length = F.length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("m")
    rows = cut(vocabulary.select("word", "n", sizes).where("m >= 2").withColumns({"head": F.lit(0), "tail": F.lit(0)}))
    done = []
    while True:
        large = materialise(rows.groupBy(*keys).count().where((F.col("count") > most) & (F.col("m") - F.col("head") - F.col("tail") >= 2)).select(*keys), "blocks")
        if large.isEmpty():
            return _union([*done, rows])
        done.append(rows.join(large, keys, "left_anti").select(*keys, "word", "n"))
        rows = materialise(cut(rows.join(large, keys, "left_semi")), "blocks")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def search(rows: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of words that have near ones in a block: their number, and the most frequent of them."""
    keys = ["m", "head", "tail", "first", "last"]

    def of_block(key, words: list[str], ns: list[int]):
        m, head, tail = key[:3]
        found = {}
        for i, j in near_pairs(words):
            a, b = words[i], words[j]
            if min(len(a), len(b)) == m and is_home(common_prefix(a, b), m, head, tail):
                for x, y in ((i, j), (j, i)):
                    n, best = found.get(x, (0, (0, "")))
                    found[x] = n + 1, min(best, (-ns[y], words[y]))
        return [(words[x], n, -best[0], best[1]) for x, (n, best) in found.items()]

    def scan(batches):
        key, words, ns, told = None, [], [], []
        for batch in batches:
            for *own, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != key:
                    told += of_block(key, words, ns) if len(words) > 1 else []
                    key, words, ns = own, [], []
                words.append(word)
                ns.append(n)
            if len(told) > 10_000:
                yield _near_batch(told)
                told = []
        told += of_block(key, words, ns) if len(words) > 1 else []
        if told:
            yield _near_batch(told)

    sorted_ = rows.select(*keys, "word", "n").repartition(*keys).sortWithinPartitions(*keys, "word")
    return sorted_.mapInArrow(scan, "word string, n_near long, best_n long, best string")


def _near_batch(told: list[tuple]) -> pa.RecordBatch:
    kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), kinds.values(), strict=True)], names=list(kinds))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form: links are followed twice as far in each round, until none goes on."""
    told = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = told.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(told.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        told = longer.select("word", "root")
        if longer.where("went").isEmpty():
            return told


def variants(docs: DataFrame, every: int = 199, least_letters: int = 6, least_n: int = 5, factor: int = 5, most: int = 2048) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``least_letters`` or more that occurs ``least_n`` times.

    A run of letters loses one where ``every`` divides the crc32 of document id and run.  Near words differ by one letter
    inserted, deleted or replaced; a word's form is the most frequent near word (ties: the smallest), if it is at least
    ``factor`` times as frequent, and its root the last of the forms that follow from it.  ``most`` bounds a block.

    Cases: a null or empty text has no runs; a text of any length is read in pieces; a null ``doc_id`` is hashed as
    empty; rows that repeat count again; an empty table gives an empty result; other columns are dropped.
    """
    counted = count_words(docs, every)
    vocabulary = materialise(counted.where((F.length("word") >= least_letters) & (F.col("n") >= least_n)), "vocabulary")
    near = search(blocks(vocabulary, most)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    form = (-F.col("b.less") >= factor * F.col("n")) & F.col("b").isNotNull()
    told = materialise(joined_back(vocabulary, near, ["word"], ["n_near", "b"]).select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("b.best")).alias("form"), F.when(form, -F.col("b.less")).alias("form_n")), "variants")
    ends = roots(told.where("form is not null"))
    return joined_back(told, ends, ["word"], ["root"]).select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
