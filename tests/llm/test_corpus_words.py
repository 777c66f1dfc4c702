"""Resampling, repeated passages and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.llm import resampling, spelling, substrings
from partwise.llm.words import word_hashes

R = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in ("stra", "kolo", "Éta", "mini") for b in ("me", "ta", "ri") for c in ("nd", "ß", "x")]


def _text(n, words=WORDS):
    return " ".join(R.choice(words) for _ in range(n))


PASSAGE = _text(30)


@pytest.fixture(scope="module")
def docs(spark):
    """Null and empty texts, repeated rows, a null id, one id with two texts, a very long text, a clashing column."""
    rows = [(i, _text(R.randrange(1, 80))) for i in range(40)]
    rows += [(100 + i, f"{_text(5)} {PASSAGE}\n{_text(4)}") for i in range(12)] + [(7, PASSAGE), (7, PASSAGE), (None, PASSAGE), (None, PASSAGE)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, _text(120_000)), (204, f"{PASSAGE} {PASSAGE}"), (205, "-- Ab1ç_ÉÉ 's\x00b")]
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int").repartition(5)


def _plain(rows):
    return [(r["doc_id"], r["text"] or "") for r in rows]


# --- repeated passages ---


def _removed(rows, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows]
    place = lambda i, at: (i is None, i or 0, at)
    first = {}
    for i, w in words:
        for at in range(len(w) - width + 1):
            k = tuple(w[at : at + width])
            first[k] = min(first.get(k, place(i, at)), place(i, at))
    out = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - width + 1):
            if place(i, at) > first[tuple(w[at : at + width])]:
                gone |= set(range(at, at + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("cells", [4, 1])
def test_repeats_equal_brute_force_whatever_the_sketch_lets_through(docs, cells):
    told = [tuple(r) for r in substrings.remove_repeats(docs, 20, cells).collect()]
    wanted = _removed(_plain(docs.collect()), 20)
    assert Counter(told) == Counter(wanted)
    assert sum(r[2] for r in wanted) > 30 * 12


def test_small_flushes_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(substrings, "MAX_CELLS", 1 << 12)
    told = [tuple(r) for r in substrings.remove_repeats(docs, 5).collect()]
    assert Counter(told) == Counter(_removed(_plain(docs.collect()), 5))


def test_sketch_never_estimates_too_low(spark, docs):
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    path = substrings.build_sketch(own, 3, 12)
    sketch = substrings.read_sketch(path, 12)
    seen = Counter()
    for r in docs.collect():
        for h, *_ in substrings.window_hashes(*word_hashes([(r["text"] or "").encode()], False), 3):
            seen.update(h.tolist())
    often = np.array([h for h, n in seen.items() if n > 1], np.uint64)
    assert len(often) and substrings.repeated(sketch, often, 12).all()


def test_windows_in_steps_equal_windows_at_once(monkeypatch):
    words = np.array([R.randrange(2**60) for _ in range(700)], np.uint64)
    counts = np.array([0, 300, 3, 0, 397])
    once = [np.concatenate(x) for x in zip(*substrings.window_hashes(words, counts, 20), strict=True)]
    monkeypatch.setattr(substrings, "_STEP", 64)
    substrings._powers.cache_clear()
    steps = [np.concatenate(x) for x in zip(*substrings.window_hashes(words, counts, 20), strict=True)]
    substrings._powers.cache_clear()
    assert all((a == b).all() for a, b in zip(once, steps, strict=True)) and len(once[0]) == 281 + 378


# --- resampling ---


def _resampled(rows, target, longest, buckets, percent, least):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, x, _ in own for f in x), Counter(bucket(f) for x in target for f in features(x)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    scored = []
    for i, x, n in own:
        weight = sum(gain(bucket(f)) for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = fit[: percent * len(fit) // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in fit[len(drawn) :]] + [(*r[:4], None) for r in scored if r[4] < least])


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 60)])
def test_resampling_equals_brute_force(spark, docs, longest, percent):
    target = [_text(20, WORDS[:9]), None, ""]
    told = resampling.resample(docs, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string"), longest, 500, percent, 20)
    assert told.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, told.collect())) == _resampled(_plain(docs.collect()), [t or "" for t in target], longest, 500, percent, 20)


def test_words_have_offsets_of_the_library():
    text = "Die 12 Äpfel-KÖRBE' ſ\x80x\x00y"
    assert resampling.split_words(text) == ["die", "12", "Äpfel", "kÖrbe", "ſ\x80x", "y"]
    assert resampling.windows(["a", "bc", "d"], 2) == ["a", "bc", "d", "a bc", "bc d"]


# --- spelling ---


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(rows, every, least_n):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    v = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_n}
    near = {w: [x for x in v if _near(w, x)] for w in v}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 5 * v[w] else None
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], len(near[w]), v[form[w]] if form[w] else None))
    return Counter(out)


@pytest.mark.parametrize("most", [2048, 3])
def test_variants_equal_brute_force(spark, docs, most):
    typed = WORDS + [f"{w[:k]}{c}{w[k + d :]}" for w in WORDS for k in (0, 3, 5) for c in ("", "q") for d in (0, 1)]
    rows = _plain(docs.collect()) + [(1000 + k, _text(60, typed)) for k in range(60)] + [(None, "Àx" * 5000)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    told = Counter(tuple(r) for r in spelling.variants(df, every=19, least_n=2, most=most).collect())
    wanted = _variants(rows, 19, 2)
    assert told == wanted
    assert any(r[1] and r[2] != r[1] for r in wanted) and max(r[4] for r in wanted) > 3


def test_sorted_scan_equals_all_pairs():
    for _ in range(300):
        words = sorted({"".join(R.choice("abc") for _ in range(R.randrange(1, 8))) for _ in range(R.randrange(1, 50))})
        assert set(spelling.near_pairs(words)) == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if _near(words[i], words[j])}


def test_every_pair_has_one_home():
    for m in range(2, 14):
        leaves, todo = [], [(m // 2, 0), (0, m - m // 2)]
        while todo:
            lo, hi = todo.pop()
            leaves.append((lo, hi)) if m - lo - hi < 2 else todo.extend([(lo + (m - lo - hi) // 2, hi), (lo, m - lo - (m - lo - hi) // 2)])
        for p in range(m + 1):
            assert sum(spelling.is_home(p, m, *leaf) for leaf in leaves) == 1


@pytest.mark.parametrize("run", [lambda d: resampling.resample(d, d), substrings.remove_repeats, spelling.variants])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []
