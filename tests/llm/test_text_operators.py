import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from partwise.llm import language, minhash, packing, quality, sentencepiece_dropout, token_files
from partwise.llm.components import connected_components
from partwise.llm.queries import tokenizer_file
from partwise.llm.tokens import ChunkIds
from partwise.llm.words import mix64, parts, shingle_sets

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("bands", T.StringType())])
DATA = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(3000)]
BPE, SP = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = [None, "", "  \n\t ", "one", "one", "don't STOP 'll 3.14 $$$ <|endoftext|>", "Ünï É! İstanbul ẞ ΣΑΣ. क़! 日本語 😀!👍🏽 각 H̱", " a▁b  c\x00 \n", "x" * 30_000, "lorem ipsum " * 9_000]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], DOCS).repartition(3)


def odd_rows():
    return [(i, t, "en", "clash") for i, t in enumerate(ODD)] + [(None, "no id", None, None), (3, "one", "en", "clash")]


def copies(seed=0, groups=12, size=9, length=120):
    """Texts in groups of edited copies, some edited so much that they leave the group."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(groups):
        base = rng.choice(WORDS, length).tolist()
        for k in range(size):
            text = list(base)
            for at in rng.integers(0, length, k):
                text[at] = str(rng.choice(WORDS))
            rows.append((10_000 + len(rows), " ".join(text)))
    return rows


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rows = copies() + [(1000, "A b C"), (1001, "a B c"), (1002, "a b c d"), (1003, None), (1004, ""), (1005, "a b c d")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), 4, 80).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = copies(seed=5, groups=4, size=24, length=160)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), 4, 80).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_of_odd_rows(spark):
    got = [tuple(r) for r in minhash.near_duplicates(frame(spark, odd_rows()), 5).collect()]
    assert len(got) == len(ODD) + 2
    assert (None, 1, None, True) in got
    assert sorted(r for r in got if r[0] in (3, 4)) == [(3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False)]
    assert (0, 0, 0, True) in got and (2, 0, 2, True) in got
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])
    with np.errstate(over="ignore"):
        a, b = minhash.odd_sketch(minhash.minhash([x, y], 1))
    bits = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    assert abs(minhash.similarity_of_bits(bits) - 900 / 1100) < 0.05


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200}


def test_long_texts_are_cut_at_spaces_only():
    text = b"word " * 700_000
    assert b"".join(parts(text)) == text and len(parts(text)) > 1
    (whole,) = shingle_sets([text], 4)
    assert len(whole) == 1


LIBRARY = Tokenizer.from_file(BPE)


def library_ids(text, *end):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, *end], "<u4")


@pytest.mark.parametrize("most", [40, 400_000])
def test_token_ids_equal_the_library(most):
    rng = random.Random(5)
    signs = "abcZÉéßİıſK'sStTreVE0129²½ .,;:!|<># \u0301\u200bñŸǅǆɐΣσ中\x1c\x7f\t\n\x0b\x0c\xa0"
    texts = [*ODD, "'S ''s a's1 １２ ² ½", "ŉ! ĳ ß \xad! ª²º x\x7f", "a\u00a0b\x1fc\x85d", "≠ a≮ x\u0301!", "long ſtring été " * 300_000]
    texts += ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(3_000)]
    for own in (texts, [t for t in texts if t is None or "<|" not in t]):
        store, at = ChunkIds(BPE, most), 0
        for first, ids, counts in store.runs(pa.array(own), 7):
            assert first == at and counts.sum() == len(ids)
            for n, end in zip(counts, np.cumsum(counts), strict=True):
                assert ids[end - n : end].tolist() == library_ids(own[at], 7).tolist(), own[at]
                at += 1
        assert at == len(own)


def test_token_ids_of_whole_documents_equal_the_library(spark):
    docs = spark.read.parquet(DATA + "/documents.parquet").select("doc_id", "text")
    packed = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(docs, BPE).collect()}
    assert packed == {r["doc_id"]: (len(x), zlib.crc32(x.tobytes())) for r in docs.collect() for x in [library_ids(r["text"], 2)]}


def test_packing_is_whole_and_tight(spark):
    rows = copies(groups=30, size=5, length=900) + odd_rows()
    out = packing.pack(packing.pieces(frame(spark, rows), BPE, 256, 1), 256, group=64).toPandas()
    total = out.length.sum()
    assert total == sum(len(library_ids(r[1], 1)) for r in rows)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    assert total / (256 * out.sequence_id.nunique()) > 0.97
    one = out[out.doc_id == 9].sort_values("start")
    ids = library_ids(ODD[9], 1).tobytes()
    assert one.ids_crc32.tolist() == [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(one.start, one.length, strict=True)]
    assert packing.pack_documents(frame(spark, []), BPE).count() == 0


def test_packing_keeps_large_ids_beside_null_and_spreads_repeated_rows(spark):
    """Ids beyond the exact range of doubles stay as they are, and rows of one id do not share a group."""
    big = 9007199254740993
    rows = [(big, "one two"), (None, "one two"), (None, None), (big + 2, "")] + [(5, "one two three")] * 3000
    out = packing.pack_documents(frame(spark, rows), BPE, capacity=64).collect()
    ids = [r["doc_id"] for r in out]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in rows)
    small = packing.pack(packing.materialise(packing.pieces(frame(spark, rows), BPE, 64, 1), "pieces"), 64, group=256)
    sizes = [r["count"] for r in small.groupBy(F.floor(F.col("sequence_id") / packing.SPAN)).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 400


def test_first_fit_decreasing_equals_a_plain_search():
    lengths = np.random.default_rng(3).integers(1, 100, 400)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert all((bins[i], offsets[i]) == want[i] for i in want)


def test_token_files_round_trip_and_lookup(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    _, manifest = token_files.write_token_files(docs, BPE, 2, file_bytes=1 << 16)
    got = token_files.read_documents(manifest).toPandas().sort_values("start")
    coded = lambda t: library_ids(t, 2).tobytes()
    assert len(got) == len(rows) and got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    assert sorted(got.ids_crc32) == sorted(zlib.crc32(coded(r[1])) for r in rows)
    assert got.doc_id.isna().tolist()[0] and got.doc_id.dropna().is_monotonic_increasing
    found = {r["doc_id"]: r["ids"] for r in token_files.lookup(spark, manifest, spark.createDataFrame([(5,), (8,), (77,), (-4,)], "doc_id long")).collect()}
    assert found == {k: np.frombuffer(coded(ODD[k]), "<u4").tolist() for k in (5, 8)}
    assert token_files.round_trip(frame(spark, []), BPE).count() == 0


def test_keys_that_span_files_and_repeat(spark):
    """A key whose rows fill several files is found at its first row; files are in the order of their numbers."""
    rows = [(5, "one two three")] * 4000 + [(i, f"text {i}") for i in range(60)]
    _, manifest = token_files.write_token_files(frame(spark, rows), BPE, 2, file_bytes=1 << 13)
    files = manifest.orderBy("file").toPandas()
    assert len(files) > 3 and (files.first_key == 5).sum() > 1 and files.base.tolist() == [0, *np.cumsum(files.ids)[:-1]]
    asked = spark.createDataFrame([(i,) for i in range(-3, 70)] + [(5,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_files.lookup(spark, manifest, asked).collect()}
    assert set(found) == set(range(60))
    assert all(found[i] == library_ids(f"text {i}", 2).tolist() for i in range(60) if i != 5) and found[5] in (library_ids("text 5", 2).tolist(), library_ids("one two three", 2).tolist())


def test_another_normalizer_goes_through_the_library(tmp_path):
    import json

    own = json.loads(open(BPE).read()) | {"normalizer": None}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(own))
    texts = ["Some Text 12", "ÉTÉ"]
    ids, sizes = ChunkIds(str(path)).encode_many(pa.array(texts))
    told = Tokenizer.from_file(str(path))
    assert ids.tolist() == [i for t in texts for i in told.encode(t, add_special_tokens=False).ids] and not ChunkIds(str(path)).apart and ChunkIds(BPE).apart


def test_documents_are_read_through_the_index(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(40)])
    _, manifest = token_files.write_token_files(docs, BPE, 2, file_bytes=1 << 20)
    assert token_files.read_documents(manifest).where("found").count() == 40
    path = manifest.first()["path"]
    at, n, kind = token_files.TokenFile(path).head["arrays"]["rows"]
    with open(path.removeprefix("file://"), "r+b") as f:
        f.seek(at)
        rows = np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)
        f.seek(at)
        f.write(np.roll(rows, 1).tobytes())
    with pytest.raises(Exception, match="does not lead to key"):
        token_files.read_documents(manifest).collect()


def test_perfect_hash_is_minimal_and_tells_strangers():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20_000).view(np.uint64)
    table = token_files.PerfectHash.build(keys)
    assert sorted(table.numbers(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(np.array([1, 1], np.uint64))


def plain_dropout(coder, text, doc_id):
    """Ids of a text by a loop over its units, each with a heap as its agenda."""
    mask = 2**64 - 1
    mix = lambda x: int(mix64(np.array([x & mask], np.uint64))[0])
    text, start, out = " " + text, 0, []
    for end in range(1, len(text) + 1):
        sign = lambda c: {" ": "▁", "▁": "\ud800"}.get(c, c)
        if end < len(text) and (sign(text[end - 1]), sign(text[end])) in coder.pieces.joined:
            continue
        key = mix(mix(doc_id * sentencepiece_dropout._BASE + coder.seed) + start)
        out += coder.piece_ids(coder.segment(text[start:end], key if coder.limit else None))
        start = end
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_dropout_equals_a_plain_agenda(dropout):
    coder = sentencepiece_dropout.MergeDropout(SP, dropout, 7, most=50)
    words = "thinking of internationalization don't été straße  ▁▁ 漢字かな 12.5% a-very-long-word-without-any-spaces-in-it-that-is-longer-than-sixty-four-signs 🙂".split(" ")
    rng = random.Random(2)
    texts = [t for t in ODD[:-2] if t] + [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    ids = np.arange(len(texts)) - 3
    for _ in range(2):
        flat, counts = coder.encode(pa.array(texts), ids)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [plain_dropout(coder, t, i) for t, i in zip(texts, ids.tolist(), strict=True)]
        assert coder.lossless(pa.array(texts), flat, counts).all()


def test_dropout_varies_by_occurrence_and_decodes(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = [t for t in ODD if t and "▁" not in t]
    flat, counts = sentencepiece_dropout.MergeDropout(SP, 0.0, 1).encode(pa.array(texts), np.zeros(len(texts), int))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts]
    out = sentencepiece_dropout.encode_documents(frame(spark, odd_rows()), SP, 0.3)
    rows = out.collect()
    assert len(rows) == len(ODD) + 2 and all(r["lossless"] for r in rows)
    assert out.where("doc_id = 9").first()["n_pieces"] > len(library.encode(ODD[9]))
    back = {r["doc_id"]: r["text"] for r in sentencepiece_dropout.decode_documents(out, SP).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    again = {r["doc_id"]: r["ids_crc32"] for r in sentencepiece_dropout.encode_documents(frame(spark, odd_rows()).repartition(1), SP, 0.3).collect()}
    assert again == {r["doc_id"]: r["ids_crc32"] for r in rows}
    assert sentencepiece_dropout.encode_documents(frame(spark, []), SP).count() == 0
    word, many = " internationalization", 4_000
    pieces = sentencepiece_dropout.encode_documents(frame(spark, [(1, (word * many)[1:])]), SP, 0.1).first()["ids"]
    decoded = sentencepiece_dropout.Pieces(SP)
    forms, own = set(), []
    for i in pieces:
        if decoded.plain[i].startswith(b" ") and own:
            forms.add(tuple(own))
            own = []
        own.append(i)
    assert len(forms) > 30


def test_text_counts_by_hand():
    text = "a b c\nx # y\na b c\n\n  \na b c d é"
    words = text.split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    got = dict(zip(quality.COUNTS, quality.text_counts(text.encode()), strict=True))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (14, 14, 1, 1, len(covered))
    assert quality.text_counts(None) == quality.text_counts(b"") == (0,) * 8


def test_rules_are_learned_and_ordered(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = rng.choice(WORDS, 80).tolist()
        rows.append((i, " ".join(w + "$$" * (bad and rng.random() < 0.9) for w in words)))
        labels.append((i, int(not bad)))
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    out = quality.judge(frame(spark, [*rows, *odd_rows()]), lab)
    told = {r["doc_id"]: r for r in out.where("doc_id >= 20").collect()}
    wrong = sum(told[i]["kept"] == (i % 5 == 0) for i in range(20, 400))
    assert wrong <= 4 and "symbols_a_word" in told[25]["rule"]
    assert not out.where("text is null").first()["kept"]
    bare = quality.judge(frame(spark, odd_rows()), lab.limit(0))
    assert bare.where("rule is not null").isEmpty() and bare.count() == len(ODD) + 2
    assert quality.judge(frame(spark, []), lab).count() == 0


def test_languages_by_family_then_pair(spark):
    sets = {"en": "the and of with house tree", "de": "der und von mit haus baum schön", "fr": "le et de avec maison arbre été", "es": "el y de con casa árbol año"}
    rng, rows = np.random.default_rng(4), []
    for i in range(480):
        code = list(sets)[i % 4]
        rows.append((i, " ".join(rng.choice(sets[code].split(), 12)), code))
    docs = frame(spark, [*rows, (None, "the house", "en"), (900, None, "en"), (901, "123 $$", "en")])
    model = language.train(docs, most_a_language=60)
    assert set(model.families) == {"germanic", "romance"} and len(model.within["romance"]) == 1
    out = language.identify(docs.drop("lang"), model).withColumn("h", language.held_out(F.col("doc_id"))).toPandas()
    got = out[out.doc_id < 480].set_index("doc_id")
    assert (got[got.h].lang_pred == [rows[int(i)][2] for i in got[got.h].index]).mean() > 0.97
    assert set(out[out.doc_id >= 900].lang_pred) == {"und"} and out.score.between(0, 1).all()
    assert language.train(docs.limit(0)) is None
    assert set(language.identify(docs, None).toPandas().lang_pred) == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
