"""Language identification: language family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bound_batches, materialise
from .words import give_back, parts, slices

#: Families of language codes.  A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

UND = "und"
ORDERS = (2, 3, 4)
DIMENSIONS = 4096
#: Texts are read in runs of so many bytes; this bounds a worker's arrays.
RUN = 1 << 20

#: Bytes as the n-grams see them: whatever is ASCII and no letter is a space.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[[i for i in range(128) if not chr(i).isalpha()]] = 32


def ngram_bins(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the hashed n-gram at every byte (DIMENSIONS where there is none), and where each text starts.

    Texts are apart by more spaces than the longest n-gram has bytes, so none sees its neighbours.
    """
    gap = b" " * max(ORDERS)
    seen = _SEEN[np.frombuffer(b" " + (gap + b" ").join(texts) + gap, np.uint8)]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 + len(gap) for t in texts])])[:-1]
    n = len(seen) - max(ORDERS) + 1
    idle = (seen[:n] == 32) & (seen[1 : n + 1] == 32)
    value, bins = seen[:n].astype(np.uint32), []
    for i in range(1, max(ORDERS)):
        value |= seen[i : n + i].astype(np.uint32) << np.uint32(8 * i)
        if i + 1 in ORDERS:
            x = (value ^ np.uint32(0x1B873593 * (i + 1) % 2**32)) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x = (x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
            x[idle] = DIMENSIONS
            bins.append(x)
    return bins, starts


@F.arrow_udf(T.ArrayType(T.FloatType()))
def ngram_shares(texts: pa.Array) -> pa.Array:
    """Per whole text, the share of each n-gram bin in per cent."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, j in slices(texts, RUN):
        bins, starts = ngram_bins([x or b"" for x in texts.slice(i, j - i).cast(pa.binary()).to_pylist()])
        ends = np.append(starts[1:], len(bins[0]))
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            counts = sum(np.bincount(x[a:b], minlength=DIMENSIONS + 1) for x in bins)[:DIMENSIONS]
            out[i + k] = 100 * counts / max(1, counts.sum())
    return pa.ListArray.from_arrays(np.arange(0, out.size + 1, DIMENSIONS, dtype=np.int32), out.ravel())


def _sums(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Per text, the table's rows summed over all its n-grams."""
    bins, starts = ngram_bins(texts)
    total = np.zeros((len(texts), table.shape[1]))
    for x in bins:
        for a in range(0, len(texts), 64):
            b = min(a + 64, len(texts))
            last = starts[b] if b < len(texts) else len(x)
            total[a:b] += np.add.reduceat(table[x[starts[a] : last]], starts[a:b] - starts[a], axis=0, dtype=np.float64)
    return total


@dataclass(frozen=True)
class Separator:
    """A linear machine: a positive margin votes for ``yes``."""

    yes: str
    no: str
    weights: np.ndarray
    intercept: float


@dataclass(frozen=True)
class LanguageModel:
    families: dict[str, list[str]]
    between: list[Separator]
    within: dict[str, list[Separator]]

    def _choose(self, classes: list[str], machines: list[tuple[Separator, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row the index of the class of most votes (sure ones count more on a tie) and its mean probability."""
        if len(classes) == 1:
            return np.zeros(n, int), np.ones(n)
        at = {c: i for i, c in enumerate(classes)}
        votes, sure = np.zeros((n, len(classes))), np.zeros((n, len(classes)))
        for s, margin in machines:
            p = 1 / (1 + np.exp(-np.clip(2 * margin, -50, 50)))
            votes[:, at[s.yes]] += p >= 0.5
            votes[:, at[s.no]] += p < 0.5
            sure[:, at[s.yes]] += p
            sure[:, at[s.no]] += 1 - p
        sure /= len(classes) - 1
        best = np.argmax(votes + sure / 2, axis=1)
        return best, sure[np.arange(n), best]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of whole texts in lower case."""
        machines = [*self.between, *(s for v in self.within.values() for s in v)]
        table = np.zeros((DIMENSIONS + 1, len(machines) + 1), np.float32)
        for k, s in enumerate(machines):
            table[:DIMENSIONS, k] = s.weights
        table[:DIMENSIONS, -1] = 1
        if len(texts) == 1:  # a text of any length, cut at spaces to keep the arrays small
            total = sum(_sums([part], table) for part in parts(texts[0]))
        else:
            total = _sums(texts, table)
        margins = 100 * total[:, :-1] / np.maximum(total[:, -1:], 1) + np.array([s.intercept for s in machines])
        of = {id(s): margins[:, k] for k, s in enumerate(machines)}
        names = sorted(self.families)
        family, score = self._choose(names, [(s, of[id(s)]) for s in self.between], len(texts))
        out = np.full(len(texts), UND, object)
        for k, name in enumerate(names):
            rows = np.flatnonzero(family == k)
            codes = self.families[name]
            best, p = self._choose(codes, [(s, of[id(s)][rows]) for s in self.within[name]], len(rows))
            out[rows] = np.array(codes, object)[best]
            score[rows] *= p
        return out.tolist(), np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _separators(rows: DataFrame, label: str, classes: list[str]) -> list[Separator]:
    """A linear support vector machine for every two classes."""
    out = []
    for a, b in combinations(classes, 2):
        two = rows.where(F.col(label).isin(a, b)).select((F.col(label) == a).cast("double").alias("label"), "features")
        fit = LinearSVC(maxIter=30, regParam=1e-3, standardization=False).fit(two)
        out.append(Separator(a, b, fit.coefficients.toArray().astype(np.float32), float(fit.intercept)))
    return out


def train(docs: DataFrame, most_a_language: int = 1_500, most: int = 8_000) -> LanguageModel | None:
    """Fit on rows that are not held out and have a language; None if there are none.

    A bounded sample is used: about ``most_a_language`` documents of a language and ``most`` in all, chosen by a hash
    of the id; their whole texts give the n-gram shares.
    """
    usable = bound_batches(docs).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect() if r["lang"] != UND}
    if not sizes:
        return None
    each = max(1, min(most_a_language, most // len(sizes)))
    draw = F.xxhash64(F.lit("language sample"), "doc_id").bitwiseAND(2**63 - 1).cast("double") / 2.0**63
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(each / n))])
    sample = usable.where(F.col("lang").isin(*sizes) & (draw < share[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
    family = F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, FAMILY.get(k, k))])
    rows = materialise(sample.select("lang", family[F.col("lang")].alias("family"), array_to_vector(ngram_shares(F.lower("text")).cast("array<double>")).alias("features")), "languages")
    families: dict[str, list[str]] = {}
    for r in rows.select("family", "lang").distinct().orderBy("family", "lang").collect():
        families.setdefault(r["family"], []).append(r["lang"])
    if not families:
        return None
    return LanguageModel(families, _separators(rows, "family", sorted(families)), {f: _separators(rows, "lang", codes) if len(codes) > 1 else [] for f, codes in families.items()})


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from whole texts alone.

    Cases: ``und`` with score 0 if a text is null or has no letter, or if there is no model (an empty table, no
    languages given); repeated rows are judged alike; columns of these names are replaced.
    """
    if model is None:
        return docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
    shared = bound_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def told(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for i, j in slices(texts, RUN):
            x, p = shared.value.predict([t or b"" for t in texts.slice(i, j - i).cast(pa.binary()).to_pylist()])
            langs += x
            scores.append(p)
        give_back()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, []]))], names=["lang", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.drop("lang_pred", "score").withColumn("told_", told(F.lower("text")))
    return out.withColumns({"lang_pred": F.when(letters, F.col("told_.lang")).otherwise(UND), "score": F.when(letters, F.col("told_.score")).otherwise(0.0)}).drop("told_")
