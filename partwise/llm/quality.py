"""Quality rules: text statistics, fixed base rules and a decision list learned by sequential covering."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bound_batches, materialise
from .words import SPACES, give_back

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"

_TAILS = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = end = 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    less = lambda drop: len(text) - len(text.translate(None, drop))
    return (len(words), len(text.translate(None, SPACES + _TAILS)), less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(_CAPITALS), text.count(b"!"))


@F.arrow_udf(STATS)
def text_stats(texts: pa.Array) -> pa.Array:
    rows = [text_counts(x.as_buffer().to_pybytes() if x.is_valid else None) for x in texts.cast(pa.binary())]
    columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
    give_back()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def _per(x: str, y: str) -> Column:
    return F.col(x) / F.greatest(F.col(y), F.lit(1))


#: What rules may test, as expressions over COUNTS.
MEASURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _per("word_chars", "n_words"),
    "symbols_a_word": lambda: _per("n_symbols", "n_words"),
    "dup_line_share": lambda: _per("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _per("n_repeat_words", "n_words"),
    "capital_share": lambda: _per("n_capitals", "word_chars"),
    "shouts_a_word": lambda: _per("n_shouts", "n_words"),
    "words_a_line": lambda: _per("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        x = MEASURES[self.measure]()
        return x >= self.threshold if self.at_least else x < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(conditions) -> Column:
    return reduce(lambda x, y: x & y, (c.column() for c in conditions), F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the text of the first rule that rejects a row, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_all(rule), " and ".join(map(str, rule))).otherwise(out)
    return out


def _best_condition(rows: DataFrame, edges: dict[str, list[float]]) -> tuple[Condition, int, int] | None:
    """The condition of the highest information gain on the covered rows, from one grouped count by bin."""
    counted = rows.select("bad", F.explode("bins").alias("x")).groupBy("x.measure", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    p0, n0 = (sum(r[k] for r in counted if r["measure"] == counted[0]["measure"]) for k in ("p", "n")) if counted else (0, 0)
    if not p0 or not n0:
        return None
    best, info = None, math.log2(p0 / (p0 + n0))
    for measure, ts in sorted(edges.items()):
        by = {r["bin"]: (r["p"], r["n"]) for r in counted if r["measure"] == measure}
        for k, t in enumerate(ts, 1):
            p = sum(v[0] for b, v in by.items() if b >= k)
            n = sum(v[1] for b, v in by.items() if b >= k)
            for at_least, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - info)) > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = gain, Condition(measure, at_least, t), a, b
    return best and best[1:]


def _with_middles(cuts: list[float]) -> list[float]:
    """Cuts and the middles between them, so that a threshold can lie in the gap between two kinds of rows."""
    return sorted({*cuts, *((a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False))})


def learn_rules(rows: DataFrame, max_rules: int = 8, max_conditions: int = 4, bins: int = 64, min_precision: float = 0.9, min_covered: int = 3) -> list[Rule]:
    """Sequential covering over ``rows`` (COUNTS, ``bad`` 0/1, ``pruning`` boolean).

    A rule grows by the condition of the highest information gain on the growing rows, is cut back to the prefix
    that does best on the pruning rows, and is taken if at least ``min_precision`` of all rows that it covers are
    bad.  Its rows leave and the next rule is grown.  Every step is one grouped count; only counts reach the driver.
    """
    names = list(MEASURES)
    cuts = rows.agg(*[F.percentile_approx(MEASURES[m](), [i / bins for i in range(1, bins)], 10_000).alias(m) for m in names]).first()
    edges = {m: _with_middles(sorted({float(t) for t in cuts[m] or [] if t is not None})) for m in names}
    bin_of = lambda m: F.size(F.filter(F.array(*map(F.lit, edges[m])), lambda t: t <= MEASURES[m]()))
    binned = [F.struct(F.lit(m).alias("measure"), bin_of(m).alias("bin")) for m in names if edges[m]]
    if not binned:
        return []
    rules: list[Rule] = []
    left = materialise(rows.withColumn("bins", F.array(*binned)), "binned")
    while len(rules) < max_rules:
        growing, rule = left.where(~F.col("pruning")), []
        while len(rule) < max_conditions and (found := _best_condition(growing.where(_all(rule)), edges)):
            rule.append(found[0])
            if not found[2]:
                break
        if not rule:
            break
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        kinds = [(k, bad, side) for k in range(len(prefixes)) for bad in (1, 0) for side in (True, False)]
        told = left.agg(*[F.count(F.when(_all(prefixes[k]) & (F.col("bad") == bad) & (F.col("pruning") == side), 1)) for k, bad, side in kinds]).first()
        count = dict(zip(kinds, told, strict=True))
        both = {k: [count[k, bad, True] + count[k, bad, False] for bad in (1, 0)] for k in range(len(prefixes))}
        fit = [k for k, (p, n) in both.items() if p >= min_covered and p >= min_precision * (p + n)]
        if not fit:
            break
        worth = {k: (count[k, 1, True] - count[k, 0, True]) / max(1, count[k, 1, True] + count[k, 0, True]) for k in fit}
        k = max(fit, key=lambda k: (worth[k], both[k][0], -k))
        rules.append(tuple(prefixes[k]))
        left = left.where(~_all(prefixes[k]))
    return rules


def labelled_counts(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """COUNTS and ``bad`` of at most ``max_labelled`` labelled documents (the first by hash) that pass the base rules.

    The ids are broadcast (``max_labelled`` rows at most), so texts stay where they are read.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = found.select("doc_id", (1 - F.col("quality")).alias("bad"), text_stats("text").alias("s"))
    return materialise(found.select("bad", (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).alias("pruning"), "s.*").where(~base_failed()), "labelled")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **options) -> DataFrame:
    """``docs`` with its COUNTS, ``base_failed``, ``rule`` (the rejecting learned rule, or null) and ``kept``.

    Words are runs free of ASCII white space.  Rules are learned from at most ``max_labelled`` labelled documents;
    all rows are judged in the scan that reads them, without a shuffle.

    Cases: a null text counts as empty (no words, so the base rule fails it); a text of any length is counted whole;
    rows that repeat are judged alike; without labels, or with labels of one kind, no rule is learned and the base
    rules decide; columns of ``docs`` named like a result are replaced; an empty table gives an empty result.
    """
    bound_batches(docs)
    rules = learn_rules(labelled_counts(docs, labels, max_labelled), **options)
    clash = [c for c in docs.columns if c in (*COUNTS, "base_failed", "rule", "kept")]
    told = docs.drop(*clash).withColumn("counts_", text_stats("text")).select("*", "counts_.*").drop("counts_")
    return told.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
