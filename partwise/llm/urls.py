"""URL filter: fixed host and path rules, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlRule:
    """``host/path`` as written: fits the host and its subdomains where the path starts with the rule's path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the query.
RULES = (UrlRule(ALLOW, "com/"), UrlRule(BLOCK, "example.com/en/"), UrlRule(ALLOW, "www.example.com/en/"), UrlRule(BLOCK, "net/es/"), UrlRule(BLOCK, "net/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """Text of the longest rule that fits, else null (ties: the first of the rules)."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        out = F.when(rule.fits(host, path), rule.text).otherwise(out)
    return out


def ngrams(host: Column, path: Column, low: int = 3, high: int = 4) -> Column:
    """Character n-grams of the bounded host and path; the two kinds are told apart by a letter in front."""

    def of(kind: str, x: Column) -> Column:
        whole = F.concat(F.lit("^"), x, F.lit("$"))

        def all_of(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1)))
            return F.transform(starts, lambda i: F.concat(F.lit(kind), F.substring(whole, i, F.lit(n))))

        return F.concat(*[all_of(n) for n in range(low, high + 1)])

    return F.concat(of("h", host), of("p", path))


#: A small labelled table: words that hosts and paths of unwanted and of ordinary sites are made of.
UNWANTED = "casino poker betting bets slots jackpot lottery gamble win adult xxx porn sex escort nude cams pills viagra pharmacy meds cheap spam linkfarm farm clickbait ads adserver track tracker popup banner warez torrent crack keygen payday loans replica free".split()
ORDINARY = "news library school university garden science history museum weather music recipes travel health books city forum docs wiki sports art law research family nature market river mountain kitchen letters archive journal daily open public local north station".split()
UNWANTED_PATHS = "free-spins bonus-code sign-up-and-win live-cams xxx-video buy-cheap-pills no-prescription cracked-download serial-keygen click-here popunder affiliate-redirect ad-banner instant-loan replica-watches hot-singles jackpot-today unlimited-credits".split()
ORDINARY_PATHS = "articles about-us opening-hours reading-list course-notes annual-report field-guide photo-gallery timetable lecture-series old-maps garden-plan weather-today family-recipes letters-to-the-editor user-manual release-notes museum-tour".split()
HOSTS = ("{0}.example.org", "www.{0}-{1}.com", "{0}-{1}.example.net", "blog.{0}.net", "m.{1}-{0}.org", "{0}{1}.example.com", "{0}-{1}.example.org", "www.{0}.example.net", "{1}-{0}.example.com", "m.{0}-{1}.example.net")
#: Weights of the urls to block that are tried.
WEIGHTS = (1.0, 1.5, 2.5)
#: Forms of a path: a phrase of the site's kind, or a plain number below a language, which says nothing.
PATHS = ("/{0}/{1}", "/en/{1}", "/{0}.html", "/de/{1}.html", "/pages/{0}?id={1}", "/fr/{1}/", "/es/{1}", "")


def made_words(n: int) -> list[str]:
    """Words of three syllables by rule, for hosts whose names mean nothing."""
    syllables = [c + v + e for c in ("b", "d", "f", "h", "l", "m", "n", "r", "t", "w", "th", "sh", "st") for v in ("a", "e", "i", "o", "u", "") for e in ("", "n", "r", "s", "t", "th", "nd", "ng")]
    return ["".join(syllables[(i * step + 11 * step) % len(syllables)] for step in (37, 101, 223)) for i in range(1, n + 1)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, label``: a fixed, small table of whole urls, 1 for unwanted sites.

    Both kinds take the same forms of hosts and paths; the words of hosts and the phrases of paths tell them apart, and
    about half of the paths say nothing.  Ordinary sites are the more, most of them with made-up names.
    """
    rows = []
    for label, words, phrases in ((1.0, UNWANTED, UNWANTED_PATHS), (0.0, ORDINARY, ORDINARY_PATHS), (0.0, made_words(480), ORDINARY_PATHS)):
        for i, w in enumerate(words):
            for k, form in enumerate(HOSTS):
                host = form.format(w, words[(i * 7 + k * 3 + 1) % len(words)])
                path = PATHS[(i + 3 * k) % len(PATHS)].format(phrases[(i * 5 + k) % len(phrases)], 1 + (i % 40 * 6 + k) * 41)
                rows.append((f"http{'s' * (k % 2)}://{host}{path}", label))
        # Some sites are told by their paths alone: both kinds have hosts of the same made-up names.
        for i, w in enumerate(made_words(60)):
            rows.append((f"https://{w}.example.com/{phrases[i % len(phrases)]}/{1 + 17 * i}", label))
    return spark.createDataFrame(rows, "url string, label double")


@dataclass(frozen=True)
class UrlModel:
    """A fitted regression and the probability from which it blocks."""

    pipeline: PipelineModel
    threshold: float

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls(host, path, ...)`` with ``block_probability``."""
        told = self.pipeline.transform(urls.withColumn("grams_", ngrams(F.col("host"), F.col("path"))))
        return told.withColumn("block_probability", vector_to_array("probability_")[1]).drop("grams_", "features_", "raw_", "probability_", "prediction_")


def part_of(url: str = "url") -> Column:
    """The part of a labelled url: 0 to 2 train, 3 sets the threshold, 4 is held out."""
    return F.pmod(F.xxhash64(F.lit("part"), F.col(url)), F.lit(5))


def train(labelled: DataFrame, features: int = 1 << 16) -> UrlModel | float:
    """Fit on ``labelled(url, label)`` (1: block); with labels of one kind, that label alone (0 without any).

    Three fifths of the urls, by hash, are fitted, with several weights of the urls to block; the weight and the
    threshold (0.3 to 0.75) are those with the best F1 on another fifth (0.5 if that lacks a class); the last fifth is
    held out for ``held_out_figures``.
    """
    host, path = url_parts(F.col("url"))
    rows = materialise(labelled.select(host.alias("host"), path.alias("path"), part_of().alias("part"), F.col("label").cast("double").alias("label")), "urls")
    counts = {(r["label"], r["train"]) for r in rows.select("label", (F.col("part") < 3).alias("train")).distinct().collect()}
    kinds = sorted({k for k, _ in counts})
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    fitted = rows.where("part < 3") if all((k, True) in counts for k in kinds) else rows
    grams = fitted.select(ngrams(F.col("host"), F.col("path")).alias("grams_"), "label")
    found = []
    for weight in WEIGHTS:
        stages = [HashingTF(inputCol="grams_", outputCol="features_", numFeatures=features), LogisticRegression(featuresCol="features_", labelCol="label", weightCol="weight", regParam=0.0003, maxIter=60, probabilityCol="probability_", rawPredictionCol="raw_", predictionCol="prediction_")]
        model = UrlModel(Pipeline(stages=stages).fit(grams.withColumn("weight", 1 + (weight - 1) * F.col("label"))), 0.5)
        cuts = model.score(rows.where("part = 3")).select("label", "block_probability", F.explode(F.array(*[F.lit(0.3 + 0.05 * k) for k in range(10)])).alias("cut"))
        hit = (F.col("block_probability") >= F.col("cut")).cast("double")
        f1 = cuts.groupBy("cut").agg((2 * F.sum(hit * F.col("label")) / (F.sum(hit) + F.sum("label"))).alias("f1")).where("f1 > 0")
        best = f1.orderBy(F.desc("f1"), F.desc("cut")).first()
        found.append((best["f1"] if best else 0.0, best["cut"] if best else 0.5, model.pipeline))
    _, cut, pipeline = max(found, key=lambda x: x[:2])
    return UrlModel(pipeline, cut)


def held_out_figures(labelled: DataFrame) -> dict[str, float]:
    """Precision, recall and number of the held-out fifth of a labelled table."""
    host, path = url_parts(F.col("url"))
    model = train(labelled)
    judged = model.score(labelled.where(part_of() == 4).select(host.alias("host"), path.alias("path"), "label"))
    hit = (F.col("block_probability") >= model.threshold).cast("double")
    r = judged.agg((F.sum(hit * F.col("label")) / F.sum(hit)).alias("precision"), (F.sum(hit * F.col("label")) / F.sum("label")).alias("recall"), F.count("*").alias("n")).first()
    return {**r.asDict(), "threshold": model.threshold}


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` of every row of ``pages(page_id, url)``.

    A fitting rule decides (the longest); else the regression does, blocking from its threshold.  It is trained on
    ``labelled(url, label)`` (1: block), or without that on a small table of urls that comes with the library.  All rows are judged in the scan that reads them; expressions only, no Python.

    Cases: a null url or one without ``://`` has empty host and path and no rule; repeated rows are judged alike;
    with labels of one kind only, urls without a rule get that label (allow if there are none); a url of any length
    is taken whole; columns of other names are dropped; an empty table gives an empty result.
    """
    rules = tuple(rules)
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = url_parts(F.col("url"))
    told = pages.select("page_id", host.alias("host"), path.alias("path"))
    told = told.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    if isinstance(model, float):
        told = told.withColumn("block_probability", F.lit(model))
    else:
        told = model.score(told)
    by_rule = F.when(F.col("rule").isin(*[r.text for r in rules if r.verdict == BLOCK]), BLOCK).when(F.col("rule").isNotNull(), ALLOW)
    verdict = F.coalesce(by_rule, F.when(F.col("block_probability") >= (0.5 if isinstance(model, float) else model.threshold), BLOCK).otherwise(ALLOW))
    return told.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")
