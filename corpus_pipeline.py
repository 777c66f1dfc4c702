"""From raw documents to packed training sequences: quality rules, language ID, near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm import language, minhash, packing, quality
from partwise.llm.queries import tokenizer_file
from partwise.llm.storage import materialise

#: A language below this score (the product of family and pair probabilities) counts as not identified.
LEAST_LANGUAGE_SCORE = 0.3


#: Documents of a language that the pipeline's model is fitted on; with 1,500 an executor of 3,000 MB runs out of memory,
#: because it also holds what the other stages' workers keep.
LANGUAGE_SAMPLE = 800


def _apart(docs: DataFrame) -> DataFrame:
    """Id and text, and the other columns in one, so that no result of an operator meets a column of its name."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *[F.struct(*others).alias("others")] * bool(others))


def _whole(told: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return told.select(*[F.col(c if c in ("doc_id", "text") else f"others.`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that no learned rule rejects; a null or empty text fails the base rules."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _whole(quality.judge(_apart(docs), labels).where("kept"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without letters go."""
    told = language.identify(_apart(docs), language.train(docs, most_a_language=LANGUAGE_SAMPLE))
    return _whole(told.where((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.  A null id links with nothing and stays."""
    dropped = minhash.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 ids."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("packing", pack)]

#: Learned rules, a classifier and MinHash have no SQL; a test compares every stage with a plain loop over its input.
#: Stages keep all columns of documents, of any name; repeated rows are judged alike; an empty table stays empty.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
