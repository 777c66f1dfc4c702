"""Global shuffle of a table into shards: scatter into memory-sized buckets, shuffle each bucket, write it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import shared_path

#: Bytes of text that one bucket holds on average; a task shuffles one bucket in memory.
BUCKET_BYTES = 16 << 20
#: Rows that share id and text are spread over the buckets one by one if they fill more than this share of a bucket.
HOT = 1 / 16
#: Buckets whose counts are summed up together before the sums of such spans are.
SPAN = 4096


def _spread(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """``row_`` (the columns of ``docs``), ``key_`` (of id and text) and ``copy_``, which tells many equal rows apart.

    Keys of many rows are found on a narrow projection.  Their rows are counted before they are shuffled, and each
    copy then gets a number, so that equal rows are dealt like different ones, by the same rule on any partitioning.
    """
    key = F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), key.alias("key_"))
    narrow = docs.select(key.alias("key_"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b_"))
    many = narrow.groupBy("key_").agg(F.count("*").alias("n_"), F.sum(F.col("b_") + 8).alias("b_")).where((F.col("n_") > 1) & (F.col("b_") > bucket_bytes * HOT)).select("key_")
    if many.isEmpty():
        return rows.withColumn("copy_", F.lit(0).cast("long"))
    few = rows.join(many, "key_", "left_anti").withColumn("copy_", F.lit(0).cast("long"))
    counted = rows.join(many, "key_", "left_semi").groupBy("key_", "row_").agg(F.count("*").alias("n_"))
    return few.unionByName(counted.select("row_", "key_", F.explode(F.sequence(F.lit(1).cast("long"), "n_")).alias("copy_")))


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` in a random order as ``shards`` shards; returns the written table.

    Pass 1 scatters the rows over ``total size / bucket_bytes`` buckets by a seeded hash of id, text and, for rows that
    are there many times, the number of the copy.  Pass 2 has one bucket a task: it collects the bucket into one array,
    puts it in a fixed order, runs Fisher-Yates over it (Spark's ``shuffle``, whose state starts anew from the seed and
    the number of the task, which is the bucket's) and writes it to the shard that its place in the whole order falls
    in.  The whole order is bucket after bucket, so counts of rows by bucket give every row its ``slot`` without a
    sort, and shards hold row counts at most one apart: law ``rows``.  Equal rows and seeds give equal shards on any
    partitioning of the input.

    The result has the columns of ``docs`` and ``size`` (UTF-8 bytes of the text plus 8), ``law``, ``shard`` and
    ``slot`` (gapless from 0 in each shard), partitioned by shard on disk.  Only DataFrame functions are used.

    Cases: a null text counts as empty and stays null; rows with null or repeated ids are scattered by their texts;
    rows that repeat are all kept, each in its own slot; columns of ``docs`` named like a result are replaced, others
    of any name are kept; an empty table writes no shard and gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "law", "shard", "slot")
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    total = docs.agg(F.count("*").alias("rows"), F.sum(weight).alias("bytes")).first()
    rows, buckets = total["rows"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("key_"), F.col("copy_")), F.lit(buckets)).cast("int")
    spread = _spread(docs, bucket_bytes).select(bucket.alias("bucket_"), F.xxhash64(F.lit(seed), F.col("key_")).alias("order_"), "row_")

    counts = spread.groupBy("bucket_").agg(F.count("*").alias("n_")).withColumn("span_", F.expr(f"bucket_ div {SPAN}"))
    up_to = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy("span_").agg(F.sum("n_").alias("n_")).select("span_", up_to(Window.orderBy("span_")).alias("first_"))
    inside = counts.withColumn("in_", up_to(Window.partitionBy("span_").orderBy("bucket_")))
    base = inside.join(spans, "span_").select("bucket_", (F.col("first_") + F.col("in_")).alias("base_"))

    # The base of a bucket travels with its rows, so that a bucket is one task and meets nothing else.
    record = F.struct("order_", "row_")
    marked = spread.select("bucket_", record.alias("record_"), F.lit(None).cast("long").alias("base_")).unionByName(base, allowMissingColumns=True)
    gathered = marked.repartitionById(buckets, "bucket_").groupBy("bucket_").agg(F.sort_array(F.collect_list("record_")).alias("records_"), F.max("base_").alias("base_"))
    placed = gathered.select("base_", F.posexplode(F.shuffle("records_", F.lit(seed))).alias("pos_", "record_"))
    at = placed.select("record_.row_", (F.col("base_") + F.col("pos_")).alias("at_"))
    shard = F.expr(f"cast(((at_ + 1) * {shards} - 1) div {max(rows, 1)} as int)")
    out = at.select("row_", "at_", shard.alias("shard_")).select("row_.*", F.col("shard_").alias("shard"), F.expr(f"at_ - shard_ * {rows} div {shards}").alias("slot"))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = out.withColumns({"size": F.octet_length(text).cast("long") + 8, "law": F.lit("rows")})
    path = shared_path(spark, "shards")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
