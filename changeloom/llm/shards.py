"""Sharding by a two-pass external shuffle, in DataFrame operations only.

First pass: a seeded hash of the key chooses the shard by highest weight, and another one a
bucket of the shard; buckets are made so many that one fits in a task's memory. Second pass:
each bucket is put in order, shuffled by Fisher-Yates (Spark's ``shuffle`` with a seed) and
written behind the buckets before it. One more shard takes rows only into itself.

Spark draws for ``shuffle`` per partition, so partitions are given, not hashed: a lane holds the
same few buckets of one shard, in order, whatever the session's number of partitions. Slots then
follow from the rows, the seed and the bucket size alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.sources.shared import new_path

BUCKET_BYTES = 4 << 20
LANE_BUCKETS = 4
MOST_LANES = 100_000  # partitions of the second pass; beyond it a lane holds more buckets


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest weight for the key; ties go to the lowest shard."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(k), key).alias("w"), F.lit(-k).alias("s")) for k in range(shards)]
    return (-F.greatest(*weights)["s"] if shards > 1 else F.lit(0)).cast("int")


def shard_documents(documents: DataFrame, shards: int = 8, seed: int = 17, id_column: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, lane_buckets: int = LANE_BUCKETS) -> DataFrame:
    """Write all rows into shards and return what was written.

    Result: id, text, size (UTF-8 bytes of the text, null: none, plus 1), shard, grown_shard (with
    one more shard), slot (gapless from 0 in each shard). A null key hashes like any key; repeated
    rows are all kept; an empty table gives no rows; other columns are left out. Equal rows (id and
    text) share a bucket. A task and a file of the second pass
    hold ``lane_buckets`` buckets, or more where there would be over 100,000 tasks.
    """
    spark = documents.sparkSession
    key = F.col("id")
    rows = documents.selectExpr(f"cast(`{id_column}` as long) id", "cast(text as string) text")
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    total = rows.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    lane_buckets = max(lane_buckets, -(-per_shard * shards // MOST_LANES))
    lanes = -(-per_shard // lane_buckets)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), key, F.col("text")), F.lit(per_shard))
    spotted = rows.withColumn("shard", shard_of(key, shards, seed)).withColumn("bucket", bucket)
    counts = spotted.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.lit(None).alias("row"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    record = F.struct("id", "size", "text").alias("row")
    # A bucket's base travels with its rows, so that nothing is joined behind the shuffle.
    sent = spotted.select("shard", "bucket", record, F.lit(None).cast("long").alias("base")).unionByName(bases)
    lane = (F.col("shard") * lanes + F.floor(F.col("bucket") / lane_buckets)).cast("int")
    placed = (
        sent.withColumn("lane", lane).repartitionById(shards * lanes, "lane")
        .groupBy("lane", "shard", "bucket").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.max("base").alias("base"))
        .sortWithinPartitions("bucket")
        .select("shard", "base", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
        .select(
            F.col("row.id").alias(id_column), "row.text", "row.size", "shard",
            shard_of(F.col("row.id"), shards + 1, seed).alias("grown_shard"),
            (F.col("base") + F.col("at")).alias("slot"),
        )
    )
    path = new_path(spark, "shards")
    placed.write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)
