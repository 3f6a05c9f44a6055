"""Sharding by weighted rendezvous hashing (operator 4); law ``key``.

Every shard draws a score for every key from the hash of (key, shard), and
the best score wins. With u uniform in (0, 1) the score is -ln(u) / weight,
smallest first, which gives each shard keys in proportion to its weight. The
scores of a shard don't depend on the other shards: one more shard takes only
the keys it now wins, and the others keep theirs.

Only built-in functions; the assignment needs no shuffle. Slots number the
rows of a shard without gaps. They come from running counts on two levels
(rows of a bucket, then buckets of a shard), after equal rows were counted
together, so neither a large shard nor a key with a third of all rows is ever
gathered in one task; counts of equal rows are expanded again in pieces.

Cases: a null text has size 8 and the checksum of the empty string; null ids
are a key of their own; repeated rows share a shard and get different slots;
an empty table gives no rows; other columns are not read by the query, and
``assign`` keeps them, adding only the columns it is told to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwise.llm.common import read, written

SHARDS = 24
BUCKETS = 256  # running-count buckets of a shard
PIECE = 4096  # equal rows expanded at a time


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins the key; shards are numbered by position
    in ``weights`` (each above 0)."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    name = F.coalesce(key.cast("string"), F.lit("\0"))

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 12) + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / weight).alias("score"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[score(s, w) for s, w in enumerate(weights)]))["shard"]


def assign(df: DataFrame, key: str, weights: list[float], shard_column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle."""
    return df.withColumn(shard_column, shard_of(df[key], weights))


def number(rows: DataFrame, shard_column: str, slot_column: str = "slot", buckets: int = BUCKETS) -> DataFrame:
    """Adds a slot from 0 without gaps within each shard. ``rows`` is narrow
    (keys, sizes, checksums): equal rows are interchangeable. The offsets are
    one row a (shard, bucket), at most shards * ``buckets``."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    counted = written(counted, "shards")
    sums = counted.groupBy(shard_column, "__bucket").agg(F.sum("__n").alias("__n"))
    ahead = Window.partitionBy(shard_column).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(shard_column).alias("__shard"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy(shard_column, "__bucket").orderBy(*[c for c in columns if c != shard_column]).rowsBetween(Window.unboundedPreceding, -1)
    placed = (counted.withColumn("__within", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
              .join(F.broadcast(offsets), F.col(shard_column).eqNullSafe(F.col("__shard")) & (F.col("__bucket") == F.col("__b")))
              .withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(PIECE).cast("long"))))
              .withColumn("__at", F.explode(F.sequence(F.col("__piece"), F.least(F.col("__piece") + PIECE, F.col("__n")) - 1))))
    return placed.select(*columns, (F.col("__offset") + F.col("__within") + F.col("__at")).alias(slot_column))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign(assign(docs, "doc_id", [1.0] * SHARDS), "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return number(placed, "shard").withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
