"""Sharding: a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix.

Rows are dealt to source partitions; how many rows each partition sends to each shard is drawn exactly (a row of the
matrix at a time, from what the shards still lack); each partition permutes its rows and cuts them by its row of
the matrix; after the exchange each shard permutes what it got. Only DataFrame operations touch rows; the driver
draws the matrix, whose size is partitions times shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import free_names, materialise, width, with_offsets

#: Rows of a source partition, and of a bucket of a shard, at most (about).
PART_ROWS = 1_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; exact at any size.

    numpy's generator takes populations under 10**9; beyond, a ratio-of-uniforms rejection with the same law is used.
    """
    total = good + bad
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0 or n >= total:
        return min(good, n)
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    p = good / total
    var = n * p * (1 - p) * (total - n) / (total - 1)
    middle, spread = n * p + 0.5, math.sqrt(8 / math.e) * math.sqrt(var + 0.5) + 3 - math.sqrt(12 / math.e)
    lf = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))
    top = lf((n + 1) * (good + 1) // (total + 2))
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        k = math.floor(middle + spread * (v - 0.5) / u)
        if max(0, n - bad) <= k <= min(good, n) and 2 * math.log(u) <= lf(k) - top:
            return k


def communication_matrix(sent: list[int], wanted: list[int], seed: int) -> np.ndarray:
    """Row p, column s: rows that partition p sends to shard s. Rows sum to sent, columns to wanted."""
    rng, left = np.random.default_rng(seed), list(wanted)
    out = np.zeros((len(sent), len(wanted)), np.int64)
    for p, n in enumerate(sent):
        lacking = sum(left)
        for s, lacks in enumerate(left):
            lacking -= lacks
            out[p, s] = k = hypergeometric(rng, lacks, lacking, n)
            left[s] -= k
            n -= k
    return out


def shuffle_to_shards(df: DataFrame, n_shards: int, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """df's rows and columns with `shard` (0..n_shards-1; sizes at most one apart) and `slot` (0.. in each shard).

    Every arrangement is as likely as any other and fixed by the seed and the order in which df's rows are stored.
    df is written once with row numbers, so that lost executors don't change the draw: narrow it first where texts
    aren't needed. Nulls and repeated rows are rows like any other; an empty table gives an empty table. Columns named
    shard or slot are replaced, others of any name stay.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    spark = df.sparkSession
    row, source_, cuts_, at, bucket_ = free_names([*df.columns, "shard", "slot"], "row", "source", "cuts", "at", "bucket")
    numbered = materialise(df.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()), "shuffle")
    n = numbered.count()
    parts = max(width(spark), -(-n // part_rows))
    source = F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(parts)).cast("int")
    sent = {r[source_]: r["n"] for r in numbered.groupBy(source.alias(source_)).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    cuts = np.cumsum(communication_matrix([sent.get(p, 0) for p in range(parts)], wanted, seed), axis=1)
    table = spark.createDataFrame([(p, [int(c) for c in row]) for p, row in enumerate(cuts)], f"{source_} int, {cuts_} array<long>")
    first = Window.partitionBy(source_).orderBy(F.xxhash64(row, F.lit(seed + 1)), row)
    local = numbered.withColumn(source_, source).withColumn(at, F.row_number().over(first) - 1)
    dealt = local.join(table, source_).withColumn("shard", F.size(F.filter(cuts_, lambda c: c <= F.col(at))).cast("int")).drop(cuts_, at, source_)
    # the second permutation orders by a hash; its leading bits make the buckets, so that a shard isn't one task
    bits = max(0, (-(-parts // n_shards) * 2 - 1).bit_length())
    key = F.xxhash64(row, F.lit(seed + 2))
    bucket = F.shiftright(key, 64 - bits) if bits else F.lit(0)
    exchanged = materialise(dealt.withColumn(bucket_, bucket), "shards")
    return with_offsets(exchanged, ["shard"], bucket_, [key, F.col(row)], "slot").drop(bucket_, row)


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 16 shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shuffle_to_shards(narrow, 16, seed=20).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
