"""Sharding by a keyed permutation of global row numbers.

Law: `rows`. Every row gets a number from 0 to n-1 that depends on the rows alone, not on files or partitions; a
Feistel network with cycle walking permutes 0..n-1; the permuted number p gives shard p mod k and slot p div k, so
counts of shards differ by one at most, slots have no gaps, and both can be computed from p without the table.

Numbers: rows fall into `buckets` by a hash of (doc_id, size, crc32 of text) and are ranked inside a bucket by
those; a bucket's offset is the count of rows in the buckets before. Equal rows are interchangeable. No task sees more
than its buckets, and the table of bucket counts is of fixed size.

Null texts have size 1 and crc32 0 (as empty ones). Null doc_ids are rows like others. Extra columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

SHARDS = 16


def feistel(p: Column, left: int, right: int, seed: int, rounds: int = 4) -> Column:
    """One permutation of 0..left*right-1: rounds of (a, b) -> (b, a + F(b)), each half in its own residue class."""
    a, b, ma, mb = F.floor(p / F.lit(right)), p % right, left, right
    a = F.expr("0") if left == 1 else a
    for i in range(rounds):
        a, b, ma, mb = b, (a + F.pmod(F.xxhash64(b, F.lit(seed), F.lit(i)), F.lit(ma))) % ma, mb, ma
    # after an even count of rounds the halves are in their own classes again
    return a * right + b


def permuted(p: Column, n: int, seed: int = 20240601) -> Column:
    """A permutation of 0..n-1: Feistel over the next larger a*b, applied again while the result is n or more.

    a*b - n is under a, and a walk can only pass numbers of n or more, each once: it ends after a*b - n more steps
    at most. 64 are made at most; past 64 such numbers a walk of that length has a chance under 64**-64,
    and an error is raised rather than a wrong number returned.
    """
    if n <= 1:
        return F.lit(0).cast("bigint")
    left = math.isqrt(n)
    right = -(-n // left)
    steps = min(64, left * right - n)
    once = lambda x: feistel(x, left, right, seed).cast("bigint")

    def walked(first: Column) -> Column:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
        return F.when(first < n, first).otherwise(let(out, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a walk of the permutation is too long")).cast("bigint"))))

    return let(once(p), walked)


def numbered(rows: DataFrame, order: list[str], buckets: int = 4096) -> tuple[DataFrame, int]:
    """rows with row_number_ (bigint, from 0), and their count."""
    dealt = rows.withColumn("bucket_", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    # at most `buckets` rows from here to the join
    counts = dealt.groupBy("bucket_").agg(F.count("*").alias("n_"))
    total = counts.agg(F.sum("n_")).first()[0] or 0
    starts = counts.select("bucket_", (F.sum("n_").over(Window.orderBy("bucket_")) - F.col("n_")).alias("offset_"))
    rank = F.row_number().over(Window.partitionBy("bucket_").orderBy(*order)) - 1
    out = dealt.withColumn("rank_", rank).join(F.broadcast(starts), "bucket_").withColumn("row_number_", F.col("offset_") + F.col("rank_"))
    return out.drop("bucket_", "rank_", "offset_"), total


def shards(docs: DataFrame, count: int = SHARDS, seed: int = 20240601, buckets: int = 4096) -> DataFrame:
    """The contract's rows: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the row number and its image."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"], buckets)
    rows = rows.withColumn("permuted", permuted(F.col("row_number_"), n, seed))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("permuted") % count).cast("int").alias("shard"),
        F.floor(F.col("permuted") / count).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("row_number_").alias("row_number"), "permuted",
    )
