"""Digests and summaries of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha_of_lines(lines: Column) -> Column:
    """sha256 of an array's elements, each followed by a line feed."""
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256)


def merkle_root(rows: DataFrame, keys: list[str], location: str, digest: str) -> DataFrame:
    """keys, merkle_root: sha256 over `digest  location` lines in order of location."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(location).alias("l"), F.col(digest).alias("d")))).alias("all_"))
    return packed.select(*keys, sha_of_lines(F.transform("all_", lambda x: F.concat(x["d"], F.lit("  "), x["l"]))).alias("merkle_root"))


def fingerprint(rows: DataFrame, keys: list[str], purl: str, *heads: str) -> DataFrame:
    """keys, fingerprint: sha256 over the heads and the sorted distinct purls, a line each."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(purl)).alias("all_"))
    return packed.select(*keys, sha_of_lines(F.concat(F.array(*map(F.lit, heads)).cast("array<string>"), F.col("all_"))).alias("fingerprint"))


def collapsed(rows: DataFrame, key: Column, name: str, path: str, sep: str = "; ") -> DataFrame:
    """One row per key with its distinct paths, sorted and joined."""
    return rows.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.array_join(F.array_sort(F.collect_set(path)), sep).alias("paths"))


def network_summary(rows: DataFrame, host: str, kind: str, size: str) -> DataFrame:
    """One row: connections, distinct hosts, bytes, and protocol counts as text sorted by protocol."""
    kinds = rows.groupBy(kind).agg(F.count("*").alias("n"))
    text = kinds.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(kind), F.col("n")))), ",").alias("protocol_counts"))
    return rows.agg(F.count("*").alias("total"), F.count_distinct(host).alias("unique_hosts"), F.sum(size).alias("total_bytes")).join(F.broadcast(text))
