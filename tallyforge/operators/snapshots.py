"""Snapshots of public indexes as bucketed tables: what a network query would answer, as a join that leaves the snapshot where it lies.

A snapshot is written once, dealt and sorted by its key into buckets. A lookup shuffles only the evidence, into the same buckets; Spark
reads the snapshot bucket by bucket, and where the evidence is small its keys' Bloom filter is applied to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import purl_segment

#: Systems of the index and the purl types of their packages.
SYSTEMS = {"CARGO": "cargo", "NPM": "npm", "GO": "golang", "MAVEN": "maven", "PYPI": "pypi", "NUGET": "nuget"}

HASH_CONFIDENCE = 0.90


def saved(rows: DataFrame, name: str, key: str, path: str, buckets: int = 200) -> DataFrame:
    """rows as table `name` at path, in buckets by key and sorted by it; repeated saving replaces the table."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def indexed_purl(system: Column, name: Column, version: Column) -> Column:
    """The purl of an index entry; null for other systems. Maven names are group:artifact."""
    known = F.upper(system)
    kind = F.coalesce(*(F.when(known == s, F.lit(t)) for s, t in SYSTEMS.items()))
    colon = F.instr(name, ":")
    own = F.when((known == "MAVEN") & (colon > 0), F.concat(purl_segment(F.substring_index(name, ":", 1)), F.lit("/"), purl_segment(F.substr(name, colon + 1)))).otherwise(purl_segment(name))
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), own, F.lit("@"), purl_segment(version))


def by_hash(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """files (sha256, ...) with purl, technique and confidence of each entry of the snapshot (sha256, system, name, version) of the same content.

    Digests are compared in small letters; those that aren't 64 hexadecimal digits and files that the index doesn't know give no row, and an
    entry that the snapshot has twice counts once.
    """
    asked = files.withColumn("sha256", F.lower("sha256")).where(F.col("sha256").rlike("^[0-9a-f]{64}$"))
    found = asked.join(snapshot.select("sha256", "system", "name", "version"), "sha256")
    found = found.select(*files.columns, indexed_purl(F.col("system"), F.col("name"), F.col("version")).alias("purl")).where("purl is not null")
    return found.distinct().withColumns({"technique": F.lit("hash_match"), "confidence": F.lit(HASH_CONFIDENCE)})


def package_hashes(packages: DataFrame, lists: DataFrame) -> DataFrame:
    """packages (name, arch) with sha256 of their md5sums list (file, text): the file `name`, else `name:arch`; null without one."""
    own = lists.select("file", F.sha2("text", 256).alias("sha256")).groupBy("file").agg(F.min("sha256").alias("sha256"))
    wanted = packages.select("name", "arch").distinct().select("name", "arch", F.posexplode(F.array(F.col("name"), F.when(F.coalesce("arch", F.lit("")) != "", F.concat_ws(":", "name", "arch")))).alias("rank_", "file")).where("file is not null")
    best = wanted.join(own, "file").groupBy("name", F.coalesce("arch", F.lit("")).alias("arch_")).agg(F.min_by("sha256", "rank_").alias("sha256"))
    return packages.withColumn("arch_", F.coalesce("arch", F.lit(""))).join(best, ["name", "arch_"], "left").drop("arch_")
