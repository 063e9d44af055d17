"""Filters over sets of evidence: guarded semi joins, claims, and cascades of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded_semi(rows: DataFrame, applies: Column, signal: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the filter applies to stay only if their key is in signal; with an empty signal all stay.

    One left join with the distinct signal keys and a one-row flag; nothing comes to the driver.
    """
    known = signal.select(*keys).distinct().withColumn("known_", F.lit(True))
    some = signal.select(F.lit(1).alias("one_")).limit(1).agg((F.count("*") > 0).alias("some_"))
    out = rows.join(known, keys, "left").join(F.broadcast(some))
    return out.where(~F.coalesce(applies, F.lit(False)) | ~F.col("some_") | F.coalesce("known_", F.lit(False))).drop("known_", "some_")


def unclaimed(rows: DataFrame, claims: DataFrame, *keys: list[str]) -> DataFrame:
    """Rows that no claim meets under any of the key lists."""
    for own in keys:
        rows = rows.join(claims.select(*own).where(" and ".join(f"{k} is not null" for k in own)).distinct(), own, "left_anti")
    return rows


def disposition(rules: list[tuple[str, Column]], otherwise: str = "keep") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def fully_resolved_cpe(cpe: Column) -> Column:
    """Parts 2 to 5 of a CPE 2.3 string (part, vendor, product, version) are neither empty nor a wildcard."""
    parts = F.split(cpe, ":")
    return (F.size(parts) >= 6) & F.forall(F.slice(parts, 3, 4), lambda x: (x != "") & (x != "*") & (x != "-"))
