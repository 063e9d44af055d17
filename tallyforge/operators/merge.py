"""Keyed merges of evidence: argmax with ordered unions, folds, precedence and first-seen rules.

Ties always fall to an explicit `ord` column, since rows of a DataFrame have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered_union(rows: DataFrame, keys: list[str], values: str, conf: str, ord_: str, name: str) -> DataFrame:
    """keys and `name`: the distinct elements of the arrays `values`, in order of (confidence descending, ord, place).

    Elements are reduced to their best place before they are collected, so that a key with very many rows sends as many
    rows as it has distinct elements.
    """
    each = rows.select(*keys, conf, ord_, F.posexplode(values).alias("at_", "value_"))
    best = each.groupBy(*keys, "value_").agg(F.min(F.struct((-F.col(conf)).alias("c"), F.col(ord_).alias("o"), F.col("at_").alias("a"))).alias("rank_"))
    packed = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank_", "value_"))).alias("all_"))
    return packed.select(*keys, F.transform("all_", lambda x: x["value_"]).alias(name))


def best_row(fields: list[str], conf: str, ord_: str) -> Column:
    """The struct of `fields` of the row with the highest confidence, the first by ord among equals."""
    return F.max_by(F.struct(*fields), F.struct(F.col(conf), -F.col(ord_)))


def tri_state(flag: str | Column) -> Column:
    """False if any row says false, else true if any says true, else null."""
    return F.min(flag)


def first_known(value: str | Column, conf: str, ord_: str, where: Column | None = None) -> Column:
    """The value of the best row that has one (and meets `where`)."""
    value = F.col(value) if isinstance(value, str) else value
    known = value.isNotNull() if where is None else value.isNotNull() & F.coalesce(where, F.lit(False))
    return F.max_by(F.when(known, value), F.when(known, F.struct(F.col(conf), -F.col(ord_))))


def dedup_merge(rows: DataFrame, keys: list[str], *, conf: str, ord_: str, winner: list[str], unions: tuple[str, ...] = (), flag: str | None = None, firsts: tuple[str, ...] = ()) -> DataFrame:
    """One row per key (nulls in keys are equal): the winner's fields, ordered unions, the tri-state flag, first known values."""
    aggs = [best_row(winner, conf, ord_).alias("best_"), F.count("*").alias("n_rows")]
    if flag:
        aggs.append(tri_state(flag).alias(flag))
    aggs += [first_known(c, conf, ord_).alias(c) for c in firsts]
    out = rows.groupBy(*keys).agg(*aggs)
    for c in unions:
        more = ordered_union(rows, keys, c, conf, ord_, c)
        on = [out[k].eqNullSafe(more[k]) for k in keys]
        out = out.join(more, on, "left").select(*(out[x] for x in out.columns), F.coalesce(more[c], F.array().cast(rows.schema[c].dataType)).alias(c))
    return out.select(*keys, *(F.col(f"best_.{w}").alias(w) for w in winner), "n_rows", *([flag] if flag else []), *firsts, *unions)


#: Row kinds that only add provenance to rows found on disk, and the marks they leave.
MARKS = {"declared-not-cached": "deps.dev", "transitive": "maven-cache-bfs"}
SECONDARY = tuple(MARKS)


def mark_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv)), kind)


def merged_tier(rows: DataFrame, keys: list[str], conf: str, ord_: str) -> DataFrame:
    """keys, sbom_tier, source_type, provenance: the winner's tier changed by the rows after it, in order of confidence.

    rows has ecosystem, sbom_tier, source_type and has_sha256. Where the merged row has a sha256 by then, a secondary row leaves its
    mark and raises a missing or `analyzed` tier to `deployed`; other rows fill what is missing. In ecosystem golang a row of
    tier source turns analyzed into source, whatever its kind.
    """
    one = F.struct((-F.col(conf)).alias("c"), F.col(ord_).alias("o"), "ecosystem", "sbom_tier", "source_type", "has_sha256")
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all_"))
    start = F.struct(F.col("all_")[0]["sbom_tier"].alias("tier"), F.col("all_")[0]["source_type"].alias("kind"), F.coalesce(F.col("all_")[0]["has_sha256"], F.lit(False)).alias("sha"), F.array().cast("array<string>").alias("marks"))

    def step(acc: Column, x: Column) -> Column:
        secondary = F.coalesce(x["source_type"].isin(*SECONDARY), F.lit(False))
        sha = acc["sha"] | F.coalesce(x["has_sha256"], F.lit(False))
        raised = F.when(sha & (acc["tier"].isNull() | (acc["tier"] == "analyzed")), F.lit("deployed")).otherwise(acc["tier"])
        tier = F.when(secondary, raised).otherwise(F.coalesce(acc["tier"], x["sbom_tier"]))
        golang = F.coalesce((x["ecosystem"] == "golang") & (tier == "analyzed") & (x["sbom_tier"] == "source"), F.lit(False))
        marks = F.when(secondary & sha, F.array_union(acc["marks"], F.array(mark_of(x["source_type"])))).otherwise(acc["marks"])
        return F.struct(F.when(golang, F.lit("source")).otherwise(tier).alias("tier"), F.when(secondary, acc["kind"]).otherwise(F.coalesce(acc["kind"], x["source_type"])).alias("kind"), sha.alias("sha"), marks.alias("marks"))

    out = packed.withColumn("m_", F.aggregate(F.slice("all_", 2, F.greatest(F.size("all_") - 1, F.lit(0))), start, step))
    return out.select(*keys, F.col("m_.tier").alias("sbom_tier"), F.col("m_.kind").alias("source_type"), F.col("m_.marks").alias("provenance"))


def fold(rows: DataFrame, keys: list[str], secondary: Column, twin: Column, mark: str, name: str = "folded") -> DataFrame:
    """Secondary rows whose key has a twin go; every twin of the key gets their marks (sorted, distinct) as `name`."""
    marked = rows.withColumns({"sec_": F.coalesce(secondary, F.lit(False)), "twin_": F.coalesce(twin, F.lit(False))})
    marks = marked.where("sec_").groupBy(*keys).agg(F.array_sort(F.collect_set(mark)).alias(name))
    twins = marked.where("twin_ and not sec_").select(*keys).distinct()
    stay = marked.where("sec_").join(twins, keys, "left_anti")
    on_disk = marked.where("not sec_").join(marks, keys, "left").withColumn(name, F.when(F.col("twin_"), F.col(name)))
    return on_disk.unionByName(stay, allowMissingColumns=True).drop("sec_", "twin_")


def fold_declared(rows: DataFrame) -> DataFrame:
    """Secondary rows go where a row on disk has their coordinate; each such row gets their marks and, if it has a sha256 and
    its tier is missing or analyzed, the tier deployed.

    rows: ecosystem, namespace, name, version, source_type, has_sha256, shaded, sbom_tier; out: the same and marks. Relocated (shaded) rows are no twins.
    """
    keys = ["ecosystem", "namespace", "name", "version"]
    plain = rows.withColumns({"namespace": F.coalesce("namespace", F.lit("")), "mark_": mark_of(F.col("source_type"))})
    secondary = F.col("source_type").isin(*SECONDARY)
    twin = F.col("has_sha256") & ~F.coalesce("shaded", F.lit(False))
    out = fold(plain, keys, secondary, twin, "mark_", "marks")
    raised = F.col("marks").isNotNull() & F.coalesce("has_sha256", F.lit(False)) & (F.col("sbom_tier").isNull() | (F.col("sbom_tier") == "analyzed"))
    return out.withColumn("sbom_tier", F.when(raised, F.lit("deployed")).otherwise(F.col("sbom_tier"))).drop("mark_")


def first_seen(rows: DataFrame, keys: list[str], *order: Column | str, count: str | None = None) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that is combined before the shuffle; with count, also how many rows the key has."""
    place = F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)))
    number = [F.count("*").cast("int").alias(count)] if count else []
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), place).alias("best_"), *number)
    return best.select(*(F.col(c) if c in keys else F.col(f"best_.{c}").alias(c) for c in rows.columns), *([count] if count else []))


def without_override(existing: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those rows of more whose key isn't there; additions aren't deduplicated among themselves."""
    return existing.unionByName(more.join(existing.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def first_tier(rows: DataFrame, root: str, tier: str) -> DataFrame:
    """Per root only the rows of its lowest tier."""
    low = rows.groupBy(root).agg(F.min(tier).alias("low_"))
    return rows.join(low, root).where(F.col(tier) == F.col("low_")).drop("low_")


def with_file(connections: DataFrame, files: DataFrame) -> DataFrame:
    """connections (path) with hash and file_path of files (path, hash, ord) of the same basename, else null.

    The hash is the last one that isn't null; file_path is the first file of that name, with or without a hash of its own.
    """
    base = lambda path: F.element_at(F.split(path, "/"), -1)
    named = files.withColumn("base_", base(F.rtrim(F.col("path"), F.lit("/")))).where("base_ <> ''")
    each = named.groupBy("base_").agg(F.max_by("hash", F.when(F.col("hash").isNotNull(), F.col("ord"))).alias("hash"), F.min_by("path", "ord").alias("file_path")).where("hash is not null")
    return connections.withColumn("base_", base(F.col("path"))).join(each, "base_", "left").drop("base_")
