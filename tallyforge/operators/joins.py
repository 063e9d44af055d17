"""Lookups that fill evidence from other tables: hashes, licences, coordinates, versions, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import measured

#: Folders that a shared library is looked for in.
LIBRARY_DIRS = "lib/x86_64-linux-gnu lib/aarch64-linux-gnu usr/lib/x86_64-linux-gnu usr/lib/aarch64-linux-gnu lib64 usr/lib64 lib usr/lib".split()

#: Folders that a system's package manager owns, and paths of a host system.
MANAGED_DIRS = "bin/ sbin/ lib/ lib64/ usr/bin/ usr/sbin/ usr/lib/ usr/lib64/ usr/libexec/ usr/share/".split()
HOST_PATHS = "/System/Library/ /usr/lib/system/ /System/iOSSupport/".split()

#: What may stand behind a package's name in its documentation folder.
DOC_SUFFIXES = ("", "-amd64", "-arm64", "-x86_64", "-aarch64")


def overwritten(rows: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `value` of found where the key is there, else their own."""
    new = found.groupBy(key).agg(F.max(value).alias("new_"))
    return rows.join(new, key, "left").withColumn(value, F.coalesce("new_", value)).drop("new_")


def filled(rows: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `value` of found where their own is null."""
    new = found.groupBy(key).agg(F.max(value).alias("new_"))
    return rows.join(new, key, "left").withColumn(value, F.coalesce(value, "new_")).drop("new_")


def listed_hashes(paths: DataFrame, sums: DataFrame) -> DataFrame:
    """paths (package, path) with md5 of sums (package, md5, path); paths without a sum stay with null."""
    own = sums.select("package", F.concat(F.lit("/"), F.regexp_replace("path", "^/", "")).alias("path"), "md5").groupBy("package", "path").agg(F.min("md5").alias("md5"))
    return paths.join(own, ["package", "path"], "left")


def documented(packages: DataFrame, texts: DataFrame) -> DataFrame:
    """packages (name) with the text of the first documentation folder there is: the name alone, then with an architecture."""
    wanted = packages.select("name", F.posexplode(F.array(*(F.concat("name", F.lit(s)) for s in DOC_SUFFIXES))).alias("rank_", "folder"))
    best = wanted.join(measured(texts.select("folder", "text")), "folder").groupBy("name").agg(F.min_by("text", "rank_").alias("text"))
    return packages.join(measured(best), "name", "left")


def appended(rows: DataFrame, found: DataFrame, keys: list[str], value: str, mark: str | None = None) -> DataFrame:
    """rows whose array `value` is followed by found's new elements; `mark`: whether the key was there."""
    own = found.groupBy(*keys).agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list(value)))).alias("new_"))
    empty = F.array().cast(rows.schema[value].dataType)
    out = rows.join(own, keys, "left")
    out = out.withColumn(mark, F.col("new_").isNotNull()) if mark else out
    return out.withColumn(value, F.array_union(F.coalesce(value, empty), F.coalesce("new_", empty))).drop("new_")


def curated_coordinate(ecosystem: Column, namespace: Column, name: Column, version: Column) -> Column:
    """kind/provider/namespace/name/revision under which a licence archive holds a package; null where it holds none."""
    space, dash = F.nullif(namespace, F.lit("")), F.lit("-")
    whole = lambda kind, provider, ns, n, v: F.concat_ws("/", F.lit(kind), F.lit(provider), ns, n, v)
    revision = F.when(F.startswith(version, F.lit("v")), version).otherwise(F.concat(F.lit("v"), version))
    known = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(version, F.lit("")) != "")
    return F.when(
        known,
        F.when(ecosystem == "npm", whole("npm", "npmjs", F.coalesce(F.regexp_replace(space, "^@", ""), dash), name, version))
        .when(ecosystem == "cargo", whole("crate", "cratesio", dash, name, version))
        .when(ecosystem == "gem", whole("gem", "rubygems", dash, name, version))
        .when(ecosystem == "pypi", whole("pypi", "pypi", dash, F.lower(name), version))
        .when((ecosystem == "maven") & space.isNotNull(), whole("maven", "mavencentral", space, name, version))
        .when(ecosystem == "golang", whole("go", "golang", F.coalesce(F.replace(space, F.lit("/"), F.lit("%2f")), dash), F.substring_index(name, "/", -1), revision)),
    )


def indexed_name(ecosystem: Column, namespace: Column, name: Column) -> Column:
    """A package's name in a public index: group:artifact of maven, the whole module path of go, @scope/name of npm."""
    space = F.nullif(namespace, F.lit(""))
    return (
        F.when((ecosystem == "maven") & space.isNotNull(), F.concat(space, F.lit(":"), name))
        .when(ecosystem.isin("golang", "go") & space.isNotNull() & ~F.contains(name, F.lit("/")), F.concat(space, F.lit("/"), name))
        .when((ecosystem == "npm") & space.isNotNull(), F.concat(F.lit("@"), F.regexp_replace(space, "^@+", ""), F.lit("/"), name))
        .otherwise(name)
    )


def local_versions(nodes: DataFrame, local: DataFrame) -> DataFrame:
    """nodes (name, version) with the version of the first local row (name, version, ord) of that name, if there is one."""
    own = local.groupBy("name").agg(F.min_by("version", "ord").alias("own_"))
    return nodes.join(own, "name", "left").withColumn("version", F.coalesce("own_", "version")).drop("own_")


def numbered_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, src, dst: edges (graph, from_node, to_node) between nodes (graph, node, purl) that they name by number."""
    a = nodes.select("graph", F.col("node").alias("from_node"), F.col("purl").alias("src"))
    b = nodes.select("graph", F.col("node").alias("to_node"), F.col("purl").alias("dst"))
    return edges.join(a, ["graph", "from_node"]).join(b, ["graph", "to_node"]).select("graph", "src", "dst").where("src <> dst").distinct()


def unclaimed_libraries(rows: DataFrame, claims: DataFrame, soname: str = "soname") -> DataFrame:
    """rows whose library no claim (path) holds in any of LIBRARY_DIRS; host system paths are dropped as well."""
    kept = rows.where(~F.coalesce(F.col(soname).rlike("^(" + "|".join(HOST_PATHS) + ")"), F.lit(False)))
    names = kept.select(soname).distinct().select(soname, F.explode(F.array(*(F.concat(F.lit(f"/{d}/"), soname) for d in LIBRARY_DIRS))).alias("path"))
    held = names.join(claims.select("path"), "path", "left_semi").select(soname).distinct()
    return kept.join(held, soname, "left_anti")


def managed_dir(path: Column) -> Column:
    """Whether a path below the root (no leading slash) lies in a folder that the package manager owns."""
    return path.rlike("^(" + "|".join(MANAGED_DIRS) + ")")


def unversioned(stem: Column) -> Column:
    """A jar's stem without a trailing -version."""
    return F.regexp_replace(stem, r"-[0-9][^-]*(-[A-Za-z0-9.]+)?$", "")


def sidecar_poms(poms: DataFrame) -> DataFrame:
    """key, path: sidecar POMs by name; a plain name counts before one with JPP-."""
    base = F.substring_index("path", "/", -1)
    rows = poms.where(F.endswith("path", F.lit(".pom"))).select("path", F.lower(F.regexp_replace(base, r"^JPP-|\.pom$", "")).alias("key"), F.startswith(base, F.lit("JPP-")).cast("int").alias("rank_"))
    return rows.groupBy("key").agg(F.min(F.struct("rank_", "path")).alias("best_")).select("key", F.col("best_.path").alias("pom"))


def with_sidecar(jars: DataFrame, poms: DataFrame) -> DataFrame:
    """jars (path) with the sidecar POM of their name without its version."""
    stem = F.regexp_extract("path", r"([^/]*)\.jar$", 1)
    return jars.withColumn("key", F.lower(unversioned(stem))).join(sidecar_poms(poms), "key", "left").drop("key")


def parent_coordinates(poms: DataFrame) -> DataFrame:
    """artifact, group, version: own values, else what the POM says of its parent, else the parent POM's own.

    poms: artifact, group, version, parent_group, parent_artifact, parent_version (empty is null). Rows that stay without a group or
    version are dropped.
    """
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    up = poms.where(own("group").isNotNull() & own("version").isNotNull()).groupBy(F.col("artifact").alias("parent_artifact")).agg(F.min(F.struct("group", "version")).alias("up_"))
    out = poms.join(up, "parent_artifact", "left").select("artifact", F.coalesce(own("group"), own("parent_group"), F.col("up_.group")).alias("group"), F.coalesce(own("version"), own("parent_version"), F.col("up_.version")).alias("version"))
    return out.where("`group` is not null and version is not null")

