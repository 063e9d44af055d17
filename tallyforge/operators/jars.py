"""Archives of a Maven project: which of them is what is being scanned, and which projects were folded into them.

coords: jar (path), at (place of the entry in the archive), group, artifact, version; jars: jar, claimed (a package manager owns it),
manifest (text of its manifest, or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import purl, purl_segment
from .merge import first_seen

MOST_MANIFEST = 64 * 1024

#: Last parts of artifact names that too many projects share.
GENERIC_LEAVES = "io api util utils core impl common commons base main lib shared plugin plugins ext".split()

#: Why a coordinate is what is being scanned, in the order in which the reasons are asked.
REASONS = ("target-name-match", "unclaimed-fat-jar-heuristic", "executable-jar-heuristic", "maven-target-dir-heuristic")


def stem(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def maven_purl(group: Column, artifact: Column, version: Column, classifier: Column | None = None) -> Column:
    base = purl(F.lit("maven"), group, artifact, version)
    return base if classifier is None else F.concat(base, F.when(F.coalesce(classifier, F.lit("")) != "", F.concat(F.lit("?classifier="), purl_segment(classifier))).otherwise(""))


def has_main_class(manifest: Column) -> Column:
    """Whether a manifest of at most MOST_MANIFEST bytes names a class to start."""
    return F.coalesce((F.octet_length(manifest) <= MOST_MANIFEST) & manifest.rlike(r"(?imd)^main-class:[^\S\n]*\S"), F.lit(False))


def primary(rows: DataFrame) -> Column:
    """Whether a coordinate is the jar's own: its name begins with the artifact."""
    return F.startswith(stem(rows["jar"]), rows["artifact"])


def primaries(coords: DataFrame) -> DataFrame:
    """jar, n_coords, own (group, artifact, version of the first primary coordinate, or null): one row a jar."""
    own = F.struct("group", "artifact", "version")
    rows = coords.withColumn("primary_", primary(coords))
    return rows.groupBy("jar").agg(F.count("*").alias("n_coords"), F.min_by(own, F.when(F.col("primary_"), F.col("at"))).alias("own"))


def judged(coords: DataFrame, jars: DataFrame, target: str | None = None) -> DataFrame:
    """coords with purl, parent (the purl of the jar's own coordinate; null for primary ones) and reason (one of REASONS, or null).

    A primary coordinate is what is being scanned if it bears the target's name, or if no package manager owns its jar and
    that holds two coordinates or more, names a class to start, or lies in a folder `target` under its own artifact and version.
    """
    own = primaries(coords).join(jars.select("jar", "claimed", has_main_class(F.col("manifest")).alias("starts_")), "jar", "left")
    rows = coords.join(own, "jar")
    free = ~F.coalesce("claimed", F.lit(False))
    named = F.lower("artifact") == F.lit(target.lower()) if target else F.lit(False)
    built = (F.regexp_extract("jar", r"([^/]*)/[^/]*$", 1) == "target") & (F.substring_index("jar", "/", -1) == F.concat("artifact", F.lit("-"), "version", F.lit(".jar")))
    tests = (named, free & (F.col("n_coords") >= 2), free & F.coalesce("starts_", F.lit(False)), free & built)
    reason = F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)))
    is_own = primary(rows)
    parent = F.when(~is_own & F.col("own").isNotNull(), maven_purl(F.col("own.group"), F.col("own.artifact"), F.col("own.version")))
    return rows.select(*coords.columns, maven_purl(F.col("group"), F.col("artifact"), F.col("version")).alias("purl"), parent.alias("parent"), F.when(is_own, reason).alias("reason"))


def components(rows: DataFrame) -> DataFrame:
    """The rows of judged() that are not what is being scanned: one for each purl and parent, the first by jar and place.

    Children of a subject keep it as parent, though it isn't among the rows.
    """
    return first_seen(rows.where("reason is null").withColumn("within_", F.coalesce("parent", F.lit(""))), ["purl", "within_"], "jar", "at").drop("within_", "reason")


def subject(rows: DataFrame) -> DataFrame:
    """group, artifact, version, reason, jar of what is being scanned: the first by jar and place of the rows of judged() that are; none without one."""
    what = F.struct("group", "artifact", "version", "reason", "jar")
    best = rows.where("reason is not null").agg(F.min_by(what, F.struct("jar", "at")).alias("s"))
    return best.where("s is not null").select("s.*")


def same_namespace(a: Column, b: Column) -> Column:
    """Whether two groups are equal or one lies within the other."""
    dot = F.lit(".")
    return F.startswith(F.concat(a, dot), F.concat(b, dot)) | F.startswith(F.concat(b, dot), F.concat(a, dot))


def shown_by_bytecode(ancestors: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ancestors (jar, group, artifact, own: the jar's own coordinate, ...) that the jar's classes (jar, path) show.

    Either a class lies below the group's folder, if the group's namespace isn't that of the jar itself; or one lies in a folder
    (not the first) named like the last part of the artifact, unless that is generic. Class paths are exploded into their
    folders, so that both tests are equi joins, on the jar and the folder together.
    """
    own = classes.where(F.endswith("path", F.lit(".class"))).select("jar", F.split("path", "/").alias("parts"))
    chain = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", 1, k), "/"))
    folders = own.where(F.size("parts") > 1).select("jar", F.explode(chain).alias("folder")).distinct()
    leaves = own.where(F.size("parts") > 2).select("jar", F.explode(F.slice("parts", 2, F.size("parts") - 2)).alias("leaf")).distinct()
    a = ancestors.withColumns({"folder": F.replace("group", F.lit("."), F.lit("/")), "leaf": F.lower(F.substring_index("artifact", "-", -1))})
    a = a.withColumn("apart_", ~same_namespace(F.col("group"), F.col("own.group")))
    by_folder = a.join(folders.withColumn("by_folder_", F.lit(True)), ["jar", "folder"], "left")
    both = by_folder.join(leaves.withColumn("by_leaf_", F.lit(True)), ["jar", "leaf"], "left")
    found = (F.col("apart_") & F.coalesce("by_folder_", F.lit(False))) | (F.coalesce("by_leaf_", F.lit(False)) & ~F.col("leaf").isin("", *GENERIC_LEAVES))
    return both.where(found).select(*ancestors.columns)


def shade_ancestors(ancestors: DataFrame, coords: DataFrame, classes: DataFrame) -> DataFrame:
    """jar, parent, purl, group, artifact, classifier, version, license of what was folded into jars.

    ancestors: jar, ord, group, artifact, classifier, version, license, as a jar lists them. Kept are those of jars with a coordinate of
    their own that its classes show, without the jar itself; each once a jar, the first by ord. parent is the purl of the jar's own
    coordinate, so that the same ancestor in two jars stands below both.
    """
    own = primaries(coords).where("own is not null").select("jar", "own")
    rows = ancestors.join(own, "jar").where(~(F.struct("group", "artifact", "version") == F.col("own")))
    rows = first_seen(rows.withColumn("classifier", F.coalesce("classifier", F.lit(""))), ["jar", "group", "artifact", "classifier", "version"], "ord")
    up = maven_purl(F.col("own.group"), F.col("own.artifact"), F.col("own.version"))
    me = maven_purl(F.col("group"), F.col("artifact"), F.col("version"), F.col("classifier"))
    return shown_by_bytecode(rows, classes).select("jar", up.alias("parent"), me.alias("purl"), "group", "artifact", F.nullif("classifier", F.lit("")).alias("classifier"), "version", "license")
