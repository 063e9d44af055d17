"""Files that a package manager owns, whatever the path under which they are met: by path, canonical path, or device and inode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoints

#: Fixed value: so many links may be followed for a path; beyond that it has no canonical form, as in a file system.
MOST_LINKS = 40


def _clean(path: Column) -> Column:
    """Without empty parts and `.`; absolute."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def canonical(paths: DataFrame, links: DataFrame) -> DataFrame:
    """path, canonical of paths (path) under links (path, target): no link is left in it; null where links lead in a circle.

    Each round looks at a path from its root: its leading parts, up to the first `..`, are met with the links in one equi join, and the
    shortest that is a link is replaced by its target, relative to the folder of the link; without one, the first `..` takes its
    folder away. Paths without link and `..` are done and leave the loop, which ends when none is left.
    """
    checkpoints(paths.sparkSession)
    known = links.where("path is not null and target is not null").groupBy(_clean(F.col("path")).alias("head")).agg(F.max("target").alias("target"))
    work = paths.select("path").where("path is not null").distinct().select("path", _clean(F.col("path")).alias("now"), F.lit(0).alias("links"))
    done = None
    while True:
        parts = F.split(F.substring("now", 2, 1 << 30), "/")
        at_up = F.array_position(parts, "..")  # from 1; 0: none
        ahead = F.when(at_up > 0, at_up.cast("int") - 1).otherwise(F.size(parts))
        heads = F.transform(F.sequence(F.lit(1), ahead), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
        asked = work.where(ahead > 0).select("path", F.posexplode(heads).alias("n", "head"))
        found = asked.join(known, "head").groupBy("path").agg(F.min_by(F.struct("head", "target"), "n").alias("link"))
        step = work.join(found, "path", "left")
        folder = F.regexp_replace("link.head", "/[^/]*$", "")
        base = F.when(F.startswith("link.target", F.lit("/")), F.col("link.target")).otherwise(F.concat(folder, F.lit("/"), F.col("link.target")))
        through = _clean(F.concat(base, F.lit("/"), F.substr("now", F.length("link.head") + 1)))
        up = F.regexp_replace("now", r"^((?:/(?!\.\.(?:/|$))[^/]+)*?)(?:/(?!\.\.(?:/|$))[^/]+)?/\.\.(/|$)", "$1$2")
        new = F.when(F.col("link").isNotNull(), through).when(at_up > 0, F.when(up == "", "/").otherwise(up))
        step = step.select("path", "now", new.alias("new"), (F.col("links") + F.col("link").isNotNull().cast("int")).alias("links")).checkpoint()
        ready = step.where(f"new is null or links > {MOST_LINKS}").select("path", F.when(F.col("new").isNull(), F.col("now")).alias("canonical"))
        done = ready if done is None else done.unionByName(ready)
        work = step.where(f"new is not null and links <= {MOST_LINKS}").select("path", F.col("new").alias("now"), "links")
        if work.isEmpty():
            return done


def with_claims(files: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """files (path, device, inode, ...) with claimed_by: path, canonical or inode, the first that meets a claim (path, device, inode); else null.

    Claims count under their own path and their canonical one. Files and claims without a device and inode can't be met by these.
    """
    both = canonical(files.select("path").unionByName(claims.select("path")), links)
    own = claims.select("path").where("path is not null")
    held = own.unionByName(own.join(both, "path").where("canonical is not null").select(F.col("canonical").alias("path"))).distinct()
    places = claims.select("device", "inode").where("device is not null and inode is not null").distinct()
    out = files.join(held.withColumn("by_path_", F.lit(True)), "path", "left").join(both, "path", "left")
    out = out.join(held.select(F.col("path").alias("canonical"), F.lit(True).alias("by_canonical_")), "canonical", "left")
    out = out.join(places.withColumn("by_inode_", F.lit(True)), ["device", "inode"], "left")
    how = F.coalesce(F.when(F.col("by_path_"), "path"), F.when(F.col("by_canonical_"), "canonical"), F.when(F.col("by_inode_"), "inode"))
    return out.select(*files.columns, how.alias("claimed_by"))


def unclaimed_files(files: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """files that no claim meets."""
    return with_claims(files, claims, links).where("claimed_by is null").drop("claimed_by")
