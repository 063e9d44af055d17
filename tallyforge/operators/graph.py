"""Dependency edges, closures, inheritance and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import checkpoints, gathered, measured

#: Rows of a frontier that may be broadcast, by count.
FEW = 250_000


def normal_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "pypi", F.lower(F.replace(name, F.lit("_"), F.lit("-")))).otherwise(F.lower(name))


def dependency_edges(rows: DataFrame, depends: DataFrame) -> DataFrame:
    """src, dst: depends (ecosystem, src, name) met with rows (ecosystem, name, purl, ord) by normalised name.

    Of rows with the same name the last by ord counts; names without a row and edges to oneself are dropped.
    """
    index = rows.groupBy("ecosystem", normal_name(F.col("ecosystem"), F.col("name")).alias("norm_")).agg(F.max_by("purl", "ord").alias("dst"))
    named = depends.withColumn("norm_", normal_name(F.col("ecosystem"), F.col("name")))
    return named.join(index, ["ecosystem", "norm_"]).where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def guard_rail(edges: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Edges of which at least one end is known."""
    ids = known.select(F.col(key)).distinct()
    a = ids.select(F.col(key).alias("src"), F.lit(True).alias("a_"))
    b = ids.select(F.col(key).alias("dst"), F.lit(True).alias("b_"))
    return edges.join(a, "src", "left").join(b, "dst", "left").where("a_ or b_").select(*edges.columns)


def dependency_map(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, depends_on: every node with its sorted distinct targets (none: empty)."""
    each = edges.groupBy(F.col("src").alias(key)).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    return nodes.select(key).distinct().join(each, key, "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast(each.schema["depends_on"].dataType)))


def roots(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that nothing points to."""
    return nodes.select(key).distinct().join(edges.select(F.col("dst").alias(key)).distinct(), key, "left_anti")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, level: what the seeds (node) reach, each at its least level; cycles end the walk.

    Level by level the edges are met with the frontier and their ends with what was seen, until the frontier is empty; checkpoint()
    cuts the lineage. A frontier of at most FEW rows, by count, is sent to the edges, so that these stay where they lie; larger ones
    don't overlap, so no more than nodes / FEW levels move the edges. A level's tasks don't grow with the levels before it.
    """
    checkpoints(edges.sparkSession)
    edges = edges.select("src", "dst").distinct().checkpoint()
    front, level = seeds.select("node").distinct().withColumn("level", F.lit(0)).checkpoint(), 0
    seen = front
    while rows := front.count():
        level += 1
        at = front.select(F.col("node").alias("src"))
        step = edges.join(F.broadcast(at) if rows <= FEW else measured(at), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = step.join(measured(gathered(seen.select("node"))), "node", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        # levels stay apart as they were written; they are put together now and then, so that plans stay short
        seen = seen.unionByName(front)
        seen = gathered(seen).checkpoint() if level % 16 == 0 else seen
    return gathered(seen)


def inherited(values: DataFrame, ancestors: DataFrame) -> DataFrame:
    """child, key, value: of the values of a child's ancestors (child, ancestor, distance) the nearest one."""
    return ancestors.join(values, "ancestor").groupBy("child", "key").agg(F.min_by("value", "distance").alias("value"))


def layer_overlay(entries: DataFrame) -> DataFrame:
    """path, layer, kind: what is visible of entries (layer, path, kind file|whiteout|opaque) stacked by layer.

    A whiteout hides its path and what lies under it in lower layers; an opaque directory hides what lies under it.
    """
    top = entries.where("kind = 'file'").groupBy("path").agg(F.max("layer").alias("layer"))
    hides = entries.where("kind <> 'file'").groupBy(F.col("path").alias("above_"), F.col("kind").alias("how_")).agg(F.max("layer").alias("by_"))
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hidden = top.select("path", "layer", F.explode(chain).alias("above_")).join(measured(hides), "above_").where((F.col("by_") > F.col("layer")) & ((F.col("how_") == "whiteout") | (F.col("above_") != F.col("path"))))
    return top.join(measured(hidden.select("path").distinct()), "path", "left_anti")


def linked_overlay(entries: DataFrame) -> DataFrame:
    """path, layer, from_path, from_layer: what is visible of entries (layer, path, kind file|hardlink|whiteout|opaque, target), and which
    file gives its content.

    Files and whiteouts are as in layer_overlay. A hard link holds what its target is when all else of its layer is in place,
    wherever the target stands in the layer, and keeps it when the target is replaced or removed later. A link to a link leads on to
    its target; chains are halved in each round, and in each some link ends, until none that can is left. A link whose target isn't there, or that leads back to itself, takes away
    what was at its path.
    """
    checkpoints(entries.sparkSession)
    # of a file and a link at one path of a layer the link comes last
    top = entries.where("kind in ('file', 'hardlink')").groupBy("path", "layer").agg(F.max("target").alias("target"), F.max(F.col("kind") == "hardlink").alias("is_link")).checkpoint()
    hides = entries.where("kind in ('whiteout', 'opaque')").groupBy(F.col("path").alias("above_"), F.col("kind").alias("how_"), F.col("layer").alias("by_")).agg(F.lit(1).alias("one_"))
    parts = F.split("to_path", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    covers = (F.col("how_") == "whiteout") | (F.col("above_") != F.col("to_path"))

    links = top.where("is_link and target is not null").select("path", "layer", F.col("target").alias("to_path"))
    there = top.select(F.col("path").alias("to_path"), F.col("layer").alias("to_layer"))
    seen = links.join(measured(there), "to_path").where("to_layer <= layer").groupBy("path", "layer", "to_path").agg(F.max("to_layer").alias("to_layer"))
    gone = seen.withColumn("above_", F.explode(chain)).join(measured(hides), "above_").where((F.col("by_") > F.col("to_layer")) & (F.col("by_") <= F.col("layer")) & covers)
    seen = seen.join(measured(gone.select("path", "layer").distinct()), ["path", "layer"], "left_anti")
    files = top.where("not is_link").select("path", "layer", F.col("path").alias("from_path"), F.col("layer").alias("from_layer"))
    ways = seen.select("path", "layer", F.col("to_path").alias("mid_path"), F.col("to_layer").alias("mid_layer")).checkpoint()
    held = files
    while True:
        goal = held.select(F.col("path").alias("mid_path"), F.col("layer").alias("mid_layer"), "from_path", "from_layer")
        ended = ways.join(measured(goal), ["mid_path", "mid_layer"]).select("path", "layer", "from_path", "from_layer").checkpoint()
        if ended.isEmpty():
            break
        held = held.unionByName(ended)
        rest = ways.join(measured(ended.select("path", "layer")), ["path", "layer"], "left_anti")
        on = ways.select(F.col("path").alias("mid_path"), F.col("layer").alias("mid_layer"), F.col("mid_path").alias("next_path"), F.col("mid_layer").alias("next_layer"))
        ways = rest.join(measured(on), ["mid_path", "mid_layer"], "left").select("path", "layer", F.coalesce("next_path", "mid_path").alias("mid_path"), F.coalesce("next_layer", "mid_layer").alias("mid_layer")).checkpoint()
    last = top.groupBy("path").agg(F.max("layer").alias("layer"))
    shown = last.join(measured(held), ["path", "layer"]).withColumn("to_path", F.col("path"))
    hidden = shown.select("path", "layer", "to_path", F.explode(chain).alias("above_")).join(measured(hides), "above_").where((F.col("by_") > F.col("layer")) & covers)
    return shown.join(measured(hidden.select("path").distinct()), "path", "left_anti").select("path", "layer", "from_path", "from_layer")


def longest_prefix(rows: DataFrame, path: str, modules: DataFrame, module: str) -> DataFrame:
    """rows with the longest of modules that is the row's path or a leading part of it; null without one.

    Each path is exploded into its leading parts, so that the match is an equi join.
    """
    parts = F.split(path, "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    paths = rows.select(path).distinct().select(path, F.explode(chain).alias(module))
    best = paths.join(modules.select(module).distinct(), module).groupBy(path).agg(F.max_by(module, F.length(module)).alias(module))
    return rows.join(best, path, "left").select(*rows.columns, module)


def sessions(rows: DataFrame, key: str, order: list[str], opens: Column) -> DataFrame:
    """rows with session: a running count of openings per key; rows before the first opening are dropped."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("session", F.sum(opens.cast("bigint")).over(by)).where("session > 0")
