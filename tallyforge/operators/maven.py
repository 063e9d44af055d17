"""Effective project models: inheritance over parents, imports of version lists, properties, versions, transitive closure.

poms: pom (group:artifact:version), parent, properties (map), managed (array of group, artifact, version, scope, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .lineage import checkpoints, measured

ROUNDS = 16

DEPENDENCY = "struct<groupId:string,artifactId:string,version:string,scope:string,type:string>"
POM = f"groupId string, artifactId string, version string, parent struct<groupId:string,artifactId:string,version:string>, properties map<string,string>, dependencies struct<dependency:array<{DEPENDENCY}>>, dependencyManagement struct<dependencies:struct<dependency:array<{DEPENDENCY}>>>"


def parsed(df: DataFrame) -> DataFrame:
    """pom, parent, properties, managed, depends, artifact of pom.xml files (path, text).

    Group and version fall to the parent's; files without a coordinate after that have null as pom. Text that isn't XML gives no row.
    """
    doc = F.from_xml("text", POM, {"mode": "PERMISSIVE", "attributePrefix": "_"})
    # behind a generator, as a filter on what is made of the document would else be pushed down and parse the text for each field it names
    rows = df.where(F.contains("text", F.lit("<project"))).select("path", F.explode(F.array(doc)).alias("d"))
    colon = lambda *xs: F.when(~F.exists(F.array(*xs), lambda x: F.coalesce(x, F.lit("")) == ""), F.concat_ws(":", *xs))
    group, version = F.coalesce("d.groupId", "d.parent.groupId"), F.coalesce("d.version", "d.parent.version")
    entry = lambda a: F.coalesce(F.transform(a, lambda x: F.struct(x["groupId"].alias("group"), x["artifactId"].alias("artifact"), x["version"].alias("version"), x["scope"].alias("scope"), x["type"].alias("kind"))), F.array().cast("array<struct<group:string,artifact:string,version:string,scope:string,kind:string>>"))
    return rows.select(
        "path", colon(group, F.col("d.artifactId"), version).alias("pom"), colon(F.col("d.parent.groupId"), F.col("d.parent.artifactId"), F.col("d.parent.version")).alias("parent"), F.coalesce("d.properties", F.create_map().cast("map<string,string>")).alias("properties"),
        entry(F.col("d.dependencyManagement.dependencies.dependency")).alias("managed"), entry(F.col("d.dependencies.dependency")).alias("depends"), F.col("d.artifactId").alias("artifact"),
    )


def resolved(raw: Column, properties: Column, pom: Column) -> Column:
    """raw with ${key} replaced by the pom's own group, artifact or version or by properties, at most ROUNDS times.

    Null if a key is unknown, if keys are left after that, or if raw is null or empty.
    """
    def step(x: Column, _: Column) -> Column:
        key = F.regexp_extract(x, r"\$\{([^}]*)\}", 1)
        part = lambda k: F.get(F.split(pom, ":"), k)
        value = F.when(key == "project.groupId", part(0)).when(key == "project.artifactId", part(1)).when(key == "project.version", part(2)).otherwise(F.try_element_at(properties, key))
        return F.when(x.rlike(r"\$\{[^}]*\}"), F.replace(x, F.concat(F.lit("${"), key, F.lit("}")), value)).otherwise(x)

    out = F.when(F.contains(raw, F.lit("${")), F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), raw, step)).otherwise(raw)
    return F.when((raw != "") & ~F.contains(out, F.lit("${")), out)


def ancestors(poms: DataFrame) -> DataFrame:
    """pom, ancestor, distance: every pom itself (0) and the parents above it that are known; a cycle ends the walk.

    The distance that is covered doubles with each join, so that the number of joins grows with the logarithm of the depth. It ends
    when no pom gains an ancestor: the chains have then ended or come back to where they were.
    """
    checkpoints(poms.sparkSession)
    up = poms.where("pom is not null").groupBy("pom").agg(F.max("parent").alias("parent")).checkpoint()
    row = lambda pom, ancestor, distance: (F.col(pom).alias("pom"), F.col(ancestor).alias("ancestor"), distance.alias("distance"))
    new = up.join(measured(up.select(F.col("pom").alias("parent"))), "parent").where("pom <> parent").select(*row("pom", "parent", F.lit(1))).checkpoint()
    out, reach = up.select(*row("pom", "pom", F.lit(0))), 1
    while not new.isEmpty():
        out = out.unionByName(new)
        # who stands `reach` above a pom knows all its own ancestors up to `reach`
        far = new.where(F.col("distance") == reach).select("pom", F.col("ancestor").alias("mid_"))
        more = far.join(measured(out.where("distance > 0").select(F.col("pom").alias("mid_"), "ancestor", "distance")), "mid_").select("pom", "ancestor", (F.col("distance") + reach).alias("distance"))
        new = more.join(measured(out.select("pom", "ancestor")), ["pom", "ancestor"], "left_anti").groupBy("pom", "ancestor").agg(F.min("distance").alias("distance")).checkpoint()
        reach *= 2
    return out


def effective_properties(poms: DataFrame, above: DataFrame) -> DataFrame:
    """pom, properties: its own and those of its parents; the nearest counts."""
    rows = poms.where("pom is not null").select(F.col("pom").alias("ancestor"), F.explode("properties").alias("key", "value"))
    each = above.join(measured(rows), "ancestor").groupBy("pom", "key").agg(F.min_by("value", "distance").alias("value"))
    packed = each.groupBy("pom").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))
    return above.select("pom").distinct().join(measured(packed), "pom", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def _and(table: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if table is None else table.unionByName(more)


class Models:
    """Effective models of poms, made when they are asked for and each made once.

    poms are stored, and who stands above whom is known for all; properties, managed versions and imports are made by load() for
    the poms it is given, those above them and the lists they import, as far as they aren't there yet, and kept in tables that
    grow. made: how many were made by each step of load().
    """

    def __init__(self, poms: DataFrame) -> None:
        checkpoints(poms.sparkSession)
        self.poms = poms.where("pom is not null").checkpoint()
        self.above = ancestors(self.poms).checkpoint()
        self.made: list[int] = []
        self.done = self.own = self.mine = self.lists = self.direct = self.imports = None

    def load(self, wanted: DataFrame | None = None) -> None:
        """Makes the models of wanted (pom), or of all poms in one round."""
        while True:
            every = wanted is None
            need = self.above.select("pom").distinct() if every else self.above.join(measured(wanted.select("pom").distinct()), "pom").select(F.col("ancestor").alias("pom")).distinct()
            need = (need if self.done is None else need.join(measured(self.done), "pom", "left_anti")).checkpoint()
            if need.isEmpty() and self.done is not None:
                return
            self.made.append(need.count())
            self.done = _and(self.done, need)
            chain = self.above if every and len(self.made) == 1 else self.above.join(measured(need), "pom").checkpoint()
            own = effective_properties(self.poms, chain).checkpoint()
            entries = self.poms.join(measured(need), "pom", "left_semi").select("pom", F.posexplode("managed").alias("at", "m")).join(measured(own), "pom")
            is_import = F.coalesce((F.col("m.scope") == "import") & (F.col("m.kind") == "pom"), F.lit(False))
            value = lambda x: resolved(F.col(x), F.col("properties"), F.col("pom"))
            entries = entries.select("pom", "at", is_import.alias("is_import"), F.col("m.group").alias("raw_group"), value("m.group").alias("group"), F.col("m.artifact").alias("artifact"), value("m.version").alias("version")).where("version is not null").checkpoint()
            mine = entries.where(~F.col("is_import")).select("pom", F.col("raw_group").alias("group"), "artifact", "version")
            lists = entries.where(F.col("is_import") & F.col("group").isNotNull()).select("pom", "at", F.concat_ws(":", "group", "artifact", "version").alias("bom"))
            self.own, self.mine, self.lists = _and(self.own, own), _and(self.mine, mine), _and(self.lists, lists)
            above = chain.withColumnRenamed("pom", "child").withColumnRenamed("ancestor", "pom")
            direct = above.join(measured(self.mine), "pom").groupBy(F.col("child").alias("pom"), "group", "artifact").agg(F.min_by("version", "distance").alias("version")).checkpoint()
            # the topmost parent's lists come first, a pom's own last, each in order
            place = F.array(F.lit(1), -F.col("distance"), F.col("at"))
            imports = above.join(measured(self.lists), "pom").where("child <> bom").groupBy(F.col("child").alias("pom"), "bom").agg(F.min(place).alias("place")).checkpoint()
            self.direct, self.imports = _and(self.direct, direct), _and(self.imports, imports)
            if every:
                return
            wanted = imports.select(F.col("bom").alias("pom"))

    def _lists(self, wanted: DataFrame) -> DataFrame:
        """pom, bom, place: all lists that come in by imports of wanted, each at the best place at which it does.

        A list that is met again at a worse place brings nothing that the better one doesn't; a place that is found to be better
        is passed on, until none is.
        """
        best = front = self.imports.join(measured(wanted), "pom", "left_semi").checkpoint()
        deeper = self.imports.select(F.col("pom").alias("bom"), F.col("bom").alias("next"), F.col("place").alias("then"))
        while not front.isEmpty():
            found = front.join(measured(deeper), "bom").where("pom <> next").groupBy("pom", F.col("next").alias("bom")).agg(F.min(F.concat("place", "then")).alias("place"))
            known = best.select("pom", "bom", F.col("place").alias("before"))
            front = found.join(measured(known), ["pom", "bom"], "left").where("before is null or place < before").select("pom", "bom", "place").checkpoint()
            if not front.isEmpty():
                best = best.join(measured(front), ["pom", "bom"], "left_anti").unionByName(front).checkpoint()
        return best

    def versions(self, wanted: DataFrame) -> DataFrame:
        """pom, group, artifact, version: the managed versions that hold for wanted (pom), which load() has been given.

        A pom's own entries count before its parents' (the nearest), and these before imported lists (scope import, kind pom): those
        of the topmost parent come first, its own last, each in order; a list brings in its own effective versions. Versions are
        resolved where they stand; entries that can't be are left out.
        """
        wanted = wanted.select("pom").distinct()
        mine = self.direct.join(measured(wanted), "pom", "left_semi").withColumn("rank_", F.array(F.lit(0)))
        listed = self._lists(wanted).join(measured(self.direct.withColumnRenamed("pom", "bom")), "bom").select("pom", "group", "artifact", "version", F.concat("place", F.array(F.lit(0))).alias("rank_"))
        return mine.unionByName(listed).groupBy("pom", "group", "artifact").agg(F.min_by("version", "rank_").alias("version"))

    def dependencies(self, wanted: DataFrame, include_test: bool = False) -> DataFrame:
        """pom, group, artifact, version, scope: what wanted (pom) need, versions resolved or managed (else null), test scope left out."""
        wanted = wanted.select("pom").distinct()
        rows = self.poms.join(measured(wanted), "pom", "left_semi").select("pom", F.explode("depends").alias("d")).join(measured(self.own), "pom")
        rows = rows if include_test else rows.where(F.coalesce(F.col("d.scope"), F.lit("compile")) != "test")
        value = lambda x: resolved(F.col(x), F.col("properties"), F.col("pom"))
        rows = rows.select("pom", value("d.group").alias("group"), F.col("d.artifact").alias("artifact"), value("d.version").alias("own_"), F.col("d.scope").alias("scope"))
        return rows.join(measured(self.versions(wanted)), ["pom", "group", "artifact"], "left").select("pom", "group", "artifact", F.coalesce("own_", "version").alias("version"), "scope")


def effective_versions(poms: DataFrame) -> DataFrame:
    """Models.versions of all poms."""
    models = Models(poms)
    models.load()
    return models.versions(models.poms)


def dependencies(poms: DataFrame, include_test: bool = False) -> DataFrame:
    """Models.dependencies of all poms."""
    models = Models(poms)
    models.load()
    return models.dependencies(models.poms, include_test)


def transitive(poms: DataFrame, seeds: DataFrame, *, on_disk: DataFrame | None = None, declared: bool = False, include_test: bool = False) -> DataFrame:
    """pom, level, known, emitted, depends: what the seeds (pom) need directly and further on, with the seeds (level 0).

    poms may have in_tree: whether the file lies in what is being scanned (true), or was found elsewhere. The walk goes through
    every coordinate once, and on through all whose pom is known; emitted is what the inventory lists: a pom in the tree whose
    archive is among on_disk (pom), or any if that isn't given; and if declared, also a coordinate whose pom isn't known. depends
    are the artifacts that a pom needs in a version that is known. Models are made for all poms at once, so that the number of jobs is
    that of one load and of the walk's levels, whatever the walk meets.
    """
    models = Models(poms)
    models.load()
    found = models.dependencies(models.poms, include_test).where("`group` is not null and version <> ''").checkpoint()
    edges = found.select(F.col("pom").alias("src"), F.concat_ws(":", "group", "artifact", "version").alias("dst"))
    seen = closure(edges, seeds.where("pom is not null").select(F.col("pom").alias("node"))).withColumnRenamed("node", "pom")
    in_tree = F.col("in_tree") if "in_tree" in poms.columns else F.lit(True)
    files = models.poms.groupBy("pom").agg(F.bool_or(in_tree).alias("in_tree_"))
    out = seen.join(measured(files), "pom", "left").withColumn("known", F.col("in_tree_").isNotNull())
    if on_disk is None:
        out = out.withColumn("there_", F.lit(True))
    else:
        out = out.join(measured(on_disk.select("pom", F.lit(True).alias("there_")).distinct()), "pom", "left")
    emitted = F.when(F.col("known"), F.col("in_tree_") & F.coalesce("there_", F.lit(False))).otherwise(F.lit(declared))
    depends = found.groupBy("pom").agg(F.array_sort(F.collect_set("artifact")).alias("depends"))
    out = out.join(measured(depends), "pom", "left")
    return out.select("pom", "level", "known", emitted.alias("emitted"), F.coalesce("depends", F.array().cast("array<string>")).alias("depends"))


def reader_order(*tables: DataFrame) -> DataFrame:
    """Rows (purl, ...) of readers in order of precedence: the first reader that has a purl counts; reader is its place."""
    from .merge import first_seen

    out = None
    for i, t in enumerate(tables):
        own = t.withColumn("reader", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return first_seen(out, ["purl"], "reader", *[c for c in ("ord", "path") if c in out.columns])
