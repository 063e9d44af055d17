"""Queries of scanned project trees: jars and what is folded into them, needed poms, claimed paths, layers with links."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import claims, graph, jars, maven, snapshots
from ..operators.lineage import measured, shared
from ..sources import locks, registry
from .inventory import query, table
from .readers import N, package, written
from .scalars import P, case, cat, parts, sql_case

TARGET = "App-Main"


def _text(x):
    return x.cast("string") if not isinstance(x, str) else F.col(x).cast("string")


def _properties(group, artifact, version):
    return F.concat(F.lit("#made\ngroupId="), group, F.lit("\nartifactId="), artifact, F.lit("\nversion="), version, F.lit("\n"))


def _jars(spark, d):
    """k, jar, claimed, manifest of a jar a part: named as the target, fat, fat and claimed, to be started, built, of another version, plain."""
    name = package()
    path = case(cat("/usr/share/java/App-Main-", "k", ".jar"), F.concat(F.lit("/app/"), name, F.lit(".jar")), F.concat(F.lit("/usr/share/java/"), name, F.lit(".jar")), F.concat(F.lit("/opt/"), name, F.lit(".jar")), F.concat(F.lit("/w/target/"), name, F.lit("-"), "v", F.lit(".jar")), F.concat(F.lit("/w/target/"), name, F.lit("-0.jar")), F.concat(F.lit("/m2/"), name, F.lit(".jar")))
    manifest = case(F.lit(None), F.lit("Manifest-Version: 1.0\n"), F.lit(None), F.lit("Manifest-Version: 1.0\r\nmain-CLASS: x.Main\r\n"), F.lit(None), F.lit(None), F.lit("Main-Class: \r\n x\n"))
    return parts(spark, d).select("k", "nm", "v", path.alias("jar"), (F.col("k") % 7).isin(0, 2).alias("claimed"), manifest.alias("manifest"))


_KEPT = "k % 7 IN (2, 5, 6)"


@query(f"""{P}, j AS (SELECT *, {N} AS a, {sql_case("'/usr/share/java/App-Main-' || k || '.jar'", f"'/app/' || {N} || '.jar'", 'NULL', f"'/opt/' || {N} || '.jar'", f"'/w/target/' || {N} || '-' || v || '.jar'", 'NULL', 'NULL')} AS jar,
  {sql_case("'target-name-match'", "'unclaimed-fat-jar-heuristic'", 'NULL', "'executable-jar-heuristic'", "'maven-target-dir-heuristic'", 'NULL', 'NULL')} AS reason FROM p)
SELECT 'component' AS role, 'pkg:maven/org.x/' || a || '@' || v AS purl, NULL AS parent, NULL AS reason FROM j WHERE {_KEPT}
UNION ALL SELECT 'component', 'pkg:maven/org.v/inner' || k || '@1', 'pkg:maven/org.x/' || a || '@' || v, NULL FROM j WHERE k % 7 IN (1, 2)
UNION ALL (SELECT 'subject', 'pkg:maven/org.x/' || CASE WHEN k % 7 = 0 THEN '{TARGET}' ELSE a END || '@' || v, NULL, reason FROM j WHERE reason IS NOT NULL ORDER BY jar LIMIT 1)""")
def scan_target_suppression(spark, d):
    rows = _jars(spark, d)
    own = F.when(F.col("k") % 7 == 0, F.lit(TARGET)).otherwise(package())
    inner = F.when((F.col("k") % 7).isin(1, 2), _properties(F.lit("org.v"), F.concat(F.lit("inner"), _text("k")), F.lit("1")))
    files = rows.select("jar", F.posexplode(F.array(_properties(F.lit("org.x"), own, F.col("v")), inner)).alias("at", "text")).where("text is not null")
    read = locks.properties(files.select(F.struct("jar", "at").alias("path"), "text"))
    value = lambda k: F.try_element_at("properties", F.lit(k))
    coords = read.select("path.jar", "path.at", value("groupId").alias("group"), value("artifactId").alias("artifact"), value("version").alias("version"))
    judged = jars.judged(coords, rows.select("jar", "claimed", "manifest"), TARGET.lower())
    found = jars.subject(judged)
    none = F.lit(None).cast("string")
    listed = jars.components(judged).select(F.lit("component").alias("role"), "purl", "parent", none.alias("reason"))
    return listed.unionByName(found.select(F.lit("subject").alias("role"), jars.maven_purl(F.col("group"), F.col("artifact"), F.col("version")).alias("purl"), none.alias("parent"), "reason"))


@query(f"""{P}, j AS (SELECT *, '/b' || b || '.jar' AS jar FROM p WHERE CAST(b AS INT) % 7 > 0),
e AS (SELECT b, jar, 'com.ext' AS g, {N} AS a, NULL AS c, v FROM j WHERE k % 6 = 0 UNION ALL SELECT b, jar, 'org.own.sub', 'lib-Leaf' || k, NULL, v FROM j WHERE k % 12 = 1 UNION ALL SELECT DISTINCT b, jar, 'com.ext', 'dup', NULL, '1' FROM j WHERE k % 6 = 4 UNION ALL SELECT b, jar, 'com.ext', {N}, 'tests', v FROM j WHERE k % 6 = 5)
SELECT jar, 'pkg:maven/org.own/b' || b || '@1' AS parent, 'pkg:maven/' || g || '/' || a || '@' || v || CASE WHEN c IS NULL THEN '' ELSE '?classifier=' || c END AS purl, 'Apache License' AS license FROM e""")
def shade_ancestors(spark, d):
    p = parts(spark, d)
    name = package()
    listed = case(
        F.concat(F.lit("com.ext:"), name, F.lit(":jar:"), "v"), F.concat(F.lit("org.own.sub:lib-Leaf"), _text("k"), F.lit(":jar:"), "v"), F.lit("net.gone:x-core:jar:1"),
        F.concat(F.lit("org.own:b"), "b", F.lit(":jar:1")), F.lit("com.ext:dup:jar:1"), F.concat(F.lit("com.ext:"), name, F.lit(":jar:tests:"), "v"),
    )
    ancestors = locks.jar_dependencies(written(p, F.concat(F.lit("  - Name (https://x) "), listed, F.lit("\n    License: Apache License (https://y)\n")), suffix=".jar")).withColumnRenamed("path", "jar")
    jar = F.concat(F.lit("/b"), "b", F.lit(".jar"))
    own = p.select("b").distinct().select(jar.alias("jar"), F.lit(0).alias("at"), F.lit("org.own").alias("group"), F.when(F.col("b").cast("int") % 7 == 0, "other").otherwise(F.concat(F.lit("b"), "b")).alias("artifact"), F.lit("1").alias("version"))
    # classes below both groups, a folder with a generic name, and folders of some leaves
    some = p.select("b").distinct().select(jar.alias("jar"), F.explode(F.array(*map(F.lit, ("com/ext/A.class", "org/own/sub/B.class", "a/core/C.class", "leaf1/D.class", "net/gone/readme.txt")))).alias("path"))
    leaves = p.where("k % 12 = 1").select(jar.alias("jar"), F.concat(F.lit("org/own/shaded/leaf"), _text("k"), F.lit("/X.class")).alias("path"))
    return jars.shade_ancestors(ancestors, own, some.unionByName(leaves)).select("jar", "parent", "purl", "license")


WIDTH = 10


def needed_poms(spark, d):
    """A pom for each part but every fifth: k needs 10k + 1 to 10k + 10, every second in a version that is a property of the parent,
    the others as managed by a list of its own that it imports; every third pom, the parent and the lists lie outside of the tree."""
    k = F.col("k")
    tag = lambda name, *xs: F.concat(F.lit(f"<{name}>"), *xs, F.lit(f"</{name}>"))
    artifact = lambda name, x, version: tag("dependency", F.lit(f"<groupId>${{own}}</groupId><artifactId>{name}"), _text(x), F.lit("</artifactId>"), version)
    version = lambda x: tag("version", F.lit(x))
    below = F.sequence(k * WIDTH + 1, k * WIDTH + WIDTH)
    needs = F.array_join(F.transform(below, lambda x: artifact("a", x, F.when(x % 2 == 0, version("${v}")).otherwise(""))), "")
    managed = F.array_join(F.transform(F.filter(below, lambda x: x % 2 == 1), lambda x: F.replace(artifact("a", x, version("1")), F.lit("${own}"), F.lit("g"))), "")
    other = F.lit("<dependency><groupId>g</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency><dependency><groupId>g</groupId><artifactId>lost</artifactId><version>${nowhere}</version></dependency>")
    imported = artifact("list", k, F.lit("<version>${v}</version><type>pom</type><scope>import</scope>"))
    p = parts(spark, d).where("k % 5 <> 4")
    each = p.select(F.concat(F.lit("a"), _text("k")).alias("path"), tag("project", F.lit("<parent><groupId>g</groupId><artifactId>parent</artifactId><version>1</version></parent><artifactId>a"), _text("k"), F.lit("</artifactId>"), tag("dependencies", needs, other), tag("dependencyManagement", tag("dependencies", imported))).alias("text"), (k % 3 != 1).alias("in_tree"))
    lists = p.select(F.concat(F.lit("list"), _text("k")).alias("path"), tag("project", F.lit("<groupId>g</groupId><artifactId>list"), _text("k"), F.lit("</artifactId><version>1</version>"), tag("dependencyManagement", tag("dependencies", managed))).alias("text"), F.lit(False).alias("in_tree"))
    above = F.lit("<project><groupId>g</groupId><artifactId>parent</artifactId><version>1</version><properties><own>g</own><v>1</v></properties></project>")
    parent = table(spark, d, "region").limit(1).select(F.lit("parent").alias("path"), above.alias("text"), F.lit(False).alias("in_tree"))
    files = each.unionByName(lists).unionByName(parent)
    return maven.parsed(files).join(measured(files.select("path", "in_tree")), "path")


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 4),
r(k, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT unnest(range(r.k * {WIDTH} + 1, r.k * {WIDTH} + {WIDTH + 1})), level + 1 FROM r JOIN p ON p.k = r.k)
SELECT 'g:a' || r.k || ':1' AS pom, level, p.k IS NOT NULL AS known, CASE WHEN p.k IS NULL THEN TRUE ELSE r.k % 3 <> 1 AND r.k % 4 <> 2 END AS emitted, CASE WHEN p.k IS NULL THEN 0 ELSE {WIDTH} END AS n_needs
FROM r LEFT JOIN p ON p.k = r.k""")
def transitive_closure(spark, d):
    seeds = table(spark, d, "part").where("p_partkey = 0").select(F.lit("g:a0:1").alias("pom"))
    on_disk = parts(spark, d).where("k % 4 <> 2").select(F.concat(F.lit("g:a"), _text("k"), F.lit(":1")).alias("pom"))
    out = maven.transitive(needed_poms(spark, d), seeds, on_disk=on_disk, declared=True)
    return out.select("pom", "level", "known", "emitted", F.size("depends").alias("n_needs"))


@query(f"""{P} SELECT k, {sql_case("'path'", "'canonical'", "'canonical'", 'NULL', "'inode'", 'NULL')} AS claimed_by FROM p""")
def path_claims(spark, d):
    """Files as a walk meets them: claimed as they are, through /lib, through links of links, in a circle, by inode only, not at all."""
    p = parts(spark, d)
    none = F.lit(None).cast("long")
    name = package()
    path = case(F.concat(F.lit("/usr/bin/"), name), F.concat(F.lit("/lib/"), name), F.concat(F.lit("/opt/cur/"), name), F.concat(F.lit("/loop/a/"), name), F.concat(F.lit("/data/"), name), F.concat(F.lit("/opt/v1/"), name))
    claim = case(F.concat(F.lit("/usr/bin/"), name), F.concat(F.lit("/usr/lib/"), name), F.concat(F.lit("/srv/./v2/"), name), F.lit(None), F.concat(F.lit("/var/x/"), name), F.concat(F.lit("/opt/v2/"), name, F.lit("x")))
    files = p.select("k", path.alias("path"), F.lit(1).cast("long").alias("device"), F.when(F.col("k") % 6 < 5, F.col("k")).otherwise(none).alias("inode"))
    held = p.select(claim.alias("path"), F.lit(1).cast("long").alias("device"), F.when(F.col("k") % 6 == 4, F.col("k")).otherwise(none).alias("inode")).where("path is not null")
    links = table(spark, d, "region").limit(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("path"), F.lit(b).alias("target")) for a, b in (("/lib", "usr/lib"), ("/opt/cur", "/opt/v2"), ("/opt/v2", "../opt/../srv/v2"), ("/loop/a", "b"), ("/loop/b", "./a"))))))
    return claims.with_claims(files, held, links).select("k", "claimed_by")


@query(f"""{P}, e(path, layer, from_path, from_layer) AS (VALUES ('l0', 0, 'later', 0), ('later', 2, 'later', 2), ('c1', 0, 'f', 0), ('c2', 0, 'f', 0), ('c3', 0, 'f', 0), ('keep', 1, 'later', 0), ('d/new', 2, 'd/new', 2))
SELECT k || '/' || path AS path, layer, k || '/' || from_path AS from_path, from_layer FROM p, e""")
def layer_hard_links(spark, d):
    """In each part's image: a link before its target, a chain of links, a target that is replaced, one that is gone, a circle of links."""
    rows = (
        (0, "l0", "hardlink", "later"), (0, "f", "file", None), (0, "later", "file", None), (0, "c1", "hardlink", "c2"), (0, "c2", "hardlink", "c3"), (0, "c3", "hardlink", "f"), (0, "dead", "file", None), (0, "d/old", "hardlink", "f"),
        (1, "f", "whiteout", None), (1, "dead", "hardlink", "f"), (1, "keep", "hardlink", "later"), (2, "later", "file", None), (2, "x", "hardlink", "y"), (2, "y", "hardlink", "x"), (2, "d", "opaque", None), (2, "d/new", "file", None),
    )
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("layer"), F.lit(p).alias("name"), F.lit(kind).alias("kind"), F.lit(to).cast("string").alias("to")) for n, p, kind, to in rows)))
    own = lambda x: F.when(F.col(x).isNotNull(), F.concat(_text("k"), F.lit("/"), x))
    entries = parts(spark, d).select("k", each).select("layer", "kind", own("name").alias("path"), own("to").alias("target"))
    return graph.linked_overlay(entries)


def mixed_tree(spark, d):
    """path and text of a tree with four kinds of package files a brand, and some that no reader wants; each part is in one of them, every eighth in two."""
    p = parts(spark, d)
    name = package()
    kinds = (
        ("var/lib/dpkg/status", 0, F.concat(F.lit("Package: "), name, F.lit("\nStatus: install ok installed\nArchitecture: amd64\nVersion: "), "v", F.lit("\n\n"))),
        ("requirements.txt", 1, F.concat(name, F.lit("=="), "v", F.lit("\n"))),
        ("go.sum", 2, F.concat(F.lit("m.io/"), name, cat(" v", "v", " h1:AAAA\n"))),
        ("Gemfile.lock", 3, F.concat(F.lit("GEM\n  specs:\n    "), name, cat(" (", "v", ")\n\n"))),
        ("sub/requirements-dev.txt", 1, F.when(F.col("k") % 8 == 1, F.concat(name, F.lit("=="), "v", F.lit("\n"))).otherwise("")),
        ("README.md", 0, F.lit("a\n")),
    )
    out = None
    for path, k, line in kinds:
        own = written(p.where(f"k % 4 = {k}"), line, suffix=f"/{path}")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""{P}, r AS (SELECT *, {sql_case("'pkg:deb/debian/' || nm || '-' || k || '@' || v || '?arch=amd64'", "'pkg:pypi/' || nm || '-' || k || '@' || v", "'pkg:golang/m.io/' || nm || '-' || k || '@v' || v", "'pkg:gem/' || nm || '-' || k || '@' || v")} AS purl, {sql_case("'dpkg'", "'requirements'", "'go.sum'", "'gemfile'")} AS reader FROM p)
SELECT purl, reader, CASE WHEN k % 4 = 0 THEN 'deployed' ELSE 'source' END AS tier, 'b' || b || {sql_case("'/var/lib/dpkg/status'", "'/requirements.txt'", "'/go.sum'", "'/Gemfile.lock'")} AS path, CASE WHEN k % 8 = 1 THEN 2 ELSE 1 END AS n_rows FROM r""")
def tree_inventory(spark, d):
    """A mixed tree, written as files and read back through the data source; one row a purl by precedence, with the number of rows before."""
    root = f"{shared(spark)}/tallyforge-tree-{uuid.uuid4().hex}"
    registry.write_tree(mixed_tree(spark, d), root)
    return registry.counted_by_precedence(registry.tree_inventory(spark, root)).select("purl", "reader", "tier", "path", "n_rows")


def index_snapshot(spark, d, buckets=8):
    """The index knows the content of two parts of three, as packages of six systems, and of every part as one of a seventh."""
    system = case(*map(F.lit, ("CARGO", "npm", "GO", "MAVEN", "PyPI", "NUGET")))
    name = F.when(F.col("k") % 6 == 3, F.concat(F.lit("org.o:"), package())).otherwise(package())
    p = parts(spark, d)
    known = p.where("k % 3 < 2").select(F.sha2(package(), 256).alias("sha256"), system.alias("system"), name.alias("name"), F.col("v").alias("version"))
    other = p.select(F.sha2(package(), 256).alias("sha256"), F.lit("RUBY").alias("system"), package().alias("name"), F.col("v").alias("version"))
    unique = uuid.uuid4().hex
    return snapshots.saved(known.unionByName(known).unionByName(other), f"tallyforge_index_{unique}", "sha256", f"{shared(spark)}/tallyforge-index-{unique}", buckets)


@query(f"""{P} SELECT k, {sql_case("'pkg:cargo/' || nm || '-' || k", "'pkg:npm/' || nm || '-' || k", 'NULL', "'pkg:maven/org.o/' || nm || '-' || k", "'pkg:pypi/' || nm || '-' || k", 'NULL')} || '@' || v AS purl, 'hash_match' AS technique, CAST(0.9 AS DOUBLE) AS confidence FROM p WHERE k % 3 < 2""")
def index_hash_query(spark, d):
    files = parts(spark, d).select("k", F.upper(F.sha2(package(), 256)).alias("sha256"))
    return snapshots.by_hash(files, index_snapshot(spark, d)).select("k", "purl", "technique", "confidence")


@query(f"""{P} SELECT {N} AS name, CASE WHEN k % 4 < 3 THEN sha256(CASE WHEN k % 4 = 1 THEN 'arch' ELSE 'plain' END || k) END AS sha256 FROM p""")
def package_list_hashes(spark, d):
    p = parts(spark, d)
    text = lambda kind: F.concat(F.lit(kind), _text("k")).alias("text")
    lists = p.where("k % 4 in (0, 2)").select(package().alias("file"), text("plain")).unionByName(p.where("k % 4 in (0, 1)").select(F.concat(package(), F.lit(":amd64")).alias("file"), text("arch")))
    packages = p.select(package().alias("name"), F.when(F.col("k") % 4 == 2, F.lit("")).otherwise("amd64").alias("arch"))
    return snapshots.package_hashes(packages, lists).select("name", "sha256")
