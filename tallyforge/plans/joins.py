"""Queries of the lookup joins and of merges that fill evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import licenses
from ..operators import jars, joins, merge
from .inventory import query, table
from .scalars import P, case, cat, parts, sql_case


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) ELSE o_orderdate END AS hash FROM orders")
def captured_path_hash(spark, d):
    found = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("hash"))
    return joins.overwritten(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("hash")), found, "o_orderkey", "hash")


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_name END, (SELECT max(c_name) FROM customer WHERE c_custkey = s_suppkey AND c_acctbal > 0)) AS maintainer FROM supplier")
def author_backfill(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("maintainer"))
    return joins.filled(rows, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("maintainer")), "s_suppkey", "maintainer")


@query(f"{P} SELECT b AS package, '/usr/share/' || nm || '-' || k AS path, CASE WHEN k % 3 <> 0 THEN md5(nm) END AS md5 FROM p")
def list_md5_join(spark, d):
    p = parts(spark, d)
    at = cat("usr/share/", "nm", "-", "k")
    return joins.listed_hashes(p.select(F.col("b").alias("package"), F.concat(F.lit("/"), at).alias("path")), p.where("k % 3 <> 0").select(F.col("b").alias("package"), F.md5("nm").alias("md5"), at.alias("path")))


@query(f"{P} SELECT nm || k AS name, {sql_case("'MIT'", "'Zlib'", "'ISC'", "''")} AS licenses FROM p")
def copyright_join(spark, d):
    p = parts(spark, d)
    folder = lambda suffix: cat("nm", "k", suffix).alias("folder")
    body = lambda name: F.lit(f"License: {name}\n").alias("text")
    texts = p.where("k % 4 = 0").select(folder(""), body("expat")).unionByName(p.where("k % 4 <= 1").select(folder("-amd64"), body("zlib"))).unionByName(p.where("k % 4 <= 2").select(folder("-aarch64"), body("isc")))
    out = joins.documented(p.select(cat("nm", "k").alias("name")), texts)
    return out.select("name", F.array_join(F.coalesce(licenses.copyright_licenses(F.col("text")), F.array().cast("array<string>")), "|").alias("licenses"))


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL OR 'q' || quality = lang THEN lang ELSE lang || '|q' || quality END AS licenses, quality IS NOT NULL AS matched FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def index_license_join(spark, d):
    found = table(spark, d, "labels").where("quality is not null").select("doc_id", F.array(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("licenses"))
    out = joins.appended(table(spark, d, "documents").select("doc_id", F.array("lang").alias("licenses")), found, ["doc_id"], "licenses", "matched")
    return out.select("doc_id", F.array_join("licenses", "|").alias("licenses"), "matched")


_KINDS = ("npm", "npm", "cargo", "gem", "pypi", "maven", "maven", "golang", "swift")


def _spaced(spark, d):
    space = case(cat("@s", "b"), F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit(""), cat("org.o", "b"), F.lit(""), cat("m.io/o", "b"), F.lit(""))
    name = case(*[cat("nm")] * 4, F.upper("nm"), *[cat("nm")] * 2, cat("m.io/o", "b", "/", "nm"), cat("nm"))
    return parts(spark, d).select("k", "v", case(*map(F.lit, _KINDS)).alias("kind"), space.alias("space"), name.alias("name"))


@query(f"""{P} SELECT k, {sql_case("'npm/npmjs/s' || b || '/' || nm || '/' || v", "'npm/npmjs/-/' || nm || '/' || v", "'crate/cratesio/-/' || nm || '/' || v", "'gem/rubygems/-/' || nm || '/' || v", "'pypi/pypi/-/' || nm || '/' || v", "'maven/mavencentral/org.o' || b || '/' || nm || '/' || v", 'NULL', "'go/golang/m.io%2fo' || b || '/' || nm || '/v' || v", 'NULL')} AS coordinate,
{sql_case("'@s' || b || '/' || nm", 'nm', 'nm', 'nm', 'upper(nm)', "'org.o' || b || ':' || nm", 'nm', "'m.io/o' || b || '/' || nm", 'nm')} AS name FROM p""")
def index_coordinates(spark, d):
    c = {x: F.col(x) for x in ("kind", "space", "name", "v")}
    return _spaced(spark, d).select("k", joins.curated_coordinate(c["kind"], c["space"], c["name"], c["v"]).alias("coordinate"), joins.indexed_name(c["kind"], c["space"], c["name"]).alias("name"))


@query("""WITH l AS (SELECT c_mktsegment AS name, arg_min(c_name, c_custkey) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT p_partkey, coalesce(v, p_name) AS version FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'none' END AS nm FROM part) LEFT JOIN l ON name = nm""")
def graph_version_override(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, "BUILDING").when(F.col("p_partkey") % 3 == 1, "MACHINERY").otherwise("none")
    local = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("version"), F.col("c_custkey").alias("ord"))
    return joins.local_versions(table(spark, d, "part").select("p_partkey", name.alias("name"), F.col("p_name").alias("version")), local).select("p_partkey", "version")


@query("SELECT DISTINCT a.o_orderkey AS graph, b.n_name AS src, c.n_name AS dst FROM (SELECT l_orderkey AS o_orderkey, l_partkey % 25 AS x, l_suppkey % 25 AS y FROM lineitem) a JOIN nation b ON b.n_nationkey = x JOIN nation c ON c.n_nationkey = y WHERE b.n_name <> c.n_name AND x < 20 AND y < 20")
def graph_node_edges(spark, d):
    graphs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph")).distinct()
    nodes = graphs.join(F.broadcast(table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("bigint").alias("node"), F.col("n_name").alias("purl"))))
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), (F.col("l_partkey") % 25).alias("from_node"), (F.col("l_suppkey") % 25).alias("to_node"))
    return joins.numbered_edges(nodes, edges)


@query(f"{P} SELECT k, nm || k || '.so' AS soname FROM p WHERE k % 6 NOT IN (0, 2, 5)")
def soname_probe(spark, d):
    p = parts(spark, d)
    name = F.when(F.col("k") % 6 == 5, cat("/System/Library/", "nm", "k", ".so")).otherwise(cat("nm", "k", ".so"))
    claims = p.where("k % 6 = 0").select(cat("/usr/lib64/", "nm", "k", ".so").alias("path")).unionByName(p.where("k % 6 = 2").select(cat("/lib/", "nm", "k", ".so").alias("path"))).unionByName(p.where("k % 6 = 3").select(cat("/opt/lib/", "nm", "k", ".so").alias("path")))
    return joins.unclaimed_libraries(p.select("k", name.alias("soname")), claims).select("k", "soname")


@query(f"{P} SELECT k, {sql_case("'/poms/' || nm || k || '.pom'", "'/poms/JPP-' || nm || k || '.pom'", 'NULL')} AS pom FROM p")
def sidecar_join(spark, d):
    p = parts(spark, d)
    jars = p.select("k", F.concat(F.lit("/usr/share/java/"), F.upper(F.substring("nm", 1, 1)), F.substr("nm", F.lit(2)), cat("k", "-", "v", ".jar")).alias("path"))
    poms = p.where("k % 3 = 0").select(cat("/poms/", "nm", "k", ".pom").alias("path")).unionByName(p.where("k % 3 < 2").select(cat("/poms/JPP-", "nm", "k", ".pom").alias("path"))).unionByName(p.select(cat("/poms/", "nm", "k", ".txt").alias("path")))
    return joins.with_sidecar(jars, poms).select("k", "pom")


@query(f"{P} SELECT nm || k AS artifact, {sql_case("'own'", "'said'", "'top'")} AS \"group\", {sql_case('v', "'9'", "'7'")} AS version FROM p WHERE k % 4 <> 3 OR k % 3 = 0 UNION ALL SELECT 'base', 'top', '7'")
def sidecar_parents(spark, d):
    none = F.lit(None).cast("string")
    p = parts(spark, d).select(cat("nm", "k").alias("artifact"), case(F.lit("own"), F.lit(""), none).alias("group"), case(F.col("v"), none, none).alias("version"), case(F.lit("x"), F.lit("said"), none).alias("parent_group"), F.when((F.col("k") % 4 != 3) | (F.col("k") % 3 == 0), "base").otherwise("lost").alias("parent_artifact"), case(F.lit("1"), F.lit("9"), none).alias("parent_version"), "k")
    base = spark.sql("SELECT 'base' AS artifact, 'top' AS `group`, '7' AS version, CAST(NULL AS STRING) AS parent_group, CAST(NULL AS STRING) AS parent_artifact, CAST(NULL AS STRING) AS parent_version")
    return joins.parent_coordinates(p.where("k % 3 <> 1 or k % 4 <> 3").drop("k").unionByName(base))


@query(f"{P} SELECT b AS jar, 'org.o' || (k % 5) AS \"group\", replace(nm, '-', '_') AS artifact FROM p WHERE k % 5 IN (0, 3) GROUP BY ALL UNION SELECT b, 'org.apache', 'a' || replace(nm, '-', '_') FROM p WHERE k % 7 = 0")
def bytecode_presence(spark, d):
    p = parts(spark, d).withColumn("nm", F.replace("nm", F.lit("-"), F.lit("_")))
    ancestors = p.select(F.col("b").alias("jar"), F.concat(F.lit("org.o"), (F.col("k") % 5).cast("string")).alias("group"), F.col("nm").alias("artifact")).distinct()
    shared = p.where("k % 7 < 2").select(F.col("b").alias("jar"), F.lit("org.apache").alias("group"), F.concat(F.when(F.col("k") % 7 == 0, "a").otherwise("z"), "nm").alias("artifact")).distinct()
    # the jar's own group is org.o1, so that org/o1 proves nothing; nor do org/apache without a class, and first folders
    own = F.struct(F.lit("org.o1").alias("group"), F.lit("own").alias("artifact"), F.lit("1").alias("version"))
    classes = p.select(F.col("b").alias("jar"), F.explode(F.array(*(F.lit(f"org/o{i}/util/X.class") for i in (0, 1, 3)), F.lit("org/apache/x.txt"))).alias("path"))
    leaf = p.where("k % 7 = 0").select(F.col("b").alias("jar"), F.concat(F.lit("lib/"), F.lit("a"), "nm", F.lit("/X.class")).alias("path"))
    rows = ancestors.unionByName(shared).withColumn("own", own)
    return jars.shown_by_bytecode(rows, classes.unionByName(leaf)).select("jar", "group", "artifact")


@query(f"{P} SELECT k, {sql_case('TRUE', 'TRUE', 'FALSE', 'FALSE')} AS managed FROM p")
def managed_dirs(spark, d):
    return parts(spark, d).select("k", joins.managed_dir(case(cat("usr/bin/", "nm"), cat("lib64/", "nm"), cat("opt/lib/", "nm"), cat("usr/local/bin/", "nm"))).alias("managed"))


@query("""WITH c AS (SELECT page_id, split_part(url, '/', -1) AS base, url FROM pages), f AS (SELECT split_part(rtrim(url, '/'), '/', -1) AS base, page_id AS ord, CASE WHEN page_id % 3 > 0 THEN md5(url) END AS hash, url AS path FROM pages),
g AS (SELECT base, arg_max(hash, ord) FILTER (WHERE hash IS NOT NULL) AS hash, arg_min(path, ord) AS file_path FROM f GROUP BY 1)
SELECT c.page_id, g.hash, CASE WHEN g.hash IS NOT NULL THEN g.file_path END AS file_path FROM c LEFT JOIN g ON g.base = c.base AND g.hash IS NOT NULL""")
def connection_file_join(spark, d):
    pages = table(spark, d, "pages")
    files = pages.select(F.col("url").alias("path"), F.when(F.col("page_id") % 3 > 0, F.md5("url")).alias("hash"), F.col("page_id").alias("ord"))
    return merge.with_file(pages.select("page_id", F.col("url").alias("path")), files).select("page_id", "hash", "file_path")
