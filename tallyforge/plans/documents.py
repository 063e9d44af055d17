"""Queries of the documents: parts are components of their brand, documents are written and read back, the SQL states their facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as out
from ..operators import parity
from .inventory import query, table
from .scalars import P, case, cat, parts, sql_case

MADE_AT = "2024-01-01T00:00:00Z"
#: A part's purl; every fifth hangs below the top-level part before it, where that is of the same brand.
PURL = "'pkg:gem/' || nm || '-' || k || '@' || v"
C = f"""{P}, c0 AS (SELECT 'b' || b AS target, k, {PURL} AS purl, nm || '-' || k AS name, v, b, nm FROM p),
c AS (SELECT *, CASE k % 5 WHEN 1 THEN lag(purl) OVER (PARTITION BY target ORDER BY k) WHEN 2 THEN 'pkg:gem/lost@1' END AS parent_purl FROM c0),
t AS (SELECT c.*, q.purl AS parent FROM c LEFT JOIN c q ON q.target = c.target AND q.purl = c.parent_purl AND q.parent_purl IS NULL),
e AS (SELECT target, purl AS src, lead(purl) OVER (PARTITION BY target ORDER BY k) AS dst, CASE k % 3 WHEN 0 THEN 'dev_depends_on' ELSE 'depends_on' END AS kind FROM c)"""


def components(spark, d):
    """The parts as components of their brand."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("target").orderBy("k")
    rows = parts(spark, d).select("k", "b", "nm", F.concat(F.lit("b"), "b").alias("target"), F.lit("gem").alias("ecosystem"), cat("pkg:gem/", "nm", "-", "k", "@", "v").alias("purl"), cat("nm", "-", "k").alias("name"), F.col("v").alias("version"))
    rows = rows.withColumn("parent_purl", F.when(F.col("k") % 5 == 1, F.lag("purl").over(by)).when(F.col("k") % 5 == 2, "pkg:gem/lost@1"))
    licenses = case(F.array(F.lit("MIT")), F.array(F.lit("MIT OR Apache-2.0")), F.array(cat("own ", "b", " licence")), F.array().cast("array<string>"))
    return rows.withColumns({
        "technique": F.lit("package_database"), "confidence": F.lit(0.85), "paths": F.array(cat("/b", "b", "/Gemfile.lock")), "hashes": F.array(F.struct(F.lit("sha256").alias("alg"), F.sha2("nm", 256).alias("value"))),
        "licenses": licenses, "concluded": case(F.array(F.lit("MIT")), F.array().cast("array<string>")), "supplier": F.when(F.col("k") % 2 == 0, cat("org", "b")), "cpes": F.array(cat("cpe:2.3:a:x:", "nm", ":*:*:*:*:*:*:*:*")),
        "tier": case(F.lit("source"), F.lit("deployed"), F.lit(None).cast("string")), "is_dev": F.col("k") % 3 == 1, "advisories": F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit("CVE-"), (F.col("k") % 3).cast("string")))),
    })


def edges(spark, d):
    from pyspark.sql.window import Window

    rows = components(spark, d)
    kind = F.when(F.col("k") % 3 == 0, "dev_depends_on").otherwise("depends_on")
    return rows.select("target", F.col("purl").alias("src"), F.lead("purl").over(Window.partitionBy("target").orderBy("k")).alias("dst"), kind.alias("kind")).where("dst is not null")


def emitted(spark, d, *formats):
    return out.emitted(components(spark, d), edges(spark, d), list(formats), made_at=MADE_AT)


_FACTS = f"""{C} SELECT target, 'A1' AS row_id, purl AS value FROM c UNION SELECT target, 'A2', purl || ' ' || name FROM c UNION SELECT target, 'A3', purl || ' ' || v FROM c UNION SELECT target, 'A4', purl || ' org' || b FROM c WHERE k % 2 = 0
UNION SELECT target, 'A6', purl || ' sha256:' || sha256(nm) FROM c UNION SELECT target, 'A12', purl || ' cpe:2.3:a:x:' || nm || ':*:*:*:*:*:*:*:*' FROM c UNION SELECT target, 'B3', parent || ' ' || purl FROM t WHERE parent IS NOT NULL
UNION SELECT target, 'A7', purl || ' ' || unnest(CASE k % 4 WHEN 0 THEN ['MIT'] WHEN 1 THEN ['MIT', 'Apache-2.0'] WHEN 2 THEN ['own ' || b || ' licence'] ELSE [] END) FROM c
UNION SELECT target, 'C1', purl || ' /b' || b || '/Gemfile.lock' FROM c UNION SELECT target, 'C2', purl || ' true' FROM c WHERE k % 3 = 1 UNION SELECT target, 'C3', purl || ' ' || {sql_case("'source'", "'deployed'", 'NULL')} FROM c WHERE k % 3 < 2
UNION SELECT DISTINCT target, 'B4', target FROM c UNION SELECT DISTINCT target, 'G1', 'inventory' FROM c """


@query(_FACTS + "UNION SELECT target, 'A8', purl || ' MIT' FROM c WHERE k % 4 = 0 UNION SELECT target, CASE WHEN dk % 3 = 1 THEN 'B2' ELSE 'B1' END, src || ' ' || dst FROM (SELECT e.*, c.k AS dk FROM e JOIN c ON c.target = e.target AND c.purl = e.dst) WHERE dst IS NOT NULL")
def cyclonedx_facts(spark, d):
    return parity.facts(emitted(spark, d, "cyclonedx-json")).select("target", "row_id", "value")


@query(_FACTS + "UNION SELECT target, 'A8', purl || ' MIT' FROM c WHERE k % 2 = 0 UNION SELECT target, CASE kind WHEN 'depends_on' THEN 'B1' ELSE 'B2' END, src || ' ' || dst FROM e WHERE dst IS NOT NULL")
def spdx2_facts(spark, d):
    return parity.facts(emitted(spark, d, "spdx-2.3-json")).select("target", "row_id", "value")


@query(_FACTS + "UNION SELECT target, 'A8', purl || ' MIT' FROM c WHERE k % 4 = 2 UNION SELECT target, CASE WHEN dk % 3 = 1 THEN 'B2' ELSE 'B1' END, src || ' ' || dst FROM (SELECT e.*, c.k AS dk FROM e JOIN c ON c.target = e.target AND c.purl = e.dst) WHERE dst IS NOT NULL")
def spdx3_facts(spark, d):
    return parity.facts(emitted(spark, d, "spdx-3-json")).select("target", "row_id", "value")


@query(f"""{C}, k AS (SELECT target, parent AS purl, string_agg(name, '|' ORDER BY purl) AS kids FROM t WHERE parent IS NOT NULL GROUP BY 1, 2)
SELECT t.target, t.name, coalesce(kids, '') AS kids FROM t LEFT JOIN k ON k.target = t.target AND k.purl = t.purl WHERE parent IS NULL""")
def cyclonedx_nesting(spark, d):
    one = "struct<name:string,components:array<struct<name:string>>>"
    doc = F.from_json("document", f"components array<{one}>")
    rows = emitted(spark, d, "cyclonedx-json").select("target", F.explode(doc["components"]).alias("c"))
    return rows.select("target", F.col("c.name").alias("name"), F.array_join(F.transform(F.coalesce(F.col("c.components"), F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), "|").alias("kids"))


@query(f"""{C}, f AS (SELECT target, string_agg(purl, '|' ORDER BY purl) AS roots FROM c WHERE purl NOT IN (SELECT dst FROM e WHERE dst IS NOT NULL) GROUP BY 1)
SELECT target, (SELECT string_agg(DISTINCT CASE k % 3 WHEN 0 THEN 'pre-build' WHEN 1 THEN 'operations' END, '|' ORDER BY CASE k % 3 WHEN 0 THEN 'pre-build' WHEN 1 THEN 'operations' END) FROM c x WHERE x.target = f.target) AS phases, roots, 'complete:' || target || '@0.0.0' AS composition, (SELECT count(*) FROM c x WHERE x.target = f.target) AS n_complete FROM f""")
def cyclonedx_metadata(spark, d):
    doc = F.from_json("document", "metadata struct<lifecycles:array<struct<phase:string>>>, dependencies array<struct<ref:string,dependsOn:array<string>>>, compositions array<struct<aggregate:string,assemblies:array<string>>>")
    rows = out.cyclonedx(components(spark, d), edges(spark, d), made_at=MADE_AT, complete_ecosystems=["gem", "deb"]).select("target", doc.alias("d"))
    own = F.filter("d.dependencies", lambda x: x["ref"] == F.concat("target", F.lit("@0.0.0")))[0]["dependsOn"]
    first = F.col("d.compositions")[0]
    each = rows.select("target", F.array_join(F.transform("d.metadata.lifecycles", lambda p: p["phase"]), "|").alias("phases"), own.alias("roots"), F.concat_ws(":", first["aggregate"], first["assemblies"][0]).alias("composition"), F.size(F.col("d.compositions")[1]["assemblies"]).cast("bigint").alias("n"))
    # the volumes of a target taken together
    return each.groupBy("target", "phases", "composition").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("roots"))), "|").alias("roots"), F.sum("n").alias("n_complete")).select("target", "phases", "roots", "composition", "n_complete")


@query(f"""{P} SELECT 'b' || b AS target, 'CVE-' || (k % 3) AS advisory, string_agg({PURL}, '|' ORDER BY {PURL}) AS products, 'under_investigation' AS status FROM p WHERE k % 4 = 0 GROUP BY 1, 2""")
def openvex_documents(spark, d):
    doc = F.from_json("document", "statements array<struct<vulnerability:struct<name:string>,products:array<struct<`@id`:string>>,status:string>>")
    rows = out.openvex(components(spark, d), made_at=MADE_AT).select("target", F.explode(doc["statements"]).alias("s"))
    return rows.select("target", F.col("s.vulnerability.name").alias("advisory"), F.array_join(F.transform("s.products", lambda p: p["@id"]), "|").alias("products"), F.col("s.status").alias("status"))


@query(f"""{P}, r AS (SELECT DISTINCT 'b' || b AS target FROM p) SELECT target, row_id, rule, TRUE AS holds FROM r, (VALUES ('A1', 'equal'), ('A2', 'equal'), ('A3', 'equal'), ('A4', 'equal'), ('A6', 'equal'), ('A7', 'equal'), ('A12', 'within'), ('C1', 'within'), ('C2', 'within'), ('C3', 'within'), ('B3', 'equal'), ('B4', 'present'), ('G1', 'present')) x(row_id, rule)
WHERE NOT (row_id = 'B3' AND target NOT IN (SELECT 'b' || b FROM (SELECT *, lag(k) OVER (PARTITION BY b ORDER BY k) AS before FROM p) WHERE k % 5 = 1 AND before % 5 NOT IN (1, 2)))""")
def parity_rows(spark, d):
    found = parity.facts(emitted(spark, d, *out.SERIALIZERS))
    return parity.compared(found).where(F.col("row_id").isin(*"A1 A2 A3 A4 A6 A7 A12 B3 B4 C1 C2 C3 G1".split())).select("target", "row_id", "rule", "holds")


@query(f"""{P}, r AS (SELECT DISTINCT 'b' || b AS target FROM p) SELECT target, row_id, 'pass' AS verdict FROM r, unnest(['A1', 'A2', 'A3', 'A4', 'A6', 'A7', 'A12', 'B1', 'B4', 'C1', 'C2', 'C3', 'G1']) x(row_id) UNION ALL SELECT target, 'C4', 'none' FROM r""")
def parity_report(spark, d):
    found = parity.facts(emitted(spark, d, *out.SERIALIZERS))
    return parity.report(found).where("row_id not in ('A8', 'B2', 'B3')").select("target", "row_id", "verdict")
