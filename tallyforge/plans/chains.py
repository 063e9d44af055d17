"""Queries of chains of steps: tier rules, effective models, attestations, connections, sets of subjects."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import filters, maven, merge, verify
from ..operators.lineage import shared
from ..streaming import connections
from .inventory import query, table
from .scalars import P, case, cat, parts, sql_case

#: Rows of a group in order of confidence: tier, kind, has_sha256.
_GROUPS = (
    ("npm", (("analyzed", None, True), ("source", "transitive", False))), ("npm", ((None, None, False), ("design", "declared-not-cached", False))),
    ("npm", ((None, None, False), ("source", "git", True), ("design", "declared-not-cached", False))), ("golang", (("analyzed", None, False), ("source", None, False))),
    ("golang", (("analyzed", None, False), ("source", "transitive", False))), ("golang", (("analyzed", None, True), ("source", "transitive", False))),
)


def _evidence(spark, d):
    """k, ecosystem, ord, conf and tier, kind and sha256 of the rows of each part's group."""
    kind = "struct<ord:int,conf:double,sbom_tier:string,source_type:string,has_sha256:boolean>"
    lists = [F.array(*(F.struct(F.lit(i), F.lit(0.9 - i / 10), F.lit(t), F.lit(s), F.lit(h)).cast(kind) for i, (t, s, h) in enumerate(rows))) for _, rows in _GROUPS]
    return parts(spark, d).select("k", case(*(F.lit(e) for e, _ in _GROUPS)).alias("ecosystem"), F.inline(case(*lists)))


@query(f"{P} SELECT k, {sql_case("'deployed'", 'NULL', "'source'", "'source'", "'source'", "'deployed'")} AS tier, {sql_case('NULL', 'NULL', "'git'", 'NULL', 'NULL', 'NULL')} AS kind, {sql_case("'maven-cache-bfs'", "''", "'deps.dev'", "''", "''", "'maven-cache-bfs'")} AS marks FROM p")
def tier_rule(spark, d):
    out = merge.merged_tier(_evidence(spark, d), ["k"], "conf", "ord")
    return out.select("k", F.col("sbom_tier").alias("tier"), F.col("source_type").alias("kind"), F.array_join("provenance", "|").alias("marks"))


@query(f"""{P} SELECT k, 'disk' AS kind, {sql_case("'deployed'", "'source'", 'NULL', 'NULL')} AS tier, {sql_case("'deps.dev|maven-cache-bfs'", "'deps.dev'", 'NULL', 'NULL')} AS marks FROM p WHERE k % 4 < 3
UNION ALL SELECT k, 'said', 'design', NULL FROM p WHERE k % 4 >= 2""")
def fold_declared(spark, d):
    none = F.lit(None).cast("string")
    rows = parts(spark, d).select("k", F.lit("maven").alias("ecosystem"), F.lit(None).cast("string").alias("namespace"), F.concat("nm", F.col("k").cast("string")).alias("name"), F.col("v").alias("version"))
    disk = rows.where("k % 4 < 3").withColumns({"kind": F.lit("disk"), "source_type": none, "has_sha256": F.lit(True), "shaded": F.col("k") % 4 == 2, "sbom_tier": case(F.lit("analyzed"), F.lit("source"), none, none)})
    said = rows.withColumns({"kind": F.lit("said"), "source_type": F.lit("declared-not-cached"), "has_sha256": F.lit(False), "shaded": F.lit(False), "sbom_tier": F.lit("design")})
    more = rows.where("k % 4 = 0").withColumns({"kind": F.lit("more"), "source_type": F.lit("transitive"), "has_sha256": F.lit(False), "shaded": F.lit(False), "sbom_tier": F.lit("source")})
    out = merge.fold_declared(disk.unionByName(said).unionByName(more))
    return out.select("k", "kind", F.col("sbom_tier").alias("tier"), F.array_join("marks", "|").alias("marks"))


# ---- effective models: the parent of model k is k // 3


def _poms(spark, d):
    tag = lambda name, *xs: F.concat(F.lit(f"<{name}>"), *xs, F.lit(f"</{name}>"))
    k = F.col("k")
    text = lambda x: x.cast("string")
    some = lambda when, x: F.when(when, x).otherwise("")
    dep = F.concat(F.lit("<groupId>g</groupId><artifactId>dep"), text(k % 7), F.lit("</artifactId>"))
    parent = some(k > 0, tag("parent", F.lit("<groupId>g</groupId><artifactId>a"), text(F.floor(k / 3)), F.lit("</artifactId><version>1</version>")))
    props = tag("properties", some(k % 2 == 0, tag("rev", text(k))), some(k % 5 == 0, F.lit("<base>${rev}.x</base>")), F.lit("<own.group>${project.groupId}</own.group>"))
    managed = some(k % 4 == 0, tag("dependency", dep, F.lit("<version>${rev}</version>")))
    listed = some(k % 6 == 1, F.concat(F.lit("<dependency><groupId>${project.groupId}</groupId><artifactId>a"), text(k - 1), F.lit("</artifactId><version>1</version><type>pom</type><scope>import</scope></dependency>")))
    needs = F.concat(tag("dependency", dep), F.lit("<dependency><groupId>${own.group}</groupId><artifactId>own</artifactId><version>${base}</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency>"), F.lit("<dependency><groupId>g</groupId><artifactId>lost</artifactId><version>${nowhere}</version></dependency>"))
    body = tag("project", parent, some(k == 0, F.lit("<groupId>g</groupId><version>1</version>")), F.lit("<artifactId>a"), text(k), F.lit("</artifactId>"), props, tag("dependencyManagement", tag("dependencies", managed, listed)), tag("dependencies", needs))
    return maven.parsed(parts(spark, d).select(text(k).alias("path"), F.concat(F.lit('<?xml version="1.0"?>'), body).alias("text")))


_UP = f"""WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), up(k, anc, dist) AS (SELECT k, k, 0 FROM p UNION ALL SELECT k, anc // 3, dist + 1 FROM up WHERE anc > 0),
rev AS (SELECT k, arg_min(anc, dist) AS rev FROM up WHERE anc % 2 = 0 GROUP BY k),
direct AS (SELECT k, anc % 7 AS dep, arg_min(anc, dist) AS v FROM up WHERE anc % 4 = 0 GROUP BY ALL),
listed AS (SELECT u.k, d.dep, d.v, -u.dist AS place FROM up u JOIN direct d ON d.k = u.anc - 1 WHERE u.anc % 6 = 1),
eff AS (SELECT k, dep, arg_min(v, (kind, place)) AS v FROM (SELECT k, dep, v, 0 AS kind, 0 AS place FROM direct UNION ALL SELECT k, dep, v, 1, place FROM listed) GROUP BY ALL)"""


@query(f"{_UP} SELECT 'g:a' || k || ':1' AS pom, 'dep' || dep AS artifact, CAST(v AS VARCHAR) AS version FROM eff")
def effective_models(spark, d):
    return maven.effective_versions(_poms(spark, d)).select("pom", "artifact", "version")


@query(f"{_UP} SELECT 'g:a' || p.k || ':1' AS pom, 'dep' || (p.k % 7) AS artifact, CAST(v AS VARCHAR) AS version FROM p LEFT JOIN eff ON eff.k = p.k AND dep = p.k % 7 UNION ALL SELECT 'g:a' || k || ':1', 'own', rev || '.x' FROM rev UNION ALL SELECT 'g:a' || k || ':1', 'lost', NULL FROM p")
def model_dependencies(spark, d):
    return maven.dependencies(_poms(spark, d)).select("pom", "artifact", "version")


@query(f"{P} SELECT k, {sql_case("v || '-x'", "'org.o'", 'nm', 'NULL', 'NULL', "'plain'")} AS value FROM p")
def property_resolution(spark, d):
    raw = case(F.lit("${a}-${b}"), F.lit("${project.groupId}"), F.lit("${c}"), F.lit("${none}"), F.lit("${loop}"), F.lit("plain"))
    props = F.create_map(F.lit("a"), F.col("v"), F.lit("b"), F.lit("x"), F.lit("c"), F.lit("${d}"), F.lit("d"), F.col("nm"), F.lit("loop"), F.lit("${loop}"))
    return parts(spark, d).select("k", maven.resolved(raw, props, F.lit("org.o:a:1")).alias("value"))


@query(f"{P} SELECT nm || '@' || v AS purl, min(r) AS reader FROM (SELECT *, 0 AS r FROM p WHERE k % 3 = 0 UNION ALL SELECT *, 1 FROM p WHERE k % 2 = 0 UNION ALL SELECT *, 2 FROM p) GROUP BY 1")
def reader_order(spark, d):
    p = parts(spark, d).select("k", cat("nm", "@", "v").alias("purl"), F.col("k").alias("ord"))
    return maven.reader_order(p.where("k % 3 = 0"), p.where("k % 2 = 0"), p).select("purl", "reader")


# ---- attestations


def _envelopes(spark, d):
    digest = F.sha2("nm", 256)
    body = F.concat(F.lit('{"_type": "https://in-toto.io/Statement/v1", "subject": [{"name": "'), "nm", F.lit('", "digest": {"sha256": "'), digest, F.lit('"}}], "predicateType": "x", "predicate": {"a": 1}}'))
    body = case(body, body, body, body, body, F.lit('{"no": 1}'), body)
    bundle = case(*map(F.lit, (', "bundle": "b"', ', "bundle": "b"', "", ', "bundle": "b"', ', "bundle": "b"', "", ', "bundle": "b"')))
    text = F.concat(F.lit('{"payloadType": "application/vnd.in-toto+json", "payload": "'), F.regexp_replace(F.base64(body.cast("binary")), r"\s", ""), cat('", "signatures": [{"keyid": "key', "b", '", "sig": "s", "cert": "me@', "nm", '.io"'), bundle, F.lit("}]}"))
    text = F.when(F.col("k") % 7 == 6, F.lit("no json")).otherwise(text)
    return parts(spark, d).select(F.col("k").alias("id"), "nm", "b", digest.alias("digest"), text.alias("text"))


_VERDICT = sql_case("'ok'", "'identity'", "'tlog'", "'subject'", "'layout'", "'envelope'", "'envelope'")


@query(f"{P} SELECT k, {_VERDICT} AS verdict, {sql_case('0', '1', '1', '2', '3', '2', '2')} AS exit_code FROM p")
def verify_pipeline(spark, d):
    rows = _envelopes(spark, d)
    opened = verify.opened(rows).join(rows.select("id", "nm", "b", "digest"), "id")
    expected = rows.select("id", F.when(F.col("id") % 7 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("digest")).alias("sha256"))
    subjects = opened.select("id", F.explode("statement.subject").alias("s")).select("id", F.try_element_at("s.digest", F.lit("sha256")).alias("sha256"))
    opened = opened.join(verify.subjects_hold(expected, subjects), "id", "left")
    signatures = F.col("envelope.signatures")
    pattern = F.when(F.col("id") % 7 == 1, "nobody").otherwise(F.concat(F.lit("*@"), "nm"))
    step = F.array(F.struct(F.array(F.when(F.col("id") % 7 == 4, "x").otherwise(F.concat(F.lit("key"), "b"))).alias("pubkeys")))
    found = verify.verdict(("envelope", F.col("failure").isNull()), ("identity", verify.identity_holds(signatures[0]["cert"], pattern)), ("tlog", verify.tlog_holds(signatures)), ("subject", F.col("subject_ok")), ("layout", verify.layout_holds(signatures, step)))
    return opened.select(F.col("id").alias("k"), found.alias("verdict"), verify.exit_code(found).alias("exit_code"))


@query(f"""{P}, s AS (SELECT b AS id, CASE WHEN CAST(b AS INT) % 3 = 0 THEN nm END AS name, 'stated' AS how, nm AS body FROM p UNION ALL SELECT b, CASE WHEN CAST(b AS INT) % 3 < 2 THEN 'f-' || nm END, 'found', nm FROM p)
SELECT DISTINCT id, name, sha256(body) AS sha256, how FROM s WHERE name IS NOT NULL AND (how = 'stated' OR CAST(id AS INT) % 3 = 1) UNION SELECT DISTINCT b, 'synthetic:' || b, sha256('synthetic:' || b), 'made' FROM p WHERE CAST(b AS INT) % 3 = 2""")
def subject_resolver(spark, d):
    p = parts(spark, d).withColumn("i", F.col("b").cast("int") % 3)
    stated = p.select(F.col("b").alias("id"), F.when(F.col("i") == 0, F.col("nm")).alias("name"), F.sha2("nm", 256).alias("sha256"))
    found = p.select(F.col("b").alias("id"), F.when(F.col("i") < 2, F.concat(F.lit("f-"), "nm")).alias("name"), F.sha2("nm", 256).alias("sha256"))
    return verify.resolved_subjects(stated, found)


@query(f"{P} SELECT b AS id, nm AS name, min(sha256(nm || k % 3)) AS sha256 FROM p GROUP BY 1, 2")
def distinct_subjects(spark, d):
    return verify.distinct_subjects(parts(spark, d).select(F.col("b").alias("id"), F.col("nm").alias("name"), F.sha2(F.concat("nm", (F.col("k") % 3).cast("string")), 256).alias("sha256")), ["id"])


@query(f"{P} SELECT b AS id, 'https://in-toto.io/Statement/v1' AS kind, string_agg(nm || k || '=' || sha256(nm), '|' ORDER BY nm || k) AS subjects FROM p GROUP BY 1")
def statement_documents(spark, d):
    rows = verify.statement(parts(spark, d).select(F.col("b").alias("id"), F.concat("nm", F.col("k").cast("string")).alias("name"), F.sha2("nm", 256).alias("sha256")), "https://x/predicate")
    s = F.from_json("document", verify.STATEMENT)
    return rows.select("id", s["_type"].alias("kind"), F.array_join(F.transform(s["subject"], lambda x: F.concat_ws("=", x["name"], F.element_at(x["digest"], "sha256"))), "|").alias("subjects"))


@query("""SELECT user_id AS id, CASE WHEN event_type IN ('view') THEN 'material' ELSE 'product' END AS part, CAST(json_extract(props, '$.k') AS VARCHAR) AS path, arg_max(CAST(event_id AS VARCHAR), event_id) AS hash FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2, 3""")
def witness_parts(spark, d):
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "write").when(F.col("event_type") == "purchase", "create").otherwise("close")
    ops = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("path"), F.col("event_id").cast("string").alias("hash"))
    return verify.witness(ops)


@query(f"""{P} SELECT k, {sql_case("'{\"a\":[1,' || k || ',2],\"b\":\"' || nm || '\"}'", "'{\"a\":[2]}'", "'{\"a\":[1,2],\"c\":1}'")} AS document FROM p""")
def json_patches(spark, d):
    patch = case(F.concat(F.lit('[{"op": "test", "path": "/a/0", "value": 1}, {"op": "add", "path": "/a/1", "value": '), F.col("k").cast("string"), cat('}, {"op": "add", "path": "/b", "value": "', "nm", '"}]')), F.lit('[{"op": "remove", "path": "/a/0"}]'), F.lit('[{"op": "copy", "from": "/a/0", "path": "/b"}, {"op": "move", "from": "/b", "path": "/c"}]'))
    return parts(spark, d).select("k", verify.patched(F.lit('{"a": [1, 2]}'), patch).alias("document"))


@query("""SELECT s_suppkey, '{"_type":"layout","expires":"1y","steps":[{"name":"' || s_name || '","threshold":1,"pubkeys":["k' || s_nationkey || '"],"expected_materials":[],"expected_products":[]}]}' AS layout FROM supplier""")
def starter_layouts(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", verify.starter_layout(F.col("s_name"), F.concat(F.lit("k"), F.col("s_nationkey").cast("string")), F.lit("1y")).alias("layout"))


# ---- connections


def _events(spark, d):
    """Events as those of sockets: a signup opens, a purchase asks, a click writes, a view reads, an error closes."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type").isin("purchase", "click"), "write").when(F.col("event_type") == "view", "read").otherwise("close")
    payload = F.when(F.col("event_type") == "purchase", F.concat(F.lit("GET /"), F.col("event_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: h"), (F.col("event_id") % 5).cast("string"), F.lit("\r\n\r\n"))).when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), "HTTP/1.1 200 OK\r\n\r\n").when(F.col("event_id") % 3 == 0, "to pypi.org")
    return table(spark, d, "events").select(F.col("user_id").alias("conn_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), kind.alias("kind"), (F.col("event_id") % 100).alias("size"), payload.alias("payload"), (F.col("event_id") % 4 == 0).alias("tls"))


_ASSEMBLED = """
WITH e AS (SELECT user_id AS c, event_id AS i, event_type AS t, event_id % 100 AS size, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT *, greatest(count(CASE WHEN t = 'purchase' THEN 1 END) OVER w, 1) AS nth, epoch > 0 OR count(CASE WHEN t IN ('purchase', 'click') THEN 1 END) OVER w > 0 AS begun FROM e WINDOW w AS (PARTITION BY c, epoch ORDER BY rn)),
g AS (SELECT *, max(nth) OVER (PARTITION BY c, epoch) AS last_nth, max(epoch) OVER (PARTITION BY c) AS last_epoch FROM f WHERE begun),
h AS (SELECT *, first_value(CASE WHEN t = 'purchase' THEN 'h' || (i % 5) END IGNORE NULLS) OVER (PARTITION BY c, epoch, nth ORDER BY rn) AS own FROM g WHERE epoch = last_epoch OR nth < last_nth),
n AS (SELECT *, CASE WHEN t IN ('purchase', 'click') THEN coalesce(own, CASE WHEN t = 'click' AND i % 3 = 0 THEN 'pypi.org' END) WHEN t = 'view' AND i % 2 = 1 AND i % 3 = 0 THEN 'pypi.org' END AS named FROM h)
SELECT c AS conn_id, CASE WHEN count(CASE WHEN t = 'purchase' THEN 1 END) = 0 THEN 'tcp' WHEN bool_or(t IN ('purchase', 'click', 'view') AND i % 4 = 0) THEN 'https' ELSE 'http' END AS protocol, '/' || min(CASE WHEN t = 'purchase' THEN i END) AS path, arg_min(named, rn) FILTER (WHERE named IS NOT NULL) AS host,
  CASE WHEN bool_or(t = 'view' AND i % 2 = 0) THEN 200 END AS status, CAST(sum(CASE WHEN t IN ('purchase', 'click') THEN size ELSE 0 END) AS BIGINT) AS bytes_sent, CAST(sum(CASE WHEN t = 'view' THEN size ELSE 0 END) AS BIGINT) AS bytes_received, count(*) AS events
FROM n GROUP BY c, epoch, nth"""


@query(_ASSEMBLED)
def connection_assembly(spark, d):
    return connections.assembled(_events(spark, d)).select("conn_id", "protocol", "path", "host", "status", "bytes_sent", "bytes_received", "events")


@query(_ASSEMBLED)
def connection_stream(spark, d):
    """The same events as a stream of eight batches, in which they lie out of order by up to an eighth of the time they cover."""
    events = _events(spark, d)
    at = f"{shared(spark)}/tallyforge-stream-{uuid.uuid4().hex}"
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).head()
    slice_s = (last - first) // 8 + 1
    jitter = F.pmod(F.xxhash64("ord"), F.lit(slice_s))
    dealt = events.withColumn("batch", F.least(F.lit(7), F.floor((F.unix_seconds("ts") - first + jitter) / slice_s)))
    # a last event far later moves the watermark past all
    end = events.limit(1).withColumns({"conn_id": F.lit(-1).cast(events.schema["conn_id"].dataType), "ts": F.timestamp_seconds(F.lit(last + 400 * 86400)), "kind": F.lit("close")})
    # files of a batch lie over all cores; one of few rows has fewer, and files of the next may then join it, which are still within `late`
    files = spark.sparkContext.defaultParallelism
    for part in [*(dealt.where(f"batch = {i}").drop("batch") for i in range(8)), end]:
        part.repartition(files).write.mode("append").parquet(f"{at}/in")
    stream = connections.assembled_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in"), idle="300 days", late=f"{2 * slice_s} seconds")
    connections.drained(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select("conn_id", "protocol", "path", "host", "status", "bytes_sent", "bytes_received", "events")


@query("""SELECT count(*) AS total, count(DISTINCT props) AS unique_paths, (SELECT string_agg(k || '=' || n, ',' ORDER BY k || '=' || n) FROM (SELECT CASE WHEN event_type IN ('signup', 'view') THEN 'read' ELSE 'write' END AS k, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)) AS by_kind FROM events WHERE event_type <> 'error'""")
def file_summary(spark, d):
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "error", "close").otherwise("write")
    return connections.file_summary(connections.mapped_file_ops(table(spark, d, "events").select(F.col("props").alias("path"), kind.alias("kind"))))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS late FROM events WHERE user_id <> 7")
def late_files(spark, d):
    rows = connections.without_tracer(table(spark, d, "events").select(F.col("user_id").alias("pid"), F.col("event_type").alias("kind"), F.col("props").alias("path"), F.lit("p").alias("process")), 7)
    out = connections.with_late_files(rows.where("kind <> 'error'"), rows.where("kind = 'error'").select("path"))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("process") == "post-trace-scan").alias("late"))


@query("SELECT CAST(sum(CASE WHEN event_type = 'error' THEN event_id % 3 ELSE 0 END) AS BIGINT) AS ring_overflows, CAST(0 AS BIGINT) AS attach_failures, CAST(sum(CASE WHEN event_type = 'view' THEN event_id % 3 ELSE 0 END) AS BIGINT) AS events_dropped, TRUE AS loss FROM events")
def trace_integrity(spark, d):
    name = F.when(F.col("event_type") == "error", "ring_overflows").when(F.col("event_type") == "view", "events_dropped")
    return connections.trace_integrity(table(spark, d, "events").select(name.alias("counter"), (F.col("event_id") % 3).alias("n")))


@query("WITH RECURSIVE t(pid, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT p_partkey, level + 1 FROM part JOIN t ON (p_partkey - 1) // 2 = pid AND p_partkey > 0) SELECT pid, level FROM t")
def process_tree(spark, d):
    rows = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("pid"), F.floor((F.col("p_partkey") - 1) / 2).alias("ppid"))
    return connections.process_tree(rows, table(spark, d, "part").where("p_partkey = 0").select(F.col("p_partkey").alias("pid"))).select("pid", "level")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'claimed' WHEN p_partkey % 4 = 1 THEN 'managed' WHEN p_size < 10 THEN 'python' WHEN p_size < 20 THEN 'object' ELSE 'keep' END AS disposition FROM part""")
def binary_disposition(spark, d):
    from ..functions.wire import jdk_version, python_version
    from ..operators.joins import managed_dir

    key = F.col("p_partkey")
    path = F.concat(F.when(key % 4 == 1, "usr/bin/x").when(F.col("p_size") < 10, "opt/lib/python3.1/x.so").when(F.col("p_size") < 20, "opt/x.o").otherwise("opt/x"))
    rules = [("claimed", key % 4 == 0), ("managed", managed_dir(path)), ("python", python_version(path).isNotNull()), ("jdk", jdk_version(path).isNotNull()), ("object", path.rlike(r"\.[oa]$"))]
    return table(spark, d, "part").select("p_partkey", filters.disposition(rules).alias("disposition"))
