"""Named queries: the library's operators over the bundled tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys, text
from ..operators import filters, graph, merge, summaries

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(x) -> F.Column:
    return F.col(x).cast("bigint") if isinstance(x, str) else x.cast("bigint")


def joined(x: str) -> F.Column:
    return F.array_join(F.col(x), "|").alias(x)


MOST_BYTES = 256 << 20


@query(f"""SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) <= {MOST_BYTES}""")
def scan_hash_filter(spark, d):
    size = F.octet_length("text").cast("bigint")
    return table(spark, d, "documents").where(size <= MOST_BYTES).select("doc_id", F.sha2("text", 256).alias("sha256"), size.alias("size"))


@query("""
WITH e AS (SELECT sha256(text) AS key, d.doc_id AS ord, coalesce(quality, -1) AS conf, source, lang, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conf DESC, ord) AS rn FROM e),
w AS (SELECT key, ord AS doc_id, lang, conf FROM r WHERE rn = 1),
s AS (SELECT key, source, min(rn) AS place FROM r GROUP BY key, source),
u AS (SELECT key, string_agg(source, '|' ORDER BY place) AS sources FROM s GROUP BY key),
g AS (SELECT key, count(*) AS n_rows, bool_and(toxic = 1) AS toxic FROM e GROUP BY key)
SELECT key, doc_id, lang, CAST(conf AS BIGINT) AS conf, n_rows, toxic, sources FROM w JOIN u USING (key) JOIN g USING (key)""")
def dedup_merge(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.sha2("text", 256).alias("key"), "doc_id", F.coalesce("quality", F.lit(-1)).cast("bigint").alias("conf"), F.array("source").alias("sources"), "lang", (F.col("toxic") == 1).alias("toxic"))
    out = merge.dedup_merge(rows, ["key"], conf="conf", ord_="doc_id", winner=["doc_id", "lang", "conf"], unions=("sources",), flag="toxic")
    return out.select("key", "doc_id", "lang", "conf", "n_rows", "toxic", joined("sources"))


@query("""SELECT source, bool_and(toxic = 1) FILTER (WHERE toxic IS NOT NULL) AS flag, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def dedup_tristate_dev(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(merge.tri_state(F.col("toxic") == 1).alias("flag"), F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_custkey AS k, o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders),
m AS (SELECT k, string_agg(DISTINCT p, '|' ORDER BY p) AS folded FROM r WHERE s = 'P' GROUP BY k),
t AS (SELECT DISTINCT k FROM r WHERE s = 'F')
SELECT o_orderkey, k, s, CASE WHEN s = 'F' THEN folded END AS folded FROM r LEFT JOIN m USING (k) WHERE s <> 'P' OR k NOT IN (SELECT k FROM t)""")
def fold_secondary(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    out = merge.fold(rows, ["k"], F.col("s") == "P", F.col("s") == "F", "p")
    return out.select("o_orderkey", "k", "s", joined("folded"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_seen_wins(spark, d):
    return merge.first_seen(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT c_nationkey AS nation, c_name AS name FROM customer WHERE c_nationkey < 10 UNION ALL SELECT s_nationkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10)""")
def tier_precedence_merge(spark, d):
    c = table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return merge.without_override(c, s, ["nation"])


@query("""
WITH t AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS tier FROM orders)
SELECT o_custkey, o_orderkey, tier FROM (SELECT *, min(tier) OVER (PARTITION BY o_custkey) AS low FROM t) WHERE tier = low""")
def npm_tier_select(spark, d):
    tier = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    return merge.first_tier(table(spark, d, "orders").select("o_custkey", "o_orderkey", tier.alias("tier")), "o_custkey", "tier").select("o_custkey", "o_orderkey", "tier")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R') OR EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = o_orderkey)""")
def linked_semi_filter(spark, d):
    signal = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.guarded_semi(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "O", signal, ["o_orderkey"])


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size > 25 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49) OR EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49 AND l_partkey = p_partkey)""")
def production_semi_filter(spark, d):
    signal = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return filters.guarded_semi(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("p_size") <= 25, signal, ["p_partkey"]).select("p_partkey", "p_brand")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 0)""")
def main_anti_filter(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(n, "s_nationkey", "left_anti").select("s_suppkey", "s_name")


@query("""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING NOT bool_and(l_returnflag = 'N')""")
def cache_only_filter(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "N").alias("x")).where("not x").select("l_orderkey")


@query("""SELECT p_partkey, p_size FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48 AND l_discount > 0.08) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_size AND s_suppkey % 2 = 0)""")
def claim_anti_join(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 48 and l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    b = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("int").alias("p_size"))
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return filters.unclaimed(filters.unclaimed(p, a, ["p_partkey"]), b, ["p_size"]).select("p_partkey", "p_size")


@query("""SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN source = 'src0' THEN 'claimed' WHEN contains(text, '@') THEN 'mail' ELSE 'keep' END AS disposition, count(*) AS n FROM documents GROUP BY 1""")
def disposition_cascade(spark, d):
    rules = [("short", F.col("n_chars") < 100), ("foreign", F.col("lang") != "en"), ("claimed", F.col("source") == "src0"), ("mail", F.contains("text", F.lit("@")))]
    return table(spark, d, "documents").groupBy(filters.disposition(rules).alias("disposition")).agg(F.count("*").alias("n"))


@query("""
WITH i AS (SELECT lower(c_mktsegment) AS nm, arg_max(c_custkey, c_custkey) AS dst FROM customer GROUP BY 1)
SELECT DISTINCT c_custkey AS src, dst FROM customer JOIN i ON lower(c_mktsegment) = nm WHERE c_custkey <> dst""")
def dep_edge_join(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.lit("x").alias("ecosystem"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("purl"), F.col("c_custkey").alias("ord"))
    return graph.dependency_edges(rows, c.select(F.lit("x").alias("ecosystem"), F.col("c_custkey").alias("src"), F.col("c_mktsegment").alias("name")))


@query("""SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) OR o_orderkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def guard_rail_edges(spark, d):
    known = table(spark, d, "customer").where("c_acctbal > 5000")
    return graph.guard_rail(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), known, "c_custkey")


@query("""SELECT o_orderkey, coalesce(deps, '') AS deps FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '|' ORDER BY CAST(l_suppkey AS VARCHAR)) AS deps FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_orderkey = o_orderkey""")
def dependency_map(spark, d):
    edges = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").cast("string").alias("dst"))
    return graph.dependency_map(table(spark, d, "orders"), edges, "o_orderkey").select("o_orderkey", F.array_join("depends_on", "|").alias("deps"))


@query("""SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_partkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def graph_roots(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.roots(e.select(F.col("src").alias("node")), e, "node")


@query("""SELECT user_id, bool_or(event_type = 'purchase') AS complete, count(*) AS n FROM events GROUP BY user_id""")
def compositions_complete(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("complete"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, bool_or(l_shipdate >= TIMESTAMP '1998-06-01') AS late, bool_or(l_discount = 0) AS full_price FROM lineitem GROUP BY 1""")
def completeness_flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.bool_or(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).alias("late"), F.bool_or(F.col("l_discount") == 0).alias("full_price"))


@query("""SELECT count(*) AS total, count(DISTINCT user_id) AS unique_hosts, CAST(sum(event_id) AS BIGINT) AS total_bytes, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type || '=' || n) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS protocol_counts FROM events""")
def network_summary(spark, d):
    return summaries.network_summary(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def protocol_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT l_suppkey, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS paths FROM lineitem GROUP BY 1""")
def linkage_aggregate(spark, d):
    return summaries.collapsed(table(spark, d, "lineitem"), F.col("l_suppkey"), "l_suppkey", "l_returnflag")


@query("""SELECT regexp_extract(p_brand, '#([0-9])', 1) AS version, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS paths FROM part GROUP BY 1""")
def version_collapse(spark, d):
    return summaries.collapsed(table(spark, d, "part"), F.regexp_extract("p_brand", "#([0-9])", 1), "version", "p_type")


@query("""SELECT source, sha256(string_agg(sha256(text) || '  ' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || chr(10), '' ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS merkle_root FROM documents GROUP BY source""")
def merkle_root(spark, d):
    rows = table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("location"), F.sha2("text", 256).alias("digest"))
    return summaries.merkle_root(rows, ["source"], "location", "digest")


@query("""SELECT p_brand, sha256('part' || chr(10) || string_agg(DISTINCT p_name || chr(10), '' ORDER BY p_name || chr(10))) AS fingerprint FROM part GROUP BY 1""")
def doc_fingerprint(spark, d):
    return summaries.fingerprint(table(spark, d, "part"), ["p_brand"], "p_name", "part")


@query("""
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM s WHERE session > 0 GROUP BY 1, 2""")
def conn_assembly_batch(spark, d):
    s = graph.sessions(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", 1).otherwise(0))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'read' ELSE event_type END AS op FROM events WHERE event_type <> 'error'""")
def open_close_map(spark, d):
    return table(spark, d, "events").where("event_type <> 'error'").select("event_id", F.when(F.col("event_type") == "view", "read").otherwise(F.col("event_type")).alias("op"))


@query("""
WITH f AS (SELECT split_part(rtrim(url, '/'), '/', -1) AS base, arg_max(md5(url), page_id) AS hash, arg_min(url, page_id) AS file_path FROM pages GROUP BY 1)
SELECT event_id, hash, file_path FROM events LEFT JOIN f ON base = CAST(user_id AS VARCHAR) AND base <> ''""")
def basename_join(spark, d):
    """Events as connections to /pool/<user>, met with pages as files of the same basename."""
    files = table(spark, d, "pages").select(F.col("url").alias("path"), F.md5("url").alias("hash"), F.col("page_id").alias("ord"))
    connections = table(spark, d, "events").select("event_id", F.concat(F.lit("/pool/"), F.col("user_id").cast("string")).alias("path"))
    return merge.with_file(connections, files).select("event_id", "hash", "file_path")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def url_host_path(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))


@query("""SELECT doc_id, coalesce(nullif(regexp_extract(text, 'icensed under (?:the |an? )?([A-Za-z0-9 ]+)', 1), ''), nullif(regexp_extract(text, 'eleased under (?:the |an? )?([A-Za-z0-9 ]+)', 1), '')) AS phrase FROM documents WHERE regexp_matches(text, '(icensed|eleased) under')""")
def license_extract(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("(icensed|eleased) under")).select("doc_id", text.license_phrase(F.col("text")).alias("phrase"))


@query("""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT doc_id, t, strpos(t, 'general public license') AS place FROM t)
SELECT doc_id, 'GPL' || CASE WHEN contains(substring(t, place, 182), 'later version') THEN '-or-later' ELSE '-only' END AS license FROM p WHERE place > 0""")
def fsf_prose(spark, d):
    return table(spark, d, "documents").select("doc_id", text.or_later(F.col("text"), "general public license", "GPL").alias("license")).where("license is not null")


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9a-f]{40}'))), '|') AS tokens FROM documents WHERE regexp_matches(text, '[0-9a-f]{40}')""")
def hex_token_scan(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("[0-9a-f]{40}")).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9a-f]{40})"), 1))), "|").alias("tokens"))


@query(r"""SELECT p_partkey, 'cpe:2.3:a:' || regexp_replace(lower(p_brand), '([^A-Za-z0-9._-])', '\\\1', 'g') || ':' || regexp_replace(p_name, '([^A-Za-z0-9._-])', '\\\1', 'g') || ':' || p_size || ':*:*:*:*:*:*:*' AS cpe FROM part""")
def cpe_synthesize(spark, d):
    return table(spark, d, "part").select("p_partkey", keys.cpe(F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string")).alias("cpe"))


@query("""SELECT p_partkey, 'pkg:generic/' || replace(p_brand, '+', '%2B') || '/' || replace(p_name, '+', '%2B') || '@' || p_size AS purl, p_brand AS namespace, CAST(p_size AS VARCHAR) AS version FROM part""")
def purl_build_parse(spark, d):
    rows = table(spark, d, "part").select("p_partkey", keys.purl(F.lit("generic"), F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string")).alias("purl"))
    parts = rows.withColumn("x", keys.purl_parts(F.col("purl")))
    return parts.select("p_partkey", "purl", F.col("x.namespace").alias("namespace"), F.col("x.version").alias("version"))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS maintainer FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey""")
def supplier_backfill(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), "c_name")
    return table(spark, d, "supplier").join(c, "s_suppkey", "left").select("s_suppkey", F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_name")), "c_name").alias("maintainer"))


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL OR 'q' || quality = lang THEN lang ELSE lang || '|q' || quality END AS tags FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def license_join_append(spark, d):
    more = F.when(F.col("quality").isNotNull(), F.array(F.concat(F.lit("q"), F.col("quality").cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.array_join(F.array_union(F.array("lang"), more), "|").alias("tags"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations""")
def line_forward_fill(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("asked_at"), F.lead("role").over(by).alias("next_role"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
c(node) AS (SELECT CAST(7 AS BIGINT) UNION SELECT dst FROM c JOIN e ON src = node)
SELECT node FROM c""")
def closure_bfs(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return graph.closure(edges, spark.range(7, 8).select(F.col("id").alias("node"))).select("node")


@query("""SELECT c_custkey AS child, 'label' AS key, CASE WHEN c_acctbal > 0 THEN c_mktsegment WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS value FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def effective_config(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    tree = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    own = lambda kind, x: F.concat(F.lit(kind), F.col(x).cast("string"))
    up = [tree.select(F.col("c_custkey").alias("child"), own(k, x).alias("ancestor"), F.lit(i).alias("distance")) for i, (k, x) in enumerate((("c", "c_custkey"), ("n", "n_nationkey"), ("r", "n_regionkey")))]
    values = c.where("c_acctbal > 0").select(own("c", "c_custkey").alias("ancestor"), F.col("c_mktsegment").alias("value"))
    values = values.unionByName(n.where("n_nationkey % 2 = 0").select(own("n", "n_nationkey").alias("ancestor"), F.col("n_name").alias("value"))).unionByName(r.select(own("r", "r_regionkey").alias("ancestor"), F.col("r_name").alias("value")))
    return graph.inherited(values.withColumn("key", F.lit("label")), up[0].unionByName(up[1]).unionByName(up[2]))


@query("""
WITH e AS (SELECT 'd' || (o_custkey % 50) || '/' || o_custkey AS path, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS layer, o_orderstatus AS s, o_custkey FROM orders),
f AS (SELECT path, max(layer) AS layer FROM e WHERE s <> 'P' GROUP BY path),
w AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN 'd' || (o_custkey % 50) ELSE path END AS above, max(layer) AS upto FROM e WHERE s = 'P' GROUP BY 1)
SELECT path, layer FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE upto > layer AND (above = path OR above = split_part(path, '/', 1)))""")
def layer_overlay(spark, d):
    o = table(spark, d, "orders")
    folder = F.concat(F.lit("d"), (F.col("o_custkey") % 50).cast("string"))
    path = F.concat(folder, F.lit("/"), F.col("o_custkey").cast("string"))
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    gone = F.col("o_orderstatus") == "P"
    e = o.select(F.when(gone & (F.col("o_custkey") % 10 == 0), folder).otherwise(path).alias("path"), days.alias("layer"), F.when(gone, "whiteout").otherwise("file").alias("kind"))
    return graph.layer_overlay(e).select("path", "layer")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_prop_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""
WITH a AS (SELECT DISTINCT o_orderkey AS v FROM orders), b AS (SELECT DISTINCT l_orderkey AS v FROM lineitem)
SELECT count(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NOT NULL) AS in_both, count(*) FILTER (WHERE b.v IS NULL) AS only_first, count(*) FILTER (WHERE a.v IS NULL) AS only_second FROM a FULL JOIN b ON a.v = b.v""")
def parity_set_compare(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("v"), F.lit(1).alias("s"))
    both = a.unionByName(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("v"), F.lit(2).alias("s"))).groupBy("v").agg(F.bool_or(F.col("s") == 1).alias("a"), F.bool_or(F.col("s") == 2).alias("b"))
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(~F.col("b")).alias("only_first"), F.count_if(~F.col("a")).alias("only_second"))


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS advisory, string_agg(DISTINCT CAST(user_id AS VARCHAR), '|' ORDER BY CAST(user_id AS VARCHAR)) AS products, 'under_investigation' AS status FROM events WHERE event_type = 'error' GROUP BY 1""")
def openvex_group(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("advisory"))
    return e.agg(F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), "|").alias("products")).withColumn("status", F.lit("under_investigation"))


@query("""SELECT o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey), '') AS children, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_containment(spark, d):
    kids = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("k"))
    text_ = F.array_join(F.transform("k", lambda x: x["l_partkey"].cast("string")), "|")
    return table(spark, d, "orders").select("o_orderkey").join(kids, "o_orderkey", "left").select("o_orderkey", F.coalesce(text_, F.lit("")).alias("children"), F.coalesce(F.size("k"), F.lit(0)).cast("bigint").alias("n"))


@query("""SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 9000) AS allowed FROM nation""")
def policy_key_match(spark, d):
    have = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_mktsegment").alias("ids"))
    return table(spark, d, "nation").join(have, "n_nationkey", "left").select("n_nationkey", F.coalesce(F.arrays_overlap("ids", F.array(F.lit("BUILDING"), F.lit("MACHINERY"))), F.lit(False)).alias("allowed"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'envelope' WHEN n_chars <> length(text) THEN 'digest' WHEN lang NOT IN ('en', 'de') THEN 'identity' WHEN source = 'src0' THEN 'layout' ELSE 'ok' END AS verdict FROM documents""")
def first_failure_wins(spark, d):
    rules = [("envelope", F.col("text").isNull() | (F.col("text") == "")), ("digest", F.col("n_chars") != F.char_length("text")), ("identity", ~F.col("lang").isin("en", "de")), ("layout", F.col("source") == "src0")]
    return table(spark, d, "documents").select("doc_id", filters.disposition(rules, "ok").alias("verdict"))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
