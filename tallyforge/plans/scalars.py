"""Queries of the scalar functions: inputs are written from the bundled tables, the SQL states what must come back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import keys, licenses, wire
from ..operators.lineage import spread
from .inventory import query, table

#: name, brand number and version of each part; k deals parts over the cases.
P = """WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') AS nm, regexp_extract(p_brand, '[0-9]+') AS b, p_size || '.' || (p_partkey % 7) || '.' || (p_partkey % 3) AS v, p_type AS t FROM part)"""


def parts(spark, d):
    k = F.col("p_partkey")
    dot = F.lit(".")
    v = F.concat(F.col("p_size").cast("string"), dot, (k % 7).cast("string"), dot, (k % 3).cast("string"))
    rows = table(spark, d, "part").select(k.alias("k"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("nm"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("b"), v.alias("v"), F.col("p_type").alias("t"))
    return spread(rows, "k")


def cat(*xs) -> Column:
    """Concatenation of columns named by k, nm, b, v, t and of other texts."""
    return F.concat(*(F.col(x) if x in ("k", "nm", "b", "v", "t") else F.lit(x) for x in xs))


def case(*options, by="k") -> Column:
    """The option that a part's number deals it."""
    out = options[-1]
    for i, x in reversed(list(enumerate(options[:-1]))):
        out = F.when(F.col(by) % len(options) == i, x).otherwise(out)
    return out


def sql_case(*options: str, by="k") -> str:
    return f"CASE {by} % {len(options)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + " END"


_URL = sql_case(
    "'pkg:cargo/' || nm || '@' || v", "'pkg:cargo/' || nm || '@' || v", "'pkg:pypi/' || replace(nm, '-', '_') || '@' || v", "'pkg:npm/%40s' || b || '/' || nm || '@' || v", "'pkg:golang/github.com/o' || b || '/' || nm || '@v' || v",
    "'pkg:maven/org.o' || b || '/' || nm || '@' || v", "'pkg:gem/' || nm || '@' || v", "'pkg:deb/debian/' || nm || '@' || v || '?arch=amd64'", "'pkg:deb/ubuntu/' || nm || '@1:' || v || '%2Bb' || b || '?arch=arm64&distro=jammy'", "NULL",
)


@query(f"{P} SELECT k, {_URL} AS purl FROM p")
def url_resolvers(spark, d):
    hosts = ("crates.io", "static.crates.io", "files.pythonhosted.org", "registry.npmjs.org", "proxy.golang.org", "repo1.maven.org", "rubygems.org", "deb.debian.org", "security.ubuntu.com", "example.org")
    paths = (
        cat("/api/v1/crates/", "nm", "/", "v", "/download"), cat("/crates/", "nm", "/", "nm", "-", "v", ".crate"), cat("/packages/ab/cd/ef/", "nm", "-", "v", ".tar.gz"), cat("/@s", "b", "/", "nm", "/-/", "nm", "-", "v", ".tgz"),
        cat("/github.com/o", "b", "/", "nm", "/@v/v", "v", ".zip"), cat("/maven2/org/o", "b", "/", "nm", "/", "v", "/", "nm", "-", "v", ".jar"), cat("/gems/", "nm", "-", "v", ".gem"),
        cat("/debian/pool/main/x/", "nm", "/", "nm", "_", "v", "_amd64.deb"), cat("/ubuntu/dists/jammy/pool/main/x/", "nm", "/", "nm", "_1:", "v", "+b", "b", "_arm64.udeb"), cat("/gems/", "nm", "-", "v", ".gem"),
    )
    return parts(spark, d).select("k", keys.resolved_url(case(*map(F.lit, hosts)), case(*paths)).alias("purl"))


_PATH = sql_case(
    "'pkg:cargo/' || nm || '@' || v", "'pkg:pypi/w' || b || '@' || v", "'pkg:pypi/w-' || b || '@' || v", "'pkg:npm/' || nm || '@' || v", "'pkg:npm/%40s' || b || '/' || nm || '@' || v",
    "'pkg:golang/m.io/o' || b || '/' || nm || '@v' || v", "'pkg:golang/m.io/o' || b || '/' || nm || '@v' || v", "'pkg:deb/debian/' || nm || '@2:' || v || '?arch=all'", "NULL",
)


@query(f"{P} SELECT k, {_PATH} AS purl FROM p")
def path_resolvers(spark, d):
    paths = (
        cat("/root/.cargo/registry/cache/idx/", "nm", "-", "v", ".crate"), cat("/tmp/w", "b", "-", "v", "-1-py3-none-any.whl"), cat("/usr/lib/python3/site-packages/W_", "b", "-", "v", ".dist-info/METADATA"), cat("/tmp/", "nm", "-", "v", ".tgz"),
        cat("/p/node_modules/.pnpm/@s", "b", "+", "nm", "@", "v", "/node_modules/x.js"), cat("/root/go/pkg/mod/cache/download/m.io/o", "b", "/", "nm", "/@v/v", "v", ".zip"), cat("/root/go/pkg/mod/m.io/o", "b", "/", "nm", "@v", "v", "/main.go"),
        cat("/var/cache/apt/archives/", "nm", "_2%3a", "v", "_all.deb"), cat("/etc/", "nm", "-", "v"),
    )
    return parts(spark, d).select("k", keys.path_key(case(*paths)).alias("purl"))


_HOSTS = list(keys.REGISTRY_HOSTS)


@query(f"SELECT s_suppkey, CASE WHEN s_suppkey % 16 < 2 THEN 'cargo' WHEN s_suppkey % 16 < 4 THEN 'pypi' WHEN s_suppkey % 16 = 4 THEN 'npm' WHEN s_suppkey % 16 < 7 THEN 'golang' WHEN s_suppkey % 16 < 10 THEN 'maven' WHEN s_suppkey % 16 = 10 THEN 'gem' WHEN s_suppkey % 16 < 15 THEN 'deb' END AS ecosystem FROM supplier")
def hostname_heuristic(spark, d):
    host = case(*(F.upper(F.lit(h)) for h in (*_HOSTS, "index.crates.io")), by="s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", keys.registry_of(host).alias("ecosystem"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'crates.io' WHEN 1 THEN 'static.crates.io' WHEN 2 THEN 'files.pythonhosted.org' END AS host FROM documents")
def registry_probe(spark, d):
    # index.crates.io is shadowed by the crates.io that stands before it in the list, as is pypi.org by a host listed earlier
    tail = case(F.lit(" index.crates.io"), F.lit(" x static.crates.io and crates.io"), F.lit("pypi.org files.pythonhosted.org"), F.lit(""), by="doc_id")
    return table(spark, d, "documents").select("doc_id", keys.probed_host(F.concat(F.coalesce("text", F.lit("")), tail)).alias("host"))


_PURL = sql_case(
    "'pkg:deb/debian/' || nm || '%2B%2B@' || v || '?arch=amd64&distro=debian-12'", "'pkg:apk/alpine/' || nm || '%2B%2B@' || v || '?arch=amd64&distro=alpine-12'", "'pkg:rpm/debian/' || nm || '%2B%2B@' || v || '?arch=amd64' || CASE WHEN b <> '0' THEN '&epoch=' || b ELSE '' END",
    "'pkg:npm/%40s' || b || '/' || nm || '%2B%2B@' || v", "'pkg:pypi/' || nm || '%2B%2B@' || v", "'pkg:maven/org.o' || b || '/' || nm || '%2B%2B@' || v", "'pkg:golang/' || nm || '%2B%2B@' || v", "'pkg:gem/' || nm || '%2B%2B@' || v", "'pkg:cargo/' || nm || '%2B%2B@' || v", "NULL",
)


@query(f"{P} SELECT k, {_PURL} AS purl FROM p")
def purl_per_ecosystem(spark, d):
    kind = case(*map(F.lit, ("deb", "apk", "rpm", "npm", "pypi", "maven", "golang", "gem", "cargo", "swift")))
    name = F.when(kind == "npm", cat("@s", "b", "/", "nm", "++")).when(kind == "pypi", F.upper(F.replace(cat("nm", "++"), F.lit("-"), F.lit("_")))).otherwise(cat("nm", "++"))
    return parts(spark, d).select("k", keys.package_purl(kind, name, F.col("v"), arch=F.lit("amd64"), distro=F.lit("12"), vendor=F.lit("debian"), group=cat("org.o", "b"), epoch=F.col("b")).alias("purl"))


@query(f"{P} SELECT k, {sql_case("'github.com/o' || b", "'org.o' || b", "'@s' || b", 'NULL', "'vanity.io'")} AS supplier, CASE k % 5 WHEN 0 THEN 'https://github.com/o' || b || '/' || nm END AS vcs FROM p")
def purl_suppliers(spark, d):
    kind = case(*map(F.lit, ("golang", "maven", "npm", "gem", "golang")))
    space = case(cat("github.com/o", "b", "/deep"), cat("org.o", "b"), cat("@s", "b"), cat("x", "b"), F.lit("vanity.io"))
    return parts(spark, d).select("k", keys.purl_supplier(kind, space).alias("supplier"), keys.purl_vcs(kind, space, F.col("nm")).alias("vcs"))


_CPE = lambda vendor: f"'cpe:2.3:a:' || {vendor} || ':' || nm || '\\+\\+:' || v || ':*:*:*:*:*:*:*'"
_CPES = sql_case(
    *(" || '|' || ".join(map(_CPE, vendors)) for vendors in (
        ("'debian'", "nm || '\\+\\+'"), ("'alpinelinux'", "nm || '\\+\\+'"), ("'org.o' || b", "nm || '\\+\\+'"), ("nm || '\\+\\+'",), ("nm || '\\+\\+'", "'org.o' || b"), ("nm || '\\+\\+'", "'python-' || nm || '\\+\\+'"), ("nm || '\\+\\+'", "'org.o' || b"),
        ("'org.o' || b", "'o' || b", "nm || '\\+\\+'"),
    )), "''",
)


@query(f"{P} SELECT k, {_CPES} AS cpes FROM p")
def cpe_candidates(spark, d):
    kind = case(*map(F.lit, ("deb", "apk", "rpm", "gem", "npm", "pypi", "golang", "maven", "swift")))
    space = F.when(kind == "npm", cat("@Org.o", "b")).otherwise(cat("Org.o", "b"))
    return parts(spark, d).select("k", F.array_join(keys.cpes(kind, space, cat("nm", "++"), F.col("v")), "|").alias("cpes"))


@query("SELECT p_partkey, replace(replace(lower(p_brand), '#', '_'), ' ', '_') || '_' || replace(p_name, ' ', '_') AS name FROM part")
def cpe_sanitize(spark, d):
    return table(spark, d, "part").select("p_partkey", keys.cpe_sanitized(F.concat_ws(" ", "p_brand", "p_name")).alias("name"))


@query("SELECT p_partkey, 'github.com/!brand' || replace(p_brand, 'Brand', '') || '/' || p_name AS path FROM part")
def module_escape(spark, d):
    return table(spark, d, "part").select("p_partkey", keys.module_escaped(F.concat(F.lit("github.com/"), "p_brand", F.lit("/"), "p_name")).alias("path"))


def _base32_sql(x: str, length: int = 16) -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    pair = lambda i: f"((strpos('0123456789abcdef', substr(sha256({x}), {5 * i // 4 + 1}, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(sha256({x}), {5 * i // 4 + 2}, 1)) - 1)"
    return " || ".join(f"substr('{alphabet}', CAST(({pair(i)} >> {3 - 5 * i % 4}) & 31 AS INTEGER) + 1, 1)" for i in range(length))


@query(f"SELECT p_partkey, 'SPDXRef-' || {_base32_sql('p_name')} AS id FROM part")
def hash_prefix_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("SPDXRef-"), keys.base32_id(F.col("p_name"))).alias("id"))


# ---- licences


@query(f"{P} SELECT k, {sql_case("'GPL-2.0-or-later AND LGPL-2.1-or-later'", "'MIT OR Apache-2.0'", "'GPL-3.0-only WITH own-' || b", "nm || ' AND ISC'", "'AGPL-3.0-or-later'")} AS license FROM p")
def shorthand_map(spark, d):
    raw = case(F.lit(" GPL-2+  and LGPL-2.1+ "), F.lit("Expat or apache-2"), cat("GPLv3 with own-", "b"), cat("nm", "\tAnd isc"), F.lit("agpl-3+"))
    return parts(spark, d).select("k", licenses.normal_license(raw).alias("license"))


_DEP5 = "Format: https://www.debian.org/doc/packaging-manuals/copyright-format/1.0/\nUpstream-Name: x\nLicense: WTFPL\n\n"


@query(f"{P} SELECT k, {sql_case("'GPL-2.0-or-later|MIT'", "'Zlib|own-' || b", "'Apache-2.0'", "'BSD-3-Clause|WTFPL'")} AS licenses FROM p")
def copyright_dep5(spark, d):
    body = case(
        F.lit("Files: *\nCopyright: me\nLicense: GPL-2+\n text\n\nFiles: a\nLicense: Expat\n\nFiles: b\nLicense: Expat\n"), cat("Files: *\nLicense: zlib\n\nLicense: own-", "b", "\n long text\n"),
        F.lit("Files: *\nLicense: GPL-2\n  SPDX-License-Identifier: Apache-2.0\n"), F.lit("Comment: nothing here\n\nbut /usr/share/common-licenses/BSD.\n"),
    )
    return parts(spark, d).select("k", F.array_join(licenses.copyright_licenses(F.concat(F.lit(_DEP5), body)), "|").alias("licenses"))


@query(f"{P} SELECT k, {sql_case("'LGPL-2.1-only|GPL-2.0-or-later'", "'GPL-3.0-only'", "'Own' || b", "'the-' || nm", "'Artistic-1.0-Perl|GPL-1.0-only'", "'MPL-2.0'", "''")} AS licenses FROM p")
def copyright_freeform(spark, d):
    body = case(
        F.lit("see '/usr/share/common-licenses/LGPL-2.1'.\nThe GNU General Public License as published by the\n  Free Software Foundation; either version 2 of the License, or (at your option) any later\nversion."),
        F.lit("GNU General Public License as published by the Free Software Foundation, version 3. No more is said, but a version that comes much later than this one stands where nobody would look for it when reading with a short breath, which is some way on from here: later version"),
        cat("It is Licensed under the Own", "b", " license, really"), cat("released under the-", "nm", "..."), F.lit("(/usr/share/common-licenses/Artistic), /usr/share/common-licenses/GPL-1, /usr/share/common-licenses/unknown"),
        F.lit("License: mpl-2"), F.lit("nothing at all"),
    )
    return parts(spark, d).select("k", F.array_join(licenses.copyright_licenses(F.concat(F.lit("Preamble.\n"), body)), "|").alias("licenses"))


@query(f"{P} SELECT k, {sql_case("'MIT'", "'GPL-2.0-or-later'", "'Zlib'", 'NULL')} AS license FROM p")
def classifier_spdx(spark, d):
    names = ("License :: OSI Approved :: MIT License", "License :: OSI Approved :: GNU General Public License v2 or later (GPLv2+)", "License::zlib/libpng License ", "License :: Other")
    return parts(spark, d).select("k", licenses.classifier_license(case(*map(F.lit, names))).alias("license"))


@query(f"{P} SELECT k, {sql_case("'MIT OR ISC'", "'Apache-2.0'", "'BSD-3-Clause'", 'NULL')} AS license FROM p")
def pip_license_precedence(spark, d):
    expression = case(F.lit(" MIT  OR ISC"), F.lit("not one"), cat("nm"), F.lit(None).cast("string"))
    raw = case(F.lit("Zlib"), F.lit("Apache-2.0"), F.lit("see file"), F.lit("see file"))
    classes = F.array(F.lit("Topic :: x"), case(F.lit("License :: OSI Approved :: MIT License"), F.lit("License :: OSI Approved :: MIT License"), F.lit("License :: OSI Approved :: BSD License"), F.lit("License :: Other")))
    return parts(spark, d).select("k", licenses.pip_license(expression, raw, classes).alias("license"))


@query(f"{P} SELECT k, {sql_case("'MIT|Apache-2.0|x' || b", "'A|B'", 'NULL', 'NULL', 'NULL', 'NULL')} AS parts FROM p")
def license_split(spark, d):
    x = case(cat("MIT OR Apache-2.0 OR x", "b"), F.lit(" A AND B "), F.lit("A AND B OR C"), F.lit("(A OR B)"), F.lit("A WITH x OR B"), F.lit("A"))
    return parts(spark, d).select("k", F.array_join(licenses.split_list(x), "|").alias("parts"))


@query(f"{P} SELECT k, {sql_case("'id:MIT|name:LicenseRef-' || b || '|id:ISC|id:Zlib'", "'expression:GPL-2.0-only WITH x'", "'id:' || nm", "''")} AS entries FROM p")
def license_entries(spark, d):
    x = case(F.array(F.lit("MIT"), cat("LicenseRef-", "b"), F.lit("ISC OR MIT"), F.lit("Zlib AND ISC")), F.array(F.lit("MIT"), F.lit("(A OR B)"), F.lit("GPL-2.0-only WITH x"), F.lit("ISC")), F.array(cat("nm")), F.array().cast("array<string>"))
    return parts(spark, d).select("k", F.array_join(F.transform(licenses.stated(x), lambda e: F.concat_ws(":", e["kind"], e["value"])), "|").alias("entries"))


@query(f"{P} SELECT k, {sql_case("'NOASSERTION'", "'MIT AND ISC'", f"'LicenseRef-' || {_base32_sql("'MIT AND own ' || b")}")} AS license FROM p")
def license_reduction(spark, d):
    x = case(F.array().cast("array<string>"), F.array(F.lit("MIT"), F.lit("ISC")), F.array(F.lit("MIT"), cat("own ", "b")))
    return parts(spark, d).select("k", licenses.reduced(x).alias("license"))


# ---- payloads, paths, envelopes


@query(f"{P} SELECT k, {sql_case("'GET'", "'POST'", 'NULL', 'NULL')} AS method, {sql_case("'/' || nm", "'/x'", 'NULL', 'NULL')} AS path, {sql_case("'h' || b || '.io'", 'NULL', 'NULL', 'NULL')} AS host FROM p")
def http_requests(spark, d):
    text = case(cat("GET /", "nm", " HTTP/1.1\r\nAccept: x\r\nhOsT:  h", "b", ".io \r\n\r\nHost: no"), cat("POST /x HTTP/1.0\r\n\r\nHost: ", "b"), cat("FETCH /", "nm", " HTTP/1.1\r\n"), cat("GET /", "nm", " FTP/1\r\n"))
    r = wire.http_request(text)
    return parts(spark, d).select("k", r["method"].alias("method"), r["path"].alias("path"), r["host"].alias("host"))


@query(f"{P} SELECT k, {sql_case('200 + k % 300', '404', 'NULL', 'NULL')} AS status, {sql_case('k', 'NULL', 'NULL', 'NULL')} AS length FROM p")
def http_responses(spark, d):
    status = (200 + F.col("k") % 300).cast("string")
    text = case(F.concat(F.lit("HTTP/1.1 "), status, F.lit(" OK\r\ncontent-length: "), F.col("k").cast("string"), F.lit("\r\n\r\n")), F.lit("HTTP/2 404\r\nContent-Length: x\r\n"), F.lit("HTTP/1.1 600 no\r\n"), F.lit("SSH-2.0 200"))
    r = wire.http_response(text)
    return parts(spark, d).select("k", r["status"].cast("bigint").alias("status"), r["length"].alias("length"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def header_extract(spark, d):
    text = F.concat(F.lit("POST / HTTP/1.1\r\nx-KIND:  "), "event_type", F.lit(" \r\nX-Who:"), F.col("user_id").cast("string"), F.lit("\r\n\r\nX-Who: no\r\n"))
    return table(spark, d, "events").select("event_id", wire.header_value(text, "X-Kind").alias("kind"), wire.header_value(text, "x-who").alias("who"))


@query("SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(event_id * 1234) AS at FROM events")
def monotonic_wall_time(spark, d):
    offset = F.lit(1704067200).cast("bigint") * 1_000_000_000 - 777
    return table(spark, d, "events").select("event_id", wire.wall_time(F.col("event_id") * 1_234_000 + 777 + 5, offset).cast("timestamp_ntz").alias("at"))


@query(f"{P} SELECT k, {sql_case("'application/gzip'", "'application/gzip'", "'application/zip'", "'application/octet-stream'", "'application/x-sharedlib'", "'application/x-executable'")} AS mime FROM p")
def mime_guess(spark, d):
    ends = (".tar.gz", ".WHL", ".jar", ".deb", ".DLL", ".bin")
    return parts(spark, d).select("k", wire.mime_type(F.concat(cat("/x/", "nm"), case(*map(F.lit, ends)))).alias("mime"))


@query(f"{P} SELECT k, {sql_case('k', '7 * k', '30 * k', '30 * k', '365 * k', 'NULL', 'NULL')} AS days FROM p")
def expiry_days(spark, d):
    units = ("d", "w", "m", "months", "yr", "h", "")
    return parts(spark, d).select("k", wire.expiry_days(F.concat(F.lit(" "), F.col("k").cast("string"), case(*map(F.lit, units)))).alias("days"))


@query(f"{P} SELECT k, {sql_case("'3.' || b", "'3.' || b", "'3.' || b", "'3.' || b", 'NULL', 'NULL')} AS python, {sql_case("b", "b", "b", "b", "b", 'NULL', "'21'")} AS jdk FROM p")
def runtime_versions(spark, d):
    python = case(cat("usr/lib/python3.", "b", "/lib-dynload/_x.so"), cat("usr/lib/libpython3.", "b", "m.so.1.0"), cat("usr/bin/python3.", "b"), cat("src/Python-3.", "b", ".2/Modules/a.o"), cat("usr/lib/python3.", "b", "/site-packages/x.so"), cat("usr/bin/python3.", "b", "-config"))
    jdk = case(cat("usr/lib/jvm/java-", "b", "-openjdk-amd64/lib/x.so"), cat("usr/lib/jvm/jre-", "b", "/x"), cat("opt/java/", "b", "/lib/x.so"), cat("opt/jdk-", "b", ".0.1/x"), cat("opt/temurin/", "b", "/x"), cat("opt/java/", "b", ".1/x"), F.lit("opt/java/openjdk/lib/x.so"))
    return parts(spark, d).select("k", wire.python_version(python).alias("python"), wire.jdk_version(jdk, F.lit('X="1"\nJAVA_VERSION="21.0.3"\n')).alias("jdk"))


@query(f"{P} SELECT k, 'openssl=3.' || b || '.1a|curl=' || v || CASE WHEN k % 2 = 0 THEN '|pcre2=10.' || b ELSE '' END AS found FROM p")
def version_string_scan(spark, d):
    text = F.concat(cat("OpenSSL 3.", "b", ".1a \0not OpenSSL 1.1.1\0libcurl/", "v", "\0libcurl/", "v", "\0zlib deflate 1.2.3\0"), F.when(F.col("k") % 2 == 0, cat("PCRE2 10.", "b", " 2024\0")).otherwise(""))
    return parts(spark, d).select("k", F.array_join(F.transform(wire.version_strings(text.cast("binary")), lambda x: F.concat_ws("=", x["library"], x["version"])), "|").alias("found"))


@query(f"{P} SELECT k, {sql_case('nm', 'nm', 'nm', 'NULL', 'NULL')} AS name FROM p")
def requirement_names(spark, d):
    x = case(cat("nm", "[a,b] (>= 2) ; python_version >= '3'"), cat(" ", "nm", "~=", "v"), cat("nm", "@ https://x/", "b"), cat("nm", " ; extra == 'dev'"), F.lit(" "))
    return parts(spark, d).select("k", wire.requirement_name(x).alias("name"))


@query("SELECT doc_id, sha256('DSSEv1 4 text ' || octet_length(encode(text)) || ' ' || text) AS digest FROM documents WHERE text IS NOT NULL")
def envelope_pae(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(wire.pae(F.lit("text"), F.col("text")), 256).alias("digest"))


@query("""SELECT event_id, '{"a":[1,{"x":"' || event_type || '","y":2}],"k":' || user_id || ',"z":null}' AS text FROM events""")
def json_canonical(spark, d):
    raw = F.concat(F.lit('{"z": null, "k": '), F.col("user_id").cast("string"), F.lit(', "a": [1, {"y": 2, "x": "'), "event_type", F.lit('"}]}'))
    return table(spark, d, "events").select("event_id", wire.canonical_json(raw).alias("text"))


def _hello(host: Column) -> Column:
    """The hex of a TLS ClientHello that asks for host."""

    name = F.hex(host.cast("binary"))
    two = lambda x: F.lpad(F.hex((F.length(x) / 2).cast("bigint")), 4, "0")
    entry = F.concat(F.lit("00"), two(name), name)
    body = F.concat(two(entry), entry)
    extension = F.concat(F.lit("000500050100000000" + "0000"), two(body), body)
    hello = F.concat(F.lit("0303" + "11" * 32 + "00" + "00021301" + "0100"), two(extension), extension)
    return F.concat(F.lit("160301"), two(F.concat(F.lit("01000000"), hello)), F.lit("0100"), two(hello), hello)


@query(f"{P} SELECT k, {sql_case("nm || '.h' || b || '.io'", "nm || '.h' || b || '.io'", 'NULL', 'NULL')} AS host FROM p")
def tls_server_names(spark, d):
    hello = F.unhex(_hello(cat("nm", ".h", "b", ".io")))
    payload = F.when(F.col("k") % 4 < 2, hello).when(F.col("k") % 4 == 2, F.substring(hello, 1, 60)).otherwise(cat("nm").cast("binary"))
    return parts(spark, d).select("k", wire.server_name(payload).alias("host"))


@query(f"{P} SELECT k, {sql_case("'elf'", "'macho'", "'pe'", 'NULL')} AS magic, CASE WHEN k % 5 = 0 THEN 'upx' END AS packer FROM p")
def magic_and_packer(spark, d):
    from ..functions import text

    content = F.concat(F.unhex(case(*map(F.lit, ("7F454C46", "CFFAEDFE", "4D5A9000", "00000000")))), F.when(F.col("k") % 5 == 0, cat("nm", "UPX!")).otherwise(cat("nm")).cast("binary"))
    return parts(spark, d).select("k", text.magic(content).alias("magic"), text.packer(content).alias("packer"))


@query(f"{P} SELECT k, {sql_case('TRUE', 'FALSE', 'FALSE')} AS resolved, {sql_case("'a=1&arch=x&z=' || b", "'b=1'", "''")} AS qualifiers FROM p")
def cpe_and_qualifiers(spark, d):
    from ..operators.filters import fully_resolved_cpe

    cpe = case(cat("cpe:2.3:a:x:", "nm", ":", "v", ":*:*:*:*:*:*:*"), cat("cpe:2.3:a:x:", "nm", ":*:*:*:*:*:*:*:*"), cat("cpe:2.3:a::", "nm", ":1:*:*:*:*:*:*:*"))
    return parts(spark, d).select("k", fully_resolved_cpe(cpe).alias("resolved"), keys.sorted_qualifiers(case(cat("z=", "b", "&arch=x&a=1"), F.lit("b=1"), F.lit(""))).alias("qualifiers"))


@query(f"""{P} SELECT k, {sql_case("'((MIT AND ISC) OR (Zlib AND (X11)))'", "'GPL-2.0-only WITH Classpath-exception-2.0 AND MIT'", "repeat('(', k % 9) || 'MIT+ OR LicenseRef-' || b || repeat(')', k % 9)", 'NULL', 'NULL', 'NULL', 'NULL', 'NULL')} AS expression FROM p""")
def license_expressions(spark, d):
    deep = F.concat(F.repeat(F.lit("( "), F.col("k").cast("int") % 9), cat("MIT+   OR LicenseRef-", "b"), F.repeat(F.lit(")"), F.col("k").cast("int") % 9))
    some = ("(( MIT  AND ISC )OR(Zlib AND (X11) ))", "GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", None, "(MIT AND ISC", "MIT AND OR ISC", "(MIT) WITH Classpath-exception-2.0", "MIT WITH ISC", "MIT ISC")
    return parts(spark, d).select("k", licenses.canonical(case(*(deep if x is None else F.lit(x) for x in some))).alias("expression"))
