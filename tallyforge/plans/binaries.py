"""Queries of the byte formats: executables, headers, archives and images are built from parts and read back."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.lineage import checkpoints, measured
from ..sources import binary
from .inventory import query
from .scalars import P, case, cat, parts, sql_case


def _pad(x: bytes, to: int = 4) -> bytes:
    return x + b"\0" * (-len(x) % to)


def make_elf(name: str, digest: bytes) -> bytes:
    strings = b"\0lib" + name.encode() + b".so\0/opt/" + name.encode() + b":/x\0"
    run = strings.index(b"/opt")
    dynamic = struct.pack("<qQqQqQ", 1, 1, 29, run, 0, 0)
    note = struct.pack("<III", 4, len(digest), 3) + b"GNU\0" + _pad(digest) + struct.pack("<III", 4, 14, 0xCAFE1A7E) + b"FDO\0" + _pad(b'{"name":"pkg"}')
    link = _pad(name.encode() + b".debug\0") + struct.pack("<I", 0xABCD)
    names = b"\0.dynstr\0.dynamic\0.note.x\0.gnu_debuglink\0.shstrtab\0"
    bodies = [(b"", 0, 0), (strings, 3, 0), (dynamic, 6, 1), (note, 7, 0), (link, 1, 0), (names, 3, 0)]
    at, out, heads = 64, b"", b""
    for body, kind, ref in bodies:
        label = {3: b".dynstr", 6: b".dynamic", 7: b".note.x", 1: b".gnu_debuglink"}.get(kind, b"") if body is not names else b".shstrtab"
        heads += struct.pack("<IIQQQQIIQQ", names.index(label) if label else 0, kind, 0, 0, at + len(out), len(body), ref, 0, 1, 0)
        out += _pad(body, 8)
    return b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, at + len(out), 0, 64, 0, 0, 64, len(bodies), len(bodies) - 1) + out + heads


def make_macho(name: str, digest: bytes) -> bytes:
    def command(kind: int, body: bytes) -> bytes:
        body = _pad(body, 8)
        return struct.pack("<II", kind, 8 + len(body)) + body

    path = name.encode() + b".dylib\0"
    parts_ = [command(0x1B, digest[:16]), command(0xC, struct.pack("<IIII", 24, 0, 0, 0) + path), command(0x8000001C, struct.pack("<I", 12) + b"@loader/" + name.encode() + b"\0"), command(0x32, struct.pack("<IIII", 1, 13 << 16 | 1 << 8, 0, 0))]
    return struct.pack("<IIIIIIII", 0xFEEDFACF, 7, 3, 2, len(parts_), sum(map(len, parts_)), 0, 0) + b"".join(parts_)


def make_pe(name: str, digest: bytes) -> bytes:
    section = 0x400
    debug = struct.pack("<IIHHIIII", 0, 0, 0, 0, 2, 25 + len(name), 0, section + 28)
    rsds = b"RSDS" + digest[:16] + struct.pack("<I", 7) + name.encode() + b"\0"
    imports_at = 0x100
    dll = name.encode() + b".dll\0"
    table = struct.pack("<IIIII", 0, 0, 0, 0x1000 + imports_at + 40, 0) + b"\0" * 20
    body = _pad(debug + rsds, 1).ljust(imports_at, b"\0") + table + dll
    optional = bytearray(112 + 16 * 8)
    struct.pack_into("<H", optional, 0, 0x20B)
    struct.pack_into("<H", optional, 68, 3)
    struct.pack_into("<I", optional, 108, 16)
    struct.pack_into("<II", optional, 112 + 8, 0x1000 + imports_at, 40)
    struct.pack_into("<II", optional, 112 + 48, 0x1000, 28)
    coff = struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0)
    head = b"MZ".ljust(60, b"\0") + struct.pack("<I", 64) + b"PE\0\0" + coff + bytes(optional) + b".rdata\0\0" + struct.pack("<IIII", len(body), 0x1000, len(body), section) + b"\0" * 16
    return head.ljust(section, b"\0") + body


def make_header(fields: list[tuple[int, int, bytes, int]]) -> bytes:
    index, store = b"", b""
    for tag, kind, body, n in fields:
        store = _pad(store, 4) if kind == 4 else store
        index += struct.pack(">IIII", tag, kind, len(store), n)
        store += body
    return struct.pack(">II", len(fields), len(store)) + index + store


def make_rpm_header(name: str, version: str, k: int) -> bytes:
    t = lambda x: x.encode() + b"\0"
    fields = [(1000, 6, t(name), 1), (1001, 6, t(version), 1), (1002, 6, t("1.el9"), 1), (1011, 6, t("Rocky Enterprise"), 1), (1014, 9, t("MIT"), 1), (1022, 6, t("x86_64"), 1), (1049, 8, t("rpmlib(x)") + t(f"dep{k % 7}") + t("/bin/sh") + t("lib.so()(64bit)"), 4)]
    fields += [(1116, 4, struct.pack(">III", 0, 1, 9), 3), (1117, 8, t("a") + t("b") + t("lost"), 3), (1118, 8, t("/usr/bin/") + t(f"/opt/{name}/"), 2)]
    return make_header(fields if k % 2 else [*fields, (1003, 4, struct.pack(">I", k % 5), 1)])


def make_rpm_file(name: str, version: str, k: int) -> bytes:
    signature = b"\x8e\xad\xe8\x01" + b"\0" * 4 + make_header([(1000, 6, b"sig\0", 1)])
    return b"\xed\xab\xee\xdb".ljust(96, b"\0") + _pad(signature, 8) + b"\x8e\xad\xe8\x01" + b"\0" * 4 + make_rpm_header(name, version, k) + b"payload"


def make_go(name: str, version: str, k: int) -> bytes:
    def var(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    info = f"path\tm.io/{name}\nmod\tm.io/{name}\tv{version}\th1:x\ndep\tm.io/dep{k}\tv1.0.0\th1:y\n=>\tn.io/new{k}\tv2.0.0\th1:z\ndep\tm.io/other\tv3.0.0\nbuild\tvcs.revision=r{k}\nbuild\tvcs.modified=true\n".encode()
    body = b"m" * 16 + info + b"n" * 16
    head = b"\xff Go buildinf:" + bytes([8, 2 if k % 4 else 0]) + b"\0" * 16
    return b"\x7fELF" + b"\0" * (64 + k % 64) + head + var(6) + b"go1.22" + var(len(body)) + body


def make_jar(name: str, version: str, k: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for artifact, v in ((name, version), (f"shaded{k}", "9")):
            z.writestr(zipfile.ZipInfo(f"META-INF/maven/org.x/{artifact}/pom.properties"), f"#c\nversion={v}\ngroupId=org.x\nartifactId={artifact}\n")
        z.writestr(zipfile.ZipInfo("org/x/Main.class"), b"\xca\xfe")
    return out.getvalue()


def _tar_header(path: str, size: int | None) -> bytes:
    """Of a file of that size, or of a directory."""
    info = tarfile.TarInfo(path)
    info.type = tarfile.DIRTYPE if size is None else tarfile.REGTYPE
    info.size = size or 0
    return info.tobuf(tarfile.DEFAULT_FORMAT, tarfile.ENCODING, "surrogateescape")


#: Headers that all images have, made once.
_TAR_HEADERS = {x: _tar_header(*x) for x in (("etc", None), ("etc/keep", 1), ("etc/gone", 1), ("opt/old", 1), ("../evil", 1), ("etc/.wh.gone", 0), ("opt/.wh..wh..opq", 0), ("/abs", 1), ("a.tar", 10240), ("b.tar", 10240), ("manifest.json", 33))}


def make_image(name: str, k: int) -> bytes:
    def tar(entries: list[tuple[str, bytes | None]]) -> bytes:
        head = lambda *x: _TAR_HEADERS.get(x) or _tar_header(*x)
        blocks = (head(path, None if body is None else len(body)) + _pad(body or b"", tarfile.BLOCKSIZE) for path, body in entries)
        return _pad(b"".join(blocks) + b"\0" * 2 * tarfile.BLOCKSIZE, tarfile.RECORDSIZE)

    low = tar([("etc", None), ("etc/keep", b"1"), ("etc/gone", b"2"), (f"opt/{name}", b"3"), ("opt/old", b"4"), ("../evil", b"5")])
    high = tar([("etc/.wh.gone", b""), ("opt/.wh..wh..opq", b""), (f"opt/{name}", name.encode()), ("/abs", b"6")])
    return tar([("a.tar", low), ("b.tar", high), ("manifest.json", json.dumps([{"Layers": ["a.tar", "b.tar"]}]).encode())])


def made(build, *columns: str):
    @F.pandas_udf("binary")
    def run(*cells: pd.Series) -> pd.Series:
        return pd.Series([build(*row) for row in zip(*cells, strict=True)])

    return run(*columns)


def named(spark, d):
    return parts(spark, d).select("k", "v", "nm", "b", cat("nm", "-", "k").alias("name"))


N = "nm || '-' || k"


@query(f"{P}, x AS (SELECT k, {N} AS name, sha256({N}) AS h FROM p) SELECT k, {sql_case("'elf'", "'macho'", "'pe'")} AS class, {sql_case("'lib' || name || '.so'", "name || '.dylib'", "name || '.dll'")} AS imports, CASE k % 3 WHEN 0 THEN h END AS build_id, CASE k % 3 WHEN 0 THEN '{{\"name\":\"pkg\"}}' END AS note_package, CASE k % 3 WHEN 0 THEN name || '.debug:0000abcd' END AS debuglink, {sql_case("'/opt/' || name || '|/x'", "'@loader/' || name", "''")} AS paths, CASE k % 3 WHEN 1 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS macho_uuid, CASE k % 3 WHEN 1 THEN 'macos:13.1' END AS macho_min_os, CASE k % 3 WHEN 2 THEN 'amd64/windows-cui' END AS pe FROM x")
def binary_identities(spark, d):
    rows = named(spark, d).withColumn("digest", F.unhex(F.sha2("name", 256)))
    own = F.when(F.col("k") % 3 == 0, made(make_elf, "name", "digest")).when(F.col("k") % 3 == 1, made(make_macho, "name", "digest")).otherwise(made(make_pe, "name", "digest"))
    b = binary.binaries(rows.select(F.col("k").cast("string").alias("path"), own.alias("content")))
    return b.select(F.col("path").cast("bigint").alias("k"), "class", F.array_join("imports", "|").alias("imports"), "build_id", "note_package", "debuglink", F.array_join(F.concat("runpath", "macho_rpath"), "|").alias("paths"), "macho_uuid", "macho_min_os", F.when(F.col("pe_machine").isNotNull(), F.concat_ws("/", "pe_machine", "pe_subsystem")).alias("pe"))


@query(f"{P}, x AS (SELECT k, sha256({N}) AS h FROM p WHERE k % 3 = 2) SELECT k, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || ':7' AS pdb FROM x")
def pe_pdb_ids(spark, d):
    rows = named(spark, d).where("k % 3 = 2").withColumn("digest", F.unhex(F.sha2("name", 256)))
    b = binary.binaries(rows.select(F.col("k").cast("string").alias("path"), made(make_pe, "name", "digest").alias("content")))
    return b.select(F.col("path").cast("bigint").alias("k"), F.col("pe_pdb_id").alias("pdb"))


@query(f"{P} SELECT k, {N} AS name, v AS version, '1.el9' AS release, CASE WHEN k % 2 = 0 THEN CAST(k % 5 AS INT) END AS epoch, 'rocky' AS vendor, 'dep' || (k % 7) AS requires, '/usr/bin/a|/opt/' || {N} || '/b' AS paths FROM p")
def rpm_files_reader(spark, d):
    rows = named(spark, d).select(F.col("k").cast("string").alias("path"), made(make_rpm_file, "name", "v", "k").alias("content"))
    r = binary.rpm_files(rows)
    return r.select(F.col("path").cast("bigint").alias("k"), "name", "version", "release", "epoch", binary.rpm_vendor_slug(F.col("vendor"), F.lit("rhel")).alias("vendor"), F.array_join("requires", "|").alias("requires"), F.array_join("paths", "|").alias("paths"))


#: Keys of parts that share a database of their brand; one of 25 of them is of the brand.
DATABASE_KEYS = 25_000


def _database(spark, d):
    """The package databases of a brand, one for each DATABASE_KEYS keys, with a header blob in most rows and text columns in the others."""
    import pandas

    def build(pdf: pandas.DataFrame) -> pandas.DataFrame:
        import sqlite3

        con = sqlite3.connect(":memory:")
        con.execute("CREATE TABLE Packages (hnum INTEGER PRIMARY KEY, blob BLOB, small BLOB, name TEXT, version TEXT)")
        for r in pdf.sort_values("k").itertuples():
            blob = make_rpm_header(r.name, r.v, r.k) + b"\0" * 5000 if r.k % 3 else b"broken"
            con.execute("INSERT INTO Packages (blob, small, name, version) VALUES (?, ?, ?, ?)", (blob, b"x", r.name if not r.k % 3 else None, r.v))
        con.commit()
        out = pandas.DataFrame({"path": [f"/b{pdf.b.iloc[0]}/{pdf.i.iloc[0]}"], "content": [con.serialize()]})
        con.close()
        return out

    rows = named(spark, d).withColumnRenamed("name", "nm2").select("k", "v", "b", F.col("nm2").alias("name"), F.floor(F.col("k") / DATABASE_KEYS).alias("i"))
    return rows.groupBy("b", "i").applyInPandas(lambda pdf: build(pdf.rename(columns={"Name": "name"})), "path string, content binary")


@query(f"{P} SELECT '/b' || b AS path, {N} AS name, v AS version, CASE WHEN k % 3 <> 0 THEN 'MIT' END AS license FROM p")
def rpm_database_reader(spark, d):
    return binary.rpm_databases(_database(spark, d)).select(F.substring_index("path", "/", 2).alias("path"), "name", "version", "license")


@query(f"{P} SELECT k, 'debian' AS a, {sql_case("'redhat'", "'fedora'", "'oracle'", "'rpm'")} AS vendor FROM p")
def rpm_vendors(spark, d):
    vendor = case(F.lit("Red Hat, Inc."), F.lit("Fedora Project"), F.lit("unknown"), F.lit(None).cast("string"))
    return parts(spark, d).select("k", F.lit("debian").alias("a"), binary.rpm_vendor_slug(vendor, case(F.lit("x"), F.lit("x"), F.lit("ol"), F.lit(""))).alias("vendor"))


@query(f"{P}, x AS (SELECT k, {N} AS name, v FROM p WHERE k % 4 <> 0) SELECT k, 'path' AS kind, 'm.io/' || name AS module, NULL AS version FROM x UNION ALL SELECT k, 'mod', 'm.io/' || name, 'v' || v FROM x UNION ALL SELECT k, 'dep', 'n.io/new' || k, 'v2.0.0' FROM x UNION ALL SELECT k, 'dep', 'm.io/other', 'v3.0.0' FROM x")
def go_binary_modules(spark, d):
    rows = named(spark, d).select("k", made(make_go, "name", "v", "k").alias("content")).withColumn("i", binary.go_build_info("content"))
    m = binary.go_modules(rows.where("i.status = 'ok'").select(F.col("k").cast("string").alias("path"), F.col("i.mod_info").alias("mod_info")))
    return m.select(F.col("path").cast("bigint").alias("k"), "kind", "module", "version")


@query(f"{P} SELECT k, CASE WHEN k % 4 <> 0 THEN 'ok' ELSE 'unsupported' END AS status, CASE WHEN k % 4 <> 0 THEN 'go1.22' END AS go_version, CASE WHEN k % 4 <> 0 THEN 'r' || k END AS revision, CASE WHEN k % 4 <> 0 THEN TRUE END AS modified FROM p")
def go_binary_info(spark, d):
    rows = named(spark, d).select("k", made(make_go, "name", "v", "k").alias("content")).withColumn("i", binary.go_build_info("content"))
    vcs = binary.go_vcs(F.col("i.mod_info"))
    return rows.select("k", F.col("i.status").alias("status"), F.col("i.go_version").alias("go_version"), vcs["revision"].alias("revision"), vcs["modified"].alias("modified"))


@query(f"{P} SELECT {N} AS artifact, v AS version, TRUE AS is_primary FROM p UNION ALL SELECT 'shaded' || k, '9', FALSE FROM p")
def jar_metadata(spark, d):
    rows = named(spark, d).select(F.concat(F.lit("/lib/"), "name", F.lit("-"), "v", F.lit(".jar")).alias("path"), made(make_jar, "name", "v", "k").alias("content"))
    return binary.jar_coordinates(rows).select("artifact", "version", "is_primary")


def _image_entries(spark, d):
    """What a part's image holds. An image is read where it is made, and gone before the next, as a batch of them between JVM and Python would be as large as 10,000 images."""
    entries = binary.entry_batches  # itself, as its module would be sent to the workers whole

    def read(batches):
        return entries((path, make_image(name, k)) for b in batches for path, name, k in zip(*(b.column(c).to_pylist() for c in ("path", "name", "k")), strict=True))

    return named(spark, d).select(F.col("k").cast("string").alias("path"), "name", "k").mapInArrow(read, binary.ENTRIES)


@query(f"{P} SELECT k, x.path, CASE WHEN x.path = 'etc/keep' THEN '1' ELSE {N} END AS content FROM p, LATERAL (SELECT unnest(['etc/keep', 'opt/' || {N}]) AS path) x")
def image_overlay(spark, d):
    checkpoints(spark)
    e = _image_entries(spark, d).where("kind in ('file', 'whiteout', 'opaque')").select("image", "layer", "path", "kind", "content").checkpoint()  # the images are read once
    shown = graph.layer_overlay(e.select(F.concat_ws("/", "image", "path").alias("path"), "layer", "kind"))
    out = shown.join(measured(e.where("kind = 'file'").select(F.concat_ws("/", "image", "path").alias("path"), "layer", "content")), ["path", "layer"])
    return out.select(F.substring_index("path", "/", 1).cast("bigint").alias("k"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), F.col("content").cast("string").alias("content"))
