"""Readers of byte formats over (path, content) rows: executables, build information, package headers, archives, images.

Decoders are plain functions on bytes, run a row at a time in Arrow batches of pandas UDFs; a file that a decoder can't follow
gives null or no rows. Caps on sizes reject a file as a whole, as a cut one would give wrong evidence.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import struct as struct_of

BINARY = "class string, imports array<string>, stripped boolean, build_id string, note_package string, debuglink string, runpath array<string>, macho_uuid string, macho_rpath array<string>, macho_min_os string, pe_pdb_id string, pe_machine string, pe_subsystem string"

MOST_BINARY, MOST_RPM, MOST_ENTRY = 500 << 20, 200 << 20, 64 << 20

#: Machines and subsystems of PE files, platforms of Mach-O files.
MACHINES = {0x14C: "i386", 0x8664: "amd64", 0x1C0: "arm", 0x1C4: "armnt", 0xAA64: "arm64", 0x200: "ia64", 0x5032: "riscv32", 0x5064: "riscv64"}
SUBSYSTEMS = {1: "native", 2: "windows-gui", 3: "windows-cui", 5: "os2-cui", 7: "posix-cui", 8: "native-windows", 9: "windows-ce-gui", 10: "efi-application", 11: "efi-boot-service-driver", 12: "efi-runtime-driver", 13: "efi-rom", 14: "xbox", 16: "windows-boot-application"}
PLATFORMS = {1: "macos", 2: "ios", 3: "tvos", 4: "watchos", 6: "maccatalyst", 7: "ios-simulator"}


def files(spark: SparkSession, root: str, most_bytes: int = MOST_BINARY) -> DataFrame:
    """path and content of files under root up to a size; larger ones aren't read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return read.where(F.col("length") <= most_bytes).select("path", "content")


def _text(raw: bytes, at: int) -> str:
    return raw[at : raw.index(b"\0", at)].decode("utf-8", "replace")


def elf(raw: bytes) -> dict:
    wide, order = raw[4] == 2, "<" if raw[5] == 1 else ">"
    u = lambda form, at: struct.unpack_from(order + form, raw, at)
    offset = u("Q", 40)[0] if wide else u("I", 32)[0]
    size, count, names = u("HHH", 58 if wide else 46)
    sections = []
    for i in range(count):
        at = offset + i * size
        name, kind = u("II", at)
        _, _, place, length, link = u("QQQQI", at + 8) if wide else u("IIIII", at + 8)
        sections.append((name, kind, place, length, link))
    table = sections[names][2] if count > names else 0
    by = {_text(raw, table + s[0]): s for s in sections} if count else {}
    out = {"class": "elf", "stripped": ".symtab" not in by, "imports": [], "runpath": []}
    if ".dynamic" in by:
        _, _, place, length, link = by[".dynamic"]
        strings = sections[link][2]
        step = 16 if wide else 8
        for at in range(place, place + length, step):
            tag, value = u("qQ" if wide else "iI", at)
            if tag == 0:
                break
            if tag == 1:
                out["imports"].append(_text(raw, strings + value))
            elif tag in (15, 29):
                out["runpath"] += [p for p in _text(raw, strings + value).split(":") if p]
    for _, kind, place, length, _ in sections:
        at = place
        while kind == 7 and at + 12 <= place + length:
            own, own_size, note = u("III", at)
            name = raw[at + 12 : at + 12 + own].rstrip(b"\0")
            body = at + 12 + -(-own // 4) * 4
            if name == b"GNU" and note == 3:
                out["build_id"] = raw[body : body + own_size].hex()
            elif name == b"FDO" and note == 0xCAFE1A7E:
                out["note_package"] = raw[body : body + own_size].rstrip(b"\0").decode("utf-8", "replace")
            at = body + -(-own_size // 4) * 4
    if ".gnu_debuglink" in by:
        _, _, place, length, _ = by[".gnu_debuglink"]
        name = _text(raw, place)
        out["debuglink"] = f"{name}:{u('I', place + -(-(len(name.encode()) + 1) // 4) * 4)[0]:08x}"
    return out


def macho(raw: bytes) -> dict:
    if raw[:4] == b"\xca\xfe\xba\xbe":  # slices are united, the first one's identity counts
        parts = [macho(raw[o : o + n]) for o, n in (struct.unpack_from(">II", raw, 8 + 20 * i + 8) for i in range(struct.unpack_from(">I", raw, 4)[0]))]
        out = dict(parts[0])
        for key in ("imports", "macho_rpath"):
            out[key] = list(dict.fromkeys(x for p in parts for x in p[key]))
        return out
    order = "<" if raw[:4] in (b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe") else ">"
    wide = raw[:4] in (b"\xcf\xfa\xed\xfe", b"\xfe\xed\xfa\xcf")
    u = lambda form, at: struct.unpack_from(order + form, raw, at)
    version = lambda x: f"{x >> 16}.{x >> 8 & 255}" + (f".{x & 255}" if x & 255 else "")
    out = {"class": "macho", "imports": [], "macho_rpath": [], "stripped": True}
    at, old = 32 if wide else 28, None
    for _ in range(u("I", 16)[0]):
        kind, size = u("II", at)
        if kind == 0x1B:
            x = raw[at + 8 : at + 24].hex()
            out["macho_uuid"] = "-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:]))
        elif kind in (0xC, 0x80000018, 0x8000001F):
            out["imports"].append(_text(raw, at + u("I", at + 8)[0]))
        elif kind == 0x8000001C:
            out["macho_rpath"].append(_text(raw, at + u("I", at + 8)[0]))
        elif kind == 0x32:
            platform, least = u("II", at + 8)
            out["macho_min_os"] = f"{PLATFORMS.get(platform, 'unknown')}:{version(least)}"
        elif kind in (0x24, 0x25, 0x2F, 0x30):
            old = {0x24: "macos", 0x25: "ios", 0x2F: "tvos", 0x30: "watchos"}[kind] + ":" + version(u("I", at + 8)[0])
        elif kind == 2:
            out["stripped"] = u("I", at + 12)[0] == 0
        at += size
    if old:
        out.setdefault("macho_min_os", old)
    return out


def pe(raw: bytes) -> dict:
    u = lambda form, at: struct.unpack_from("<" + form, raw, at)
    head = u("I", 60)[0]
    if raw[head : head + 4] != b"PE\0\0":
        return {}
    machine, count = u("HH", head + 4)
    symbols, optional = u("I", head + 16)[0], u("H", head + 20)[0]
    start = head + 24
    wide = u("H", start)[0] == 0x20B
    out = {"class": "pe", "pe_machine": MACHINES.get(machine, "unknown"), "pe_subsystem": SUBSYSTEMS.get(u("H", start + 68)[0], "unknown"), "imports": [], "stripped": symbols == 0}
    sections = [u("IIII", start + optional + 40 * i + 8) for i in range(count)]
    place = lambda rva: next((rva - v + p for n, v, m, p in sections if v <= rva < v + max(n, m)), None)
    folders = start + (112 if wide else 96)
    directory = lambda k: u("II", folders + 8 * k) if folders + 8 * k + 8 <= start + optional else (0, 0)
    rva, _ = directory(1)
    at = place(rva) if rva else None
    while at is not None and (name := u("I", at + 12)[0]):
        out["imports"].append(_text(raw, place(name)))
        at += 20
    rva, size = directory(6)
    at = place(rva) if rva else None
    for i in range(size // 28 if at is not None else 0):
        kind, length, _, where = u("IIII", at + 28 * i + 12)
        if kind == 2 and raw[where : where + 4] == b"RSDS":
            a, b, c = u("IHH", where + 4)
            rest = raw[where + 12 : where + 20].hex()
            out["pe_pdb_id"] = f"{a:08x}-{b:04x}-{c:04x}-{rest[:4]}-{rest[4:]}:{u('I', where + 20)[0]}"
    return out


def scanned(raw: bytes | None) -> dict | None:
    """What an executable says of itself (fields of BINARY), or None."""
    try:
        if raw is None or len(raw) < 64:
            return None
        kind = elf if raw[:4] == b"\x7fELF" else macho if raw[:4] in (b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe") else pe if raw[:2] == b"MZ" else None
        out = kind(raw) if kind else None
    except (struct.error, ValueError, IndexError):
        return None
    names = [f.split()[0] for f in BINARY.split(", ")]
    return {n: out.get(n, [] if n in ("imports", "runpath", "macho_rpath") else None) for n in names} if out else None


@F.pandas_udf(struct_of(BINARY))
def binary_scan(content: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in BINARY.split(", ")]
    return pd.DataFrame([scanned(c) or dict.fromkeys(names) for c in content], columns=names)


def binaries(df: DataFrame) -> DataFrame:
    """path and the fields of BINARY of files that are executables."""
    heads = F.hex(F.substring("content", 1, 4))
    rows = df.where(heads.isin("7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE") | F.startswith(heads, F.lit("4D5A")))
    return rows.select("path", binary_scan("content").alias("b")).where("b.class is not null").select("path", "b.*")


def _uvarint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def build_info(raw: bytes | None) -> dict | None:
    """status (ok, unsupported), go version and module text of a Go executable; None without the mark."""
    at = -1 if raw is None else raw.find(b"\xff Go buildinf:")
    if at < 0:
        return None
    try:
        if not raw[at + 15] & 2:
            return {"status": "unsupported", "go_version": None, "mod_info": None}
        n, p = _uvarint(raw, at + 32)
        version = raw[p : p + n].decode()
        m, p = _uvarint(raw, p + n)
        text = raw[p : p + m]
        # sixteen bytes of a mark stand before and after the module text
        text = text[16:-16] if len(text) >= 33 and text[-17:-16] == b"\n" else text
        return {"status": "ok", "go_version": version, "mod_info": text.decode("utf-8", "replace")}
    except (IndexError, UnicodeDecodeError):
        return {"status": "unsupported", "go_version": None, "mod_info": None}


@F.pandas_udf(struct_of("status string, go_version string, mod_info string"))
def go_build_info(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([build_info(c) or {"status": None, "go_version": None, "mod_info": None} for c in content], columns=["status", "go_version", "mod_info"])


def go_modules(df: DataFrame) -> DataFrame:
    """path, ord, kind (path, mod, dep), module, version, hash of rows (path, mod_info); a => row takes the place of the row before it."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("path").orderBy("ord")
    rows = df.select("path", F.posexplode(F.split("mod_info", "\n")).alias("ord", "line")).withColumn("c", F.split("line", "\t"))
    rows = rows.where(F.get("c", 0).isin("path", "mod", "dep", "=>")).withColumn("next", F.lead("c").over(by)).where(F.get("c", 0) != "=>")
    own = F.when(F.get("next", 0) == "=>", F.col("next")).otherwise(F.col("c"))
    cell = lambda k: F.nullif(F.get(own, k), F.lit(""))
    return rows.select("path", "ord", F.get("c", 0).alias("kind"), cell(1).alias("module"), cell(2).alias("version"), cell(3).alias("hash"))


def go_vcs(mod_info: Column) -> Column:
    """revision, time and modified of the build lines of a module text."""
    value = lambda key: F.nullif(F.regexp_extract(mod_info, rf"(?m)^build\tvcs\.{key}=(.*)$", 1), F.lit(""))
    return F.struct(value("revision").alias("revision"), value("time").alias("time"), (value("modified") == "true").alias("modified"))


#: Tags of rpm headers.
RPM_TAGS = {1000: "name", 1001: "version", 1002: "release", 1003: "epoch", 1011: "vendor", 1014: "license", 1015: "packager", 1022: "arch", 1049: "requires", 1116: "dir_indexes", 1117: "base_names", 1118: "dir_names"}
RPM = "name string, version string, release string, epoch int, vendor string, license string, packager string, arch string, requires array<string>, paths array<string>"
MOST_INDEX, MOST_STORE = 65_535, 16 << 20


def rpm_header(raw: bytes | None) -> dict | None:
    """Fields of RPM of a header blob (index count, store size, index, store); None if counts are beyond their limits or the bytes."""
    try:
        count, size = struct.unpack_from(">II", raw, 0)
        if count > MOST_INDEX or size > MOST_STORE or 8 + 16 * count + size > len(raw):
            return None
        base, found = 8 + 16 * count, {}
        for i in range(count):
            tag, kind, place, n = struct.unpack_from(">IIII", raw, 8 + 16 * i)
            name = RPM_TAGS.get(tag)
            if name is None:
                continue
            if kind == 4:
                found[name] = list(struct.unpack_from(f">{n}I", raw, base + place))
            elif kind in (6, 8, 9):
                at, texts = base + place, []
                for _ in range(n if kind == 8 else 1):
                    texts.append(_text(raw, at))
                    at = raw.index(b"\0", at) + 1
                found[name] = texts
    except (struct.error, ValueError, TypeError):
        return None
    if "name" not in found or "version" not in found:
        return None
    dirs = found.get("dir_names", [])
    paths = [dirs[d] + b for d, b in zip(found.get("dir_indexes", []), found.get("base_names", []), strict=False) if d < len(dirs)]
    keep = [x for x in dict.fromkeys(found.get("requires", [])) if not x.startswith(("rpmlib(", "/")) and "(" not in x]
    first = lambda k: (found.get(k) or [None])[0]
    return {k: first(k) for k in ("name", "version", "release", "epoch", "vendor", "license", "packager", "arch")} | {"requires": keep, "paths": paths}


def rpm_file(raw: bytes | None) -> dict | None:
    """Fields of RPM of an .rpm file: lead, signature header padded to eight bytes, header."""
    if raw is None or not 96 <= len(raw) <= MOST_RPM or raw[:4] != b"\xed\xab\xee\xdb":
        return None
    try:
        at = 96
        for part in ("signature", "header"):
            if raw[at : at + 3] != b"\x8e\xad\xe8":
                return None
            count, size = struct.unpack_from(">II", raw, at + 8)
            end = at + 16 + 16 * count + size
            if part == "header":
                return rpm_header(raw[at + 8 : end])
            at = -(-end // 8) * 8
    except struct.error:
        return None


def _struct_udf(decode: Callable[[bytes], dict | None], schema: str):
    names = [f.split()[0] for f in schema.split(", ")]

    @F.pandas_udf(struct_of(schema))
    def run(content: pd.Series) -> pd.DataFrame:
        rows = [decode(c) or dict.fromkeys(names) for c in content]
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="Int32" if n == "epoch" else object) for n in names})

    return run


rpm_header_fields = _struct_udf(rpm_header, RPM)
rpm_file_fields = _struct_udf(rpm_file, RPM)


def rpm_files(df: DataFrame) -> DataFrame:
    """path and the fields of RPM of .rpm files."""
    return df.select("path", rpm_file_fields("content").alias("r")).where("r.name is not null").select("path", "r.*")


def rpm_vendor_slug(header_vendor: Column, os_id: Column) -> Column:
    """The vendor's slug by what the header's vendor begins with, else by the system's id, else rpm."""
    from ..functions.keys import rpm_vendor

    #: Beginnings of vendors.
    table = {"Red Hat": "redhat", "Fedora Project": "fedora", "Rocky": "rocky", "AlmaLinux": "almalinux", "CentOS": "centos", "Oracle": "oracle", "Amazon": "amazon", "SUSE": "suse", "openSUSE": "opensuse"}
    own = F.lit(None).cast("string")
    for k, v in reversed(table.items()):
        own = F.when(F.startswith(header_vendor, F.lit(k)), F.lit(v)).otherwise(own)
    return F.coalesce(own, rpm_vendor(F.nullif(os_id, F.lit(""))), F.lit("rpm"))


def sqlite_rows(raw: bytes | None, table: str) -> Iterator[dict]:
    """Rows of a table of an SQLite file held in memory, blobs as bytes; none if it isn't one or lacks the table."""
    if raw is None or raw[:16] != b"SQLite format 3\0":
        return
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(raw)
        con.row_factory = sqlite3.Row
        names = {r[0] for r in con.execute("SELECT name FROM sqlite_schema WHERE type = 'table'")}
        if table in names:
            for r in con.execute(f'SELECT * FROM "{table}"'):
                yield dict(r)
    except sqlite3.DatabaseError:
        return
    finally:
        con.close()


def rpm_databases(df: DataFrame, most_bytes: int = MOST_RPM) -> DataFrame:
    """path, ord and the fields of RPM of the packages of rpmdb.sqlite files: the largest blob of a row is its header, else its
    text columns count. Larger files are left out. The older key-value databases give no rows.
    """
    names = [f.split()[0] for f in RPM.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "ord", *names]).astype({"epoch": "Int32"}) if rows else pd.DataFrame(columns=["path", "ord", *names])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                out = []
                for i, row in enumerate(sqlite_rows(raw, "Packages")):
                    blobs = [v for v in row.values() if isinstance(v, bytes)]
                    low = {k.lower(): v for k, v in row.items() if isinstance(v, str | int)}
                    found = rpm_header(max(blobs, key=len)) if blobs else None
                    if found is None and low.get("name") and low.get("version"):
                        found = {n: low.get(n) for n in names} | {"requires": [], "paths": []}
                    if found:
                        out.append({"path": path, "ord": i} | found)
                    if len(out) == 1000:
                        yield frame(out)
                        out = []
                yield frame(out)

    return df.where(F.length("content") <= most_bytes).select("path", "content").mapInPandas(read, f"path string, ord int, {RPM}")


def jar_coordinates(df: DataFrame) -> DataFrame:
    """path, group, artifact, version, is_primary, sha256 of every pom.properties of a jar.

    An artifact is primary if the archive's name begins with it. Entries beyond MOST_ENTRY bytes are left out.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            out = []
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                        for e in sorted(z.infolist(), key=lambda e: e.filename):
                            parts = e.filename.split("/")
                            if parts[:2] == ["META-INF", "maven"] and parts[-1] == "pom.properties" and e.file_size <= MOST_ENTRY:
                                lines = [x.split("=", 1) for x in z.read(e).decode("utf-8", "replace").splitlines() if "=" in x and not x.startswith("#")]
                                p = {k.strip(): v.strip() for k, v in lines}
                                if all(p.get(k) for k in ("groupId", "artifactId", "version")):
                                    out.append((path, p["groupId"], p["artifactId"], p["version"], stem.startswith(p["artifactId"]), hashlib.sha256(raw).hexdigest()))
                except (zipfile.BadZipFile, TypeError, NotImplementedError):
                    continue
            yield pd.DataFrame(out, columns=["path", "group", "artifact", "version", "is_primary", "sha256"])

    return df.select("path", "content").mapInPandas(read, "path string, `group` string, artifact string, version string, is_primary boolean, sha256 string")


#: Numbers of a tar header from mode to check sum, and of its device, in the form that tar writes them.
_TAR_NUMBERS, _TAR_DEVICE = re.compile(rb"(?:[0-7]{7}[\0 ]){3}([0-7]{11})[\0 ][0-7]{11}[\0 ]([0-7]{6}\0 |[0-7]{7}[\0 ])"), re.compile(rb"(?:[0-7]{7}[\0 ]|\0{8}){2}")
_TAR_KINDS = {b"0": "file", b"1": "hardlink", b"2": "link", b"5": "dir"}


def _plain_members(raw: memoryview, kinds: bytes) -> list[tuple[str, str, str, memoryview]] | None:
    """Name, kind, linked name and content of the members of an archive of which all are of these kinds and have headers of the simplest form, else null."""
    out, at = [], 0
    while at + 512 <= len(raw):
        head = bytes(raw[at : at + 512])
        if not any(head):
            return out or None
        numbers, kind = _TAR_NUMBERS.fullmatch(head, 100, 156), head[156:157]
        if not numbers or kind not in kinds or head[345] or not _TAR_DEVICE.fullmatch(head, 329, 345) or sum(head) - sum(head[148:156]) + 256 != int(numbers[2].rstrip(b"\0 "), 8):
            return None
        name, linked, size = head[:100].partition(b"\0")[0], head[157:257].partition(b"\0")[0], int(numbers[1], 8)
        end = at + 512 + size
        if not (name.isascii() and linked.isascii()) or end > len(raw) or (size if kind != b"0" else name.endswith(b"/")):
            return None
        out.append((name.decode().rstrip("/") if kind == b"5" else name.decode(), _TAR_KINDS[kind], linked.decode(), raw[at + 512 : end]))
        at = end + -size % 512
    return None


def _layer_members(raw: memoryview) -> Iterator[tuple[str, str, str, bytes | None]]:
    """Name, kind, linked name and content (of files) of a layer's members."""
    plain = _plain_members(raw, b"0125")
    if plain is not None:
        yield from ((name, kind, linked, bytes(body) if kind == "file" else None) for name, kind, linked, body in plain)
        return
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        for m in t:
            kind = "hardlink" if m.islnk() else "file" if m.isfile() else "dir" if m.isdir() else "link"
            yield m.name, kind, m.linkname, t.extractfile(m).read() if kind == "file" else None


def _image_files(raw: bytes | None) -> Callable[[str], memoryview]:
    """Gives the content of an image's file by its name."""
    plain = _plain_members(memoryview(raw or b""), b"05")
    if plain is not None:
        found = {name: body if kind == "file" else None for name, kind, _, body in plain}
        return lambda name: memoryview(found[name])
    top = tarfile.open(fileobj=io.BytesIO(raw))
    return lambda name: memoryview(top.extractfile(name).read())


def _entries(image: str, raw: bytes | None) -> list[tuple]:
    """Rows of image_entries() of one archive; none if it can't be read."""
    out = []
    try:
        body = _image_files(raw)
        manifest = json.loads(bytes(body("manifest.json")))
        for layer, name in enumerate(manifest[0]["Layers"]):
            for own, kind, linked, content in _layer_members(body(name)):
                path = own.removeprefix("./")
                if path.startswith("/") or ".." in path.split("/") or not path:
                    continue
                folder, _, base = path.rpartition("/")
                if base == ".wh..wh..opq":
                    out.append((image, layer, folder, "opaque", None, None))
                elif base.startswith(".wh."):
                    out.append((image, layer, f"{folder}/{base[4:]}" if folder else base[4:], "whiteout", None, None))
                else:
                    target = linked.removeprefix("./") if kind == "hardlink" else None
                    if target is not None and (target.startswith("/") or ".." in target.split("/") or not target):
                        continue
                    out.append((image, layer, path, kind, content, target))
    except (tarfile.TarError, KeyError, TypeError, ValueError, AttributeError):
        return []
    return out


ENTRIES = "image string, layer int, path string, kind string, content binary, target string"


def entry_batches(images: Iterable[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of image_entries() for images (path, content), which are taken one at a time and not kept; a batch has about 10,000 rows or 16 MB of content."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    out, held = [], 0
    for image, raw in images:
        own = _entries(image, raw)
        held += sum(len(e[4] or b"") for e in own)
        out += own
        if len(out) >= 10_000 or held >= 16 << 20:
            yield packed(out)
            out, held = [], 0
    if out:
        yield packed(out)


def image_entries(df: DataFrame) -> DataFrame:
    """image, layer, path, kind (file, dir, link, hardlink, whiteout, opaque), content, target (of hard links) of the layers of `docker save` archives, in their order.

    Paths are relative; those that are absolute or climb with .. are left out. Whiteouts name what they hide.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return entry_batches((path.as_py(), raw.as_py()) for b in batches for path, raw in zip(b.column("path"), b.column("content"), strict=True))

    return df.select("path", "content").mapInArrow(read, ENTRIES)
