"""Functions over captured payloads, paths and envelopes, as Column expressions (the server name is a pandas UDF)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import STRING

#: Methods of requests.
METHODS = "GET HEAD POST PUT DELETE CONNECT OPTIONS TRACE PATCH".split()

#: Libraries, the text that stands before their version after a NUL, and the version's form.
VERSION_STRINGS = (
    ("openssl", "OpenSSL ", r"[0-9]+\.[0-9]+\.[0-9]+[a-qs-z]?"), ("boringssl", "BoringSSL ", r"[0-9a-f]{40}"), ("zlib", "deflate ", r"[0-9]+\.[0-9]+(?:\.[0-9]+){0,2}"),
    ("sqlite", "SQLite version ", r"3\.[0-9]+\.[0-9]+(?:\.[0-9]+)?"), ("curl", "libcurl/", r"[0-9]+\.[0-9]+\.[0-9]+"), ("pcre2", "PCRE2 ", r"[0-9]+\.[0-9]+"), ("pcre", "PCRE ", r"[0-9]+\.[0-9]+"),
)


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def header_value(text: Column, name: str) -> Column:
    """The trimmed value of the first header of this name (any case), up to the first empty line; null without one."""
    lines = _lines(text)
    stop = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "")
    heads = F.slice(lines, 2, F.when(stop > 0, stop - 1).otherwise(F.greatest(F.size(lines) - 1, F.lit(0))).cast("int"))
    own = F.filter(heads, lambda x: (F.instr(x, ":") > 0) & (F.lower(F.trim(F.substring_index(x, ":", 1))) == name.lower()))
    return F.trim(F.regexp_replace(F.get(own, 0), "^[^:]*:", ""))


def http_request(text: Column) -> Column:
    """method, path, host of a payload that begins like a request, else null."""
    parts = F.filter(F.split(F.get(_lines(text), 0), r"\s+"), lambda x: x != "")
    ok = F.get(parts, 0).isin(*METHODS) & (F.size(parts) >= 2) & ((F.size(parts) == 2) | F.startswith(F.get(parts, 2), F.lit("HTTP/")))
    return F.when(ok, F.struct(F.get(parts, 0).alias("method"), F.get(parts, 1).alias("path"), header_value(text, "Host").alias("host")))


def http_response(text: Column) -> Column:
    """status and length of a payload that begins like a response with a status from 100 to 599, else null."""
    parts = F.filter(F.split(F.get(_lines(text), 0), r"\s+"), lambda x: x != "")
    status = F.get(parts, 1).try_cast("int")
    length = header_value(text, "Content-Length").try_cast("bigint")
    return F.when(F.startswith(F.get(parts, 0), F.lit("HTTP/")) & status.between(100, 599), F.struct(status.alias("status"), length.alias("length")))


def wall_time(monotonic_ns: Column, boot_offset_ns: Column) -> Column:
    return F.timestamp_micros(F.floor((monotonic_ns + boot_offset_ns) / 1000).cast("bigint"))


def mime_type(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.rlike(r"\.(whl|tar\.gz|tgz)$"), "application/gzip").when(low.rlike(r"\.(zip|jar|war)$"), "application/zip").when(low.rlike(r"\.(deb|rpm)$"), "application/octet-stream")
        .when(low.rlike(r"\.(so|dylib|dll)$"), "application/x-sharedlib").otherwise("application/x-executable")
    )


def expiry_days(x: Column) -> Column:
    """Days of 30d, 2w, 6m (also mo, mon, month, months) or 1y (also yr, year, years); null for other texts."""
    form = r"^\s*(-?[0-9]+)([a-z]+)\s*$"
    unit = F.regexp_extract(x, form, 2)
    days = F.when(unit == "d", 1).when(unit == "w", 7).when(unit.isin("m", "mo", "mon", "month", "months"), 30).when(unit.isin("y", "yr", "year", "years"), 365)
    return F.regexp_extract(x, form, 1).try_cast("bigint") * days


def _first(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def python_version(path: Column) -> Column:
    """major.minor of a path in an installed or built CPython, by four rules in order; null elsewhere."""
    number = r"([0-9]+\.[0-9]+)"
    shared = path.rlike(r"\.so$|\.so[.-]")
    return F.when(
        ~F.contains(path, F.lit("site-packages/")),
        F.coalesce(
            F.when(shared, _first(path, f"^.*?lib/python{number}")),
            _first(path, rf"^.*?lib/libpython{number}[a-z]*\.so"),
            _first(path, f"^.*bin/python{number}$"),
            _first(path, rf"^.*?Python-{number}(?:\.[0-9]+)?/(?:(?:.*/)?python|.*\.[oa])$"),
        ),
    )


def jdk_version(path: Column, release: Column | None = None) -> Column:
    """Major version of a path in an installed JDK, by nine places in order; release: text of /opt/java/openjdk/release."""
    places = ("lib/jvm/java-", "lib/jvm/jre-", "lib/jvm/openjdk-", "opt/java/openjdk-", "opt/java/", "opt/jdk-", "opt/openjdk-", "opt/corretto-", "opt/temurin/")
    found = [_first(path, rf"^.*?{p}([0-9]+)(?:{'/' if p == 'opt/java/' else '[/.-]'}|$)") for p in places]
    if release is not None:
        found.append(F.when(F.contains(path, F.lit("opt/java/openjdk/")), _first(release, r"""(?m)^\s*JAVA_VERSION=\s*["']*([0-9]+)""")))
    return F.coalesce(*found)


def version_strings(content: Column) -> Column:
    """Distinct (library, version) that stand after a NUL (or at the start) of binary content, in order of libraries."""
    text = F.decode(content, "ISO-8859-1")

    def one(library: str, lead: str, form: str) -> Column:
        own = F.regexp_extract_all(text, F.lit(rf"(?:^|\x00){lead}({form})(?![A-Za-z0-9.])"), 1)
        return F.transform(F.array_distinct(own), lambda v: F.struct(F.lit(library).alias("library"), v.alias("version")))

    return F.concat(*(one(*x) for x in VERSION_STRINGS))


def requirement_name(x: Column) -> Column:
    """The name of a requirement, null if its marker asks for an extra."""
    name = F.regexp_extract(F.trim(F.substring_index(x, ";", 1)), r"^[^\s\[(<>=!~@]+", 0)
    return F.when(~F.contains(F.when(F.contains(x, F.lit(";")), F.regexp_replace(x, "^[^;]*;", "")).otherwise(""), F.lit("extra ==")), F.nullif(name, F.lit("")))


def pae(kind: Column, payload: Column) -> Column:
    """What is signed of an envelope: the length of kind and payload in bytes before each."""
    return F.concat_ws(" ", F.lit("DSSEv1"), F.octet_length(kind).cast("string"), kind, F.octet_length(payload).cast("string"), payload)


def _sorted_json(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(STRING)
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with the keys of every object sorted and no white space; null for what isn't JSON."""
    return text.map(_sorted_json, na_action="ignore")


def _server_name(data: bytes | None) -> str | None:
    """The host of the server-name extension of a TLS ClientHello; null for anything else."""
    at = 0

    def number(size: int) -> int:
        nonlocal at
        if at + size > len(data):
            raise EOFError
        at += size
        return int.from_bytes(data[at - size : at], "big")

    try:
        if data is None or number(1) != 0x16:
            return None
        at += 4  # version, record length
        if number(1) != 1:
            return None
        at += 3 + 2 + 32  # length, version, random
        for size in (1, 2, 1):  # session, ciphers, compression
            skip = number(size)
            at += skip
        end = number(2) + at
        while at + 4 <= end:
            kind, size = number(2), number(2)
            if kind == 0:
                last = min(at + size, len(data))
                at += 2
                while at + 3 <= last:
                    entry, size = number(1), number(2)
                    if entry == 0:
                        return data[at : at + size].decode("ascii") if size and at + size <= last else None
                    at += size
                return None
            at += size
    except (EOFError, UnicodeDecodeError):
        pass
    return None


@F.pandas_udf(STRING)
def server_name(payload: pd.Series) -> pd.Series:
    return payload.map(_server_name, na_action="ignore")
