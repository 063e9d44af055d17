"""Licence and header text functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of licences in control files and their SPDX ids.
SHORTHAND = {
    "gpl-1": "GPL-1.0-only", "gpl-2": "GPL-2.0-only", "gpl-2+": "GPL-2.0-or-later", "gpl-3": "GPL-3.0-only", "gpl-3+": "GPL-3.0-or-later",
    "lgpl-2": "LGPL-2.0-only", "lgpl-2.1": "LGPL-2.1-only", "lgpl-2.1+": "LGPL-2.1-or-later", "lgpl-3": "LGPL-3.0-only",
    "apache-2.0": "Apache-2.0", "expat": "MIT", "mit": "MIT", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "artistic": "Artistic-1.0-Perl", "zlib": "Zlib", "public-domain": "LicenseRef-public-domain",
}


def spdx_of(name: Column) -> Column:
    out = name
    for k, v in SHORTHAND.items():
        out = F.when(F.lower(F.trim(name)) == k, F.lit(v)).otherwise(out)
    return out


def license_phrase(text: Column) -> Column:
    """What a licensing sentence names: after `icensed under` or `eleased under`, up to the sentence's end."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"icensed under (?:the |an? )?([A-Za-z0-9 ]+)", r"eleased under (?:the |an? )?([A-Za-z0-9 ]+)")))


def or_later(text: Column, needle: str, family: str, reach: int = 160) -> Column:
    """family with -or-later or -only, by `later version` within reach of the needle; null without the needle."""
    low = F.lower(text)
    at = F.instr(low, needle)
    near = F.substring(low, at, F.lit(len(needle) + reach))
    return F.when(at > 0, F.concat(F.lit(family), F.when(F.instr(near, "later version") > 0, "-or-later").otherwise("-only")))


def header(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1), F.lit(""))


def packer(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return F.when(head.rlike("UPX[!01]"), "upx")


def magic(content: Column) -> Column:
    """elf, macho, pe or null by the first bytes."""
    four = F.hex(F.substring(content, 1, 4))
    return F.when(four == "7F454C46", "elf").when(four.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE"), "macho").when(F.substring(four, 1, 4) == "4D5A", "pe")
