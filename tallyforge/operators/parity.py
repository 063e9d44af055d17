"""Whether the documents of one target say the same: facts are taken from each format, then compared row by row.

facts(): target, format, row_id, value. What a document says by itself is read from it in a task; ends of edges may stand in another
volume of the target, so that documents give their nodes (id, purl, whether it is for development) and edges by ids, which are joined. A row of the table has a rule: `equal` sets, the first format's facts `within` the
others', or facts that must only be `present`. The report counts, per row, in which formats there is any fact.
"""

from __future__ import annotations

import json

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import PREFIX
from .lineage import checkpoints, measured

#: Row id: label and rule. Rows from C1 on are the properties named.
ROWS = {
    "A1": ("purl", "equal"), "A2": ("name", "equal"), "A3": ("version", "equal"), "A4": ("supplier", "equal"), "A6": ("hashes", "equal"), "A7": ("declared licences", "equal"), "A8": ("concluded licences", "within"),
    "A12": ("cpes", "within"), "B1": ("runtime edges", "within"), "B2": ("dev edges", "within"), "B3": ("containment", "equal"), "B4": ("root", "present"), "G1": ("tool", "present"),
}
PROPERTIES = {"C1": "source-files", "C2": "dev-dependency", "C3": "sbom-tier", "C4": "cpe-candidates"}


def _walk(components: list, parent: str | None = None):
    for c in components or []:
        yield c, parent
        yield from _walk(c.get("components"), c.get("purl"))


def _atoms(text: str) -> list[str]:
    """The scalars of a JSON text, arrays and objects taken apart; other texts stand for themselves."""
    try:
        x = json.loads(text)
    except ValueError:
        return [text]
    if isinstance(x, list):
        return [a for i in x for a in _atoms(i if isinstance(i, str) else json.dumps(i))]
    if isinstance(x, dict):
        return [f"{k}={a}" for k in sorted(x) for a in _atoms(x[k] if isinstance(x[k], str) else json.dumps(x[k]))]
    return [text if not isinstance(x, str) else x]


def _cyclonedx(doc: dict) -> tuple[set, dict, set]:
    out, nodes, edges = set(), {}, set()
    for c, parent in _walk(doc.get("components")):
        p = c["purl"]
        nodes.setdefault(p, [p, False])
        out |= {("A1", p), ("A2", f"{p} {c.get('name')}"), ("A3", f"{p} {c.get('version')}")}
        if "supplier" in c:
            out.add(("A4", f"{p} {c['supplier']['name']}"))
        out |= {("A6", f"{p} {h['alg'].replace('-', '').lower()}:{h['content']}") for h in c.get("hashes", ())}
        for x in c.get("licenses", ()):
            own = x.get("license", x)
            row = "A7" if own.get("acknowledgement") == "declared" else "A8"
            out.add((row, f"{p} {own.get('id') or own.get('name') or own.get('expression')}"))
        if "cpe" in c:
            out.add(("A12", f"{p} {c['cpe']}"))
        if parent:
            out.add(("B3", f"{parent} {p}"))
        for q in c.get("properties", ()):
            key = q["name"].removeprefix(PREFIX)
            out |= {(row, f"{p} {a}") for row, name in PROPERTIES.items() if name == key for a in _atoms(q["value"])}
            if key == "dev-dependency":
                nodes[p][1] = True
    target = doc["metadata"]["component"]["bom-ref"]
    for d in doc.get("dependencies", ()):
        if d["ref"] != target:
            edges |= {("edge", d["ref"], t) for t in d.get("dependsOn", ())}
    return out | {("B4", doc["metadata"]["component"]["name"]), ("G1", "inventory")}, nodes, edges


def _annotated(text: str) -> tuple[str, str] | None:
    try:
        x = json.loads(text)
    except ValueError:
        return None
    return (x["field"].removeprefix(PREFIX), x["value"]) if isinstance(x, dict) and "field" in x else None


def _license_parts(x: str) -> list[str]:
    for word in (" OR ", " AND "):
        parts = x.split(word)
        if len(parts) > 1 and not any(c in x for c in "()") and all(len(p.split()) == 1 for p in parts):
            return parts
    return [x]


def _spdx2(doc: dict) -> tuple[set, dict, set]:
    out, edges = set(), set()
    purl = {p["SPDXID"]: next((r["referenceLocator"] for r in p.get("externalRefs", ()) if r["referenceType"] == "purl"), None) for p in doc.get("packages", ())}
    texts = {x["licenseId"]: x["extractedText"] for x in doc.get("hasExtractedLicensingInfos", ())}
    for c in doc.get("packages", ()):
        p = purl[c["SPDXID"]]
        out |= {("A1", p), ("A2", f"{p} {c.get('name')}"), ("A3", f"{p} {c.get('versionInfo')}")}
        if "supplier" in c:
            out.add(("A4", f"{p} {c['supplier'].removeprefix('Organization: ')}"))
        out |= {("A6", f"{p} {h['algorithm'].lower()}:{h['checksumValue']}") for h in c.get("checksums", ())}
        for row, key in (("A7", "licenseDeclared"), ("A8", "licenseConcluded")):
            if c.get(key, "NOASSERTION") != "NOASSERTION":
                out |= {(row, f"{p} {x}") for x in _license_parts(texts.get(c[key], c[key]))}
        out |= {("A12", f"{p} {r['referenceLocator']}") for r in c.get("externalRefs", ()) if r["referenceType"] == "cpe23Type"}
        for a in c.get("annotations", ()):
            if own := _annotated(a["comment"]):
                out |= {(row, f"{p} {x}") for row, name in PROPERTIES.items() if name == own[0] for x in _atoms(own[1])}
    for r in doc.get("relationships", ()):
        a, kind, b = r["spdxElementId"], r["relationshipType"], r["relatedSpdxElement"]
        if kind == "DEPENDS_ON":
            edges.add(("B1", a, b))
        elif kind in ("DEV_DEPENDENCY_OF", "BUILD_DEPENDENCY_OF"):
            edges.add(("B2", b, a))
        elif kind == "CONTAINS":
            edges.add(("B3", a, b))
        elif kind == "DESCRIBES":
            out.add(("B4", doc["name"]))
    out |= {("G1", c.removeprefix("Tool: ").split("-")[0]) for c in doc["creationInfo"]["creators"] if c.startswith("Tool: ")}
    return out, {i: [p, False] for i, p in purl.items()}, edges


def _spdx3(doc: dict) -> tuple[set, dict, set]:
    edges, out, by = set(), set(), {e["spdxId"]: e for e in doc["@graph"]}
    purl = {i: e["software_packageUrl"] for i, e in by.items() if e["type"] == "software_Package"}
    dev = set()
    for e in by.values():
        if e["type"] == "Annotation" and (own := _annotated(e["statement"])):
            out |= {(row, f"{purl[e['subject']]} {x}") for row, name in PROPERTIES.items() if name == own[0] for x in _atoms(own[1])}
            if own[0] == "dev-dependency":
                dev.add(e["subject"])
    for i, e in by.items():
        if e["type"] == "software_Package":
            p = purl[i]
            out |= {("A1", p), ("A2", f"{p} {e.get('name')}"), ("A3", f"{p} {e.get('software_packageVersion')}")}
            if "suppliedBy" in e:
                out.add(("A4", f"{p} {by[e['suppliedBy']]['name']}"))
            out |= {("A6", f"{p} {h['algorithm']}:{h['hashValue']}") for h in e.get("verifiedUsing", ())}
            out |= {("A12", f"{p} {x['identifier']}") for x in e.get("externalIdentifier", ()) if x["externalIdentifierType"] == "cpe23"}
        elif e["type"] == "Relationship":
            kind, a = e["relationshipType"], e["from"]
            for b in e["to"]:
                if kind == "dependsOn":
                    edges.add(("edge", a, b))
                elif kind == "contains":
                    edges.add(("B3", a, b))
                elif kind in ("hasDeclaredLicense", "hasConcludedLicense"):
                    rows = ("A7", "A8") if kind == "hasDeclaredLicense" else ("A8",)
                    out |= {(rows[0], f"{purl[a]} {x}") for x in _license_parts(by[b].get("simplelicensing_licenseText", by[b]["simplelicensing_licenseExpression"]))}
        elif e["type"] == "SpdxDocument":
            out |= {("B4", e["name"]), ("G1", "inventory")}
    return out, {i: [p, i in dev] for i, p in purl.items()}, edges


_EXTRACTORS = {"cyclonedx-json": _cyclonedx, "spdx-2.3-json": _spdx2, "spdx-3-json": _spdx3}


_READ = "target string, format string, row_id string, value string, src string, dst string, dev boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts, nodes (row_id node: src is the id, value the purl) and edges (src, dst) of documents, one document after the other."""
    names = [f.split()[0] for f in _READ.split(", ")]
    kinds = [pa.bool_() if f.endswith("boolean") else pa.string() for f in _READ.split(", ")]
    for batch in batches:
        for target, kind, document in zip(*(batch.column(c) for c in ("target", "format", "document")), strict=True):
            found, nodes, edges = _EXTRACTORS[kind.as_py()](json.loads(document.as_py()))
            rows = [(r, v, None, None, None) for r, v in found] + [("node", p, i, None, dev) for i, (p, dev) in nodes.items()] + [(r, None, a, b, None) for r, a, b in edges]
            same = [[target.as_py()] * len(rows), [kind.as_py()] * len(rows)]
            columns = [*same, *zip(*rows, strict=True)] if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def facts(documents: DataFrame) -> DataFrame:
    """target, format, row_id, value of documents (target, format, document), volumes of a target taken together."""
    checkpoints(documents.sparkSession)
    read = documents.select("target", "format", "document").mapInArrow(_read, _READ).checkpoint()  # documents are read once
    nodes = read.where("row_id = 'node'").groupBy("target", "format", F.col("src").alias("id")).agg(F.max("value").alias("purl"), F.max("dev").alias("dev"))
    end = lambda x: measured(nodes.select("target", "format", F.col("id").alias(x), F.col("purl").alias(f"{x}_purl"), F.col("dev").alias(f"{x}_dev")))
    edges = read.where("dst is not null").select("target", "format", "row_id", "src", "dst").join(end("src"), ["target", "format", "src"], "left").join(end("dst"), ["target", "format", "dst"], "left")
    row = F.when(F.col("row_id") != "edge", F.col("row_id")).when(F.col("dst_dev"), "B2").otherwise("B1")
    edges = edges.select("target", "format", row.alias("row_id"), F.concat_ws(" ", F.coalesce("src_purl", "src"), F.coalesce("dst_purl", "dst")).alias("value"))
    return read.where("dst is null and row_id <> 'node'").select("target", "format", "row_id", "value").unionByName(edges).distinct()


def _rules() -> Column:
    table = {k: rule for k, (_, rule) in ROWS.items()} | dict.fromkeys(PROPERTIES, "within")
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), F.col("row_id"))


def compared(found: DataFrame) -> DataFrame:
    """target, row_id, rule, holds, and how many values are missing from each format: facts met by value."""
    kinds = list(_EXTRACTORS)
    met = found.groupBy("target", "row_id", "value").agg(*(F.bool_or(F.col("format") == k).alias(f"in_{i}") for i, k in enumerate(kinds)))
    sums = met.groupBy("target", "row_id").agg(*(F.count_if(~F.col(f"in_{i}")).alias(f"missing_{n}") for i, n in enumerate(("cdx", "spdx2", "spdx3"))), F.count_if(F.col("in_0") & ~(F.col("in_1") & F.col("in_2"))).alias("beyond"))
    out = sums.withColumn("rule", _rules())
    none = (F.col("missing_cdx") == 0) & (F.col("missing_spdx2") == 0) & (F.col("missing_spdx3") == 0)
    return out.select("target", "row_id", "rule", F.when(F.col("rule") == "equal", none).when(F.col("rule") == "within", F.col("beyond") == 0).otherwise(F.lit(True)).alias("holds"), "missing_cdx", "missing_spdx2", "missing_spdx3")


def report(found: DataFrame, formats: int = 3) -> DataFrame:
    """target, row_id, n_formats, verdict: pass if every format has some fact, gap if only some have, none if no one has."""
    checkpoints(found.sparkSession)
    found = found.select("target", "format", "row_id").distinct().checkpoint()  # documents are read once
    ids = found.sparkSession.createDataFrame([(r,) for r in (*ROWS, *PROPERTIES)], "row_id string")
    each = found.groupBy("target", "row_id").agg(F.count_distinct("format").alias("n_formats"))
    out = found.select("target").distinct().join(F.broadcast(ids)).join(each, ["target", "row_id"], "left").withColumn("n_formats", F.coalesce("n_formats", F.lit(0)))
    return out.withColumn("verdict", F.when(F.col("n_formats") == formats, "pass").when(F.col("n_formats") > 0, "gap").otherwise("none"))


def exit_code(verdicts: DataFrame) -> DataFrame:
    """target, exit_code: 1 with a gap, else 0."""
    return verdicts.groupBy("target").agg(F.max(F.when(F.col("verdict") == "gap", 1).otherwise(0)).alias("exit_code"))
