"""Attestations: envelopes, the order of checks, subjects, layouts, witness collections, JSON patches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import STRING

ENVELOPE = "payloadType string, payload string, signatures array<struct<keyid:string,sig:string,cert:string,bundle:string>>"
STATEMENT = "_type string, subject array<struct<name:string,digest:map<string,string>>>, predicateType string, predicate string"
PAYLOAD_TYPE = "application/vnd.in-toto+json"

#: What each failure ends a run with.
EXIT_CODES = {"ok": 0, "signature": 1, "key": 1, "identity": 1, "tlog": 1, "envelope": 2, "subject": 2, "layout": 3}


def opened(df: DataFrame) -> DataFrame:
    """id, envelope, statement and, in failure, `envelope` where text (id, text) is no well-formed envelope of a statement."""
    rows = df.select("id", F.from_json("text", ENVELOPE).alias("envelope"))
    body = F.try_to_binary(F.col("envelope.payload"), F.lit("base64"))
    rows = rows.withColumn("statement", F.from_json(F.decode(body, "UTF-8"), STATEMENT))
    e, s = F.col("envelope"), F.col("statement")
    good = e.isNotNull() & (e["payloadType"] == PAYLOAD_TYPE) & (F.size(e["signatures"]) > 0) & s["_type"].isNotNull() & s["predicateType"].isNotNull() & s["subject"].isNotNull()
    return rows.withColumn("failure", F.when(~F.coalesce(good, F.lit(False)), "envelope"))


def verdict(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that doesn't hold (null counts as failed), else ok."""
    out = F.lit("ok")
    for name, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def exit_code(failure: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in EXIT_CODES.items() for x in kv)), failure)


def identity_holds(san: Column, pattern: Column) -> Column:
    """Whether a certificate's name contains the pattern; one that begins with * contains what follows it."""
    return F.contains(san, F.regexp_replace(pattern, r"^\*", ""))


def tlog_holds(signatures: Column) -> Column:
    """Whether some signature carries a bundle; the bundle isn't proven."""
    return F.exists(signatures, lambda s: s["bundle"].isNotNull())


def subjects_hold(expected: DataFrame, subjects: DataFrame) -> DataFrame:
    """id, subject_ok: every expected digest (id, sha256) is one of the id's subjects (id, sha256)."""
    met = expected.join(subjects.select("id", "sha256", F.lit(True).alias("met")).distinct(), ["id", "sha256"], "left")
    return met.groupBy("id").agg(F.bool_and(F.coalesce("met", F.lit(False))).alias("subject_ok"))


def layout_holds(signatures: Column, steps: Column) -> Column:
    """Whether a signature's key is one of the first step's keys; threshold and expiry aren't evaluated."""
    return F.arrays_overlap(F.transform(signatures, lambda s: s["keyid"]), steps[0]["pubkeys"])


def starter_layout(name: Column, keyid: Column, expires: Column) -> Column:
    """JSON of a layout with one step that the key may sign."""
    step = F.struct(name.alias("name"), F.lit(1).alias("threshold"), F.array(keyid).alias("pubkeys"), F.array().cast("array<string>").alias("expected_materials"), F.array().cast("array<string>").alias("expected_products"))
    return F.to_json(F.struct(F.lit("layout").alias("_type"), expires.alias("expires"), F.array(step).alias("steps")))


def distinct_subjects(subjects: DataFrame, keys: list[str]) -> DataFrame:
    """One subject of each name within keys, the least by digest."""
    return subjects.groupBy(*keys, "name").agg(F.min("sha256").alias("sha256"))


def resolved_subjects(stated: DataFrame, found: DataFrame) -> DataFrame:
    """id, name, sha256, how: the stated subjects; without any the files found; without these one made from the id."""
    tiers = stated.select("id", "name", "sha256", F.lit("stated").alias("how"), F.lit(1).alias("tier")).unionByName(found.select("id", "name", "sha256", F.lit("found").alias("how"), F.lit(2).alias("tier")))
    ids = tiers.select("id").distinct()
    low = tiers.where("name is not null").groupBy("id").agg(F.min("tier").alias("low"))
    kept = tiers.where("name is not null").join(low, "id").where("tier = low").select("id", "name", "sha256", "how")
    made = ids.join(low, "id", "left_anti").select("id", F.concat(F.lit("synthetic:"), F.col("id").cast("string")).alias("name"), F.sha2(F.concat(F.lit("synthetic:"), F.col("id").cast("string")), 256).alias("sha256"), F.lit("made").alias("how"))
    return kept.dropDuplicates(["id", "name"]).unionByName(made)


def statement(subjects: DataFrame, predicate_type: str, predicate: Column | None = None) -> DataFrame:
    """id, document: an in-toto statement over subjects (id, name, sha256)."""
    one = F.struct("name", F.create_map(F.lit("sha256"), "sha256").alias("digest"))
    packed = subjects.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "sha256"))).alias("s"))
    body = F.struct(F.lit("https://in-toto.io/Statement/v1").alias("_type"), F.transform("s", lambda x: F.struct(x["name"].alias("name"), F.create_map(F.lit("sha256"), x["sha256"]).alias("digest"))).alias("subject"), F.lit(predicate_type).alias("predicateType"), (predicate if predicate is not None else F.struct(F.size("s").alias("subjects"))).alias("predicate"))
    return packed.select("id", F.to_json(body).alias("document"))


def witness(operations: DataFrame) -> DataFrame:
    """id, part (material or product), path, hash: of reads and of writes with a hash the last one of a path.

    operations: id, ord, kind (read, write, create), path, hash.
    """
    part = F.when(F.col("kind") == "read", "material").when(F.col("kind").isin("write", "create"), "product")
    rows = operations.withColumn("part", part).where("part is not null and hash is not null")
    return rows.groupBy("id", "part", "path").agg(F.max_by("hash", "ord").alias("hash"))


def _pointer(text: str) -> list[str]:
    if text == "":
        return []
    if not text.startswith("/"):
        raise KeyError(text)
    return [p.replace("~1", "/").replace("~0", "~") for p in text[1:].split("/")]


def _at(doc, path: list[str]):
    for p in path:
        doc = doc[int(p)] if isinstance(doc, list) else doc[p]
    return doc


def _put(doc, path: list[str], value, insert: bool):
    if not path:
        return value
    home, last = _at(doc, path[:-1]), path[-1]
    if isinstance(home, list):
        at = len(home) if last == "-" else int(last)
        if at > len(home) or at < 0 or not insert and at >= len(home):
            raise KeyError(last)
        home.insert(at, value) if insert else home.__setitem__(at, value)
    else:
        if not insert and last not in home:
            raise KeyError(last)
        home[last] = value
    return doc


def _take(doc, path: list[str]):
    home = _at(doc, path[:-1])
    return home.pop(int(path[-1])) if isinstance(home, list) else home.pop(path[-1])


def apply_patch(document: str, patch: str, source: str | None = None) -> str:
    """The document after the operations of an RFC 6902 patch, in order; a failed test or a missing place raises ValueError.

    source: noted as a property of the document's metadata, once for each patch.
    """
    doc = json.loads(document)
    try:
        for op in json.loads(patch):
            kind, path = op["op"], _pointer(op["path"])
            if kind in ("add", "replace"):
                doc = _put(doc, path, op["value"], kind == "add")
            elif kind == "remove":
                _take(doc, path)
            elif kind in ("move", "copy"):
                start = _pointer(op["from"])
                if kind == "move" and path[: len(start)] == start and path != start:
                    raise KeyError(op["path"])
                value = _take(doc, start) if kind == "move" else json.loads(json.dumps(_at(doc, start)))
                doc = _put(doc, path, value, True)
            elif kind == "test":
                if _at(doc, path) != op["value"]:
                    raise KeyError(op["path"])
            else:
                raise KeyError(kind)
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError(f"patch can't be applied: {e}") from e
    if source is not None and isinstance(doc, dict):
        doc.setdefault("metadata", {}).setdefault("properties", []).append({"name": "sbom:enrichment-patch", "value": source})
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(STRING)
def patched(document: pd.Series, patch: pd.Series) -> pd.Series:
    """apply_patch a row; null documents stay null, null patches change nothing."""
    return pd.Series([d if d is None or p is None else apply_patch(d, p) for d, p in zip(document, patch, strict=True)])
