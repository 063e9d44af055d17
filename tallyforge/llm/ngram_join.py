"""Exact join of documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

Jaccard distance is a metric. Its balls say little about sparse sets when pivots are documents: unrelated documents are
at distance 1 from nearly every pivot, so that windows around Voronoi borders would replicate everything (README).
Pivots are therefore taken where distances differ, in two levels:

1. Pivots {s}, one for each 5-gram s. A document A is at distance 1 - 1/|A| from the pivots it contains and at 1 from the
   others; ties are broken by one global order (common 5-grams last, then by hash), which makes its first 5-gram its Voronoi
   cell. A set within distance t = 0.2 of A lacks at most t|A| of A's 5-grams, so replicating A to the cells of its first
   floor(t|A|) + 1 pivots is the window that meets every partner.
   The place of the cell's pivot among A's own bounds the sizes of partners that A can have there, so that rows of a
   cell meet only within each other's reach, and most cells of common 5-grams hold no two rows that do.
2. Within a cell the pivot is, of the documents whose reach covers their own size, the one that stands in most cells. Distances to it are computed exactly. Documents
   in one component need no further test among themselves; documents whose distances to the pivot differ by more than t
   cannot be linked (triangle inequality); the pivot leaves and the rest of the cell is joined in the same way, until
   the pairs that may remain are few beside the cells' rows and are tested one by one.

Before a test the parity maps of both sets (about two bits for each shingle) are compared: where they differ, the sets
do, and pairs that differ too much go no further. Every test is exact on the sets (as 64-bit hashes of 5-grams); no pair of different sets within t is lost, whatever
the sizes of cells. Equal sets are one class from the start. The order of 5-grams only steers the cost: 5-grams that are
frequent in some batch are counted over all documents, and at most `most_common` of them are sent to the workers.

Null and empty texts have no set (0 shingles) and stay alone. Repeated rows each give a row. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, Words, mixed, stored, text_slices
from .graph import components

GRAM = 5
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, sorted within the text; where each text's begin, and the end)."""
    words = Words(column, WHITE)
    own = words.hashes()
    counts = words.counts()
    runs = np.where(counts >= GRAM, counts - GRAM + 1, np.minimum(counts, 1))
    edges = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(edges[-1]), np.uint64)
    with np.errstate(over="ignore"):
        long = counts >= GRAM
        at = np.arange(edges[-1]) - np.repeat(edges[:-1], runs) + np.repeat(words.first[:-1], runs)
        full = np.repeat(long, runs)
        for k in range(GRAM):
            out[full] += own[at[full] + k] * _SALTS[k]
        for i in np.flatnonzero((counts > 0) & ~long):
            part = own[words.first[i] : words.first[i + 1]]
            out[edges[i]] = (part * _SALTS[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
        out = mixed(out)
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if e - s > 1:
            out[s:e].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[edges[:-1][runs > 0]] = True
    edges = np.concatenate([[0], np.cumsum(new)])[edges]
    return out[new], edges


def signatures(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit signature of each text's set (0 where it is empty)."""
    size = np.diff(edges)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(sets), dtype=np.uint64)])
        own = mixed(total[edges[1:]] - total[edges[:-1]] + size.astype(np.uint64) * _SALTS[0])
    return np.where(size > 0, own, np.uint64(0)).view(np.int64)


def dealt(docs: DataFrame, task_bytes: int) -> tuple[DataFrame, int | None]:
    """docs in tasks of about task_bytes of stored input or more, without a shuffle; how many at most, if it is known."""
    tasks = max(1, -(-docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // task_bytes))
    return (docs.coalesce(tasks), tasks) if tasks < 1 << 20 else (docs, None)  # sizes that Spark doesn't know are huge


def common_shingles(docs: DataFrame, least: int, most_common: int, in_batch: int = 2, at_once: int = 6_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; ranks by rising count) of shingles that `in_batch` texts of a batch share and `least` of all.

    Every document is counted; a batch holds about at_once shingles, however the table is dealt. A shingle that never
    reaches in_batch texts in one batch may be missed, as those beyond the `most_common` most frequent are: then it is
    ordered as a rare one, which costs time but loses nothing.
    """

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        sets = np.concatenate(parts)
        sets.sort()
        # runs of equal hashes of in_batch or more
        keys = np.unique(sets[in_batch - 1 :][sets[in_batch - 1 :] == sets[: len(sets) - in_batch + 1]]) if len(sets) >= in_batch else sets[:0]
        n = np.searchsorted(sets, keys, side="right") - np.searchsorted(sets, keys, side="left")
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in text_slices(batches):
            parts.append(shingle_sets(batch.column("text"))[0])
            held += len(parts[-1])
            if held >= at_once:
                yield counted(parts)
                parts, held = [], 0
        if parts:
            yield counted(parts)

    rows, tasks = dealt(docs.select("text"), 4 << 20)
    found = rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = stored(found.where(F.col("n") >= least).withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "common", tasks and 500_000 * tasks)
    floor = held = 0
    for r in found.groupBy("level").agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect():  # some hundred levels at most
        if held and held + r.c > most_common:
            break
        floor, held = r.level, held + r.c
    rows = found.where(F.col("level") >= floor).select("h", "n").limit(most_common).toArrow()
    keys, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    rank = np.empty(len(keys), np.int32)
    rank[np.lexsort((keys, n))] = np.arange(1, len(keys) + 1)
    order = np.argsort(keys)
    return keys[order], rank[order]


def cells(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """doc_id, n, sig, and for the first text of a batch with that set its pivots, rare and common (arrays of hashes), and its parity map."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = sent.value
        some = np.zeros(1 << 24, bool)  # the first bits of common shingles, so that few others are looked up
        some[keys >> np.uint64(40)] = True
        for big in text_slices(batches, 64 << 20):
            seen: set[int] = set()
            for batch in text_slices(iter([big])):
                sets, edges = shingle_sets(batch.column("text"))
                sig, size = signatures(sets, edges), np.diff(edges)
                order = np.zeros(len(sets), np.int32)
                maybe = np.flatnonzero(some[sets >> np.uint64(40)])
                where = np.searchsorted(keys, sets[maybe])
                where[where == len(keys)] = 0
                order[maybe] = np.where(keys[where] == sets[maybe], rank[where], 0) if len(maybe) else 0
                take = size - -(-size * percent // 100) + 1
                rare, common_own, repeats = [], [], np.zeros(len(size), bool)
                for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    if s == e or int(sig[i]) in seen:
                        rare.append(None)
                        common_own.append(None)
                        repeats[i] = True
                        continue
                    seen.add(int(sig[i]))
                    own, o = sets[s:e], order[s:e]
                    light = own[o == 0][: take[i]]
                    rare.append(light.view(np.int64))
                    heavy = np.flatnonzero(o > 0)
                    common_own.append(own[heavy[np.argsort(o[heavy])]][: take[i] - len(light)].view(np.int64))
                kind = pa.list_(pa.int64())
                maps = pc.if_else(pa.array(repeats), pa.scalar(None, kind), parity_maps(sets, edges))
                columns = [batch.column("doc_id"), pa.array(size), pa.array(sig), pa.array(rare, kind), pa.array(common_own, kind), maps]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "rare", "common", "map"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n long, sig long, rare array<bigint>, common array<bigint>, map array<bigint>")


def reach(n: Column, pos: Column, percent: int) -> Column:
    """The size up to which sets may be within reach of one with n shingles if its place pos is the first common one.

    A linked pair meets in the cell of its first common shingle with both sizes within the other's reach. Sets whose
    reach is below their own size can only meet smaller ones.
    """
    return F.floor((100 + percent) * (n - pos) / percent).cast("bigint") - n


def crowded(table: DataFrame, percent: int) -> DataFrame:
    """h, sig, n, hi: the rows of cells in which two or more classes may meet; hi is how far the row reaches there.

    Cells of rare shingles are met in one shuffle by h. Cells of common shingles, which may hold any share of all
    rows, are summed map-side first and joined with the (bounded) list of those in which classes may meet.
    """
    rare = table.select(F.posexplode("rare").alias("pos", "h"), "sig", "n")
    rare = rare.select("h", "sig", "n", reach(F.col("n"), F.col("pos"), percent).alias("hi"))
    often = table.select(F.posexplode("common").alias("pos", "h"), "sig", "n", F.size("rare").alias("before"))
    often = often.select("h", "sig", "n", reach(F.col("n"), F.col("pos") + F.col("before"), percent).alias("hi"))
    by = Window.partitionBy("h")
    least = F.min(F.when(F.col("hi") >= F.col("n"), F.col("n")))
    two = {"lo": F.min("sig").over(by), "hi_sig": F.max("sig").over(by)}
    rare = rare.withColumns(two | {"least": least.over(by)}).where((F.col("lo") < F.col("hi_sig")) & (F.col("hi") >= F.col("least")))
    rare = rare.groupBy("h", "sig").agg(F.max("n").alias("n"), F.max("hi").alias("hi")).withColumns(two).where(F.col("lo") < F.col("hi_sig"))
    met = often.groupBy("h").agg(least.alias("least"), F.min("sig").alias("lo"), F.max("sig").alias("hi_sig")).where((F.col("lo") < F.col("hi_sig")) & F.col("least").isNotNull())
    often = often.join(F.broadcast(met.select("h", "least")), "h").where(F.col("hi") >= F.col("least")).groupBy("h", "sig").agg(F.max("n").alias("n"), F.max("hi").alias("hi"))
    return rare.select("h", "sig", "n", "hi").unionByName(often.select("h", "sig", "n", "hi"))


def sets_of(docs: DataFrame, ids: DataFrame, most_sent: int) -> DataFrame:
    """sig and set (array of hashes) of the documents whose doc_id is in ids.

    Up to most_sent ids are broadcast, so that texts aren't shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets, edges = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(signatures(sets, edges)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(sets.view(np.int64)))], names=["sig", "set"])

    own = small(ids.select(F.col("doc_id").alias("own_id")), most_sent)
    return docs.select("doc_id", "text").join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi").select("text").mapInArrow(run, "sig long, set array<bigint>")


def parity_maps(sets: np.ndarray, edges: np.ndarray) -> pa.Array:
    """For each text the parities of how many of its shingles fall on each of m places, in words of 64 bits.

    m is the least power of two that isn't below the set's size (64 at least). A shingle that two sets share falls on one
    place in both, so that maps which differ in k places belong to sets which differ in k shingles or more.
    """
    size = np.diff(edges)
    places = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(places)])
    at = np.repeat(begin[:-1], size) + (sets & np.repeat(places - 1, size).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(begin[-1])) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(begin // 64, pa.int32()), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def folded(a: Column, b: Column) -> Column:
    """a's map, with its halves laid on each other where it has twice the places of b's."""
    half = F.size(b)
    return F.when(F.size(a) == 2 * half, F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(a)


def possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, sig) whose parity maps don't already differ in more places than linked sets may differ in shingles.

    Sets of na and nb shingles within reach differ in (100 - percent) / (100 + percent) of na + nb at most. Their sizes
    are so near that one map has at most twice the places of the other.
    """
    x = maps.select("sig", F.col("n").alias("na"), F.col("map").alias("a"))
    y = maps.select(F.col("sig").alias("p"), F.col("n").alias("nb"), F.col("map").alias("b"))
    apart = F.zip_with(folded(F.col("a"), F.col("b")), folded(F.col("b"), F.col("a")), lambda s, t: F.bit_count(s.bitwiseXOR(t)))
    differ = F.aggregate(apart, F.lit(0), lambda s, k: s + F.coalesce(k, F.lit(0)))
    return pairs.join(x, "sig").join(y, "p").where((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).select("p", "sig")


def tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """p, sig, distance, linked for pairs (p, sig) of classes, by the intersection of their sets."""
    x = sets.select("sig", F.col("set").alias("a"))
    y = sets.select(F.col("sig").alias("p"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("bigint")
    out = pairs.join(x, "sig").join(y, "p").select("p", "sig", both.alias("both"), (F.size("a") + F.size("b") - both).alias("either"))
    return out.select("p", "sig", (1 - F.col("both") / F.col("either")).alias("distance"), (100 * F.col("both") >= percent * F.col("either")).alias("linked"))


def meet(a: str, b: str) -> Column:
    """Whether rows a and b of a cell are within each other's reach."""
    return (F.col(f"{a}n") <= F.col(f"{b}hi")) & (F.col(f"{b}n") <= F.col(f"{a}hi"))


def open_cells(rows: DataFrame) -> DataFrame:
    """h, most: the cells in which rows of two components may meet, and a bound on the pairs there."""
    one = F.when(F.col("hi") >= F.col("n"), 1).otherwise(0)
    each = rows.groupBy("h", "comp").agg(F.count("*").alias("c"), F.sum(one).alias("i"))
    cells = each.groupBy("h").agg((F.sum("c") * F.sum("i") - F.sum(F.col("c") * F.col("i"))).alias("most"))
    return cells.where("most > 0")


def small(ids: DataFrame, most: int) -> DataFrame:
    """ids, marked for broadcast if they are at most `most` rows."""
    return F.broadcast(ids) if ids.count() <= most else ids


def class_components(docs: DataFrame, table: DataFrame, percent: int, few: float = 2.0, most_sent: int = 2_000_000) -> DataFrame | None:
    """node, component of every class that is linked with another; None if no cell holds two classes.

    Parity maps are shuffled only for classes in pairs. Up to `most_sent` of these, of tested pairs, cells and linked classes
    are broadcast to the tables they are joined with (their number is checked); more are joined by a shuffle.
    """
    places = table.agg(F.sum(F.coalesce(F.size("rare") + F.size("common"), F.lit(0)))).first()[0] or 0
    rows = stored(crowded(table, percent).withColumns({"comp": F.col("sig"), "distance": F.lit(None).cast("double")}), "cells", places)
    total = rows.count()
    if not total:
        return None
    # in how many cells a class is: one that many are near to shares its 5-grams with more of them than they do
    weight = small(stored(rows.groupBy("sig").agg(F.count("*").alias("w")), "weights", total), most_sent)
    links: list[DataFrame] = []
    slack = (100 - percent) / 100 + 1e-9

    def settle(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        pairs = stored(pairs, "met", most)
        n = 2 * pairs.count()
        met = stored(pairs.select(F.explode(F.array("p", "sig")).alias("sig")).distinct(), "classes", n)
        own = table.where(F.col("rare").isNotNull()).join(small(met, most_sent), "sig", "left_semi")
        maps = stored(own.groupBy("sig").agg(F.min("n").alias("n"), F.first("map").alias("map"), F.min("doc_id").alias("doc_id")), "maps", n)
        able = stored(possible(small(pairs, most_sent), maps, percent), "pairs", n)
        # one document stands for each class
        ids = stored(maps.join(able.select(F.explode(F.array("p", "sig")).alias("sig")), "sig", "left_semi").select("sig", "doc_id"), "ids", n)
        sets = sets_of(docs, ids, most_sent).join(small(ids.select("sig"), most_sent), "sig", "left_semi").groupBy("sig").agg(F.first("set").alias("set"))
        found = stored(tested(small(able, most_sent), stored(sets, "sets", n, 20_000), percent), "tested", n, 20_000)
        links.append(found.where("linked").select(F.col("p").alias("u"), F.col("sig").alias("v")))
        return found, stored(components(reduce(DataFrame.unionByName, links)), "comps")

    while True:
        index = rows.where(F.col("hi") >= F.col("n")).join(weight, "sig")
        pivots = index.groupBy("h").agg(F.max(F.struct("w", "sig", "n", "hi", "comp")).alias("pivot"))
        pivots = pivots.select("h", F.col("pivot.sig").alias("p"), F.col("pivot.n").alias("p_n"), F.col("pivot.hi").alias("p_hi"), F.col("pivot.comp").alias("p_comp"))
        live = stored(rows.join(small(stored(pivots, "pivots", total), most_sent), "h").where(F.col("sig") != F.col("p")), "live", total)
        pairs = live.where((F.col("comp") != F.col("p_comp")) & meet("", "p_")).select("p", "sig").distinct()
        found, comps = settle(pairs, total)
        own = small(comps.select(F.col("node").alias("sig"), "component"), most_sent)
        after = live.drop("comp", "distance").join(small(found.select("p", "sig", "distance"), most_sent), ["p", "sig"], "left").join(own, "sig", "left")
        after = stored(after.select("h", "sig", "n", "hi", F.coalesce("component", "sig").alias("comp"), "distance"), "after", total)
        cells = stored(open_cells(after), "open", total)
        rows = stored(after.join(small(cells.select("h"), most_sent), "h", "left_semi"), "cells", total)
        left = cells.agg(F.sum("most")).first()[0] or 0
        if not left:
            return comps
        if left <= few * total:
            a, b = rows.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns)), rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns))
            apart = F.coalesce(F.abs(F.col("a_distance") - F.col("b_distance")) > slack, F.lit(False))
            pairs = a.join(b, (F.col("a_h") == F.col("b_h")) & (F.col("a_sig") < F.col("b_sig")) & (F.col("a_comp") != F.col("b_comp")) & meet("a_", "b_") & ~apart)
            return settle(pairs.select(F.col("a_sig").alias("p"), F.col("b_sig").alias("sig")).distinct(), left)[1]


def groups(docs: DataFrame, *, percent: int = 80, common_least: int = 4, most_common: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, class_id (the set's signature, null without a set) and label, the component's, for each row."""
    common = common_shingles(docs, common_least, most_common)
    table = stored(cells(docs, common, percent), "sets")
    comps = class_components(docs, table, percent)
    own = table.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("class_id"))
    if comps is None:
        return own.withColumn("label", F.col("class_id"))
    named = small(comps.select(F.col("node").alias("class_id"), "component"), 2_000_000)
    return own.join(named, "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("label"))


def similarity_components(docs: DataFrame, **options: int) -> DataFrame:
    """The contract's rows: doc_id, n_shingles, component_id; class_id (the set's signature, null without a set) beside them."""
    labelled = groups(docs, **options)
    least = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    out = labelled.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "class_id")


def signed(docs: DataFrame) -> DataFrame:
    """docs with tf_class: the signature of each text's set, null where it is empty."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            own = signatures(*shingle_sets(part.column("text")))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(own, mask=own == 0)], names=[*names, "tf_class"])

    return docs.mapInArrow(run, docs.withColumn("tf_class", F.lit(None).cast("bigint")).schema)


def one_of_each(docs: DataFrame, *, most_sent: int = 2_000_000, **options: int) -> DataFrame:
    """docs with one row kept of each component: of the least doc_id (null counts as the largest), then of the least class.

    Up to `most_sent` ids to drop are broadcast (their number is checked), so that texts aren't shuffled; more are joined.
    Rows whose doc_id is null or repeated are told apart by their texts' classes: of those with equal doc_id and class
    one stays, so that a text no other row is near to is never lost. Texts without a set stay, repeated rows of them once.
    """
    found = stored(groups(docs, **options), "groups")
    key = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", F.col("class_id").alias("c"))
    best = found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(key).alias("best"))
    judged = found.join(best, "label", "left").select("doc_id", "class_id", F.coalesce(key == F.col("best"), F.lit(True)).alias("stays"))
    ids = stored(judged.groupBy("doc_id").agg((F.count("*") > 1).alias("again"), F.bool_and("stays").alias("stays")), "ids")
    again = ids.where(F.col("again") | F.col("doc_id").isNull())
    drop = ids.where(F.col("doc_id").isNotNull() & (F.col("again") | ~F.col("stays"))).select("doc_id")
    kept = docs.where(F.col("doc_id").isNotNull()).join(small(drop, most_sent), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    own = small(again.select(F.col("doc_id").alias("own_id")), most_sent)
    rows = signed(docs.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi"))
    stay = judged.where("stays and class_id is not null").select(F.col("doc_id").alias("own_id"), F.col("class_id").alias("own_class")).distinct()
    stay = rows.where("tf_class is not null").join(stay, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tf_class") == F.col("own_class")), "left_semi").dropDuplicates(["doc_id", "tf_class"])
    empty = rows.where("tf_class is null").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(stay.unionByName(empty).select(*docs.columns))
