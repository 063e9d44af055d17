"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of the items' words is built once per block of items. Training texts stream through it: after each
word it holds the longest suffix of the text that occurs in some item. Wherever that length reaches a window
(13 words, or a whole shorter item) the words of the window are hit, and the items that hold the window are noted.

Before that, numpy drops what cannot hit: words outside the items' vocabulary and runs whose word pairs do not
all occur in items. Both tests are implied by a window's occurrence, so nothing is lost.

Null or empty texts have no words; an item without words has no window; equal items each count. The items are a
stated test set: they are dealt into blocks of about `block_words` words, and documents stream through the blocks
one after the other, so that each worker holds the automaton of one block. Columns of the input may have any names
but those that begin with tf_.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, hash_words, text_slices

WINDOW = 13


def normal_words(text: str | None) -> list[bytes]:
    """The contract's words of one text, A-Z lower-cased, as UTF-8."""
    raw = (text or "").encode().lower()
    return raw.translate(bytes(32 if i in NOT_ALNUM else i for i in range(256))).split()


class SuffixAutomaton:
    """A generalised suffix automaton over word ids, with the items of each window at the window's state.

    link, length, step: suffix link, longest length and transitions of each state. owners: (state, window length)
    to the items that hold that window. short: for each state the nearest state on its link path (itself included)
    that ends a window shorter than WINDOW.
    """

    def __init__(self, items: list[tuple[object, list[int]]], window: int = WINDOW) -> None:
        self.window = window
        self.link, self.length, self.step = [-1], [0], [{}]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.owners: dict[tuple[int, int], set] = {}
        ends: set[int] = set()
        for item, words in items:
            size = min(window, len(words))
            state = matched = 0
            for w in words:
                state, matched = self.advance(state, matched, w)
                if matched >= size:
                    at = self.suffix(state, size)
                    self.owners.setdefault((at, size), set()).add(item)
                    if size < window:
                        ends.add(at)
        self.short = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.short[s] = s if s in ends else self.short[self.link[s]] if s else -1
        self.sizes: dict[int, list[int]] = {}
        for at, n in self.owners:
            if n < window:
                self.sizes.setdefault(at, []).append(n)

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings up to length[p] + 1; p's path is turned to it."""
        copy = len(self.link)
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.step.append(dict(self.step[q]))
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (q := self.step[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = len(self.link)
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.step.append({})
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def advance(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The state and matching length after one more word."""
        while state and w not in self.step[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.step[state].get(w)
        return (0, 0) if to is None else (to, matched + 1)

    def suffix(self, state: int, size: int) -> int:
        """The state on the link path that holds the suffix of this size."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """(start, end) of the windows that occur in a run of word ids (unmerged), and their items."""
        spans, items = [], set()
        state = matched = 0
        for i, w in enumerate(words):
            state, matched = self.advance(state, matched, w)
            if matched >= self.window and (own := self.owners.get((self.suffix(state, self.window), self.window))):
                spans.append((i + 1 - self.window, i + 1))
                items |= own
            at = self.short[state]
            while at >= 0:
                for size in self.sizes[at]:
                    if size <= matched:
                        spans.append((i + 1 - size, i + 1))
                        items |= self.owners[at, size]
                at = self.short[self.link[at]] if at else -1
        return spans, items


class Block:
    """A block of items with what the numpy sieve needs: sorted word hashes, sorted pair hashes, shortest window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        lists = [(i, normal_words(t)) for i, t in items]
        lists = [(i, ws) for i, ws in lists if ws]
        vocabulary = sorted({w for _, ws in lists for w in ws})
        hashes = hash_words(vocabulary)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        ids = {vocabulary[j]: n for n, j in enumerate(order)}
        coded = [(i, [ids[w] for w in ws]) for i, ws in lists]
        size = np.int64(len(vocabulary) + 1)
        self.size = size
        self.pairs = np.unique(np.array([a * size + b for _, ws in coded for a, b in zip(ws, ws[1:], strict=False)], np.int64))
        self.shortest = min((min(window, len(ws)) for _, ws in coded), default=0)
        self.automaton = SuffixAutomaton(coded, window)

    def runs(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, text, word ids) of each run that could hold a window."""
        if not len(self.hashes) or not len(hashes):
            return
        ids = np.searchsorted(self.hashes, hashes)
        ids[ids == len(self.hashes)] = 0
        known = self.hashes[ids] == hashes
        text = np.repeat(np.arange(len(words.first) - 1), words.counts())
        joined = np.zeros(len(ids), bool)  # the word goes on from the one before
        joined[1:] = known[1:] & known[:-1] & (text[1:] == text[:-1])
        at = np.flatnonzero(joined)
        if len(at):
            pair = ids[at - 1] * self.size + ids[at]
            where = np.searchsorted(self.pairs, pair)
            where[where == len(self.pairs)] = 0
            joined[at] = self.pairs[where] == pair if len(self.pairs) else False
        starts = np.flatnonzero(known & ~joined)
        ends = np.append(starts[1:], len(ids))
        if not len(starts):
            return
        lengths = np.add.reduceat(known.astype(np.int64), starts)
        lengths = np.minimum(lengths, ends - starts)
        # known words after a gap start runs of their own, so those of a run are consecutive
        for s, n in zip(starts[lengths >= self.shortest], lengths[lengths >= self.shortest], strict=True):
            yield int(s), int(text[s]), ids[s : s + n].tolist()


def item_blocks(items: DataFrame, block_words: int, key: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of about block_words words; rows come to the driver partition by partition."""
    block, words = [], 0
    for row in items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        block.append((row.k, row.t))
        words += len(normal_words(row.t))
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def match_items(docs: DataFrame, items: DataFrame, *, key: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = 100_000) -> DataFrame:
    """docs with tf_n_words, tf_hit_spans (array of start and end words, merged) and tf_hit_items (array of strings)."""
    names = docs.columns
    out = docs.select("*", F.lit(None).cast("bigint").alias("tf_n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("tf_hit_spans"), F.array().cast("array<string>").alias("tf_hit_items"))
    schema = out.schema
    for part in list(item_blocks(items, block_words, key, text)) or [[]]:

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            block = Block(part, window)
            for batch in text_slices(batches):
                words = Words(batch.column("text"), NOT_ALNUM)
                spans, found = batch.column("tf_hit_spans").to_pylist(), batch.column("tf_hit_items").to_pylist()
                for first, row, ids in block.runs(words, words.hashes()):
                    hit, own = block.automaton.hits(ids)
                    if hit:
                        base = first - int(words.first[row])
                        more = [{"start": base + s, "end": base + e} for s, e in merged(hit)]
                        spans[row] = [{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in [*(spans[row] or ()), *more]])]
                        found[row] = sorted({*(found[row] or ()), *own}, key=lambda x: (x is None, x or ""))
                cols = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words.counts(), pa.int64()), pa.array([x or [] for x in spans], _SPANS), pa.array([x or [] for x in found], pa.list_(pa.string()))], names=[*names, "tf_n_words", "tf_hit_spans", "tf_hit_items"])

        out = out.mapInArrow(run, schema)
    return out


def hit_columns() -> dict:
    hit = F.aggregate("tf_hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return {"n_hit": hit, "contaminated": (hit > 0) & (20 * hit >= F.col("tf_n_words"))}


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's digest for each document.

    Items without an id count as one item, which the digest of ids leaves out.
    """
    found = match_items(docs.select("doc_id", "text"), items)
    hit = hit_columns()
    return found.select(
        "doc_id", F.col("tf_n_words").alias("n_words"), hit["n_hit"].alias("n_hit"), F.size("tf_hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("tf_hit_items"), ","), 256).alias("items_sha256"), hit["contaminated"].alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]], longest: int) -> str:
    """The text without the hit spans of more than `longest` words, from each span's first word to its last."""
    raw = text.encode()
    words = Words(pa.array([text]), NOT_ALNUM)
    out, at = [], 0
    for s, e in spans:
        if e - s > longest:
            out.append(raw[at : words.start[s]])
            at = int(words.end[e - 1])
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(docs: DataFrame, items: DataFrame, *, longest: int = WINDOW - 1) -> DataFrame:
    """docs with hit spans of more than `longest` words cut from their texts, and documents over the coverage limit gone.

    The columns are those of docs.
    """
    found = match_items(docs, items)
    keep = found.where(~hit_columns()["contaminated"])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in text_slices(batches):
            spans = batch.column("tf_hit_spans").to_pylist()
            texts = [without_spans(t, [(x["start"], x["end"]) for x in s], longest) if t and s else t for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return keep.mapInArrow(run, docs.schema)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones; those that stay are unchanged."""
    return match_items(docs, items).where(~hit_columns()["contaminated"]).select(*docs.columns)
