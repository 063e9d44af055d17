"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features are numbers of the text alone: densities of two lexicons, how close their words stand to second-person words, and
rates of capitals, punctuation and obfuscation. One lexicon is fixed (as written, and after undoing digits and signs
put for letters); the other holds the words and word beginnings of 4 to 7 bytes that mark toxic rows of the sample, by
a likelihood ratio, so that inflected words of any language are met. Lexicon and trees are fitted on at most `sample`
labelled rows (the ones with the smallest hash of doc_id, held-out rows excluded), a fifth of which calibrate the
scores. Features, scores and decisions are made for every document.

Null and empty texts have zero features and are scored like others; texts of any length are read whole. Repeated rows each
give a row; an empty table gives none. Equal features give equal scores. Labels that are null are ignored; a doc_id labelled twice
takes the larger label. Without any labels, or with labels of one kind, the score is that kind's share (0 without
labels). Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, hash_words, held_out, mixed, text_slices, utf8

#: Insults, and words of address.
LEXICON = (
    "asshole bastard bitch bullshit clown coward crap creep cretin cunt damn dickhead dimwit disgusting dumb dumbass "
    "filth fool freak fuck fucking garbage hateful hypocrite idiot idiotic imbecile jerk lame liar loser lunatic moron moronic "
    "nitwit pathetic pig prick psycho rat retard scum scumbag shit shut sick slut stupid sucker swine trash twat "
    "ugly useless vermin vile weirdo whore worthless "
    "arsch arschloch blödmann depp dreckig dummkopf idiota imbécil estúpido estúpida basura cabrón mierda pendejo puta "
    "abruti connard crétin débile merde ordure salaud salope scheiße trottel vollidiot"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted vosotros".split()

FEATURES = (
    "log_words", "lexicon_count", "lexicon_density", "undone_count", "undone_density", "distinct_lexicon", "second_person_rate", "near_second_person",
    "learned_count", "learned_density", "learned_distinct", "capital_rate", "capital_words", "exclamation_rate", "question_rate", "other_sign_rate", "mixed_word_rate", "mean_word",
)

_WORD_BREAK = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: What is put for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


def _plain_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs between white space: the hash of their letters after undoing _LEET, and whether that changed anything.

    Signs count as letters only before another letter or digit of the run ("$tupid", but not "stupid$$$").
    """
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    table = np.zeros(256, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    solid = table > 0
    solid[48:58] = True
    for c, letter in _LEET.items():
        table[ord(c)] = ord(letter)
    sign = np.zeros(256, bool)
    sign[[ord(c) for c in "@$!"]] = True
    out, odd = np.empty(len(start), np.uint64), np.empty(len(start), bool)
    block = 1 << 17
    for at in range(0, len(start), block):
        s, e = start[at : at + block], end[at : at + block]
        size = e - s
        ends = np.cumsum(size)
        firsts = ends - size
        own = data[np.arange(ends[-1]) - np.repeat(firsts, size) + np.repeat(s, size)]
        letter = table[own]
        follows = np.zeros(len(own), bool)
        follows[:-1] = solid[own[1:]]
        follows[ends - 1] = False
        keep = (letter > 0) & (~sign[own] | follows)
        count = np.cumsum(keep)
        before = np.concatenate([[0], count])[firsts]
        place = count - 1 - np.repeat(before, size)
        length = count[ends - 1] - before
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(max(1, int(size.max())), 0x9E3779B97F4A7C15, np.uint64))
            terms = np.where(keep, (letter.astype(np.uint64) + np.uint64(1)) * power[np.maximum(place, 0)], np.uint64(0))
            h = np.add.reduceat(terms, firsts) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out[at : at + block] = mixed(h)
        changed = keep & (letter != own) & ~((own >= 65) & (own <= 90))
        inner = ~keep & follows & (place >= 0)
        odd[at : at + block] = np.add.reduceat((changed | inner).astype(np.int32), firsts) > 0
    return out, odd


def _isin(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(of, hashes)
    at[at == len(of)] = 0
    return of[at] == hashes


def word_keys(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words' places, keys): the whole words' hashes, then their first 4 to 7 bytes, packed with that number."""
    yield np.arange(len(words.start)), words.hashes()
    size = words.end - words.start
    at = np.flatnonzero(size >= 4)
    key = np.zeros(len(at), np.uint64)
    for k in range(7):
        if k >= 4:
            far = size[at] > k
            at, key = at[far], key[far]
        key |= words.data[words.start[at] + k].astype(np.uint64) << np.uint64(8 * k)
        if k >= 3:
            yield at, key | np.uint64(k + 1) << np.uint64(56)


def lowered(column: pa.Array) -> Words:
    """Words of letters and bytes over 127, found before lower-casing A-Z."""
    return Words(column, _WORD_BREAK)


def features(column: pa.Array, learned: np.ndarray | None = None) -> np.ndarray:
    """A row of FEATURES for each text. learned: the sorted keys of the learned lexicon."""
    learned = np.zeros(0, np.uint64) if learned is None else learned
    words = lowered(column)
    n = len(words.offsets) - 1
    out = dict.fromkeys(FEATURES, np.zeros(n))
    raw, _ = utf8(column)
    if not len(raw):
        return np.zeros((n, len(FEATURES)))
    lexicon, second = (np.sort(hash_words([w.encode() for w in ws])) for ws in (LEXICON, SECOND_PERSON))
    counts = words.counts()
    text_of, count = np.repeat(np.arange(n), counts), np.maximum(counts, 1)
    per = lambda of, weights=None: np.bincount(of, weights, minlength=n).astype(float)
    firsts = np.minimum(words.offsets[:-1], len(raw))
    by_byte = lambda mask: (np.add.reduceat(np.append(mask, False).astype(np.int32), firsts) * (words.offsets[1:] > words.offsets[:-1])).astype(float)
    known = np.zeros(len(text_of), bool)
    for k, (at, keys) in enumerate(word_keys(words)):
        if k == 0:
            bad, you, hashes = _isin(keys, lexicon), _isin(keys, second), keys
        if len(learned):
            known[at[_isin(keys, learned)]] = True
    marked = np.flatnonzero(bad | known)
    upper = (raw >= 65) & (raw <= 90)
    total = np.concatenate([[0], np.cumsum(upper)])
    capitals = total[words.end] - total[words.start]
    runs = Words(column, _WHITE, lower=False)
    run_text = np.repeat(np.arange(n), runs.counts())
    undone, odd = _plain_hashes(raw, runs.start, runs.end)
    hidden = _isin(undone, lexicon) & odd
    signs = np.zeros(256, bool)
    signs[[ord(c) for c in "#*$%&|<>@^~_"]] = True

    out["log_words"] = np.log1p(counts)
    out["lexicon_count"] = per(text_of[bad])
    out["undone_count"] = per(run_text[hidden])
    out["learned_count"] = per(text_of[known])
    for name in ("lexicon", "undone", "learned"):
        out[f"{name}_density"] = 100 * out[f"{name}_count"] / count
    for name, mask in (("distinct_lexicon", bad), ("learned_distinct", known)):
        if mask.any():
            out[name] = per(np.unique(np.stack([text_of[mask].astype(np.uint64), hashes[mask]]), axis=1)[0].astype(np.int64))
    near = np.flatnonzero(you)
    if len(marked) and len(near):
        left = np.clip(np.searchsorted(near, marked) - 1, 0, len(near) - 1)
        right = np.minimum(left + 1, len(near) - 1)
        gap = np.minimum(*(np.where(text_of[near[side]] == text_of[marked], np.abs(near[side] - marked), 99) for side in (left, right)))
        out["near_second_person"] = per(text_of[marked], (gap < 20) / (1 + np.minimum(gap, 20)))
    out["second_person_rate"] = 100 * per(text_of[you]) / count
    out["capital_rate"] = by_byte(upper) / np.maximum(by_byte(((raw | 32) >= 97) & ((raw | 32) <= 122)), 1)
    out["capital_words"] = 100 * per(text_of[(capitals >= 3) & (capitals == words.end - words.start)]) / count
    out["exclamation_rate"] = 100 * by_byte(raw == 33) / count
    out["question_rate"] = 100 * by_byte(raw == 63) / count
    out["other_sign_rate"] = 100 * by_byte(signs[raw]) / count
    out["mixed_word_rate"] = 100 * per(run_text[odd]) / count
    out["mean_word"] = per(text_of, words.end - words.start) / count
    return np.stack([out[f] for f in FEATURES], axis=1)


class Trees:
    """Boosted regression trees on the logistic loss, over at most 64 bins a feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 5.0, l2: float = 1.0) -> None:
        self.cuts = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, 31)).tolist() + [0.0]) for c in x.T]
        binned = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.rate, self.trees = float(np.log(p / (1 - p))), rate, []
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - q, np.maximum(q * (1 - q), 1e-9), depth, least, l2)
            self.trees.append(tree)
            score += rate * self._leaf(binned, tree)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float) -> list[tuple[int, int, float]]:
        """A full tree as a heap: (feature, last bin of the left child, value); feature -1 sends all left."""
        nodes: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (depth + 1) - 1)
        where = np.zeros(len(g), np.int64)
        for at in range(2**depth - 1):
            own = np.flatnonzero(where == at)
            best, gain = (-1, 0), 1e-6
            if len(own) >= 2 * least:
                gs, hs = g[own].sum(), h[own].sum()
                for f in range(b.shape[1]):
                    n = len(self.cuts[f]) + 1
                    c = b[own, f]
                    gl, hl, nl = (np.cumsum(np.bincount(c, weights=w, minlength=n))[:-1] for w in (g[own], h[own], None))
                    ok = (nl >= least) & (len(own) - nl >= least)
                    if ok.any():
                        gains = np.where(ok, gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2), 0)
                        k = int(gains.argmax())
                        if gains[k] > gain:
                            best, gain = (f, k), float(gains[k])
            nodes[at] = (*best, 0.0)
            where[own] = 2 * at + 1 + (b[own, best[0]] > best[1] if best[0] >= 0 else 0)
        for at in range(2**depth - 1, len(nodes)):
            own = where == at
            nodes[at] = (-1, 0, float(g[own].sum() / (h[own].sum() + l2)))
        return nodes

    @staticmethod
    def _leaf(b: np.ndarray, tree: list[tuple[int, int, float]]) -> np.ndarray:
        feature, cut, value = (np.array(v) for v in zip(*tree, strict=True))
        at = np.zeros(len(b), np.int64)
        while 2 * at[0] + 2 < len(tree) if len(at) else False:
            f = feature[at]
            at = 2 * at + 1 + ((f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]))
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum((self._leaf(b, t) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, rising y) of the monotone step function nearest to y, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order], y[order], strict=True):
        blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            t2, n2, _, hi = blocks.pop()
            t1, n1, lo, _ = blocks.pop()
            blocks.append([(t1 * n1 + t2 * n2) / (n1 + n2), n1 + n2, lo, hi])
    return np.array([k for b in blocks for k in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


class Model:
    """Trees and calibration, or a constant where there is nothing to learn."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.trees, self.constant = None, float(y.mean()) if len(y) else 0.0
        if 0 < y.sum() < len(y):
            apart = np.arange(len(y)) % 5 == 4
            if not 0 < y[~apart].sum() < (~apart).sum() or not 0 < y[apart].sum() < apart.sum():
                apart = np.zeros(len(y), bool)
            self.trees = Trees(x[~apart], y[~apart])
            test = apart if apart.any() else ~apart
            self.knots = isotonic(self.trees.margin(x[test]), y[test])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        margin = self.trees.margin(x)
        step = np.interp(margin, *self.knots)
        # a small share of the raw probability keeps the order within calibrated steps
        return np.clip(0.98 * step + 0.02 / (1 + np.exp(-margin)), 0.0, 1.0)


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, y of at most `sample` labelled doc_ids that are not held out; of a repeated doc_id the least text."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")  # at most `sample` ids
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def learned_lexicon(rows: DataFrame, most: int = 2000) -> np.ndarray:
    """Keys of words and beginnings that mark y = 1: at most `most`, by likelihood ratio against the share of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = lowered(batch.column("text"))
            text_of = np.repeat(np.arange(batch.num_rows), words.counts())
            y = batch.column("y").to_numpy(zero_copy_only=False) > 0
            found = []
            for at, keys in word_keys(words):
                order = np.lexsort((text_of[at], keys))
                k, t = keys[order], text_of[at][order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
                k, own = k[new], y[t[new]]
                head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
                if len(head):
                    pos, n = np.add.reduceat(own.astype(np.int64), head), np.diff(np.append(head, len(k)))
                    found.append((k[head], pos, n - pos))
            if found:
                k, pos, neg = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(pos), pa.array(neg)], names=["k", "pos", "neg"])

    all_rows = rows.agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).first()
    if not all_rows.pos or all_rows.pos == all_rows.n:
        return np.zeros(0, np.uint64)
    base = all_rows.pos / all_rows.n
    sums = rows.mapInArrow(run, "k long, pos long, neg long").groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    ratio = F.col("pos") * F.log(share / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    best = sums.where((F.col("pos") >= max(5, 0.01 * all_rows.pos)) & (share >= max(0.7, base)) & (ratio >= 8)).orderBy(ratio.desc(), "k").limit(most)
    return np.sort(np.array([r.k for r in best.select("k").collect()], np.int64).view(np.uint64))


def learned(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> tuple[Model, np.ndarray]:
    """Model and learned lexicon from at most `sample` labelled rows that are not held out."""
    rows = sample_rows(docs, labels, sample)
    lexicon = learned_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = features(batch.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(found.x.tolist(), float).reshape(len(found), len(FEATURES))
    shuffled = np.random.default_rng(7).permutation(len(found))
    return Model(x[shuffled], (found.y.to_numpy() > 0).astype(float)[shuffled]), lexicon


def toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    model, lexicon = learned(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            score = model.score(features(batch.column("text"), lexicon))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """docs without those whose score reaches the threshold; columns as they are."""
    model, lexicon = learned(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.filter(pa.array(model.score(features(batch.column("text"), lexicon)) < threshold))

    return docs.mapInArrow(run, docs.schema)
