"""Language identification with interpolated Kneser-Ney character models.

Training counts the 4-grams of characters (16 bits each, words padded with blanks) of every text whose language is known and
that is not held out: words are counted per batch, their 4-grams summed in Spark by (language, gram). Lower orders follow
from the 4-grams by continuation counts. The model holds, per order, a sorted array of gram hashes and a matrix of log
probabilities and back-off weights by language. All grams enter it, rare ones too, since discounts and continuation counts
rest on those; it grows with the corpus and is held by the driver and by each worker. A text gets the language of the
lowest cross-entropy per character.

Rejection: the scores of all labelled rows that are not held out give a temperature, and per language the cross-entropy
that 99.9 % of its rows stay under (to STEP nats); the rows are counted and their losses summed in Spark. Texts above it (or whose score is under 0.5) are marked `rejected`. lang_pred
is filled all the same, as its contract asks.

Null texts and texts without a letter are `und` with score 0, as are all texts when nothing can be learned. Ties go to
the language first in the alphabet. Extra columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held_out, text_slices

ORDER = 4
#: Width in nats of the bins in which cross-entropies are counted, and the temperatures that are tried.
STEP, TEMPERATURES = 1e-4, [2.0**t for t in range(-2, 8)]
#: Bytes that end a word: ASCII other than letters.
_BREAK = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def letter_table() -> np.ndarray:
    """For each of the 65536 first code points whether it is a letter; all others count as letters if Python says so."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x10000)), bool, 0x10000)


class Batch:
    """The distinct words of a slice of texts and where they stand."""

    def __init__(self, column: pa.Array, letters: np.ndarray) -> None:
        words = Words(column, _BREAK)
        n = len(words.offsets) - 1
        hashes = words.hashes()
        _, first, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.text_of, self.texts = np.repeat(np.arange(n), words.counts()), n
        start, end = words.start[first], words.end[first]
        raw = words.data.tobytes()
        joined = b" ".join([raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]).decode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        # lower case by the code point, so that the distinct words keep their places
        low = {c: ord(x) for c in np.unique(points[points > 127]).tolist() if len(x := chr(c).lower()) == 1 and ord(x) != c}
        if low:
            points = points.copy()
            keys = np.array(sorted(low), np.uint32)
            at = np.searchsorted(keys, points)
            at[at == len(keys)] = 0
            points = np.where(keys[at] == points, np.array([low[k] for k in keys.tolist()], np.uint32)[at], points)
        inside = np.where(points < 0x10000, letters[np.minimum(points, 0xFFFF)], False)
        high = np.flatnonzero(points >= 0x10000)
        if len(high):
            own, back = np.unique(points[high], return_inverse=True)
            inside[high] = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in own.tolist()), bool, len(own))[back]
        word_of = np.cumsum(points == 32)
        self.has = np.bincount(word_of[inside], minlength=len(first)) > 0 if len(first) else np.zeros(0, bool)
        # code points over 16 bits are folded into 16
        code = np.where(inside, np.where(points < 0x10000, points, points % 0xFFF1), 32).astype(np.uint64)
        ends = np.zeros(len(code), bool)
        ends[1:] = ~inside[1:] & inside[:-1]
        at = np.flatnonzero(inside | ends)
        if len(code) and inside[-1]:
            code, word_of, at = np.append(code, np.uint64(32)), np.append(word_of, word_of[-1]), np.append(at, len(code))
        self.word_of = np.minimum(word_of[at] - (code[at] == 32) * (points[np.minimum(at, len(points) - 1)] == 32) * (at < len(points)), max(0, len(first) - 1))
        gram, blank = code[at].copy(), np.uint64(32)
        solid = np.ones(len(at), bool)  # no word edge since the gram's last character
        for back in range(1, ORDER):
            prev = np.where(solid & (at >= back), code[np.maximum(at - back, 0)], blank)
            solid &= prev != blank
            gram |= prev << np.uint64(16 * back)
        self.gram = gram

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """The sums over each text's words of what the distinct words have."""
        return np.bincount(self.text_of, values[self.inverse], minlength=self.texts).astype(float)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (four characters of 16 bits), n over all rows of docs with text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in text_slices(batches, 4 << 20):
            words = Batch(batch.column("text"), letters)
            coded = batch.column("lang").dictionary_encode()
            names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(names):
                times = np.bincount(words.inverse[which[words.text_of] == i], minlength=len(words.has))
                weight = times[words.word_of]
                grams, back = np.unique(words.gram[weight > 0], return_inverse=True)
                n = np.bincount(back, weight[weight > 0], minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """languages; per order sorted grams with a (gram, language) matrix of log probabilities, and sorted histories with one of back-offs."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.languages = sorted(counts.lang.unique())
        tables = [self._language(counts[counts.lang == x]) for x in self.languages]
        self.floor = np.array([t[-1] for t in tables], np.float32)
        self.orders = []
        for k in range(ORDER):
            keys = np.unique(np.concatenate([t[k][0] for t in tables])) if tables else np.zeros(0, np.uint64)
            probability = np.full((len(keys), len(tables)), np.nan, np.float32)
            histories = np.unique(np.concatenate([t[k][2] for t in tables])) if tables else np.zeros(0, np.uint64)
            backoff = np.zeros((len(histories), len(tables)), np.float32)
            for i, t in enumerate(tables):
                probability[np.searchsorted(keys, t[k][0]), i] = t[k][1]
                backoff[np.searchsorted(histories, t[k][2]), i] = t[k][3]
            self.orders.append((keys, probability, histories, backoff))

    @staticmethod
    def _language(rows: pd.DataFrame) -> list:
        """For orders 1 to 4 (grams, log probability, histories, log back-off of each); last the floor of unseen characters.

        A history need not be a gram of the order below: the blanks before a word are none.
        """
        gram = rows.gram.to_numpy(np.int64).view(np.uint64)
        n = rows.n.to_numpy(float)
        levels = [(gram, n)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many grams end in the shorter one
            longer = levels[0][0]
            levels.insert(0, tuple(np.unique(longer & np.uint64((1 << 16 * k) - 1), return_counts=True)))
        size = len(levels[0][0]) + 1
        out, lower, backs = [], None, []
        for k, (grams, count) in enumerate(levels):
            count = count.astype(float)
            once, twice = (count == 1).sum(), (count == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            d = min(d, 0.95)
            history = grams >> np.uint64(16)
            own, back = np.unique(history, return_inverse=True)
            total, kinds = np.bincount(back, count), np.bincount(back)
            weight = d * kinds / total
            if k == 0:
                p = (count - d) / total[back] + weight[back] / size
                out.append((grams, np.log(p), grams[:0], np.zeros(0)))
                floor = float(np.log(weight[0] / size)) if len(weight) else 0.0
            else:
                keys, logp = out[-1][0], out[-1][1]
                at = np.searchsorted(keys, grams & np.uint64((1 << 16 * k) - 1))
                p = (count - d) / total[back] + weight[back] * np.exp(logp[at])
                out.append((grams, np.log(p), own, np.log(weight)))
        return [*out, floor]

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """(gram, language) natural log probability of each gram's last character."""
        shape = (len(grams), len(self.languages))
        out = np.broadcast_to(self.floor, shape).copy()
        for k, (keys, probability, histories, backoff) in enumerate(self.orders):
            part = grams & np.uint64((1 << 16 * (k + 1)) - 1) if k + 1 < ORDER else grams
            if k:  # what the longer history costs, if it was seen
                history = (grams >> np.uint64(16)) & np.uint64((1 << 16 * k) - 1)
                at = np.searchsorted(histories, history)
                at[at == len(histories)] = 0
                seen = histories[at] == history
                out[seen] += backoff[at[seen]]
            at = np.searchsorted(keys, part)
            at[at == len(keys)] = 0
            seen = np.flatnonzero(keys[at] == part)
            own = probability[at[seen]]
            out[seen] = np.where(np.isnan(own), out[seen], own)
        return out

    def of_texts(self, column: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) cross-entropy per character in nats, and each text's number of characters (0: no letter)."""
        words = Batch(column, letters)
        grams, back = np.unique(words.gram, return_inverse=True)
        each = self.scores(grams) if len(grams) else np.zeros((0, len(self.languages)), np.float32)
        size = np.bincount(words.word_of, minlength=len(words.has)).astype(float) * words.has
        total = words.per_text(size)
        out = np.zeros((words.texts, len(self.languages)))
        for i in range(len(self.languages)):
            own = np.bincount(words.word_of, -each[back, i].astype(float), minlength=len(words.has)) * words.has
            out[:, i] = words.per_text(own) / np.maximum(total, 1)
        return out, total


def trained(docs: DataFrame) -> Model:
    """The model of all rows that are not held out; all their grams come to the driver, as Arrow with coded languages."""
    return Model(gram_counts(docs.where(~held_out())).toArrow().to_pandas(strings_to_categorical=True))


def calibrated(model: Model, docs: DataFrame, evidence: int) -> tuple[float, np.ndarray]:
    """(temperature, per language the highest cross-entropy that isn't rejected) from all labelled rows that aren't held out.

    Tasks give counts by language and bin of cross-entropy, and sums of losses by temperature in millionths, so that the order of
    rows changes nothing; the driver gets the sums, whose number is bounded by the bins.
    """
    k = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, place = letter_table(), {x: i for i, x in enumerate(model.languages)}
        for batch in text_slices(batches, 4 << 20):
            ce, n = model.of_texts(batch.column("text"), letters)
            own = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            kept = np.flatnonzero((n > 0) & (own >= 0))
            if not len(kept):
                continue
            ce, n, own, row = ce[kept], n[kept], own[kept], np.arange(len(kept))
            bins, count = np.unique(np.stack([own, np.round(ce[row, own] / STEP).astype(np.int64)]), axis=1, return_counts=True)
            z = -ce * np.minimum(n, evidence)[:, None]
            loss = [int(np.round(-np.log(np.maximum(_softmax(z / t)[row, own], 1e-12)) * 1e6).astype(np.int64).sum()) for t in TEMPERATURES]
            # temperatures stand behind the languages
            which = np.concatenate([bins[0], k + np.arange(len(loss))])
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate([bins[1], np.zeros(len(loss), np.int64)])), pa.array(np.concatenate([count, np.array(loss, np.int64)]).astype(np.int64))], names=["which", "bin", "n"])

    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    found = rows.mapInArrow(run, "which long, bin long, n long").groupBy("which", "bin").agg(F.sum("n").alias("n")).toPandas().sort_values(["which", "bin"])
    limits = np.full(k, np.inf)
    for i in range(k):
        own = found[found.which == i]
        upto = own.n.to_numpy().cumsum()
        if len(own) and upto[-1] >= 20:
            at = (upto[-1] - 1) * 0.999
            low, high = own.bin.to_numpy()[np.searchsorted(upto, [np.floor(at), np.ceil(at)], side="right")] * STEP
            limits[i] = low + (high - low) * (at - np.floor(at)) + 0.05
    if not len(found) or not (found.which < k).any():
        return 1.0, limits
    losses = found[found.which >= k].n.to_numpy()
    return TEMPERATURES[int(losses.argmin())], limits


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def languages(docs: DataFrame, *, evidence: int = 200) -> DataFrame:
    """The contract's rows, with cross_entropy (bits per character) and rejected beside them.

    score is the softmax of the languages' log probabilities over a temperature, which is fitted; a text counts in it with its
    cross-entropy times its number of characters, `evidence` at most: characters aren't independent, and beyond that length the score would be 0 or 1.
    The prediction and cross_entropy are of the whole text.
    """
    model = trained(docs)
    temperature, limits = calibrated(model, docs, evidence) if model.languages else (1.0, np.zeros(0))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        names = np.array([*model.languages, "und"], object)
        for batch in text_slices(batches, 4 << 20):
            if model.languages:
                ce, n = model.of_texts(batch.column("text"), letters)
                z = _softmax(-ce * np.minimum(n, evidence)[:, None] / temperature)
                best = np.where(n > 0, ce.argmin(axis=1), len(names) - 1)
                at = np.minimum(best, len(names) - 2)
                row = np.arange(len(best))
                score, entropy = np.where(n > 0, z[row, at], 0.0), np.where(n > 0, ce[row, at], 0.0)
                rejected = (n == 0) | (entropy > limits[at]) | (score < 0.5)
            else:
                score = entropy = np.zeros(batch.num_rows)
                best, rejected = np.zeros(batch.num_rows, int), np.ones(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(entropy / np.log(2)), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {key}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
