"""Language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary, whatever their length. For each
language, the probabilities of the pieces are learned by expectation-maximisation over
the words of labelled texts. The probability of a word is the sum over all its
segmentations into pieces, by the forward algorithm, also for the longest words; a
text's is the product over its words, and the language with the largest one is
predicted (of equal ones the first by name). A word's value is kept for its next use,
so most of a text costs one look-up a word.

Learning uses the SAMPLE texts of each language with the least hashes of their id, a
bounded number at any input size, as whole texts. Their words are counted and the
expected piece counts summed on the executors; the driver gets pieces x languages.

A word is a run of letters. Null texts and texts without a letter are ``und`` with
score 0. Repeated rows are predicted each, and learned from each if they are in the
sample, which never exceeds SAMPLE rows a language; without any labelled text, or with
an empty table, all are ``und``. A very long text is one row, of a very long word
nothing is kept. Columns besides doc_id, text and lang are not read, so they may have
any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import top
from .common import hash_bound, id_and_text, prepare, written
from .tokens import vocabulary

#: Labelled texts of each language that the model is learned from, at most.
SAMPLE = 800
ROUNDS = 2
SMOOTH = 0.05
#: Words of up to so many characters are scored together with others of their length; the values of longer ones are scaled as they grow.
TOGETHER = 32
#: Probability of a character that no piece holds.
UNKNOWN = 1e-6
#: Words whose values a worker keeps.
KEPT = 900_000
MARK = "▁"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Marked lower-case words: runs of letters."""
    out = []
    for w in _WORD.findall(text.lower()):
        if w.isalpha():
            out.append(MARK + w)
        else:  # numbers such as fractions and Roman numerals part words
            out += [MARK + x for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return out


def pieces(path: str | None = None) -> list[str]:
    """Lower-case letter pieces of the vocabulary, marked or not."""
    from .piece_model import NORMAL, Model

    with open(path or vocabulary("piece_bpe_32k.model"), "rb") as f:
        found = Model(f.read()).pieces
    return sorted({p for p, _, kind in found if kind == NORMAL and (p == MARK or p.lstrip(MARK).isalpha()) and p == p.lower() and MARK not in p[1:]})


def spans(word: str, known: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece in a word, by end; -1 for a character that no piece holds."""
    out = []
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            k = known.get(word[start:end])
            if k is not None:
                out.append((start, end, k))
            elif start == end - 1:
                out.append((start, end, -1))
    return out


def forward(word: str, known: dict[str, int], probability: np.ndarray) -> np.ndarray:
    """Log-probability of a word in each language: all segmentations summed, position by position.

    The last values are scaled when they get small, each language by its own factor, so that
    words of any length keep their order.
    """
    longest = max(map(len, known), default=1)
    ahead: deque[np.ndarray] = deque([np.ones(probability.shape[1])], maxlen=longest)
    scale = np.zeros(probability.shape[1])
    for end in range(1, len(word) + 1):
        now = np.zeros(probability.shape[1])
        for size in range(1, min(longest, end) + 1):
            k = known.get(word[end - size : end])
            if k is not None:
                now += ahead[-size] * probability[k]
            elif size == 1:
                now += ahead[-1] * UNKNOWN
        ahead.append(now)
        if now.min() < 1e-100:
            most = np.max(ahead, axis=0)
            scale += np.log(most)
            for values in ahead:
                values /= most
    with np.errstate(divide="ignore"):
        return np.log(ahead[-1]) + scale


class Scorer:
    """Log-probabilities of words in each language, in batches, with the values of earlier words kept."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, names: list[str], probability: np.ndarray, rows: int = KEPT):
        self.longest = max(map(len, names), default=1)
        powers = np.array([pow(self.BASE, k, 1 << 64) for k in range(self.longest)], np.uint64)
        hashes = np.array([sum(ord(c) * int(powers[len(x) - 1 - i]) for i, c in enumerate(x)) % (1 << 64) for x in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.p, self.powers = hashes[order], probability[order], powers
        if len(set(hashes.tolist())) < len(names):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece: one look here tells
        self.maybe[hashes >> np.uint64(44)] = True
        self.known = {x: k for k, x in enumerate(names)}
        self.probability = probability
        self.rows, self.index = rows, {}
        self.values = np.zeros((1024, probability.shape[1]))

    def same_length(self, words: list[str]) -> np.ndarray:
        """The forward algorithm for words of one length, all at once."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
        ahead = [np.ones((n, self.p.shape[1]))]
        for end in range(1, length + 1):
            now, h = np.zeros((n, self.p.shape[1])), np.zeros(n, np.uint64)
            for size in range(1, min(end, self.longest) + 1):
                h = h + codes[:, end - size] * self.powers[size - 1]
                rows = np.flatnonzero(self.maybe[h >> np.uint64(44)])
                if not len(rows) and size > 1:
                    continue
                at = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[rows]
                rows, at = rows[hit], at[hit]
                now[rows] += ahead[end - size][rows] * self.p[at]
                if size == 1 and len(rows) < n:
                    unknown = np.ones(n, bool)
                    unknown[rows] = False
                    now[unknown] += ahead[end - 1][unknown] * UNKNOWN
            ahead.append(now)
        with np.errstate(divide="ignore"):
            return np.log(ahead[-1])

    def learn_words(self, words: set[str]) -> None:
        """Score words that are not kept yet; when the store is full it starts anew with these."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > self.rows:
            self.index.clear()
            new = list(words)
        at = len(self.index)
        if at + len(new) > len(self.values):
            more = np.zeros((2 * (at + len(new)), self.values.shape[1]))
            more[:at] = self.values[:at]
            self.values = more
        by: dict[int, list[str]] = defaultdict(list)
        for w in new:
            by[min(len(w), TOGETHER + 1)].append(w)
        for length, group in by.items():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                self.values[at : at + len(part)] = self.same_length(part) if length <= TOGETHER else [forward(w, self.known, self.probability) for w in part]
                self.index.update(zip(part, range(at, at + len(part)), strict=True))
                at += len(part)

    def total(self, words: list[str]) -> np.ndarray:
        return self.values[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(axis=0)


def expected(word: str, known: dict[str, int], longest: int, p: list[float] | None, weight: float, into: dict[int, float]) -> None:
    """Add the expected piece counts of a word to ``into``, by the forward and backward sums.

    p None: every piece that stands in the word counts, longer ones weighing more. Sums are scaled at each
    position, so words of any length count.
    """
    found = spans(word, known, longest)
    if p is None:
        for start, end, k in found:
            if k >= 0:
                into[k] = into.get(k, 0.0) + weight * (end - start)
        return
    n = len(word)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    ahead[0] = behind[n] = 1.0
    scale = [1.0] * (n + 1)  # what the values at a position were multiplied by, beside those at the one before
    at = 0
    for end in range(1, n + 1):
        total, first = 0.0, at
        while at < len(found) and found[at][1] == end:
            at += 1
        factor = 1.0
        starts = {start: k for start, _, k in found[first:at]}
        for back in range(1, min(longest, end) + 1):
            k = starts.get(end - back)
            if k is not None:
                total += ahead[end - back] * factor * (p[k] if k >= 0 else UNKNOWN)
            factor *= scale[end - back]
        scale[end] = 1 / total
        ahead[end] = 1.0
    for start, end, k in reversed(found):
        factor = 1.0
        for j in range(start + 1, end + 1):
            factor *= scale[j]
        share = (p[k] if k >= 0 else UNKNOWN) * factor * behind[end]
        behind[start] += share
        if k >= 0:
            into[k] = into.get(k, 0.0) + weight * share * ahead[start]


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): of each language the ``sample`` training texts (crc32(doc_id) mod 5 not 0) with the least hashes of their id."""
    train = docs.where("lang is not null and text is not null").where("pmod(crc32(cast(doc_id as string)), 5) <> 0")
    rows = train.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("text").cast("string").alias("text"))
    # first the bound of each language from the hashes alone, then the texts under it; equal hashes (repeated ids) are cut at the number
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return rows.select("lang", "text")
    spark = docs.sparkSession

    def bounds(limits: dict[str, int]) -> DataFrame:
        limited = rows.select("lang", "h").join(F.broadcast(spark.createDataFrame(list(limits.items()), "lang string, most long")), "lang").where("h <= most")
        return written(top(limited.select("lang", "h"), ["lang"], [F.asc("h")], sample).groupBy("lang").agg(F.max("h").alias("bound"), F.count(F.lit(1)).alias("n")), "hash-bounds")

    found = bounds({lang: hash_bound(n, sample) for lang, n in sizes.items()})
    if any(r["n"] < min(sample, sizes[r.lang]) for r in found.collect()) or found.count() < len(sizes):  # too many rows share too few ids
        found = bounds(dict.fromkeys(sizes, (1 << 63) - 1))
    under = rows.join(F.broadcast(found.select("lang", "bound")), "lang").where("h <= bound")
    return top(under, ["lang"], [F.asc("h")], sample).select("lang", "text")


def word_counts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, word, n) of the sampled texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang].update(words_of(text))
                seen[lang][""] += 0  # a language without any word is one all the same
            rows = [(lang, w, n) for lang, own in seen.items() for w, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    counted = sampled(docs, sample).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return written(counted, "language-words")


def learn(counts: DataFrame, names: list[str], rounds: int = ROUNDS, smooth: float = SMOOTH) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities with a column for each) from (lang, word, n)."""
    spark = counts.sparkSession
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    probability = np.zeros((len(names), len(langs)))
    for r in range(rounds + 1 if langs else 0):
        kept = spark.sparkContext.broadcast((langs, names, probability if r else None))  # pieces x languages, fixed by the vocabulary

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            langs, names, probability = kept.value
            known, longest = {x: k for k, x in enumerate(names)}, max(map(len, names))
            columns = {lang: probability[:, k].tolist() for k, lang in enumerate(langs)} if probability is not None else dict.fromkeys(langs)
            into: dict[str, dict[int, float]] = defaultdict(dict)
            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if word:
                        expected(word, known, longest, columns[lang], n, into[lang])
            rows = [(lang, k, x) for lang, own in into.items() for k, x in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["lang", "piece", "x"])

        seen = np.zeros_like(probability)
        summed = counts.select("lang", "word", "n").mapInArrow(run, "lang string, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).toPandas()
        seen[summed.piece.to_numpy(int), np.searchsorted(langs, summed.lang.to_numpy(str)) if len(summed) else []] = summed.x.to_numpy()
        probability = (seen + smooth) / (seen.sum(axis=0) + smooth * len(names))
    return langs, probability


def predicted(docs: DataFrame, langs: list[str], vocabulary_pieces: list[str], probability: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score): score is the posterior of the predicted language under equal priors."""
    prepare(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast((vocabulary_pieces, probability))  # pieces x languages, fixed by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*kept.value) if langs else None
        for batch in batches:
            found, scores = [], []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 250):
                asked = [words_of((t or b"").decode("utf-8", "replace")) if langs else [] for t in texts[at : at + 250]]
                if langs:
                    scorer.learn_words(set().union(*asked))
                for words in asked:
                    if not words:
                        found.append("und")
                        scores.append(0.0)
                        continue
                    total = scorer.total(words)
                    best = int(np.argmax(total))
                    found.append(langs[best])
                    scores.append(1 / math.fsum(np.exp(np.clip(total - total[best], -700, 0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_langid(docs: DataFrame) -> DataFrame:
    names = pieces()
    langs, probability = learn(word_counts(docs), names)
    out = predicted(docs, langs, names, probability)
    return out.select("doc_id", F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0").alias("held_out"), "lang_pred", "score")
