"""Toxicity scores by weak supervision.

Voters are lexicon words, word stems and patterns: a fixed seed list of insults, and
words and stems mined from labelled rows (those far more frequent in toxic rows than in
others, shorter stems standing for all words they begin). A generative label model
estimates by expectation-maximisation, over labelled and unlabelled texts together, how
often each voter fires on either class, and weighs a voter down by its correlation with
others beyond what the class explains; where a text has a given label, that is one more
voter. A logistic regression is then trained on the model's posterior labels of all
these texts over counts of the voters' hits, and scores every text.

The model is fitted on the SAMPLE labelled ids and the UNLABELLED_SAMPLE other ids with
the least hashes, bounded numbers at any input size; every text is scored as a whole.
Null and empty texts get the score of a text without any hit; a very long text is one
row. Repeated labels of an id count once (toxic if any says so), null ones not at all;
without labels of both classes only the seed list votes. Of documents that share an id
the sample has one (the least text), and each is scored. A score at THRESHOLD is
predicted toxic. An empty table gives no rows. Columns besides doc_id and text, and
toxic of the labels, are not read, so they may have any name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bound, id_and_text, prepare, written

#: Labelled ids, and others, that the model is fitted on, at most.
SAMPLE = 20_000
UNLABELLED_SAMPLE = 10_000
#: Longest word or stem that may become a voter.
VOTER_CHARS = 64
#: Mined voters, at most, and how much likelier in toxic rows a voter must be.
VOTERS = 256
LIFT = 6.0
STEMS = range(3, 8)
#: A voter's hits count in steps: so many or more.
STEPS = (1, 2, 4)
THRESHOLD = 0.7
#: How far a given label is trusted.
LABEL_ACCURACY = 0.97
#: What a row without a label counts for, so that voters that repeat one another cannot vouch for themselves.
UNLABELLED = 0.2

# A seed list of English insults.
SEED_WORDS = (
    "clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless",
)
# Patterns of address.
SEED_PATTERNS = (r"\byou(?:'re| are) (?:an? |such an? |all )?(?:%s)s?\b" % "|".join(SEED_WORDS), r"\bshut up\b", r"\bgo to hell\b")
#: What every match of a seed pattern holds: a pattern is only searched in texts with one of these.
_NEEDS = dict(zip(SEED_PATTERNS, (("you're ", "you are "), ("shut up",), ("go to hell",)), strict=True))

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall((text or b"").decode("utf-8", "replace").lower())


@dataclass
class Model:
    words: dict[str, int]
    stems: dict[str, int]
    patterns: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0

    def __post_init__(self):
        self.size = len(self.words) + len(self.stems) + len(self.patterns)
        self._lookup: dict[str, int] = {}
        self._stem_sizes = sorted({len(s) for s in self.stems})

    def voter(self, word: str) -> int:
        """The voter that a word fires, or -1: the word itself, else its shortest known stem."""
        got = self._lookup.get(word)
        if got is None:
            got = self.words.get(word, -1)
            for n in self._stem_sizes if got < 0 else ():
                got = self.stems.get(word[:n], -1) if len(word) > n else -1
                if got >= 0:
                    break
            if len(self._lookup) > 500_000:
                self._lookup.clear()
            if len(word) <= 64:
                self._lookup[word] = got
        return got

    def hits(self, text: bytes | None) -> tuple[dict[int, int], int]:
        """Hits of each voter that fires, and the number of words."""
        low = (text or b"").decode("utf-8", "replace").lower()
        words = _WORD.findall(low)
        found: dict[int, int] = defaultdict(int)
        for v in map(self.voter, words):
            if v >= 0:
                found[v] += 1
        base = self.size - len(self.patterns)
        for k, pattern in enumerate(self.patterns):
            if any(x in low for x in _NEEDS.get(pattern, ("",))):
                n = len(re.findall(pattern, low))
                if n:
                    found[base + k] = n
        return found, len(words)

    def features(self, hits: dict[int, int], n_words: int) -> np.ndarray:
        """Each voter's steps, and for all hits together their logarithm and how dense they are."""
        m = len(STEPS)
        x = np.zeros(m * self.size + 2)
        for v, n in hits.items():
            x[m * v : m * v + m] = [n >= step for step in STEPS]
        total = sum(hits.values())
        x[-2:] = np.log1p(total), min(10.0, 100 * total / max(1, n_words))
        return x

    def score(self, text: bytes | None) -> float:
        hits, n = self.hits(text)
        z = self.bias + (float(self.features(hits, n) @ self.weights) if hits and len(self.weights) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features_of(text: bytes | None) -> tuple[set[str], int]:
    """Words and '^stem's of a text, and a signature that near copies mostly share (the least hash of a 4-word run)."""
    import xxhash

    words = words_of(text)
    found = {w for w in words if len(w) <= VOTER_CHARS}
    found |= {"^" + w[:n] for w in words if len(w) > 3 for n in STEMS if len(w) > n}
    runs = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    return found, min(map(xxhash.xxh3_64_intdigest, runs))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, toxic, n) from (text, toxic): copies within a batch are counted once by their signature."""
    for batch in batches:
        seen: dict[tuple[str, int], set[int]] = defaultdict(set)
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, signature = features_of(text)
            for f in found:
                seen[f, toxic].add(signature)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array([len(seen[k]) for k in keys], pa.int64())], ["feature", "toxic", "n"])


def mined(sample: DataFrame, n_toxic: int, n_clean: int, voters: int = VOTERS, lift: float = LIFT) -> list[str]:
    """Words and '^stem's that are ``lift`` times as frequent in toxic rows, best first.

    They are counted, compared and ordered in Spark; 16 for each voter that is asked for reach the driver,
    as stems in use cover many of them.
    """
    least = max(3, min(8, n_toxic // 50))
    counts = sample.where("toxic >= 0").select("text", "toxic").mapInArrow(_counted, "feature string, toxic int, n long")
    of = lambda y: F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0))
    both = counts.groupBy("feature").agg(of(1).alias("t"), of(0).alias("c")).where(F.col("t") >= least)
    ratio = (F.col("t") + 0.5) / (n_toxic + 1) / ((F.col("c") + 0.5) / (n_clean + 1))
    best = both.withColumn("ratio", ratio).where(F.col("ratio") >= lift).orderBy((F.col("t") * F.ln("ratio")).desc(), F.length("feature"), "feature").limit(16 * voters).collect()
    toxic = {r.feature: r.t for r in best}
    out: list[str] = []
    for f in toxic:
        bare = f.lstrip("^")
        # a stem in use stands for all it begins; one that a single word makes up is left to that word
        covered = any(o[0] == "^" and bare.startswith(o[1:]) or f[0] == "^" and o.lstrip("^").startswith(bare) and toxic.get(o, 0) > 0.8 * toxic[f] for o in (*SEED_WORDS, *out))
        if not covered and f not in SEED_WORDS:
            out.append(f)
        if len(out) >= voters:
            break
    return out


def label_model(fires: np.ndarray, given: np.ndarray, times: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Posterior of class 1 for each row, from voters that fire or not and given labels (-1: none); a row stands for ``times`` equal ones."""
    m = fires.shape[1]
    fires = fires.astype(float)
    known = np.where(given < 0, 0.5, np.where(given == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY))
    side = np.log(known / (1 - known))
    base = (times @ (given == 1) + 1) / (times @ (given >= 0) + 2)
    post = np.where(given < 0, base, known)  # a row without a label starts at the rate of the labelled ones
    times = times * np.where(given < 0, UNLABELLED, 1.0)
    n = times.sum()
    extra = np.zeros((m, m))
    for r in range(rounds):
        weight = times @ post
        prior = (weight + 1) / (n + 2)
        on1 = ((times * post) @ fires + 0.5) / (weight + 1)
        on0 = ((times * (1 - post)) @ fires + 0.05) / (n - weight + 1)
        if r in (2, rounds // 2):  # correlation that the class leaves over
            rest = np.sqrt(times)[:, None] * (fires - np.outer(post, on1) - np.outer(1 - post, on0))
            scale = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            extra = np.clip(rest.T @ rest / np.outer(scale, scale) - np.eye(m), 0, None)
        # a voter that does not fire abstains; voters that fire together share what they are correlated in
        votes = fires * np.clip(np.log(on1 / on0), -4, 8) / (1 + fires @ extra)
        logit = np.log(prior / (1 - prior)) + votes.sum(axis=1) + side
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def logistic(x: np.ndarray, target: np.ndarray, times: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft targets, by Newton's method."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (times * (p - target)) + penalty * w
        hessian = (design * (times * (p * (1 - p) + 1e-6))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def least_hashed(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id): the ``most`` ids with the least hashes, exact at any size.

    Only hashes under a bound that a few times as many rows keep are looked at; if so many rows share an id that
    too few ids are under it, all are. Each task sends on ``most`` different ones at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, [("h", np.int64), ("i", np.int64)])
        for batch in batches:
            own = np.zeros(batch.num_rows, best.dtype)
            own["h"], own["i"] = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            best = np.unique(np.concatenate([best, own]))[:most]  # sorted by hash, then id
        yield pa.RecordBatch.from_arrays([pa.array(best["h"]), pa.array(best["i"])], ["h", "doc_id"])

    ids = docs.where("doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"))
    bound = hash_bound(docs.count(), most)
    first = lambda rows: rows.mapInArrow(run, "h long, doc_id long").distinct().orderBy("h", "doc_id").limit(most)
    found = written(first(ids.where(F.col("h") <= bound)), "least-hashes")  # at most ``most`` rows
    if bound < (1 << 63) - 1 and found.count() < most:
        found = written(first(ids), "least-hashes")
    return found.select("doc_id")


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, unlabelled: int = UNLABELLED_SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): texts of labelled ids, and of ids without a label (toxic -1); none whose crc32(doc_id) mod 3 is 1."""
    learnt = F.expr("doc_id is not null and pmod(crc32(cast(doc_id as string)), 3) <> 1")
    given = labels.where("toxic is not null").where(learnt).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    few = given.join(F.broadcast(least_hashed(given, sample)), "doc_id", "left_semi")
    # an id whose label was not drawn is none without a label
    others = least_hashed(docs.where(learnt), unlabelled).join(given, "doc_id", "left_anti").withColumn("toxic", F.lit(-1))
    chosen = written(few.unionByName(others), "toxicity-ids")  # at most ``sample`` + ``unlabelled`` rows
    return written(id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, unlabelled: int = UNLABELLED_SAMPLE) -> Model:
    """Fit on a sample of texts, labelled and not."""
    prepare(docs.sparkSession)
    rows = sampled(docs, labels, sample, unlabelled)
    classes = {r.toxic: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = mined(rows, classes[1], classes[0]) if classes.get(1) and classes.get(0) else []
    words = dict.fromkeys([*SEED_WORDS, *(f for f in found if f[0] != "^")])
    words = {w: k for k, w in enumerate(words)}
    stems = {f[1:]: len(words) + k for k, f in enumerate(f for f in found if f[0] == "^")}
    model = Model(words, stems, list(SEED_PATTERNS))
    if not (classes.get(1) and classes.get(0)):
        model.weights, model.bias = np.append(np.tile([4.0, 2.0, 1.0], model.size), [1.0, 0.2]), -4.0
        return model

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(*model.hits(t)) for t in batch.column(0).to_pylist()]
            x = [np.packbits(r[:-2] > 0).tobytes() + r[-2:].astype("<f4").tobytes() for r in rows]  # a bit for each step of a voter
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "toxic"])

    # at most the sample's rows; equal ones, as those without any hit, are counted before they are sent
    table = rows.select("text", "toxic").mapInArrow(votes, "x binary, toxic int").groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "toxic").toPandas()
    raw = np.frombuffer(b"".join(table.x), np.uint8).reshape(len(table), -1)
    bits = np.unpackbits(raw[:, :-8], axis=1, count=len(STEPS) * model.size)
    x = np.column_stack([bits, np.ascontiguousarray(raw[:, -8:]).view("<f4")]).astype(float)
    fires, given = bits > 0, table.toxic.to_numpy()
    times = table.n.to_numpy(float)
    posterior = label_model(fires, given, times)
    model.weights, model.bias = logistic(x, posterior, times * np.where(given < 0, UNLABELLED, 1.0))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    prepare(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kept.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score as a column of a table that keeps its other columns."""
    prepare(spark)
    kept = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([kept.value.score(t) for t in texts], dtype=float)

    return score(text.cast("string").cast("binary"))


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.expr("pmod(crc32(cast(doc_id as string)), 3) = 1")
    return scored(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
