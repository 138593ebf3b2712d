"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts of the training part are unlabelled, whether they are labelled
harmless or not at all. A linear model over the set of a text's words and word beginnings is trained in numpy by
minibatches on the class-prior-corrected risk ``prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)])``; where the
second part is negative, the step goes the other way, so that it can't fall below nought by overfitting. The prior is the
share of toxic rows among all labelled training rows.

The classifier is fitted on a bounded sample: at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled texts,
those of the smallest hashes of id and text, repeated rows once. Everything else covers all rows.

Cases: a null or empty text has no features and gets the score of the bias alone; repeated rows are scored each; an empty
table gives an empty table; without positives every score is 0; several labels of one id count as toxic if one of
them is; null labels are none; rows without an id are scored but never in the sample; only doc_id and text of the documents are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strings, table

MAX_POSITIVE, MAX_UNLABELLED = 2_500, 7_500
BITS, MIN_TEXTS, MIN_SHARE, MIN_Z, EPOCHS, RATE, DECAY, BATCH, SEED = 20, 4, 0.02, 6.0, 40, 0.05, 1e-4, 1024, 7
CACHE_SIZE = 400_000
LETTERS = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Features:
    """The feature ids of a text: its words and their first four, five and six letters, hashed."""

    def __init__(self):
        self.cache: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        names = [f"{word}$"] + [word[:n] for n in (4, 5, 6) if len(word) >= n]
        return tuple(zlib.crc32(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in names)

    def __call__(self, text: str | None) -> set[int]:
        cache, out = self.cache, set()
        for word in set(LETTERS((text or "").lower())):
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= CACHE_SIZE:
                    cache.clear()
                ids = cache[word] = self.of_word(word)
            out.update(ids)
        return out


def featurise(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([sorted(features(t)) for t in strings(batch.column(1))], pa.list_(pa.int32()))], ["positive", "features"])

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, features array<int>")


class Rows:
    """Sparse binary rows: the features of all of them, and each one's end."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.ends = flat, ends

    def __len__(self) -> int:
        return len(self.ends)

    def counts(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.int64)
        for i in range(0, len(self.flat), 1 << 20):
            out += np.bincount(self.flat[i : i + (1 << 20)], minlength=1 << BITS)
        return out

    def kept(self, index: np.ndarray) -> Rows:
        """Only the features that index has a number for, by that number."""
        new = index[self.flat]
        return Rows(new[new >= 0], np.concatenate([[0], np.cumsum(new >= 0)])[self.ends])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and row numbers of the chosen rows."""
        begins = np.concatenate([[0], self.ends[:-1]])
        n = (self.ends - begins)[which]
        at = np.repeat(begins[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.flat[at], np.repeat(np.arange(len(which)), n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Of the scores of positives and unlabelled texts: the risk of the positives, and the corrected one of the negatives, which the
    whole risk takes as nought if it is negative. The loss is ln(1 + exp(-y z))."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What to step along by every score: the whole risk's slope, or, where the negative part is below nought, that part's backwards."""
    gp, gu = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if risk(zp, zu, prior)[1] < 0:
        return -gp, -gu
    return gp - prior * sigmoid(-zp) / len(zp), gu


def train(positive: Rows, unlabelled: Rows, prior: float) -> tuple[np.ndarray, float]:
    """Weights by feature id, and the bias."""
    weights = np.zeros(1 << BITS, np.float32)
    if not len(positive) or not len(unlabelled):
        return weights, 30.0 * (2 * prior - 1) if len(positive) else -30.0
    in_p, in_u = positive.counts(), unlabelled.counts()
    expected = (in_p + in_u) * (len(positive) / (len(positive) + len(unlabelled)))
    # Among very many rare features some are more common in positives by chance: only those beyond MIN_Z are learnt.
    common = np.flatnonzero((in_p >= max(MIN_TEXTS, MIN_SHARE * len(positive))) & (in_p - expected >= MIN_Z * np.sqrt(expected)))
    index = np.full(1 << BITS, -1, np.int32)
    index[common] = np.arange(len(common))
    p, u = positive.kept(index), unlabelled.kept(index)
    w, b = np.zeros(len(common)), np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    random = np.random.default_rng(SEED)
    n_batches = max(1, -(-len(unlabelled) // BATCH))
    for _ in range(EPOCHS):
        for pi, ui in zip(np.array_split(random.permutation(len(positive)), n_batches), np.array_split(random.permutation(len(unlabelled)), n_batches)):
            if not len(pi):
                pi = random.integers(0, len(positive), 1)
            (pf, pr), (uf, ur) = p.take(pi), u.take(ui)
            gp, gu = slopes(np.bincount(pr, w[pf], len(pi)) + b, np.bincount(ur, w[uf], len(ui)) + b, prior)
            g = np.append(np.bincount(pf, gp[pr], len(w)) + np.bincount(uf, gu[ur], len(w)) + DECAY * w, gp.sum() + gu.sum())
            t += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w -= step[:-1]
            b -= step[-1]
    weights[common] = w
    return weights, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Trains on the rows that are not held out."""
    toxic = labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("positive"))
    n, n_toxic = toxic.agg(F.count("*"), F.count_if("positive")).first()
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).filter(~held_out(F.col("doc_id")))
    ids = rows.select("doc_id", "h").distinct().join(toxic, "doc_id", "left").select("doc_id", F.coalesce("positive", F.lit(False)).alias("positive"), "h")
    picked = [ids.filter(ids.positive if yes else ~ids.positive).orderBy("h", "doc_id").limit(most) for yes, most in ((True, MAX_POSITIVE), (False, MAX_UNLABELLED))]
    sample = picked[0].union(picked[1])  # at most MAX_POSITIVE + MAX_UNLABELLED rows
    found = featurise(rows.join(F.broadcast(sample), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])).toArrow().combine_chunks()
    lists = found.column("features").combine_chunks()
    flat, offsets, yes = lists.values.to_numpy(), lists.offsets.to_numpy(), found.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    n_features = np.diff(offsets)
    each = np.repeat(yes, n_features)
    return train(Rows(flat[each], np.cumsum(n_features[yes])), Rows(flat[~each], np.cumsum(n_features[~yes])), n_toxic / n if n else 0.0)


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS numbers of four bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), model.value
        for batch in batches:
            z = np.array([bias + float(w[np.fromiter(features(t), np.int64)].sum(dtype=np.float64)) for t in strings(batch.column(2))], np.float64)
            s = sigmoid(z)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
