"""Quality classifier: supervised subword embeddings.

A text's features are its words and their character n-grams, hashed into buckets; each bucket has a learned vector,
the vectors are averaged over the text, and a softmax layer gives the class. Training is plain numpy stochastic
gradient descent. As softmax over two classes of an average of vectors needs only one number per bucket, scoring keeps
that number and adds up cached words.

Defined cases: a null or empty text, and one without words, gets the share of label 1 in training; repeated rows
score alike; of rows that share a labelled id, the one whose text has the smallest hash is learned from, and repeated
labels count once; an empty table gives an empty result; without usable labels every score is 0.5; null labels are
ignored; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's caches, and the longest word that is kept in them.
CACHE, LONG_WORD = 500_000, 64
#: Stands for a pair of one word twice.
PAIR = "\x00twice"


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 17
    dim: int = 12
    grams: tuple[int, ...] = (2, 3, 4)
    #: The bound of the training sample: so many labelled ids of each class, those of smallest hash, one row each.
    per_class: int = 1500
    epochs: int = 8
    rate: float = 0.4
    seed: int = 7
    threshold: float = 0.7


def bucket(gram: str, n: int, p: Params) -> int:
    """The bucket of a character n-gram, or of a whole word for ``n = 0``."""
    return zlib.crc32(gram.encode("utf-8", "surrogatepass"), n) & (p.buckets - 1)


def char_grams(word: str, p: Params) -> list[str]:
    """The word's character n-grams, with marks at both ends."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in p.grams for i in range(len(marked) - n + 1)]


def repeats(words: list[str]) -> int:
    """Word pairs of one word twice; they share one bucket, as other pairs are too rare to learn."""
    return sum(map(eq, words, words[1:]))


def text_features(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with their shares."""
    total: Counter[int] = Counter()
    words = text.split()
    for word, n in Counter(words).items():
        total[bucket(word, 0, p)] += n
        for g in char_grams(word, p):
            total[bucket(g, len(g), p)] += n
    if twice := repeats(words):
        total[bucket(PAIR, 1, p)] += twice
    counts = np.fromiter(total.values(), np.float64, len(total))
    return np.fromiter(total, np.int64, len(total)), counts / max(counts.sum(), 1)


@dataclass
class Model:
    """``logit = bias + mean(weights[features])``; ``prior`` is the score of a text without words."""

    weights: np.ndarray
    bias: float
    prior: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], p: Params) -> Model:
    """Numpy SGD over ``(label, buckets, shares)``; classes weigh alike."""
    labels = np.array([r[0] for r in rows])
    prior = float(labels.mean()) if len(rows) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(p.buckets), float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1.0 / p.dim, 1.0 / p.dim, (p.buckets, p.dim))
    out = np.zeros((2, p.dim))
    offset = np.zeros(2)
    weight = {c: len(labels) / (2 * max((labels == c).sum(), 1)) for c in (0, 1)}
    steps, done = p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            label, buckets, shares = rows[i]
            rate = p.rate * (1 - done / steps)
            done += 1
            hidden = shares @ vectors[buckets]
            z = out @ hidden + offset
            prob = np.exp(z - z.max())
            prob /= prob.sum()
            slope = prob * weight[label]
            slope[label] -= weight[label]
            back = slope @ out
            out -= rate * np.outer(slope, hidden)
            offset -= rate * 0.1 * slope
            vectors[buckets] -= rate * 20 * np.outer(shares, back)
    return Model(vectors @ (out[1] - out[0]), float(offset[1] - offset[0]), prior)


def in_training(id_col: str):
    """Rows whose labels may be learned: crc32 of the id as text leaves another remainder than 2 by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), label_col: str = "quality") -> Model:
    """Train on at most ``2 * p.per_class`` rows; features are taken on the executors, so texts stay there."""
    usable = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).filter(
        F.col("label").isin(0, 1) & in_training("doc_id")
    ).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for c in (0, 1):
        part = usable.filter(F.col("label") == c).orderBy(*order).limit(p.per_class)
        picked = part if picked is None else picked.union(part)
    # The picked ids have a fixed bound, so they may be broadcast; rows that share one are cut to one per task, then to one.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    sample = sample.groupBy("doc_id", "label").agg(one).select("doc_id", "label", "one.text")

    def featured(batches):
        for batch in batches:
            got = [text_features(t or "", p) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("label").cast(pa.int32()),
                    pa.array([f.astype(np.int32) for f, _ in got], pa.list_(pa.int32())),
                    pa.array([s.astype(np.float32) for _, s in got], pa.list_(pa.float32())),
                ],
                names=["doc_id", "label", "buckets", "shares"],
            )

    rows = sample.mapInArrow(featured, "doc_id bigint, label int, buckets array<int>, shares array<float>").toArrow()
    ids = rows.column("doc_id").to_numpy()
    labels_ = rows.column("label").to_numpy()
    buckets, shares = rows.column("buckets").combine_chunks(), rows.column("shares").combine_chunks()
    order_ = np.lexsort((labels_, ids))
    made = [
        (int(labels_[i]), buckets[int(i)].values.to_numpy(), shares[int(i)].values.to_numpy())  # views: texts may be long
        for i in order_
        if len(buckets[int(i)].values)
    ]
    return train(made, p)


def scorer(model: Model, p: Params):
    """A function from a text to its probability of label 1; words and n-grams are cached in each worker.

    A word's value is a complex number: the sum of its features' weights, and their count.
    """
    weights = model.weights.astype(np.float64).tolist()

    class Grams(dict):
        def __missing__(self, gram):
            if len(self) >= CACHE:
                self.clear()
            value = self[gram] = weights[bucket(gram, len(gram), p)]
            return value

    grams = Grams()

    class Words(dict):
        def __missing__(self, word):
            if len(self) >= CACHE:
                self.clear()
            parts = char_grams(word, p)
            value = complex(weights[bucket(word, 0, p)] + sum(map(grams.__getitem__, parts)), len(parts) + 1)
            if len(word) <= LONG_WORD:
                self[word] = value
            return value

    cache, pair = Words(), complex(weights[bucket(PAIR, 1, p)], 1)

    def score(text: str | None) -> float:
        words = text.split() if text else []
        if not words:
            return model.prior
        value = sum(map(cache.__getitem__, words)) + repeats(words) * pair
        return float(1.0 / (1.0 + np.exp(-np.clip(model.bias + value.real / value.imag, -500, 500))))

    return score


def quality_classifier(
    docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; only the text enters the score."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(texts, labels, p)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.prior))

    def run(batches):
        weights, bias, prior = shared.value
        score = scorer(Model(weights, bias, prior), p)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())],
                names=["doc_id", "score"],
            )

    scored = texts.mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= p.threshold, 1).otherwise(0).alias("predicted"),
    )
