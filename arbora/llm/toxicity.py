"""Toxicity of texts behind leetspeak, spacing and repeated letters.

A noisy channel writes words in disguise: it replaces letters by digits and signs, puts signs or spaces between them, and
repeats them. Each stretch of a text is a lattice of what its characters may stand for, with the channel's costs; a
character trigram model, counted by Spark over all texts, and Viterbi decoding find the likeliest reading. A stretch that
leaves no choice (letters without repeats) is its own reading.

The restored words are scored by a logistic model over the presence of words and of their first letters. Its features
are those that stand in toxic rows clearly more often than in others; weights are found by numpy gradient descent.

Defined cases: a null or empty text has no words and the score of the bias alone; repeated rows score alike; of rows that
share a labelled id, the one whose text has the smallest hash is learned from; null labels are ignored; without labels of
both classes every score is the share of label 1, or 0.5; an empty table gives an empty result; texts of any length are
read whole; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import Scratch

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Stands for any letter, between two letters.
MASK, ANY = "*", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the character model: the edge of a word, any digit, any other letter, and letters of their own.
EDGE, DIGIT, OTHER = 0, 1, 2
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, (0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100))))
SYMBOL = {c: i for i, c in enumerate(LETTERS, 3)}
SIZE = 3 + len(LETTERS)
WORD = re.compile(r"[^\W_]+")
#: Two equal characters in a row, in a token of letters.
TWICE = re.compile(r"(.)\1")
#: Three or more single characters in a row: spaces may stand between the letters of a word.
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: Signs that are only ever an edge at the end of a token, which needs none.
EDGES = ".,;:?-_'\"#%&)[]{}/\\=~^`>" + MASK


@dataclass(frozen=True)
class Params:
    #: Costs, as negative logarithms: a sign for a letter, any letter, a sign left out, a letter said twice or more often.
    leet: float = 1.5
    any_letter: float = 4.5
    skip: float = 0.7
    double: float = 2.0
    repeat: float = 0.5
    smooth: float = 5.0
    #: First letters that are features beside the whole word; the least toxic rows and the score of a feature.
    first_letters: tuple[int, ...] = (4, 5, 6)
    least_rows: int = 3
    least_z: float = 2.5
    #: The bound of the training sample: so many labelled ids of each class, those of smallest hash, one row each. And of the model.
    per_class: int = 2000
    features: int = 20_000
    epochs: int = 40
    rate: float = 0.3
    shrink: float = 3e-5
    #: Up to this share of a toxic row's features is hidden in a step, at random, so that a single word is learned to be enough.
    hide: float = 1.0
    seed: int = 7
    threshold: float = 0.5
    #: Entries of a worker's caches, and the longest token that is kept there.
    cache: int = 300_000
    long_token: int = 64


def symbol(c: str) -> int:
    return SYMBOL.get(c) or (DIGIT if c.isdigit() else OTHER if c.isalpha() else EDGE)


# The character model -----------------------------------------------------------------------------------------------


def word_trigrams(words: list[str], counts: np.ndarray) -> np.ndarray:
    """Counts of all symbol trigrams of the words, which have two edges before them and one behind."""
    points = np.frombuffer("".join(f"\0\0{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    found, spot = np.unique(points, return_inverse=True)
    symbols = np.array([symbol(chr(c)) for c in found.tolist()], np.int64)[spot]
    code = (symbols[:-2] * SIZE + symbols[1:-1]) * SIZE + symbols[2:]
    weight = np.repeat(counts, np.fromiter(map(len, words), np.int64, len(words)) + 3)
    # A trigram belongs to the word of its last symbol, and must not begin in the word before: that one ends in an edge.
    starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 3)[:-1]
    weight[starts] = weight[starts + 1] = 0
    return np.bincount(code, weights=weight[2:], minlength=SIZE**3).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``gram, n``: symbol trigrams of all words of all texts, added up in every task; at most ``SIZE ** 3`` rows."""

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            words: Counter[str] = Counter()
            for text in batch.column("text"):
                words.update(WORD.findall((text.as_py() or "").lower()))
            if words:
                total += word_trigrams(list(words), np.fromiter(words.values(), np.int64, len(words)))
        gram = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(total[gram])], names=["gram", "n"])

    return docs.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def log_model(grams: np.ndarray, counts: np.ndarray, p: Params = Params()) -> np.ndarray:
    """``log P(c | a, b)`` at ``[a, b, c]``: each order is smoothed towards the shorter one."""
    tri = np.zeros(SIZE**3)
    tri[grams] = counts
    tri = tri.reshape(SIZE, SIZE, SIZE)
    bi = tri.sum(axis=0)
    one = (bi.sum(axis=0) + 1) / (bi.sum() + SIZE)
    two = (bi + p.smooth * one) / (bi.sum(axis=1, keepdims=True) + p.smooth)
    three = (tri + p.smooth * two[None]) / (tri.sum(axis=2, keepdims=True) + p.smooth)
    return np.log(three).astype(np.float32)


# Decoding ----------------------------------------------------------------------------------------------------------


class Decoder:
    """Restores the words of texts. Tokens are kept in a cache, as they come again."""

    def __init__(self, model: np.ndarray, p: Params = Params()):
        self.p, self.cost = p, (-model.astype(np.float64)).reshape(SIZE * SIZE, SIZE).tolist()
        self.tokens: dict[str, tuple[str, ...]] = {}
        self.edges: dict[str, list[tuple[int, str, float]]] = {}

    def readings(self, c: str) -> list[tuple[int, str, float]]:
        """What a character may stand for: ``(symbol, text, cost)``; no text is a sign left out."""
        found = self.edges.get(c)
        if found is None:
            own = symbol(c)
            found = [(EDGE, " ", 0.0), (EDGE, "", self.p.skip)] if own == EDGE else [(own, c, 0.0)]
            found += [(SYMBOL[x], x, self.p.leet) for x in LEET.get(c, "")]
            self.edges[c] = found
        return found

    def viterbi(self, span: str) -> str:
        """The likeliest reading of a span. A state is the last two symbols; a path is a chain of what it wrote.

        While a single state survives and a letter leaves no choice, no costs are compared: that stretch is committed.
        """
        p, cost = self.p, self.cost
        masked = self.readings(MASK) + [(SYMBOL[x], x, p.any_letter) for x in ANY]
        states = {(EDGE, EDGE): (0.0, None, "")}
        for i, c in enumerate(span):
            options = self.readings(c)
            if len(options) == 1 and len(states) == 1:
                (((a, b), (spent, path, last)),) = states.items()
                if c != last:
                    s = options[0][0]
                    states = {(b, s): (spent + cost[a * SIZE + b][s], (path, c), c)}
                    continue
            if c == MASK and span[i - 1 : i].isalpha() and span[i + 1 : i + 2].isalpha():
                options = masked
            run = span[max(0, i - 2) : i + 3]
            again = p.repeat if c * 3 in run else p.double
            after = {}
            for (a, b), (spent, path, last) in states.items():
                row = cost[a * SIZE + b]
                for s, text, extra in options:
                    if s == EDGE:
                        if b == EDGE:  # one more sign at an edge
                            state, value, way, end = (a, b), spent, path, last
                        elif text:
                            state, value, way, end = (EDGE, EDGE), spent + row[EDGE], (path, " "), " "
                        else:
                            state, value, way, end = (a, b), spent + extra, path, last
                    else:
                        if text == last:
                            state, value = (a, b), spent + extra + again
                            if state not in after or value < after[state][0]:
                                after[state] = value, path, last
                        state, value, way, end = (b, s), spent + extra + row[s], (path, text), text
                    if state not in after or value < after[state][0]:
                        after[state] = value, way, end
            states = after
        ends = ((spent + (0.0 if b == EDGE else cost[a * SIZE + b][EDGE]), path) for (a, b), (spent, path, _) in states.items())
        _, path = min(ends, key=lambda e: e[0])
        out = []
        while path is not None:
            path, text = path
            out.append(text)
        return "".join(reversed(out))

    def words(self, token: str) -> tuple[str, ...]:
        """The restored words of a token, or of a span of single characters with spaces between them."""
        found = self.tokens.get(token)
        if found is None:
            found = tuple(w for w in WORD.findall(self.viterbi(token)) if not w.isdigit())
            if len(token) <= self.p.long_token:
                if len(self.tokens) >= self.p.cache:
                    self.tokens.clear()
                self.tokens[token] = found
        return found

    def restore(self, text: str) -> set[str]:
        """The distinct restored words of a text: of its distinct tokens, and of single characters in a row."""
        text, out = text.lower(), set()
        for span in SPACED.findall(text):
            out.update(self.words(" ".join(span.split())))
        for token in set(SPACED.sub(" ", text).split()):
            if token.isalpha() and not TWICE.search(token):
                out.add(token)
                continue
            token = token.strip(EDGES)
            if token.isalpha() and not TWICE.search(token):
                out.add(token)
            elif token:
                out.update(self.words(token))
        return out


# The score ---------------------------------------------------------------------------------------------------------


def features(words: set[str], p: Params) -> set[str]:
    """Words, and first letters of longer words (with a mark)."""
    out = set(words)
    for k in p.first_letters:
        out.update(w[:k] + "-" for w in words if len(w) > k)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


def train(rows: list[tuple[int, np.ndarray]], names: list[str], weight: dict[int, float], p: Params) -> Model:
    """Numpy gradient descent over ``(label, places of the features that are there)``, in steps scaled by past slopes."""
    w, bias = np.zeros(len(names)), 0.0
    past, past_bias = np.full(len(names), 1e-8), 1e-8
    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            slope, slope_bias = p.shrink * w, 0.0
            for i in batch:
                label, there = rows[i]
                if label and p.hide and len(there) > 1:
                    seen = rng.random(len(there)) >= p.hide * rng.random()
                    there = there[seen] if seen.any() else there[[rng.integers(len(there))]]
                z = bias + w[there].sum()
                off = (1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z)))) - label) * weight[label] / len(batch)
                slope[there] += off
                slope_bias += off
            past += slope * slope
            past_bias += slope_bias * slope_bias
            w -= p.rate * slope / np.sqrt(past)
            bias -= p.rate * slope_bias / math.sqrt(past_bias)
    return Model(dict(zip(names, w.tolist())), bias)


def in_training(id_col: str):
    """Rows whose labels may be learned: crc32 of the id as text is no multiple of 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, p: Params = Params(), label_col: str = "toxic") -> Model:
    """Train on at most ``2 * p.per_class`` rows; classes weigh as in all labels that may be learned.

    Executors restore the texts and count features by class; the driver gets the chosen features and where they stand.
    """
    scratch = Scratch(docs.sparkSession)
    usable = labels.select("doc_id", F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1) & in_training("doc_id")).distinct()
    usable = scratch.table(usable, "labels")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [usable.filter(F.col("label") == c).orderBy(*order).limit(p.per_class) for c in (0, 1)]
    # The picked ids have a fixed bound, so they may be broadcast; rows that share one are cut to one per task, then to one.
    sample = docs.join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    sample = sample.groupBy("doc_id", "label").agg(one).select("doc_id", F.col("label").cast("int").alias("label"), "one.text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def restored(batches):
        decoder = Decoder(shared.value, p)
        for batch in batches:
            found = [sorted(features(decoder.restore(t.as_py() or ""), p)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "label", "features"])

    # As many rows as the bound: dealt out, as decoding is the work, and not as many tasks as their bytes ask for.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = sample.repartition(tasks, "doc_id").mapInArrow(restored, "doc_id bigint, label int, features array<string>")
    sample = scratch.table(sample, "sample")
    total = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        scratch.drop()
        return Model({}, math.inf if 1 in n else -math.inf if 0 in n else 0.0)
    counted = sample.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )
    a, b, half = F.col("a") + 0.5, F.col("b") + 0.5, 0.5
    rest_a, rest_b = F.lit(n[1] + half) - F.col("a"), F.lit(n[0] + half) - F.col("b")
    z = (F.ln(a) - F.ln(rest_a) - F.ln(b) + F.ln(rest_b)) / F.sqrt(1 / a + 1 / b)
    chosen = counted.withColumn("z", z).filter((F.col("a") >= p.least_rows) & (F.col("z") > p.least_z))
    names = [r["feature"] for r in chosen.orderBy(F.col("z").desc(), "feature").limit(p.features).collect()]
    place = {f: i for i, f in enumerate(names)}
    known = docs.sparkSession.sparkContext.broadcast(place)

    def placed(batches):
        for batch in batches:
            at = [[known.value[f] for f in fs if f in known.value] for fs in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "label", "at"])

    rows = sample.mapInArrow(placed, "doc_id bigint, label int, at array<int>").collect()
    rows = [(r["label"], np.array(r["at"], np.int64)) for r in sorted(rows, key=lambda r: (r["doc_id"], r["label"]))]
    scratch.drop()
    share = {c: total[c] / n[c] for c in (0, 1)}
    mean = sum(share[label] for label, _ in rows) / len(rows)
    return train(rows, names, {c: share[c] / mean for c in (0, 1)}, p)


def toxicity(
    docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_restored`` for every document; only the text enters the score.

    ``n_restored`` counts the distinct words that toxic features speak for, as restored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    grams = trigram_counts(texts.select("text")).toArrow()  # at most SIZE ** 3 rows, whatever the corpus
    model = log_model(grams.column("gram").to_numpy(), grams.column("n").to_numpy(), p)
    toxic = fit(texts, labels, model, p)
    shared = docs.sparkSession.sparkContext.broadcast((model, toxic))

    def run(batches):
        table, learned = shared.value
        decoder, weights = Decoder(table, p), learned.weights

        class Evidence(dict):
            """The chosen features of a word."""

            def __missing__(self, word):
                if len(self) >= p.cache:
                    self.clear()
                found = tuple(f for f in features({word}, p) if f in weights)
                if len(word) <= p.long_token:
                    self[word] = found
                return found

        evidence = Evidence()
        for batch in batches:
            scores, hits = [], []
            for text in batch.column("text"):
                found = [e for e in map(evidence.__getitem__, decoder.restore(text.as_py() or "")) if e]
                z = learned.bias + sum(weights[f] for f in sorted({f for e in found for f in e}))
                scores.append(1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z)))))
                hits.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], names=["doc_id", "score", "n_restored"]
            )

    scored = texts.mapInArrow(run, "doc_id bigint, score double, n_restored bigint")
    return scored.select(
        "doc_id",
        F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= p.threshold, 1).otherwise(0).alias("predicted"),
        "n_restored",
    )
