"""Spelling variants: words one edit apart, grouped under their most frequent form.

The vocabulary is counted by Spark. It is sorted, cut into shards of a bounded size, and every shard becomes a compact
trie: nodes in breadth-first order, a label byte and the number of the first child for each. Shards are broadcast in
blocks of a bounded size, one block after another. Each word's distance-one Levenshtein automaton is intersected with
every shard depth-first; a shard gives out the number of the word's neighbours in it and the best of them, and Spark
reduces these figures over shards. Forms are then followed to the last by joins that double their reach.

A range of sorted words shares its first letters, so most automata die at a shard's root. These are not even started:
a neighbour keeps the first or second letter in one of its first two places, so a table of a shard's first and second
letters tells in one step of numpy which words of a batch can enter it.

Words are letters of Latin-1 in code-point order, so a letter is a byte and bytes sort as code points do.

Defined cases: null texts and texts without letters give no words; repeated rows count each; a null id counts as an
empty one in the rule for dropped letters; an empty table gives an empty result; words of any length are walked; ties go
to the smallest word; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import Scratch, materialize, remove

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    #: A word's least code points and occurrences; a form is so many times as frequent; one run in so many loses a letter.
    min_length: int = 6
    min_count: int = 5
    ratio: int = 5
    drop_one_in: int = 199
    #: Letters of a shard (a longer single word is a shard alone), and bytes of a block of shards that is broadcast.
    shard_letters: int = 400_000
    block_bytes: int = 32 << 20


# The vocabulary ----------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words that are long and frequent enough, counted over all texts."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("raw"),
    )
    # One letter less still has to reach the least length.
    runs = runs.filter(F.length("raw") >= p.min_length).select("id", F.translate("raw", UPPER, LOWER).alias("run"))
    hashed = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (hashed % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(hashed % p.drop_one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= p.min_length) & (F.col("n") >= p.min_count))


# Shards ------------------------------------------------------------------------------------------------------------


class Trie:
    """Sorted words in arrays: of node ``v``, ``labels[v]`` is the byte that leads to it, ``first[v]`` to
    ``first[v + 1]`` are its children, and ``count[v]`` is the frequency of the word that ends there, else 0."""

    def __init__(self, labels: bytes, first, count):
        self.labels, self.first, self.count = labels, first, count

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        labels, first, count = bytearray(1), [], []
        # A node is a range of words that share ``depth`` letters; a queue of ranges is the breadth-first order.
        todo, made = deque([(0, len(words), 0)]), 1
        while todo:
            low, high, depth = todo.popleft()
            first.append(made)
            ends = low < high and len(words[low]) == depth
            count.append(counts[low] if ends else 0)
            low += ends
            while low < high:
                letter, stop = words[low][depth], low + 1
                if words[high - 1][depth] == letter:
                    stop = high
                else:
                    while words[stop][depth] == letter:
                        stop += 1
                labels.append(letter)
                todo.append((low, stop, depth + 1))
                made += 1
                low = stop
        first.append(made)
        return cls(bytes(labels), np.array(first, np.uint32), np.array(count, np.int64))

    def pack(self) -> bytes:
        size = np.array([len(self.labels)], np.int64).tobytes()
        return size + self.count.tobytes() + self.first.tobytes() + self.labels

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        """Views of the packed bytes: a worker holds nothing beside them."""
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        view = memoryview(blob)
        at = 8 + 8 * n
        return cls(bytes(view[at + 4 * (n + 1) :]), view[at : at + 4 * (n + 1)].cast("I"), view[8:at].cast("q"))

    def doors(self) -> tuple[np.ndarray, np.ndarray]:
        """First and second letters of its words, as tables of 256 flags."""
        one, two = np.zeros(256, bool), np.zeros(256, bool)
        for v in range(self.first[0], self.first[1]):
            one[self.labels[v]] = True
            two[list(self.labels[self.first[v] : self.first[v + 1]])] = True
        return one, two

    def _end(self, v: int, word: bytes, at: int) -> int:
        """The count of the word that ``word[at:]`` spells from node ``v`` on, or 0."""
        labels, first = self.labels, self.first
        for i in range(at, len(word)):
            v = labels.find(word[i], first[v], first[v + 1])
            if v < 0:
                return 0
        return self.count[v]

    def neighbours(self, word: bytes) -> dict[bytes, int]:
        """Words at distance one, with their counts: the automaton's states without an edit are the word's own path.

        From each node of that path one edit is tried against the children there, and the rest must then follow without
        another. In a run of one letter only the first place is edited, as the others give the same word.
        """
        labels, first, found = self.labels, self.first, {}
        v, n, before = 0, len(word), -1
        for i in range(n + 1):
            low, high = first[v], first[v + 1]
            for child in range(low, high):
                letter = labels[child]
                if letter != before and (hit := self._end(child, word, i)):
                    found[word[:i] + labels[child : child + 1] + word[i:]] = hit
                if i < n and letter != word[i] and (hit := self._end(child, word, i + 1)):
                    found[word[:i] + labels[child : child + 1] + word[i + 1 :]] = hit
            if i == n:
                break
            if word[i] != before and (hit := self._end(v, word, i + 1)):
                found[word[:i] + word[i + 1 :]] = hit
            before = word[i]
            v = labels.find(before, low, high)
            if v < 0:
                break
        return found


def shard_tries(words: DataFrame, p: Params) -> DataFrame:
    """``shard, bytes, trie``: sorted ranges of the vocabulary, cut where a shard has enough letters."""

    def build(batches):
        names, counts, letters = [], [], 0

        def full():
            blob = Trie.of(names, counts).pack()
            return pa.RecordBatch.from_arrays([pa.array([names[0].decode("latin-1")]), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "bytes", "trie"])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                names.append(word.encode("latin-1"))
                counts.append(n)
                letters += len(word)
                if letters >= p.shard_letters:
                    yield full()
                    names, counts, letters = [], [], 0
        if names:
            yield full()

    ranges = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.select("word", "n").repartitionByRange(ranges, "word").sortWithinPartitions("word")
    return dealt.mapInArrow(build, "shard string, bytes bigint, trie binary")


# Neighbours --------------------------------------------------------------------------------------------------------

NEAR = "word string, n bigint, n_near bigint, near_n bigint, near string"


def walk(words: DataFrame, shared) -> DataFrame:
    """For each word and each shard of a block that has neighbours of it: their number and the best of them."""

    def run(batches):
        tries = [(t, *t.doors()) for t in map(Trie.unpack, shared.value)]
        for batch in batches:
            names = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            counts = batch.column("n").to_pylist()
            # A word without a second letter can reach any shard: its automaton is simply started.
            one = np.frombuffer(b"".join(w[:1] or b"\0" for w in names), np.uint8)
            two = np.frombuffer(b"".join(w[1:2] or b"\0" for w in names), np.uint8)
            short = np.array([len(w) < 2 for w in names])
            out = []
            for trie, firsts, seconds in tries:
                may = firsts[one] | firsts[two] | seconds[one] | seconds[two] | short
                for k in np.nonzero(may)[0].tolist():
                    found = trie.neighbours(names[k])
                    if found:
                        top = max(found.values())
                        best = min(w for w, n in found.items() if n == top)
                        out.append((names[k].decode("latin-1"), counts[k], len(found), top, best.decode("latin-1")))
            if out:
                kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["word", "n", "n_near", "near_n", "near"])

    return words.mapInArrow(run, NEAR)


def blocks(sizes: list[tuple[str, int]], limit: int) -> list[tuple[str, str]]:
    """First and last shard of each block of at most ``limit`` bytes; a larger shard is a block alone."""
    out, held = [], 0
    for name, size in sizes:
        if out and held + size <= limit:
            out[-1] = out[-1][0], name
            held += size
        else:
            out.append((name, name))
            held = size
    return out


def spelling_variants(
    docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary; see the module."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    words = scratch.table(vocabulary(docs, p, id_col, text_col), "words")
    shards = scratch.table(shard_tries(words, p), "shards")
    # One short row for each shard reaches the driver, and one block of tries at a time.
    sizes = sorted((r["shard"], r["bytes"]) for r in shards.select("shard", "bytes").toLocalIterator())
    near, tasks = None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for low, high in blocks(sizes, p.block_bytes):
        held = [bytes(r["trie"]) for r in shards.filter(F.col("shard").between(low, high)).select("trie").collect()]
        shared = spark.sparkContext.broadcast(held)
        # A vocabulary is small for its work: it is dealt to all tasks, not to as many as its bytes ask for.
        found = scratch.table(walk(words.repartition(tasks, "word"), shared), "near")
        shared.destroy()
        near = found if near is None else near.unionByName(found)
    if near is None:
        near = spark.createDataFrame([], NEAR)
    # The largest count, then the smallest word: a word has few neighbours, so no group is large.
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    reduced = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    long_enough = -F.col("best.order") >= p.ratio * F.col("n")
    made = words.join(reduced, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(long_enough, F.col("best.near")).alias("form"), F.when(long_enough, -F.col("best.order")).alias("form_n"),
    )
    made, _ = materialize(made, "forms")
    roots = follow(made.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    scratch.drop()
    return made.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(forms: DataFrame) -> DataFrame:
    """``word, root``: forms followed to the last, by joins that double the reach until nothing moves.

    Counts grow at every step, so there are no cycles.
    """
    spark = forms.sparkSession
    at, path = materialize(forms, "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step, step_path = materialize(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        moved = not step.filter("next IS NOT NULL").isEmpty()
        remove(spark, path)
        at, path = step.select("word", "root"), step_path
        if not moved:
            return at
