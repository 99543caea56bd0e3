"""Exact substring dedup by suffix arrays built in two stages.

Every byte inside a string of ``length`` bytes that also starts elsewhere is removed. A string of that length is filed
under the smallest hash of the shorter grams inside it, so equal strings are filed together and the suffix arrays stay
local. Neighbouring strings under one hash form one run with one context, the bytes that they span; equal contexts are
one class with a count, so copies never meet in one task. Where a hash has several classes, the classes' contexts are
joined into one text, its suffix array is built, and adjacent common prefixes of ``length`` bytes mark the repeats.

A hash with very many classes is split before that: its strings are filed anew under the next smallest hash of their
grams too, so equal strings still meet, in shorter contexts of which more are equal. This is done again as long as a
group is too large, up to LEVELS hashes; strings that agree in so many grams and still crowd are counted one by one.

The suffix array takes two stages: suffixes smaller than their successors are sorted directly, all others are induced
by one scan over the buckets of first bytes. Orders are exact to ``length`` bytes, more is never compared.

Defined cases: a null or empty text has no bytes and the digest of nothing; a text shorter than ``length`` loses
nothing; rows that repeat a text are removed whole if they are long enough, also if they share an id; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import materialize, remove
from arbora.tables import Scratch

LENGTH, GRAM = 200, 64
#: Bytes of one piece of a long text, strings of one run, bytes of one suffix array.
PIECE, RUN, TEXT = 1 << 20, 512, 1 << 19
#: A hash with more classes is split by the next smallest hashes of its strings, so many times at most.
CROWD, LEVELS = 1_000, 6
SEPARATOR = 0xFF  # no byte of UTF-8

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the hash base and of its inverse, grown as texts need them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of every ``k``-byte gram."""
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` neighbours: of block prefixes and block suffixes."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """``(hash, first, last, twin)`` arrays: maximal runs of string starts filed under one hash, at most RUN long.

    ``twin`` tells that the hash belongs to two grams so near that one run may hold one string twice.
    """
    hashes, firsts, lasts, twins = [], [], [], []
    width = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, PIECE + length - 1), at)
        each = gram_hashes(part, gram)
        low = sliding_min(each, width)
        # A gram is chosen if it equals the greatest minimum among the strings that hold it.
        edge = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
        chosen = np.nonzero(~sliding_min(np.concatenate([edge, ~low, edge]), width) == each)[0]
        order = np.argsort(each[chosen], kind="stable")
        value, spot = each[chosen][order], chosen[order]
        near = value[1:][(value[1:] == value[:-1]) & (np.diff(spot) < length + RUN)]
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        starts = np.nonzero(new)[0]
        ends = np.append(starts[1:], len(low)) - 1
        long = np.nonzero(ends - starts >= RUN)[0]
        if len(long):
            cut = np.concatenate([np.arange(starts[i] + RUN, ends[i] + 1, RUN) for i in long])
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.append(starts[1:], len(low)) - 1
        hashes.append(low[starts])
        firsts.append(starts + at)
        lasts.append(ends + at)
        twins.append(np.isin(hashes[-1], near))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(map(np.concatenate, (hashes, firsts, lasts, twins)))


def words_at(text: np.ndarray) -> np.ndarray:
    """The next eight bytes of every place as one big-endian number; behind the end stand separators."""
    padded = np.concatenate([text, np.full(8, SEPARATOR, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last one is not."""
    n = len(text)
    differs = np.nonzero(text[:-1] != text[1:])[0]
    spot = np.searchsorted(differs, np.arange(n))
    out = np.zeros(n, bool)
    inside = spot < len(differs)
    at = differs[spot[inside]]
    out[inside] = text[at] < text[at + 1]
    return out


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by their suffixes, to ``depth`` bytes: eight bytes at a time, ties only."""
    n = len(words)
    key = words[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    group = np.zeros(len(places), np.int64)
    group[1:] = np.cumsum(key[1:] != key[:-1])
    tied = np.arange(len(places))
    for d in range(8, depth, 8):
        g = group[tied]
        same = np.zeros(len(tied) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        tied = tied[same[1:] | same[:-1]]
        if not len(tied):
            break
        g = group[tied]
        key = words[np.minimum(places[tied] + d, n - 1)]
        order = np.lexsort((key, g))
        places[tied] = places[tied][order]
        key = key[order]
        new = np.ones(len(tied), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[tied] = tied[np.nonzero(new)[0]][np.cumsum(new) - 1]
    return places


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` in order, exact to ``depth`` bytes.

    The text ends with a separator, and separators follow its end for ever.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    words, small = words_at(text), smaller_than_next(text)
    direct = sort_directly(np.nonzero(small)[0], words, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[~small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for part in np.split(before, np.nonzero(np.diff(first))[0] + 1):
            if len(part):
                induced[text[part[0]]].append(part)

    out = []
    for c in range(256):
        bucket, i = induced[c], 0
        while i < len(bucket):  # a bucket grows while it is scanned
            induce(bucket[i])
            i += 1
        if c == SEPARATOR:
            bucket.append(np.array([len(text) - 1]))  # the last suffix is the largest, and nothing induces it
        sorted_here = direct[bounds[c] : bounds[c + 1]]
        induce(sorted_here)
        out += bucket
        out.append(sorted_here)
    return np.concatenate(out)


def common_prefixes(left: np.ndarray, right: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes ``left[i]`` and ``right[i]`` share, up to ``depth``."""
    out = np.full(len(left), depth, np.int64)
    live = np.arange(len(left))
    n = len(words)
    for d in range(0, depth, 8):
        a, b = words[np.minimum(left[live] + d, n - 1)], words[np.minimum(right[live] + d, n - 1)]
        apart = a ^ b
        ends = apart != 0
        if ends.any():
            gap, same = apart[ends], np.zeros(int(ends.sum()), np.int64)
            for j in range(7, 0, -1):
                same += (gap >> np.uint64(8 * j)) == 0
            out[live[ends]] = np.minimum(d + same, depth)
            live = live[~ends]
        if not len(live):
            break
    return out


def repeated_starts(contexts: list[bytes], counts: list[int], length: int) -> list[tuple[list[int], list[int]]]:
    """For every context the ranges of string starts whose string stands elsewhere among the contexts."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.zeros(len(contexts), np.int64)
    begin[1:] = np.cumsum(sizes[:-1] + 1)
    text = np.frombuffer(bytes([SEPARATOR]).join(contexts) + bytes([SEPARATOR]), np.uint8)
    valid = np.zeros(len(text) + 1, np.int8)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + np.maximum(sizes - length + 1, 0), -1)
    valid = np.cumsum(valid)[:-1].astype(bool)
    order = suffix_array(text, length)
    order = order[valid[order]]
    shared = common_prefixes(order[:-1], order[1:], words_at(text), length) >= length
    hit = np.zeros(len(text), bool)
    hit[order[:-1][shared]] = True
    hit[order[1:][shared]] = True
    out = []
    for b, size, count in zip(begin.tolist(), sizes.tolist(), counts):
        if count > 1:
            out.append(([0], [size - length]))
            continue
        edge = np.diff(np.concatenate([[0], hit[b : b + size - length + 1].view(np.int8), [0]]))
        out.append((np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()))
    return out


def _marks(contexts: DataFrame, length: int) -> DataFrame:
    """``hash, context, lows, highs`` from ``hash, context, n, bytes``, one suffix array after another."""
    lists = pa.list_(pa.int64())

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def settle():
            marks = repeated_starts([r[3] for r in held], [r[2] for r in held], length)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in held], pa.int64()),
                    pa.array([r[1] for r in held], pa.int64()),
                    pa.array([m[0] for m in marks], lists),
                    pa.array([m[1] for m in marks], lists),
                ],
                names=["hash", "context", "lows", "highs"],
            )
            held.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and row[0] != last and size >= TEXT:
                    yield settle()
                    size = 0
                held.append(row)
                size += len(row[3])
                last = row[0]
        if held:
            yield settle()

    return (
        contexts.repartition("hash")
        .sortWithinPartitions("hash")
        .mapInArrow(run, MARKS)
    )


MARKS = "hash bigint, context bigint, lows array<bigint>, highs array<bigint>"


def _settled(contexts: DataFrame, length: int, gram: int, scratch: Scratch, level: int = 1) -> DataFrame:
    """The marks of ``hash, context, n, bytes, chain``: every group in one suffix array, crowded ones split before.

    ``chain`` has the hashes that all strings of the group share.
    """
    crowd = scratch.table(contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > CROWD).select("hash"), "crowd")
    plain = ["hash", "context", "n", "bytes"]
    if not crowd.limit(1).count():
        return _marks(contexts.select(*plain), length)
    small = contexts.join(crowd, "hash", "left_anti").select(*plain)
    large = contexts.join(crowd, "hash", "left_semi")
    if level == LEVELS:
        return _marks(small, length).unionByName(_single_marks(large.select(*plain), length, scratch))

    def split(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                each = gram_hashes(np.frombuffer(row["bytes"], np.uint8), gram)
                each[np.isin(each, np.array(row["chain"], np.int64).view(np.uint64))] = np.iinfo(np.uint64).max
                low = sliding_min(each, length - gram + 1)
                starts = np.nonzero(np.concatenate([[True], low[1:] != low[:-1]]))[0]
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(low)]):
                    chain = [*row["chain"], int(low[a : a + 1].view(np.int64)[0])]
                    part = row["bytes"][a : b - 1 + length]
                    key = xxhash.xxh3_64_intdigest(np.array(chain, np.int64).tobytes())
                    rows.append((row["hash"], row["context"], a, key, xxhash.xxh3_64_intdigest(part), row["n"], part, chain))
            signed = lambda xs: pa.array(np.array(xs, dtype=np.uint64).view(np.int64))
            column = lambda i: [r[i] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column(0), pa.int64()), pa.array(column(1), pa.int64()), pa.array(column(2), pa.int64()), signed(column(3)), signed(column(4)),
                    pa.array(column(5), pa.int64()), pa.array(column(6), pa.binary()), pa.array(column(7), pa.list_(pa.int64())),
                ],
                names=["hash", "context", "at", "key", "part", "n", "bytes", "chain"],
            )

    schema = "hash bigint, context bigint, at bigint, key bigint, part bigint, n bigint, bytes binary, chain array<bigint>"
    parts = scratch.table(large.select(*plain, "chain").mapInArrow(split, schema), "parts")
    merged = scratch.table(
        parts.groupBy(F.col("key").alias("hash"), F.col("part").alias("context")).agg(
            F.sum("n").alias("n"), F.first("bytes").alias("bytes"), F.first("chain").alias("chain")
        ),
        "merged",
    )
    deeper = scratch.table(_settled(merged, length, gram, scratch, level + 1).filter(F.size("lows") > 0), "deeper")
    deeper = deeper.withColumnsRenamed({"hash": "key", "context": "part"})
    shift = lambda c: F.flatten(F.collect_list(F.transform(c, lambda x: x + F.col("at"))))
    found = parts.select("hash", "context", "at", "key", "part").join(deeper, ["key", "part"])
    found = found.groupBy("hash", "context").agg(shift("lows").alias("lows"), shift("highs").alias("highs"))  # within one context
    return _marks(small, length).unionByName(found)


def _single_marks(contexts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """As :func:`_marks` by a grouped count of string hashes, which pre-aggregates."""

    def strings(batches):
        for batch in batches:
            rows = []
            for h, c, n, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for j in range(len(data) - length + 1):
                    rows.append((h, c, j, n, xxhash.xxh3_128_digest(data[j : j + length])))
                if len(rows) > 100_000:
                    yield _strings_batch(rows)
                    rows = []
            yield _strings_batch(rows)

    each = contexts.mapInArrow(strings, "hash bigint, context bigint, j bigint, n bigint, string binary")
    each = scratch.table(each, "strings")
    twice = scratch.table(each.groupBy("hash", "string").agg(F.sum("n").alias("c")).filter("c > 1").drop("c"), "twice")
    found = each.join(twice, ["hash", "string"], "left_semi").groupBy("hash", "context").agg(F.array_sort(F.collect_set("j")).alias("lows"))
    return found.withColumn("highs", F.col("lows"))


def _strings_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["hash", "context", "j", "n", "string"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, text_hash, lows, highs``: unmerged byte ranges to remove, for texts that have any."""
    spark = docs.sparkSession

    def cut(batches):
        for batch in batches:
            sizes, parts, contexts = [], [], []
            for cell in batch.column(2):
                data = cell.as_py() or b""
                h, s, e, twin = runs_of(data, length, gram)
                contexts += [xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(s.tolist(), e.tolist())]
                sizes.append(len(h))
                parts.append((h.view(np.int64), s, e, twin))
            repeat = np.repeat(np.arange(len(sizes)), sizes)
            flat = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(repeat)),
                    batch.column(1).take(pa.array(repeat)),
                    pa.array(flat[0], pa.int64()),
                    pa.array(np.array(contexts, dtype=np.uint64).view(np.int64), pa.int64()),
                    pa.array(flat[1], pa.int64()),
                    pa.array(flat[2], pa.int64()),
                    pa.array(flat[3].astype(bool), pa.bool_()),
                ],
                names=["doc_id", "text_hash", "hash", "context", "first", "last", "twin"],
            )

    runs, runs_at = materialize(
        docs.filter(F.length("data") >= length).mapInArrow(
            cut, "doc_id bigint, text_hash bigint, hash bigint, context bigint, first bigint, last bigint, twin boolean"
        ),
        "runs",
    )
    often, often_at = materialize(runs.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.max("twin").alias("twin")).filter("c > 1 OR twin").select("hash"), "often")
    met, _ = materialize(runs.join(often, "hash"), "met")
    remove(spark, runs_at, often_at)

    classes, classes_at = materialize(
        met.groupBy("hash", "context").agg(
            F.count(F.lit(1)).alias("n"), F.max("twin").alias("twin"), F.min(F.struct("doc_id", "text_hash", "first", "last")).alias("at")
        ),
        "classes",
    )
    kinds, kinds_at = materialize(
        classes.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.max("twin").alias("twin")).filter("kinds > 1 OR twin").select("hash"), "kinds"
    )
    # Of a hash with one class every string is repeated. Of the others the contexts are fetched, one per class.
    mixed = classes.join(kinds, "hash").select("hash", "context", "n", "at.*")
    wanted = mixed.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("hash", "context", "n", "first", "last")).alias("want")  # a text bounds its runs
    )

    def fetch(batches):
        for batch in batches:
            rows = []
            for data, want in zip(batch.column("data"), batch.column("want")):
                data = data.as_py()
                for w in want.as_py():
                    rows.append((w["hash"], w["context"], w["n"], data[w["first"] : w["last"] + length]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["hash", "context", "n", "bytes"]
            )

    on = docs.doc_id.eqNullSafe(wanted.doc_id) & (docs.text_hash == wanted.text_hash)
    texts = docs.join(wanted, on).select(docs.data, "want")
    contexts, contexts_at = materialize(
        texts.mapInArrow(fetch, "hash bigint, context bigint, n bigint, bytes binary"), "fetched"
    )
    # Rows that repeat id and text fetch the same contexts again; one of each stays.
    contexts = contexts.groupBy("hash", "context").agg(F.first("n").alias("n"), F.first("bytes").alias("bytes"))
    contexts, merged_at = materialize(contexts.withColumn("chain", F.array("hash")), "contexts")
    scratch = Scratch(spark)
    marks = _settled(contexts, length, gram, scratch)
    marks, _ = materialize(marks.filter(F.size("lows") > 0), "marks")
    scratch.drop()
    single, _ = materialize(
        classes.join(kinds, "hash", "left_anti").filter("n > 1").select(
            "hash", "context", F.lit(None).cast("array<bigint>").alias("lows"), F.lit(None).cast("array<bigint>").alias("highs")
        ),
        "single",
    )
    decided, _ = materialize(marks.unionByName(single), "decided")
    remove(spark, contexts_at, merged_at, classes_at, kinds_at)
    shift = lambda c, by: F.transform(c, lambda x: x + by)
    spans = met.join(decided, ["hash", "context"]).select(
        "doc_id", "text_hash",
        F.coalesce(shift(F.col("lows"), F.col("first")), F.array("first")).alias("lows"),
        F.coalesce(shift(F.col("highs"), F.col("first")), F.array("last")).alias("highs"),
    )
    # Rows that repeat id and text, or have no id, give the same spans again: sets keep one of each, in every task first.
    found = F.collect_set(F.struct("lows", "highs")).alias("found")
    gathered = spans.groupBy("doc_id", "text_hash").agg(found)
    gathered = gathered.select("doc_id", "text_hash", F.flatten("found.lows").alias("lows"), F.flatten("found.highs").alias("highs"))
    return materialize(gathered, "spans")[0]


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every document; ``kept`` is the remaining text's bytes."""
    docs = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"),
    )
    spans = repeated_spans(docs, length, gram)
    on = docs.doc_id.eqNullSafe(spans.doc_id) & (docs.text_hash == spans.text_hash)
    joined = docs.join(spans, on, "left").select(docs.doc_id, "data", "lows", "highs")

    def trim(batches):
        for batch in batches:
            out = []
            for data, lows, highs in zip(batch.column("data"), batch.column("lows"), batch.column("highs")):
                data, lows = data.as_py(), lows.as_py()
                spots = sorted(zip(lows, highs.as_py())) if lows else []
                removed = n = seen = 0
                kept = []
                for low, high in spots:
                    if n == 0 or low > seen:
                        kept.append(data[seen:low])
                        n += 1
                        removed -= low
                        removed += high + length
                        seen = high + length
                    elif high + length > seen:
                        removed += high + length - seen
                        seen = high + length
                kept.append(data[seen:])
                kept = b"".join(kept)
                out.append((len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return joined.mapInArrow(
        trim, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
