"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A window and an item are sequences of words. The CGK embedding walks along a sequence: at every step it gives out the
word that it stands at, and a random bit of that word and step decides whether it moves on. Sequences a few edits apart
fall into step again, so their embeddings agree in many places: edit distance becomes Hamming distance. A key is a
sample of such places. Texts are looked up by the keys of all their windows, at every word, in the keys of all items;
many keys of several walks are tried. An item longer than PIECE words is looked up by its pieces, of which one at least
is no further from its match than the whole.

How many keys a size of items needs is measured: items with as many random edits as may be are embedded, and keys are
added until the target recall is reached. How many places a key samples follows from the number of items, so that
chance hits stay rare. Every hit is verified by edit distance on words around the window, which whole numbers of n bits
compute a text word at a time. Stretches of text that hold fewer of the rarer words of any piece than a match of it
keeps are not embedded. So a match without edits is always found, and one at the edit bound with the target recall.

Words are split at ASCII and wide punctuation; scripts without spaces between words are split by character.

Defined cases: a null or empty text or item matches nothing; an item of fewer than ``min_words`` words matches only
where all of it stands in a row; of equally good places the first is reported; rows that share an id are scanned apart;
an empty documents or benchmark table gives an empty result; extra columns are not read and pass through
``without_leaks``, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import fresh, materialize

#: Characters of benchmark text that are held at once; a larger benchmark is scanned in several blocks, one after another.
BLOCK_CHARS = 4 << 20
#: Texts of this many bytes are searched at once.
SLICE_BYTES = 1 << 20
HITS = "doc_id bigint, text_hash bigint, item_id bigint, first_word bigint, n_words bigint, edits int, similarity double"
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
#: Characters of scripts without spaces between words (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han), and their punctuation.
UNSPACED = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u303c"
    "\u3041-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f"
    "\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U0003ffff]"
)
WIDE = re.compile("[\u3000-\u3003\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


#: Words of a piece at most, keys of one walk, keys at most, trials of a measurement, and chance hits of a window.
PIECE, PER_WALK, MOST_KEYS, TRIALS, CHANCE = 48, 4, 1024, 400, 0.001
#: A word is telling if it stands in this share of the pieces at most, or in two.
TELLING = 1 / 100
#: Words of a stretch, and how far a window may start outside a match.
STRETCH, SLACK = 128, 2
#: Sizes of pieces that share keys: the keys look at the first steps, as many as the smallest of them has words.
SIZES = (1, 2, 3, 4, 5, 8, 12, 18, 27, 39, PIECE + 1)


@dataclass(frozen=True)
class Spec:
    similarity: float = 0.8
    #: Items of fewer words match without any edit.
    min_words: int = 5
    #: The share of matches at the edit bound that the keys must find.
    recall: float = 0.995
    seed: int = 5

    def edits(self, n: int) -> int:
        return int(n * (1 - self.similarity) + 1e-9) if n >= self.min_words else 0


def words_of(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = UNSPACED.sub(r" \g<0> ", WIDE.sub(" ", text))
    return WORDS(text.encode("utf-8", "surrogatepass"))


def _places(item: list[int]) -> dict[int, int]:
    """The places of each word of ``item`` as bits."""
    out: dict[int, int] = {}
    for i, x in enumerate(item):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _distances(item: list[int], text: list[int], anchored: bool):
    """The edits between ``item`` and the nearest part that ends behind each word of ``text``; anchored, all before it.

    Myers' bit vectors: ``up`` and ``down`` hold where a column of the edit table rises and falls.
    """
    n, places = len(item), _places(item)
    full, top, first = (1 << n) - 1, 1 << (n - 1), int(anchored)
    up, down, cost = full, 0, n
    for word in text:
        eq = places.get(word, 0)
        across = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = down | (full & ~(across | up)), up & across
        cost += (rise & top > 0) - (fall & top > 0)
        yield cost
        rise, fall = (rise << 1 | first) & full, (fall << 1) & full
        eq |= down
        up, down = fall | (full & ~(eq | rise)), rise & eq


def best_place(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the part of ``text`` nearest to ``item`` within ``most`` edits.

    Of equals the one that starts last, then the first.
    """
    costs = list(_distances(item, text, False))
    edits = min(costs, default=len(item))
    if edits > most or edits == len(item):
        return None
    back, best = item[::-1], None
    for end in (j for j, cost in enumerate(costs, 1) if cost == edits):
        part = text[max(0, end - len(item) - edits) : end][::-1]
        start = end - next(size for size, cost in enumerate(_distances(back, part, True), 1) if cost == edits)
        if best is None or start > best[1]:
            best = (edits, start, end)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keys:
    """The keys of pieces of ``low`` words or more: for each key the steps of the embedding that it samples."""

    def __init__(self, low: int, places: int, seed: int):
        self.low, self.places, self.seed, self.n = low, places, seed, MOST_KEYS
        rng = np.random.default_rng([seed, low])
        self.steps = [sorted(rng.choice(low, self.places, replace=False).tolist()) for _ in range(MOST_KEYS)]

    def codes(self, ids: np.ndarray, starts: np.ndarray):
        """For each key the hashes of the samples of the windows of ``ids`` that begin at ``starts``."""
        for walk in range(-(-self.n // PER_WALK)):
            chance = _mixed(ids.astype(np.uint64) + np.uint64((self.seed << 40) + (walk + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            keys = range(walk * PER_WALK, min(self.n, (walk + 1) * PER_WALK))
            at, out = starts.copy(), [np.full(starts.shape, k, np.uint64) for k in keys]
            for step in range(1 + max(self.steps[k][-1] for k in keys)):
                for i, k in enumerate(keys):
                    if step in self.steps[k]:
                        out[i] = _mixed(out[i] * np.uint64(0x9E3779B97F4A7C15) + ids[at].astype(np.uint64))
                at += ((chance[at] >> np.uint64(step)) & np.uint64(1)).astype(at.dtype)
            yield from out

    def fit(self, sizes: list[int], spec: Spec) -> bool:
        """Keep as many keys as find the target share of random matches at the edit bound, if there are so many."""
        rng = np.random.default_rng([self.seed, self.low, 1])
        fresh_words = iter(range(1, 1 << 40)).__next__
        pieces, hosts, starts = [], [], []
        gap = lambda n: [fresh_words() for _ in range(n)]
        for _ in range(TRIALS):
            size = int(rng.choice(sizes))
            piece = gap(size)
            part = list(piece)
            for _ in range(spec.edits(size)):
                kind, spot = rng.integers(3), int(rng.integers(len(part)))
                part[spot : spot + (kind != 1)] = gap(1) if kind else []
            before = sum(map(len, hosts))
            hosts.append(gap(PIECE) + part + gap(PIECE))
            starts.append(before + PIECE + np.arange(-SLACK, SLACK + 1))
            pieces.append(piece + gap(PIECE))
        own = np.cumsum([0, *map(len, pieces)])[:-1]
        text, items = (np.array([w for x in xs for w in x] + [0] * PIECE, dtype=np.int64) for xs in (hosts, pieces))
        found, self.n = np.zeros(TRIALS, bool), MOST_KEYS
        for k, (a, b) in enumerate(zip(self.codes(items, own), self.codes(text, np.array(starts))), 1):
            found |= (a[:, None] == b).any(axis=1)
            if found.mean() >= spec.recall:
                self.n = k
                return True
        return False


class Index:
    """The items, cut into pieces, and their keys."""

    def __init__(self, items: list[tuple[int, str]], spec: Spec):
        self.spec = spec
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.items.append((item_id, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]))
        self.pieces: list[tuple[int, int, int]] = []  # item, first word, size
        for k, (_, ids) in enumerate(self.items):
            parts = -(-len(ids) // PIECE)
            cuts = [i * len(ids) // parts for i in range(parts + 1)]
            self.pieces += [(k, a, b - a) for a, b in zip(cuts, cuts[1:])]
        self.tables = []
        if not self.items:
            return
        flat = np.concatenate([np.array(ids, dtype=np.int64) for _, ids in self.items] + [np.zeros(PIECE, np.int64)])
        begin = np.cumsum([0, *(len(ids) for _, ids in self.items)])
        # Two words of the benchmark are equal with this chance; a key's places make chance hits rare.
        alike = min(0.5, float(((np.bincount(flat[: begin[-1]]) / begin[-1]) ** 2).sum()))
        places = int(np.ceil(np.log(CHANCE / (50 * len(self.pieces))) / np.log(alike)))
        self._list_telling_words()
        for low, high in zip(SIZES, SIZES[1:]):
            mine = np.array([i for i, (_, _, size) in enumerate(self.pieces) if low <= size < high], dtype=np.int64)
            if not len(mine):
                continue
            keys = self._keys(low, sorted({self.pieces[i][2] for i in mine}), places)
            starts = np.array([begin[self.pieces[i][0]] + self.pieces[i][1] for i in mine])
            codes = np.concatenate(list(keys.codes(flat, starts)))
            owner = np.tile(mine, keys.n)
            order = np.argsort(codes, kind="stable")
            self.tables.append((keys, mine, codes[order], owner[order]))

    def _keys(self, low: int, sizes: list[int], places: int) -> Keys:
        """Keys of so many places, or of fewer where edits leave too few samples whole."""
        edited = any(self.spec.edits(size) for size in sizes)
        for p in range(min(places, max(2, low // 3) if edited else low), 0, -1):
            keys = Keys(low, p, self.spec.seed)
            if keys.fit(sizes, self.spec):
                return keys
        raise ValueError(f"no keys find a share of {self.spec.recall} of the matches of {low} words or more")

    def _list_telling_words(self) -> None:
        """``least`` is the number of its telling words that a match of a piece keeps at least; ``owners`` lists the
        pieces of every telling word, those of word w from ``first[w]`` on."""
        held = [set(self.items[k][1][a : a + size]) for k, a, size in self.pieces]
        pairs = np.array([(w, i) for i, words in enumerate(held) for w in words], dtype=np.int64).reshape(-1, 2)
        often = np.bincount(pairs[:, 0], minlength=len(self.numbers) + 2)
        self.telling = (often > 0) & (often <= max(2, int(TELLING * len(self.pieces))))
        pairs = pairs[self.telling[pairs[:, 0]]]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.numbers) + 2))
        edits = np.array([self.spec.edits(size) for _, _, size in self.pieces])
        self.least = np.bincount(pairs[:, 1], minlength=len(self.pieces)) - edits

    def stretches(self, ids: np.ndarray, count: int) -> np.ndarray:
        """``stretch * pieces + piece`` where a stretch of ``ids`` holds as many telling words of a piece as a match."""
        at = np.nonzero(self.telling[ids])[0]
        # A window that starts in a stretch ends less than 2 * PIECE words behind it.
        late = at[(at % STRETCH < 2 * PIECE) & (at >= STRETCH)]
        where = np.concatenate([at // STRETCH, late // STRETCH - 1])
        held = np.unique(where * len(self.telling) + ids[np.concatenate([at, late])])
        where, word = held // len(self.telling), held % len(self.telling)
        size = self.first[word + 1] - self.first[word]
        spots = np.repeat(self.first[word] - np.cumsum(size) + size, size) + np.arange(size.sum())
        found, counts = np.unique(np.repeat(where, size) * len(self.pieces) + self.owners[spots], return_counts=True)
        found = found[counts >= self.least[found % len(self.pieces)]]
        plain = np.nonzero(self.least <= 0)[0]
        everywhere = (np.arange(count)[:, None] * len(self.pieces) + plain).ravel()
        return np.unique(np.concatenate([found[found < count * len(self.pieces)], everywhere]))

    def windows(self, ids: np.ndarray):
        """By size class, the windows that are embedded and those of them that hit a piece, as ``keys, starts, hit
        starts, hit pieces``. ``ids`` ends with 2 * PIECE zeros."""
        last = len(ids) - 2 * PIECE
        count = -(-last // STRETCH)
        near = self.stretches(ids, count)
        for keys, mine, codes, owner in self.tables:
            held = np.zeros(count * STRETCH + 2 * SLACK, bool)
            for a in (np.unique(near[np.isin(near % len(self.pieces), mine)] // len(self.pieces)) * STRETCH).tolist():
                held[a : a + STRETCH + 2 * SLACK] = True
            starts = np.nonzero(held[SLACK : SLACK + last])[0]
            found = [np.zeros((2, 0), np.int64)]
            if len(starts):
                for code in keys.codes(ids, starts):
                    at = np.searchsorted(codes, code)
                    for i in np.nonzero(codes[np.minimum(at, len(codes) - 1)] == code)[0].tolist():
                        end = np.searchsorted(codes, code[i], "right")
                        found.append(np.array([np.full(end - at[i], starts[i]), owner[at[i] : end]]))
            hits = np.unique(np.concatenate(found, axis=1), axis=1)
            yield keys, starts, hits[0], hits[1]

    def best(self, item: list[int], text: list[int], starts: list[int]) -> tuple[int, int, int] | None:
        """``(edits, start, end)`` of the best place of ``item`` around the windows that begin at ``starts``."""
        n, most, found = len(item), self.spec.edits(len(item)), None
        for start in starts:
            if start >= 0 and text[start : start + n] == item:
                return 0, start, start + n
        if not most:
            return None
        while starts:
            near = [s for s in starts if s <= starts[0] + most]  # one region for windows that lie close together
            starts = starts[len(near) :]
            low = max(0, near[0] - most)
            region = text[low : max(0, near[-1] + n + most)]
            held = set(region)
            if sum(w not in held for w in item) > most:
                continue  # each word that is missing costs an edit
            if got := best_place(item, region, most if found is None else found[0]):
                got = (got[0], low + got[1], low + got[2])
                found = got if found is None else min(found, got)
        return found

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item number, edits, start, end)``: the best place of every item in every text."""
        ends = np.cumsum([0, *map(len, texts)])
        ids = np.concatenate([*texts, np.zeros(2 * PIECE, np.int64)])
        wanted: dict[tuple[int, int], set] = defaultdict(set)
        for _, _, starts, pieces in self.windows(ids):
            where = np.searchsorted(ends, starts, "right") - 1
            for t, start, piece in zip(where.tolist(), (starts - ends[where]).tolist(), pieces.tolist()):
                k, first, _ = self.pieces[piece]
                wanted[t, k].add(start - first)
        out, held = [], {}
        for (t, k), starts in sorted(wanted.items()):
            if t not in held:
                held = {t: texts[t].tolist()}
            if got := self.best(self.items[k][1], held[t], sorted(starts)):
                out.append((t, k, *got))
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every benchmark item that stands in a document, with its best place there, in words.

    Beyond one block of benchmark text, each block's rows are written before the next block's keys are sent out, so at
    most one block is broadcast at a time.
    """
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")
    )
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item")).filter("item IS NOT NULL")
    size = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b).toArrow().to_pylist()  # a bounded block
        index = Index(sorted({(x["item_id"] if x["item_id"] is not None else -1, x["item"]) for x in held}), spec)
        shared = texts.sparkSession.sparkContext.broadcast(index)
        hits = _scan(texts, shared)
        if blocks > 1:
            hits, _ = materialize(hits, "leaks")
            shared.destroy()
        out = hits if out is None else out.union(hits)
    return out


def _scan(texts: DataFrame, shared) -> DataFrame:
    def run(batches):
        held = shared.value
        number = held.numbers.get
        for batch in batches:
            ids, size, first = [], 0, 0
            for i, text in enumerate(batch.column(2), 1):
                text = text.as_py()
                ids.append(np.array([number(w, 0) for w in words_of(text)], dtype=np.int64))
                size += len(text or "")
                if size >= SLICE_BYTES or i == batch.num_rows:
                    yield _rows(batch, first, held, sorted(held.search(ids)) if held.items else [])
                    ids, size, first = [], 0, i

    return texts.mapInArrow(run, HITS)


def _rows(batch: pa.RecordBatch, first: int, held: Index, rows: list[tuple]) -> pa.RecordBatch:
    sizes = [len(held.items[k][1]) for _, k, *_ in rows]
    at = pa.array([first + r[0] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(at),
            batch.column(1).take(at),
            pa.array([held.items[r[1]][0] for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
            pa.array([r[4] - r[3] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int32()),
            pa.array([1 - r[2] / n for r, n in zip(rows, sizes)], pa.float64()),
        ],
        names=["doc_id", "text_hash", "item_id", "first_word", "n_words", "edits", "similarity"],
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item stands, with all their columns."""
    doc, text = fresh("_doc", docs), fresh("_hash", docs)
    found = leaks(docs, benchmark, spec, id_col, text_col).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text_col)) == F.col(text))
    return docs.join(found, same, "left_anti")
