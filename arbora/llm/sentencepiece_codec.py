"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice has a node at every character boundary and an edge for every piece. The model is a byte-pair model, whose
result is no sum of scores; a path costs nothing where every two neighbouring pieces are what the model makes of their
concatenation, and is barred elsewhere. Exactly one allowed path reaches each node, so each node keeps one backpointer.
Only the last ``longest`` nodes can be extended, ``longest`` being the length of the longest piece. Once the paths from
all of them run through one common boundary, the pieces before that boundary are committed and their nodes dropped; a
window of ``2 * longest`` nodes is looked at for such a boundary whenever it is full.

No piece holds a space mark behind another character, so all paths converge before each space mark, and what lies
between two such boundaries is committed there; its ids are kept in a bounded cache. Every text takes this one way.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded alike; an empty
table gives an empty result. The model's space mark U+2581 in a text decodes as a space, as the model defines.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Entries of the chunk cache and of the pair cache, and the longest chunk kept. An idle Python worker keeps its caches.
CACHE, PAIRS, LONG_CHUNK = 400_000, 600_000, 48
#: Texts that a worker holds encoded at once.
SLICE = 200
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _fields(data: bytes):
    """The ``(number, value)`` fields of a protocol-buffer message."""

    def varint(at):
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            value, at = data[at : at + 4], at + 4
        yield key >> 3, value


class _Chunks(dict):
    """Ids by chunk, as the bytes of 32-bit numbers; made when they are missing, emptied when it is full."""

    def __init__(self, codec):
        self.codec = codec

    def __missing__(self, text: str) -> bytes:
        got = array("i", self.codec.chunk(text)).tobytes()
        if len(text) <= LONG_CHUNK:
            if len(self) >= CACHE:
                self.clear()
            self[text] = got
        return got


class Codec:
    """Encoder and decoder of one byte-pair model with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        normalizer = b""
        kind_of_model, self.prefix = 1, True
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                text, kind = part[1].decode(), part.get(3, NORMAL)
                i = len(self.pieces)
                self.pieces.append(text)
                if kind == NORMAL:
                    self.ids[text] = i
                    self.score[text] = struct.unpack("<f", part[2])[0]
                elif kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = i
                elif kind == UNKNOWN:
                    self.unknown = i
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                normalizer = value
        self.number = {p: (i,) for p, i in self.ids.items()}
        norm = dict(_fields(normalizer))
        self.prefix = bool(norm.get(3, 1))
        if kind_of_model != 2 or norm.get(2) or norm.get(4, 1):
            raise ValueError("a byte-pair model with identity normalisation is needed")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        self.longest = max(map(len, self.ids))
        byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [byte.get(i) or p.encode() for i, p in enumerate(self.pieces)]
        self.fit: dict[tuple[str, str], bool] = {}
        #: Pieces that the model leaves in one; only these are edges.
        good = {p for p in self.ids if len(self.merge(p)) == 1}
        self.edges = ahocorasick.Automaton()
        for p in good:
            self.edges.add_word(p, p)
        self.edges.make_automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        breaks = "" if "\n" in joined else "\\n"
        # Space marks with what follows them; a line end that no piece joins stands alone.
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|{breaks}" if breaks else "")).findall
        self.cache = _Chunks(self)

    def merge(self, text: str) -> list[str]:
        """The model's pieces of a short text: the best-scored neighbouring pair merges first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the model leaves ``left`` and ``right`` side by side."""
        if len(self.fit) >= PAIRS:
            self.fit.clear()
        got = self.fit[left, right] = self.merge(left + right) == [left, right]
        return got

    def stream(self, text: str) -> list[str]:
        """The pieces of ``text``; nodes behind the last boundary on which all surviving paths agree are dropped."""
        last = {0: ""}  # node -> the piece that its path ends with
        known, fits, window, out = self.fit.get, self.fits, 2 * self.longest, []
        settled = done = 0
        for end, piece in self.edges.iter(text):
            end += 1
            while settled < end - 1:  # no more edges end there
                settled += 1
                if settled not in last:
                    last[settled] = text[settled - 1]  # a character outside the vocabulary
                if settled - done >= window:
                    done = self.commit(last, done, settled, out)
            if end not in last:
                before = last[end - len(piece)]
                if before:
                    ok = known((before, piece))
                    if not (fits(before, piece) if ok is None else ok):
                        continue
                last[end] = piece
        for n in range(settled + 1, len(text) + 1):
            if n not in last:
                last[n] = text[n - 1]
            if n - done >= window:
                done = self.commit(last, done, n, out)
        out += self.path(last, done, len(text))
        return out

    def commit(self, last: dict[int, str], done: int, end: int, out: list[str]) -> int:
        """Give out the pieces before the last boundary that the paths from all nodes that can still be extended share."""
        shared = None
        for n in range(end, end - self.longest, -1):
            chain = {n}
            while n > done:
                n -= len(last[n])
                chain.add(n)
            shared = chain if shared is None else shared & chain
        meet = max(shared)
        if meet > done:
            out += self.path(last, done, meet)
            for n in range(done, meet):  # the piece before the boundary stays, as the next one must fit it
                last.pop(n, None)
        return meet

    @staticmethod
    def path(last, start: int, end: int) -> list[str]:
        """The pieces from node ``start`` to node ``end``."""
        out = []
        while end > start:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def numbers(self, piece: str) -> tuple[int, ...]:
        """The piece's id, or the ids of its bytes."""
        got = self.number.get(piece)
        if got is not None:
            return got
        found = tuple(self.bytes.get(b, self.unknown) for b in piece.encode("utf-8", "replace"))
        return found if self.bytes else (self.unknown,)

    def chunk(self, text: str) -> tuple[int, ...]:
        return tuple(i for p in self.stream(text) for i in self.numbers(p))

    def encoded(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers."""
        if not text:
            return b""
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return b"".join(map(self.cache.__getitem__, self.chunks(marked)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no valid UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec_of(model: bytes) -> Codec:
    """One codec per model and process, so that its caches outlast a task."""
    return Codec(model)


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every whole text.

    The model has a fixed size of some hundred KB; it is read once on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_of(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                held = [codec.encoded(t.as_py()) for t in batch.column(1)]
                ends = np.cumsum([0, *(len(x) // 4 for x in held)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(held), np.int32))),
                        pa.array((codec.decode(np.frombuffer(x, np.int32).tolist()) for x in held), pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")
