"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is the set of its word shingles. Two sets of similarity t or more share a token among the first
``n - ceil(t n) + 1`` of each, under any global order of tokens. Three orders are used. Each puts tokens in ascending
classes of their frequency, the rare ones first, and within a class by an own hash. A pair must meet in the first order's prefixes, there
pass the bounds of size and place, and share a token of the second and of the third order's prefixes. What all orders
let through is verified on whole sets.

Where a group of a token is large, its members are near copies, whose prefixes agree under every order. So a bound on
the difference of sets acts where pairs are formed: a bitmap holds the parity of a set's tokens in each of 512 cells,
and two sets differ in at least as many tokens as their bitmaps differ in bits.

Exact copies are one class from the start. Links inside a token's group are first sought with the group's most central
member, the one with the smallest share of rare tokens; later only between members that are not yet in one component. So a large group of copies never becomes all pairs, and no link between components is lost.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; with fewer words than a shingle
the whole sequence is one shingle; rows that share an id are compared each by its own text; a null id has a null
component; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import components, gram_hashes, materialize, remove, word_hashes

#: Tokens in fewer sets are rare, one class. The classes of at most so many others are broadcast (9 bytes each), those of
#: the most frequent; they only set the orders, and a token that is left out counts as rare.
RARE, LIST_MAX = 8, 4_000_000
#: Tokens that a task counts at once, and about as many that one list may have.
LIST_TOKENS = 1_000_000
#: Ids up to this number (some 70 bytes each) are broadcast to filter a scan; beyond it the scan is joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Documents that a Python worker cuts up at once.
SLICE = 500
#: Bits of a token that are stored, in whole bytes. Two sets of 300 tokens have one in common by chance once in some
#: 10^9 pairs.
STORED = 48
#: Longs of a bitmap.
LONGS = 8
BITS = [f"b{i}" for i in range(LONGS)]


@dataclass(frozen=True)
class Spec:
    """Words in a shingle, and the similarity as ``num / den``."""

    words: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - (self.num * n + self.den - 1) // self.den + 1 if n else 0


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingle_tokens(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased."""
    words = word_hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def packed(tokens: np.ndarray) -> bytes:
    """The first STORED bits of the tokens, in their order."""
    return (tokens >> np.uint64(64 - STORED)).view(np.uint8).reshape(-1, 8)[:, : STORED // 8].tobytes()


def unpacked(cell) -> np.ndarray:
    """The tokens of a binary cell that :func:`packed` made, as numbers of STORED bits."""
    data = np.frombuffer(cell.as_buffer(), np.uint8).reshape(-1, STORED // 8)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, : STORED // 8] = data
    return out.view(np.uint64).ravel()


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens in each cell, as LONGS longs."""
    cells = np.bincount((tokens >> np.uint64(64 - 6 - LONGS.bit_length() + 1)).astype(np.int64), minlength=64 * LONGS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def ranks(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Where tokens stand in one of the global orders: by class, then by the order's own hash."""
    mixed = tokens * _MIX[order]
    mixed ^= mixed >> np.uint64(32)
    return (classes.astype(np.uint64) << np.uint64(56)) | ((mixed * _MIX[1]) >> np.uint64(8))


def prefix_of(rank: np.ndarray, p: int) -> np.ndarray:
    """The places of the ``p`` smallest ranks, in their order."""
    if p < len(rank):
        first = np.argpartition(rank, p - 1)[:p]
        return first[np.argsort(rank[first])]
    return np.argsort(rank)


def _lists(arrays: list[np.ndarray], dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(dtype, copy=False)))


def set_table(docs: DataFrame, spec: Spec, id_type: str = "bigint") -> DataFrame:
    """``node, doc_id, n, set_hash, tokens, b0..b7``: a row's number, and its set's size, 128-bit hash, sorted tokens as
    :func:`packed`, and bitmap. Texts are cut up once."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sets = [shingle_tokens(t.as_py(), spec.words) for t in batch.column(1)]
                bits = np.array([bitmap(t) for t in sets]).reshape(len(sets), LONGS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(map(len, sets), pa.int32()),
                        pa.array([xxhash.xxh3_128_hexdigest(t.tobytes()) for t in sets], pa.string()),
                        pa.array(map(packed, sets), pa.binary()),
                        *(pa.array(bits[:, i], pa.int64()) for i in range(LONGS)),
                    ],
                    names=["doc_id", "n", "set_hash", "tokens", *BITS],
                )

    schema = f"doc_id {id_type}, n int, set_hash string, tokens binary, " + ", ".join(f"{b} bigint" for b in BITS)
    return docs.mapInArrow(run, schema).withColumn("node", F.monotonically_increasing_id())


def frequent_tokens(sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The tokens, of ``total``, that are not rare, with their classes, one per doubling of the frequency.

    Tokens are cut to their first bits, sorted; the third value is the number of bits cut off.

    Every task counts its own tokens and deals them out by their first bits, as sorted lists of the bits that follow, 32
    at most; each list is then counted on its own. Lists have some MB at any size of the corpus.
    """
    bits = min(24, max(8, int(total // LIST_TOKENS).bit_length()))
    cut, width = max(0, STORED - 32 - bits), min(32, STORED - bits)

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            for cell in batch.column(0):
                held.append(unpacked(cell) >> np.uint64(cut))
                size += len(held[-1])
                if size >= LIST_TOKENS:
                    yield _dealt(held, width)
                    held, size = [], 0
        if size:
            yield _dealt(held, width)

    def count(batches):
        held, last = [], None
        for batch in batches:
            for part, once, more, counts in zip(*(batch.column(i) for i in range(4))):
                if held and part.as_py() != last:
                    yield _counted(held, last, width)
                    held = []
                last = part.as_py()
                held.append([np.frombuffer(x.as_buffer(), np.uint32) for x in (once, more, counts)])
        if held:
            yield _counted(held, last, width)

    dealt = sets.select("tokens").mapInArrow(deal, "part int, once binary, more binary, counts binary")
    counted = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "token bigint, class int")
    table, path = materialize(counted, "counts")
    low = 0
    while table.filter(F.col("class") >= low).count() > LIST_MAX:
        low += 1
    kept = table.filter(F.col("class") >= low).toArrow()
    remove(sets.sparkSession, path)
    tokens, classes = kept.column(0).to_numpy().view(np.uint64), kept.column(1).to_numpy().astype(np.int8)
    order = np.argsort(tokens)
    return tokens[order], classes[order], cut


def _dealt(held: list[np.ndarray], width: int) -> pa.RecordBatch:
    tokens, counts = np.unique(np.concatenate(held), return_counts=True)
    part, rest = (tokens >> np.uint64(width)).astype(np.int32), (tokens & np.uint64((1 << width) - 1)).astype(np.uint32)
    starts = np.nonzero(np.diff(part, prepend=-1))[0]
    lists = []
    for a, b in zip(starts, [*starts[1:], len(part)]):
        single = counts[a:b] == 1
        more = ~single
        lists.append((rest[a:b][single].tobytes(), rest[a:b][more].tobytes(), counts[a:b][more].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[starts], pa.int32()), *(pa.array([x[i] for x in lists], pa.binary()) for i in range(3))],
        names=["part", "once", "more", "counts"],
    )


def _counted(held: list[list[np.ndarray]], part: int, width: int) -> pa.RecordBatch:
    rest = np.concatenate([x for once, more, _ in held for x in (once, more)])
    counts = np.concatenate([x for once, _, n in held for x in (np.ones(len(once), np.int64), n.astype(np.int64))])
    order = np.argsort(rest, kind="stable")
    rest, counts = rest[order], counts[order]
    starts = np.nonzero(np.diff(rest.astype(np.int64), prepend=-1))[0]
    sums = np.add.reduceat(counts, starts) if len(starts) else counts
    often = sums >= RARE
    tokens = (np.uint64(part) << np.uint64(width)) | rest[starts][often].astype(np.uint64)
    classes = np.log2(sums[often] / RARE).astype(np.int32) + 1
    return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(classes)], names=["token", "class"])


def only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` that are in ``nodes``: broadcast up to a checked size, else joined by shuffle."""
    return sets.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node", "left_semi")


def order_table(sets: DataFrame, spec: Spec, frequent: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """``node, n, far, first, second, third, b0..b7``: the share of rare tokens in thousandths, and the prefixes under
    the three orders."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        hot, classes, cut = shared.value
        for batch in batches:
            far, first, others = [], [], ([], [])
            for n, cell in zip(batch.column(1).to_pylist(), batch.column(2)):
                t = unpacked(cell)
                c = np.zeros(n, np.int8)
                if len(hot) and n:
                    short = t >> np.uint64(cut)
                    at = np.minimum(np.searchsorted(hot, short), len(hot) - 1)
                    c = np.where(hot[at] == short, classes[at], 0)
                p = spec.prefix(n)
                far.append(1000 * int((c == 0).sum()) // max(1, n))
                first.append(t[prefix_of(ranks(t, c, 0), p)].view(np.int64))
                for order, out in enumerate(others, 1):
                    # Half of each hash is enough for a filter.
                    out.append(t[prefix_of(ranks(t, c, order), p)].astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(far, pa.int32()),
                    _lists(first, np.int64),
                    *(_lists(x, np.int32) for x in others),
                    *batch.columns[3:],
                ],
                names=["node", "n", "far", "first", "second", "third", *BITS],
            )

    schema = "node bigint, n int, far int, first array<bigint>, second array<int>, third array<int>, "
    return sets.select("node", "n", "tokens", *BITS).mapInArrow(run, schema + ", ".join(f"{b} bigint" for b in BITS))


def may_link(spec: Spec, u: str, v: str, places: bool = False) -> Column:
    """What sizes, bitmaps and, with ``places``, the places of a common token allow for the sets ``u`` and ``v``."""
    at = lambda side, c: F.col(f"{side}{c}")
    nu, nv = at(u, "n"), at(v, "n")
    apart = reduce(lambda x, y: x + y, (F.bit_count(at(u, b).bitwiseXOR(at(v, b))) for b in BITS))
    ok = (spec.den * F.least(nu, nv) >= spec.num * F.greatest(nu, nv)) & (
        (spec.num + spec.den) * apart <= (spec.den - spec.num) * (nu + nv)
    )
    if places:
        left = F.least(nu - at(u, "at"), nv - at(v, "at"))
        ok = ok & ((spec.num + spec.den) * left >= spec.num * (nu + nv))
    return ok


def verified(pairs: DataFrame, sets: DataFrame, orders: DataFrame, spec: Spec) -> DataFrame:
    """The pairs ``(u, v)`` that meet in the second and in the third order too, and whose whole sets are similar enough."""
    spark = pairs.sparkSession
    side = lambda df, c, *names: df.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in names))
    nodes = lambda df: df.select(F.col("u").alias("node")).union(df.select("v")).distinct()
    # First by sizes and bitmaps, which are small; the prefixes of what is left are fetched then.
    near = pairs.join(side(orders, "u", "n", *BITS), "u").join(side(orders, "v", "n", *BITS), "v")
    near, near_at = materialize(near.filter(may_link(spec, "u_", "v_")).select("u", "v"), "near")
    some = only(orders.select("node", "second", "third"), nodes(near))
    meet = near.join(side(some, "u", "second", "third"), "u").join(side(some, "v", "second", "third"), "v")
    meet = meet.filter(F.arrays_overlap("u_second", "v_second") & F.arrays_overlap("u_third", "v_third")).select("u", "v")
    meet, meet_at = materialize(meet, "candidates")
    ids, ids_at = materialize(nodes(meet), "candidate-ids")
    chosen = only(sets, ids)
    whole = lambda c: chosen.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("tokens_u"), batch.column("tokens_v")):
                x, y = unpacked(a), unpacked(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(spec.den * both >= spec.num * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    checked = (
        meet.join(whole("u"), "u").join(whole("v"), "v").select("u", "v", "tokens_u", "tokens_v").mapInArrow(check, "u bigint, v bigint")
    )
    links, _ = materialize(checked.distinct(), "links")
    remove(spark, near_at, meet_at, ids_at)
    return links


def jaccard_classes(
    docs: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text", every_link: bool = False, id_type: str = "bigint"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document, and ``n_links`` with ``every_link``.

    ``component_id`` is the smallest id that links reach; ``n_links`` counts all classes that the document's class is
    linked with, its exact copies excluded. For that, pairs inside components are formed and verified too. Ids are read
    as ``id_type``, which may be a string.
    """
    docs = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    full, full_at = materialize(set_table(docs, spec, id_type), "sets")
    rows, _ = materialize(full.select("doc_id", "n", "set_hash"), "rows")
    # Of the rows with one set, one of the smallest id stands for all.
    named = full.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(
        F.min(F.struct("doc_id", "node")).alias("one"), F.max("n").alias("n")
    )
    classes, _ = materialize(named.select("set_hash", F.col("one.node").alias("node"), F.col("one.doc_id").alias("doc_id"), "n"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    sets = only(full, classes.select("node"))
    orders, orders_at = materialize(order_table(sets, spec, frequent_tokens(sets, total)), "orders")

    spots = orders.select("node", "n", "far", F.posexplode("first").alias("at", "token"))
    leaders = spots.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("far", "node")).alias("one"))
    leaders, leaders_at = materialize(leaders.filter("c > 1").select("token", F.col("one.node").alias("leader")), "leaders")
    groups, groups_at = materialize(spots.join(leaders, "token").drop("far"), "groups")
    star, star_at = materialize(
        groups.filter("node <> leader")
        .select(F.least("leader", "node").alias("u"), F.greatest("leader", "node").alias("v"))
        .distinct(),
        "star",
    )
    links = verified(star, full, orders, spec)
    first = components(links)

    # A token's group is open while its members are in several components; its main component is the most frequent.
    labelled, labelled_at = materialize(
        groups.drop("leader").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled"
    )
    remove(spark, groups_at, leaders_at)
    main = (
        labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("token")
        .agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("c"))
        .filter("comps > 1 AND c > 2")
        .select("token", "main")
    )
    main, main_at = materialize(main, "main")
    opened = labelled if every_link else labelled.join(main, "token")
    opened, opened_at = materialize(opened.join(orders.select("node", *BITS), "node"), "open")
    side = lambda df, s: df.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "comp", "n", "at", *BITS)))
    if every_link:
        a, b, apart = side(opened, "u"), side(opened, "v"), F.col("u_node") < F.col("v_node")
    else:
        a, b, apart = side(opened.filter("comp <> main"), "u"), side(opened, "v"), F.col("u_comp") != F.col("v_comp")
    cross = (
        a.join(b, "token")
        .filter(apart & may_link(spec, "u_", "v_", places=True))
        .select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))
    )
    cross, cross_at = materialize(cross.distinct().join(star, ["u", "v"], "left_anti"), "cross")
    remove(spark, labelled_at, main_at, opened_at)
    links = links.union(verified(cross, full, orders, spec))
    links, _ = materialize(links, "all-links")
    final = components(links)
    remove(spark, cross_at, star_at, orders_at)

    comps = classes.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = comps.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = comps.join(heads, "comp").select("node", "set_hash", "component_id")
    if every_link:
        degree = links.select(F.col("u").alias("node")).union(links.select("v")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        named = named.join(degree, "node", "left")
    named, _ = materialize(named.drop("node"), "named")
    remove(spark, full_at)
    return (
        rows.join(named, "set_hash", "left")
        .select(
            "doc_id",
            F.col("n").cast("bigint").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
            *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if every_link else []),
        )
    )
