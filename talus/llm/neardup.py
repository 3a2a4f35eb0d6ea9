"""Near copies by SimHash in BK-trees, checked by exact Jaccard similarity of 5-word shingles.

Sets of shingles (not documents) are nodes, named by a 64-bit hash of the whole
set, so exact copies are merged before any of this. A node's fingerprint is the
majority of the hashes of its shingles, bit by bit (`simhash.majority`). Near
copies are found among neighbours by Hamming distance, in shards; every link is
then checked by the exact similarity of the two sets.

Radius: a pair of similarity 0.8 differs in a bit with probability 0.161 at
most (0.1875 where the larger set has 5 shingles; counted out for all sizes up
to 60, and 0.151 in the limit). That is 10 of 64 bits and up to over 20, where
fingerprints of 64 bits don't tell near copies from others. So trees hold
fingerprints of WIDE * 64 bits: of 1024, a pair of just 0.8 differs in more than
NEAR with probability 4e-6, and unrelated ones differ in some 512.

Shards: choices of blocks of bits, as `simhash.links` has them for 3 of 64 bits,
would be without number for this radius. A shard is a MinHash key instead: a set
has BANDS keys, each over ROWS minima. A pair of similarity J shares none with
probability (1 - J**ROWS)**BANDS: 1.2e-7 at 0.8, less above.

In the first rounds the root of a shard's tree is its most central member, which
shares most keys with others, and only its own neighbours are taken, by the
first 64 bits and a radius FIRST that misses few; the next round takes the most
central member of the next component as root. So a large group of near copies
is linked without all of its pairs. After STARS such rounds the members that
are left in shards of several components get the wide fingerprints, and a tree
over the whole shard gives the neighbours of each; only the first shard that two
sets share lists them. 1024 bits let pairs of 0.7 through as well, and sets that
share a passage have many such, so neighbours are looked at once more before
their sets are sent about: their sketches, four bits of each of 1024 more
minima, must agree in ALIKE places (a pair of just 0.8 falls below with
probability 4e-6).

Defined cases: null, empty and blank texts have the empty set and are copies of
each other; with fewer words than a shingle the whole sequence is one; rows
that share a doc_id but not the text are rows of their own; rows without a
doc_id are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.blocks import dealt, mix
from talus.llm.common import col, ensure_checkpoints, few, settings, slices, text_bytes
from talus.llm.components import components
from talus.llm.simhash import BkTree, majority, shingle_hashes

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 40, 5
STARS = 2
#: Radius of the first rounds, of 64 bits.
FIRST = 20
#: Words of a wide fingerprint, and its radius: the mean and 4.5 standard deviations; that of sets of SMALL shingles and fewer.
WIDE, NEAR = 16, 218
SMALL, NEAR_SMALL = 5, 248
#: Minima of a sketch, and in how many of them near copies agree at least: 1024 * (0.8 + 0.2 / 16) less 4.5 standard deviations.
SKETCH, ALIKE = 1024, 776
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS + SKETCH + WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return [np.unique(np.array(shingle_hashes(t, size), dtype=np.uint64)) for t in texts]


def _minima(sets: list[np.ndarray], odds: np.ndarray) -> Iterator[np.ndarray]:
    """For each odd number, the least product with it of each set; none may be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    for odd in odds:
        yield np.minimum.reduceat(flat * odd, starts)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys for each set; a key's last 6 bits are the number of its band."""
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for k, least in enumerate(_minima(sets, _ODD[: BANDS * ROWS])):
        out[:, k // ROWS] = mix(out[:, k // ROWS] ^ least) + np.uint64(k)
    return out & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Four bits of each of the minima of each set, two a byte."""
    out = np.empty((len(sets), SKETCH), dtype=np.uint8)
    for k, least in enumerate(_minima(sets, _ODD[BANDS * ROWS : BANDS * ROWS + SKETCH])):
        out[:, k] = mix(least) & np.uint64(15)
    return out[:, ::2] << 4 | out[:, 1::2]


def alike(sketch: bytes, others: list[bytes]) -> np.ndarray:
    """Whether the sketches agree enough with one of them."""
    differ = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), -1) ^ np.frombuffer(sketch, np.uint8)
    return np.count_nonzero(differ >> 4 == 0, axis=1) + np.count_nonzero(differ & 15 == 0, axis=1) >= ALIKE


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WIDE words for each set; the first is the majority of the hashes themselves."""
    counts, flat = np.array([len(s) for s in sets], dtype=np.int64), np.concatenate(sets)
    return np.stack([majority(mix(flat * odd) if k else flat, counts) for k, odd in enumerate(_ODD[-WIDE:])], axis=1)


def radius(n: int) -> int:
    """Of the wide fingerprint of a set of n shingles."""
    return NEAR_SMALL if n <= SMALL else NEAR


def _described(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, th (hash of the text), node (hash of the set), n (its size), fp (64 bits), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingle_sets(text_bytes(col(batch, "text")), size)
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                some, bands = [i for i, s in enumerate(sets) if len(s)], [b""] * len(sets)
                for i, keys in zip(some, band_keys([sets[i] for i in some]) if some else ()):
                    bands[i] = keys.tobytes()
                n = np.array([len(s) for s in sets], dtype=np.int64)
                fp = majority(np.concatenate(sets), n).view(np.int64)
                yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), col(batch, "th"), *map(pa.array, (node, n, fp)), pa.array(bands, pa.binary())], names=["doc_id", "th", "node", "n", "fp", "bands"])

    return _named(documents).mapInArrow(run, "doc_id long, th long, node long, n long, fp long, bands binary")


def _named(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _shared(nodes: DataFrame) -> DataFrame:
    """key, node, n, fp, size (members of the key) of the keys that two nodes or more have."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                keys = np.frombuffer(b"".join(col(batch, "bands").to_pylist()), np.int64)
                own = [np.repeat(col(batch, c).to_numpy(), BANDS) for c in ("node", "n", "fp")]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (keys, *own))), names=["key", "node", "n", "fp"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_keys(batches):
            edges = np.flatnonzero(np.concatenate(([True], np.diff(part[0]) != 0, [True])))
            size = np.repeat(np.diff(edges), np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(x[size > 1]) for x in (*part, size)], names=["key", "node", "n", "fp", "size"])

    dealt = nodes.where("n > 0").mapInArrow(deal, "key long, node long, n long, fp long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(keep, "key long, node long, n long, fp long, size long")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns, cut only between keys; the rows are sorted by the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # where the last key begins
        if cut or held and held[-1][0][-1] != now[0][0]:
            held.append([x[:cut] for x in now])
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([x[cut:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _ordered(key: np.ndarray, *rest: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The columns sorted by key and, in an order that all keys agree on, by weight (the last) and node (the first); bounds of the keys."""
    order = np.lexsort((mix(rest[0].view(np.uint64)), -rest[-1], key))
    key = key[order]
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist()
    return [key, *(x[order] for x in rest)], list(zip(edges[:-1], edges[1:]))


def _named_pairs(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _fits(n: np.ndarray, component: np.ndarray, i: int, other: slice, least: float) -> np.ndarray:
    """Places of members in other components that are not too large or too small."""
    return other.start + np.flatnonzero((component[other] != component[i]) & (np.minimum(n[other], n[i]) >= least * np.maximum(n[other], n[i])))


def _by_key(shared: DataFrame, *columns: str) -> DataFrame:
    return shared.select("key", "node", "n", "component", *columns, "weight").repartition("key").sortWithinPartitions("key")


def _with_star(shared: DataFrame, least: float, star: int) -> DataFrame:
    """Pairs (u, v) of each key: its root, the heaviest member of its star-th component, and the root's neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_keys(batches):
            (_, node, n, component, fp, _), bounds = _ordered(*part)
            us, vs = [], []
            for a, b in bounds:
                first = np.sort(np.unique(component[a:b], return_index=True)[1])
                if len(first) >= max(2, star):
                    i = a + int(first[star - 1])
                    other = _fits(n, component, i, slice(a, b), least)
                    found = node[other[np.bitwise_count(fp[other] ^ fp[i]) <= FIRST]]
                    us.append(np.minimum(found, node[i]))
                    vs.append(np.maximum(found, node[i]))
            if us:
                yield _named_pairs(us, vs)

    return _by_key(shared, "fp").mapInArrow(run, "u long, v long")


def _all_left(shared: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of neighbours in the tree of each key, under the first key that they share.

    shared has wide (fingerprints) and sketch besides, and tags: 32 bits of each of a node's keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_keys(batches):
            (key, node, n, component, wide, sketch, tags, _), bounds = _ordered(*part)
            us, vs = [], []
            for a, b in bounds:
                keys = np.frombuffer(b"".join(tags[a:b]), np.uint32).reshape(b - a, -1)
                band = int(key[a]) & 63
                tree, place, members = BkTree(), {}, []
                for i in range(a, b):
                    fp = int.from_bytes(wide[i], "little")
                    near = tree.add(fp, radius(int(n[i])))
                    if near:
                        other = np.array([x for k in near for x in members[k]])
                        fits = (component[other] != component[i]) & (np.minimum(n[other], n[i]) >= least * np.maximum(n[other], n[i]))
                        fits &= (keys[other - a] == keys[i - a]).argmax(axis=1) == band
                        if len(other := other[fits]):
                            found = node[other[alike(sketch[i], sketch[other])]]
                            us.append(np.minimum(found, node[i]))
                            vs.append(np.maximum(found, node[i]))
                    # sets may share a fingerprint, which the tree has once
                    if fp in place:
                        members[place[fp]].append(i)
                    else:
                        place[fp] = len(members)
                        members.append([i])
                    if len(us) >= 1000:
                        yield _named_pairs(us, vs)
                        us, vs = [], []
            if us:
                yield _named_pairs(us, vs)

    return _by_key(shared, "wide", "sketch", "tags").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets (node, hashes) have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = []
            for a, b in zip(col(batch, "a"), col(batch, "b")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                right.append(common >= least * (len(both) - common))
            keep = pa.array(right, pa.bool_())
            yield pa.RecordBatch.from_arrays([col(batch, c).filter(keep) for c in ("u", "v")], names=["u", "v"])

    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _sets(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, hashes of the nodes, from the texts of one row of each; checkpointed by node, so that links move and sets don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                hashes = [s.tobytes() for s in shingle_sets(text_bytes(col(batch, "text")), size)]
                yield pa.RecordBatch.from_arrays([col(batch, "node"), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    rows = _named(documents).join(nodes.select("node", "doc_id", "th"), ["doc_id", "th"]).select("node", "text")
    return dealt(rows.mapInArrow(run, "node long, hashes binary"), "node", once=True)


def _widened(shared: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """shared with the wide fingerprint, the sketch and the tags of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "hashes", 1 << 20):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in col(batch, "hashes")]
                tags = [(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32) for x in col(batch, "bands")]
                made = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (wide_fingerprints(own), sketches(own), tags)]
                yield pa.RecordBatch.from_arrays([col(batch, "node"), *made], names=["node", "wide", "sketch", "tags"])

    left = sets.join(shared.select("node").distinct(), "node", "left_semi").join(nodes.select("node", "bands"), "node")
    return shared.join(left.mapInArrow(run, "node long, wide binary, sketch binary, tags binary"), "node")


def groups(documents: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id, th (hash of the text) and component of every row with a doc_id."""
    ensure_checkpoints(documents.sparkSession)
    rows = _described(documents, size).checkpoint()
    # copies of a set have the same size, fingerprint and bands
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "th", "n", "fp", "bands")).alias("head")).select("node", "head.*")
    shared = _shared(nodes).checkpoint()
    if shared.isEmpty():
        return rows.select("doc_id", "th", F.col("node").alias("component"))
    sets = _sets(documents, nodes.join(shared.select("node").distinct(), "node", "left_semi"), size)
    links, now = None, shared.join(shared.groupBy("node").agg(F.sum("size").alias("weight")), "node").withColumn("component", F.col("node"))
    for star in [*range(1, STARS + 1), None]:
        pairs = few((_with_star(now, least, star) if star else _all_left(_widened(now, nodes, sets), least)).distinct()).checkpoint()
        if pairs.isEmpty() and star is not None:
            continue
        found = few(_verified(pairs, sets, least).distinct())
        # a row has two whole sets
        with settings(documents.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
            links = (links.unionByName(found) if links is not None else found).checkpoint()
        known = components(links)
        if star is not None:
            # a key whose members are in one component stays so
            now = now.drop("component").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
            now = now.join(mixed.select("key"), "key", "left_semi").checkpoint()
    return rows.select("doc_id", "th", "node").join(known, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("component"))


def one_of_each(documents: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The documents, unchanged, with one row of each component: that of the smallest doc_id. Rows without a doc_id stay."""
    first = groups(documents, size, least).groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_first"), F.col("first.th").alias("_th"))
    text = F.xxhash64(F.col("text").cast("string"))
    own = documents.join(first, (documents["doc_id"].cast("long") == first["_first"]) & (text == first["_th"]), "left_semi")
    name = "_th"  # of a column for the moment, unlike all others
    while name in (c.lower() for c in documents.columns):
        name += "_"
    own = own.withColumn(name, text).dropDuplicates(["doc_id", name]).drop(name)
    return own.unionByName(documents.where("doc_id IS NULL"))
