"""SimHash near-duplicates linked through BK-trees.

Fingerprints: 64 bits over hashed word shingles. Distinct fingerprints (not
documents) are searched: two that differ in at most r bits agree exactly in
enough of m blocks of bits, so each is dealt to one shard for each choice of
blocks, and a shard builds one BK-tree over its fingerprints: children are
keyed by their integer Hamming distance to the parent, and a search follows
only edges within the radius. Trees travel to no one: queries and nodes of a
shard meet in its partition, because a broadcast of all trees would hold all
fingerprints on the driver.

Within a shard, links are merged at once and leave as a spanning star, so a
group of k near copies gives k rows, not k*k. Components are found over these.

Scale: one shuffle of distinct fingerprints per block choice (16 bytes a row);
the number of choices rises with the number of fingerprints so that shards stay
small (`plan_blocks`). Copies of a text share a fingerprint and are merged
before any of this.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; with fewer words than a shingle the whole sequence is one;
repeated rows come out once each, with the same component; rows that share a
doc_id but not the text have fingerprints and components of their own; rows
without a doc_id are linked too, and a component of only such rows has a null id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import col, ensure_checkpoints, slices, text_bytes
from talus.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `size` words, joined by spaces."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def majority(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits for each run of `counts` hashes; a bit is set if it is set in over half of them."""
    out = np.zeros(len(counts), dtype=np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for byte in range(8):
        value = ((flat >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        # ones of each bit, by way of a histogram of this byte
        histogram = np.bincount(owner * 256 + value, minlength=256 * len(counts)).reshape(-1, 256)
        on = (histogram @ _BITS) * 2 > counts[:, None]
        for bit in range(8):
            out |= on[:, bit].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A bit is set if it is set in over half of the text's hashes."""
    hashes = [shingle_hashes(t, size) for t in texts]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    return majority(np.fromiter(itertools.chain.from_iterable(hashes), dtype=np.uint64, count=int(counts.sum())), counts)


def fingerprint(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fp = fingerprints(text_bytes(col(batch, "text")), size)
                yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """BK-tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int, radius: int) -> list[int]:
        """Inserts x; the nodes within the radius that were there before. A value already there is not inserted again."""
        found: list[int] = []
        if not self.value:
            self.value.append(x)
            self.children.append({})
            return found
        value, children = self.value, self.children
        todo = [0]
        while todo:
            node = todo.pop()
            d = (value[node] ^ x).bit_count()
            if d <= radius:
                found.append(node)
            below = children[node]
            if len(below) > 2 * radius + 1:
                todo.extend([below[k] for k in range(max(1, d - radius), d + radius + 1) if k in below])
            else:
                todo.extend([c for k, c in below.items() if d - radius <= k <= d + radius])
        at = 0
        while (d := (value[at] ^ x).bit_count()) and d in children[at]:
            at = children[at][d]
        if d:
            children[at][d] = len(value)
            value.append(x)
            children.append({})
        return found


def plan_blocks(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(blocks, how many of them are free to differ): few rows while shards are small, longer keys for more fingerprints."""
    m = radius + 1 if n < 4_000_000 else radius + 2 if n < 1_000_000_000 else radius + 3
    return m, radius


def shard_keys(m: int, radius: int) -> list[int]:
    """Bit masks, one for each choice of blocks that must agree."""
    edges = [round(64 * i / m) for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(block, m - radius)]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (u, v) of nodes whose fingerprints are within the radius. nodes: node (long), fp (long), each fp once."""
    m, _ = plan_blocks(nodes.count(), radius)
    masks = shard_keys(m, radius)
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    dealt = nodes.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in signed])).alias("choice", "key"))
    dealt = dealt.repartition("choice", "key").sortWithinPartitions("choice", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, names, root = None, BkTree(), [], []
        us: list[int] = []
        vs: list[int] = []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def flush() -> None:
            for i in range(len(root)):
                if (r := find(i)) != i:
                    us.append(names[i])
                    vs.append(names[r])

        for batch in batches:
            for node, fp, choice, key in zip(*(col(batch, c).to_pylist() for c in ("node", "fp", "choice", "key"))):
                if shard != (choice, key):
                    flush()
                    shard, tree, names, root = (choice, key), BkTree(), [], []
                near = tree.add(fp & 0xFFFFFFFFFFFFFFFF, radius)
                i = len(root)
                names.append(node)
                root.append(i)
                for j in near:
                    if (r := find(j)) != (own := find(i)):
                        root[max(r, own)] = min(r, own)
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us.clear()
                vs.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(documents: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row."""
    ensure_checkpoints(documents.sparkSession)
    prints = fingerprint(documents, size).checkpoint()
    # nodes go by their fingerprints: a doc_id may stand for several texts, or be null
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius)).select(F.col("node").alias("fp"), "component")
    placed = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    classes = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
