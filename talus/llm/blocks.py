"""Blocks of whole documents, and questions about content keys across all of them.

Three operators look for content that stands in more than one document. They
pack documents into blocks of about 1 MB once, compressed, dealt by block number
and checkpointed: that partitioning is kept (`dealt`), so the blocks never move
again while small answers are joined to them, however often.

A question is asked with keys (48 bits of a content hash). Each block sends a
key once per bucket row, packed; buckets are ranges of keys, so they are even
whatever the content, and a key that a third of all documents hold costs one
entry per block, not per document. Answers come back as bits in the order the
block sent its keys.

Exactness: keys only choose candidates. A clash costs time and never makes a
wrong answer, as contents are compared before anything is cut.

Scale: a block sends at most a row for each bucket and each of its keys, so
there are min(blocks * buckets, keys) rows; both numbers grow with the corpus,
and larger blocks (`packed(size=...)`) lessen their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import col, ensure_checkpoints, replaced, settings, slices, text_bytes

BLOCK_BYTES = 1 << 20
#: Raw text behind one bucket of keys; buckets bound what a task holds, whatever the corpus.
BUCKET_BYTES = 12 << 20
KEY_BITS = 48
#: Stands for a null doc_id: larger than all others.
NO_ID = np.iinfo(np.int64).max

_ODD = 0x9E3779B97F4A7C15 | 1


@dataclass
class Block:
    """Documents of a block, one after the other; a null text is an empty one."""

    ids: np.ndarray
    starts: np.ndarray  # of each document, and the end
    data: bytes

    def pack(self) -> bytes:
        head = np.array([len(self.ids)], dtype=np.int64).tobytes() + self.ids.astype(np.int64).tobytes() + np.diff(self.starts).astype(np.int64).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + self.data)

    @staticmethod
    def unpack(packed: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, lengths = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        return Block(ids, np.concatenate(([0], np.cumsum(lengths))), raw[8 + 16 * n :])


def packed(documents: DataFrame, carry: bool = False, size: int = BLOCK_BYTES) -> DataFrame:
    """block (long), raw (bytes of text), ids (of its documents, but nulls), payload, rest; partitioned by block and checkpointed.

    rest has the documents' rows without their texts (compressed Arrow) if `carry`, else nothing.
    A block has about `size` bytes of text, or one longer text.
    """
    ensure_checkpoints(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", size):
                texts = text_bytes(col(batch, "text"))
                ids = np.array([NO_ID if i is None else i for i in col(batch, "doc_id").to_pylist()], dtype=np.int64)
                made = Block(ids, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64), b"".join(texts))
                rest = whole_rows(batch) if carry else b""
                known = ids[ids != NO_ID].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(made.data)], pa.int64()), pa.array([known], pa.list_(pa.int64())), pa.array([made.pack()], pa.binary()), pa.array([rest], pa.binary())], names=["block", "raw", "ids", "payload", "rest"])
                block += 1

    rows = documents if carry else documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return dealt(rows.mapInArrow(run, "block long, raw long, ids array<long>, payload binary, rest binary"), "block")


def dealt(frame: DataFrame, column: str, once: bool = False) -> DataFrame:
    """Repartitioned by the column and checkpointed, so that later joins on the column leave these rows where they are.

    With `once`, one row of each value stays.

    Adaptive planning is off meanwhile: a plan made by it doesn't tell its partitioning to the checkpoint.
    """
    spark = frame.sparkSession
    with settings(spark, spark__sql__adaptive__enabled="false"):
        placed = frame.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), column)
        return (placed.dropDuplicates([column]) if once else placed).checkpoint()


def whole_rows(batch: pa.RecordBatch) -> bytes:
    """The rows with null texts: the payload has those."""
    k = batch.schema.get_field_index("text")
    bare = batch.set_column(k, batch.schema.field(k), pa.nulls(batch.num_rows, batch.schema.field(k).type))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, bare.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(bare)
    return sink.getvalue().to_pybytes()


def read_rows(rest: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rest).read_next_batch()


def buckets_for(blocks: DataFrame, each: int = BUCKET_BYTES) -> int:
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-raw // each))


# --- hashes of runs of units ---------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (a finaliser of two rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hashes of any run of units by prefix sums of a polynomial in `odd`, modulo 2**64."""

    def __init__(self, units: np.ndarray, odd: int = _ODD):
        n = len(units)
        power = np.full(n + 1, odd, dtype=np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(units * power[:n], out=self.sums[1:])
        self.back = np.full(n + 1, pow(odd, -1, 1 << 64), dtype=np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, k: int) -> np.ndarray:
        """Of the k units from each position on."""
        n = len(self.sums) - 1 - k + 1
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


@dataclass
class Runs:
    """Neighbouring windows with the same anchor: windows first..last of one document."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    at: np.ndarray  # of the anchor
    key: np.ndarray


def winnow(rolling: Rolling, starts: np.ndarray, gram: int, window: int) -> Runs:
    """Winnowed anchors: each window of `window` units picks its smallest gram of `gram` units, the leftmost of equals.

    Equal windows pick the same gram, so documents that share a window share an anchor.
    """
    n = len(rolling.sums) - 1
    spread = window - gram + 1
    none = np.zeros(0, dtype=np.int64)
    lengths = np.diff(starts)
    count = np.maximum(lengths - window + 1, 0)
    if not count.sum():
        return Runs(none, none, none, none, none.astype(np.uint64))
    grams = rolling.grams(gram)
    best = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have * 2 <= spread:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < spread:
        best = np.minimum(best[: n - window + 1], best[spread - have : spread - have + n - window + 1])
    at = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    doc = np.repeat(np.arange(len(lengths)), count)
    anchor = (best[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(doc) != 0)) + 1
    head, tail = np.concatenate(([0], change)), np.concatenate((change - 1, [len(at) - 1]))
    # minima lie low: mixed once more, so that ranges of keys are even
    return Runs(at[head], at[tail], doc[head], anchor[head], mix(~grams[anchor[head]]) >> np.uint64(64 - KEY_BITS))


def chunks(starts: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Documents a..b-1 of about `size` bytes together, or one longer; all of them in order."""
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + size, "right")) - 1)
        yield a, b
        a = b


def anchors(block: Block, gram: int, window: int, size: int = BLOCK_BYTES) -> Runs:
    """Winnowed anchors of a block's bytes, chunk by chunk: hashes take many times the memory of the text."""
    data, parts = np.frombuffer(block.data, np.uint8), []
    for a, b in chunks(block.starts, size):
        at, end = int(block.starts[a]), int(block.starts[b])
        runs = winnow(Rolling(data[at:end].astype(np.uint64) + np.uint64(1)), block.starts[a : b + 1] - at, gram, window)
        parts.append((runs.first + at, runs.last + at, runs.doc + a, runs.at + at, runs.key))
    return Runs(*map(np.concatenate, zip(*parts)))


# --- packed arrays ----------------------------------------------------------


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte planes apart."""
    parts = []
    for a in arrays:
        wide = np.ascontiguousarray(a)
        parts.append(np.array([len(wide), wide.dtype.itemsize], dtype=np.int64).tobytes())
        parts.append(wide.view(np.uint8).reshape(len(wide), wide.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def stretch(value: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(raw):
        n, size = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
        planes = np.frombuffer(raw, np.uint8, n * size, at + 16).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").reshape(n))
        at += 16 + n * size
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys, in the order of the keys."""
    return ((keys >> np.uint64(KEY_BITS - 31)).astype(np.int64) * buckets) >> 31


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for `count` each."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(first) else np.zeros(0, dtype=np.int64)


def strings(data: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Pieces of the data, as binary values."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    joined = np.empty(offsets[-1], dtype=np.uint8)
    for a, b in chunks(offsets):  # places take eight times the memory of the bytes
        joined[offsets[a] : offsets[b]] = data[spread(first[a:b], lengths[a:b])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])


def distinct(values: pa.Array, docs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, by their bytes; which of them each value is; one place of each; the smallest document of each."""
    coded = values.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.empty(len(coded.dictionary), dtype=np.int64)
    place[which[::-1]] = np.arange(len(which))[::-1]
    least = np.full(len(place), NO_ID)
    np.minimum.at(least, which, docs)
    return coded.dictionary, which, place, least


def ask(block: int, keys: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, block, payload) rows: each key once, with whether it has two documents."""
    if not len(keys):
        return
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    tail = np.concatenate((head[1:], [len(keys)])) - 1
    once, several = keys[head], docs[tail] != docs[head]
    bucket = bucket_of(once, buckets)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[a]), block, squeeze(np.diff(once[a:b], prepend=np.uint64(0)), several[a:b].view(np.uint8))


def answer(questions: DataFrame, name: str) -> DataFrame:
    """block, and under `name` the bits of each bucket: whether a key stands in two documents or more."""

    def run(table: pa.Table) -> pa.Table:
        asked = [stretch(x) for x in table.column("payload").to_pylist()]
        keys = [np.cumsum(x[0], dtype=np.uint64) for x in asked]
        once, where, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[where[np.concatenate([x[1] for x in asked]).astype(bool)]] = True
        bits = np.split(shared[where], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    return by_block(questions.groupBy("bucket").applyInArrow(run, ANSWER), name)


def by_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def read_bits(keys: np.ndarray, buckets: int, answers: list[dict] | None) -> np.ndarray:
    """The answer to each key of the block, in any order and with repeats."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    once, where = np.unique(keys, return_inverse=True)
    bucket, bits = bucket_of(once, buckets), np.zeros(len(once), dtype=bool)
    for x in answers or ():
        a, b = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
        bits[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    return bits[where]


def over_blocks(blocks: DataFrame, work: Callable, schema: str, names: list[str], *extra: str) -> DataFrame:
    """work(block number, Block, the extra columns' values) yields tuples of a row each."""
    kinds = [f.dataType for f in blocks.sparkSession.createDataFrame([], schema).schema.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.unpack(col(batch, "payload")[i].as_py())
                rows = list(work(col(batch, "block")[i].as_py(), block, *(col(batch, x)[i].as_py() for x in extra)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow)], names=names)

    return blocks.select("block", "payload", *extra).mapInArrow(run, schema)


def over_rows(blocks: DataFrame, work: Callable, schema, *extra: str) -> DataFrame:
    """work(Block, the extra columns' values) gives the texts of the block's rows; these come back with their other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.unpack(col(batch, "payload")[i].as_py())
                texts = work(block, *(col(batch, x)[i].as_py() for x in extra))
                yield replaced(read_rows(col(batch, "rest")[i].as_py()), texts)

    return blocks.select("payload", "rest", *extra).mapInArrow(run, schema)


ANSWER = "block long, bucket long, bits binary"
QUESTION = "bucket long, block long, payload binary"
QUESTION_NAMES = ["bucket", "block", "payload"]
