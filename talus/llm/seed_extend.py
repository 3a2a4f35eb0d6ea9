"""Substring dedup by seed and extend over words.

Seeds are winnowed anchors of 25 words: every window of 50 words holds one, and
equal windows hold the same one at the same place. Three steps over blocks of
documents (see `blocks`):

1. Seeds: which anchors stand in two documents. Keys of 48 bits.
2. Windows around such anchors: which may stand in two documents. Keys again,
   so what differs around a very common seed goes no further.
3. Documents are joined on the anchors that are left. Each sends the stretch of
   words around an anchor; in the anchor's bucket the match is extended from
   the seed word by word, to the right and to the left, on the words themselves:
   stretches that agree so far form a class, and each further word splits it.
   A window is k words to the left of the seed and the rest from it on, so two
   stretches share it when both classes agree. A class is answered with its
   smallest document; no pair of documents is ever formed. Neighbouring windows
   with a smaller document make up the maximal repeats, which are cut.

Keys choose candidates only: contents decide (`key_bits` is there for the test
of that).

Scale: two small questions and the stretches, equal ones once a block however
many of its documents repeat them, once more compared in the bucket. A seed's
stretches in a bucket grow with the number of different repeated surroundings
it has, not with its copies.

Defined cases: null, empty and short texts lose nothing; of repeated rows with
one doc_id none is smaller than the other; a null doc_id counts as the largest;
extra columns are not read; a very long text is one block: some 20 bytes of
memory for one of text, besides its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from talus.llm import blocks as B

WINDOW, SEED = 50, 25
#: Text of documents behind one bucket of stretches.
EXTEND_BYTES = 8 << 20
#: Bytes hashed at a time: sums take 40 bytes for one.
_AT_ONCE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of a block: where they stand, whose they are, and a hash of each."""

    def __init__(self, block: B.Block):
        data = np.frombuffer(block.data, np.uint8)
        inside = ~_SPACE[data]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        cut = block.starts[1:-1]
        cut = cut[cut < len(data)]
        edge[cut] = inside[cut]  # a word never runs on into the next document
        self.start = np.flatnonzero(edge)
        last = inside
        last[:-1] &= edge[1:] | _SPACE[data[1:]]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, block.starts)  # first word of each document
        self.data = data
        self.hashes = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + _AT_ONCE)))
            rolling = B.Rolling(data[low : self.end[to - 1]].astype(np.uint64) + np.uint64(1))
            self.hashes[at:to] = rolling.of(self.start[at:to] - low, self.end[at:to] - low)
            at = to

    def joined(self, first: np.ndarray, count: np.ndarray) -> pa.Array:
        """Runs of words, each joined by one space."""
        lengths = self.end - self.start
        ends = np.concatenate(([0], np.cumsum(lengths + 1)))
        flat = np.full(ends[-1], 32, dtype=np.uint8)
        flat[B.spread(ends[:-1], lengths)] = self.data[B.spread(self.start, lengths)]
        return B.strings(flat, ends[first], ends[first + count] - ends[first] - 1)


class _Windows:
    """Windows of a block around seeds that stand in two documents."""

    def __init__(self, block: B.Block, met: list | None, buckets: int, seed: int, window: int, mask: np.uint64):
        self.words = Words(block)
        rolling = B.Rolling(self.words.hashes)
        runs = B.winnow(rolling, self.words.first, seed, window)
        self.seeds, self.seed_docs = runs.key & mask, block.ids[runs.doc]
        shared = B.read_bits(self.seeds, buckets, met)
        count = (runs.last - runs.first + 1)[shared]
        self.at = B.spread(runs.first[shared], count)
        self.run = np.repeat(np.flatnonzero(shared), count)
        self.docs = self.seed_docs[self.run]
        self.keys = rolling.of(self.at, self.at + window) >> np.uint64(64 - B.KEY_BITS) & mask if len(self.at) else np.zeros(0, dtype=np.uint64)
        self.anchor = runs.at


class _Stretches:
    """Neighbouring windows of a seed that may repeat, as runs of words; runs of equal words once."""

    def __init__(self, block: B.Block, met: list | None, twice: list | None, buckets: int, fine: int, seed: int, window: int, mask: np.uint64):
        found = _Windows(block, met, buckets, seed, window, mask)
        self.words = found.words
        chosen = B.read_bits(found.keys, buckets, twice)
        edge = chosen.copy()
        if len(edge):
            edge[1:] &= ~chosen[:-1] | (found.run[1:] != found.run[:-1])
        head = np.flatnonzero(edge)
        #: First window and number of windows of each stretch, its document.
        self.first, self.count = found.at[head], np.diff(np.append(np.cumsum(chosen)[head] - 1, chosen.sum())) if len(head) else head
        self.docs = found.docs[head]
        run = found.run[head]
        values, which, place, least = B.distinct(self.words.joined(self.first, self.count + window - 1), self.docs)
        bucket = B.bucket_of(found.seeds[run][place], fine)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        #: Of each content, in the order sent: its bucket, smallest document, words before the seed, number of windows, words.
        self.bucket, self.least, self.before = bucket[order], least[order], (found.anchor[run] - self.first)[place][order]
        self.windows, self.values = self.count[place][order], values.take(pa.array(order))
        #: Which content each stretch has.
        self.stands = back[which]

    def groups(self) -> Iterator[tuple[int, slice]]:
        for b in np.unique(self.bucket):
            i, j = np.searchsorted(self.bucket, [b, b + 1])
            yield int(b), slice(int(i), int(j))

    def removed(self, owned: list | None, window: int) -> np.ndarray:
        """Of each word of the block, whether it stands in a window that a smaller document has."""
        ends = np.concatenate(([0], np.cumsum(self.windows)))
        bits, told = np.zeros(ends[-1], dtype=bool), {x["bucket"]: x["bits"] for x in owned or ()}
        for b, part in self.groups():
            i, j = ends[part.start], ends[part.stop]
            bits[i:j] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=int(j - i)).astype(bool)
        change = np.zeros(len(self.words.start) + 1, dtype=np.int64)
        if len(self.first):
            # the answer is about the smallest document in the block; the others are larger than that one
            gone = bits[B.spread(ends[self.stands], self.count)] | np.repeat(self.least[self.stands] < self.docs, self.count)
            at = B.spread(self.first, self.count)[gone]
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
        return np.cumsum(change)[:-1] > 0


def _coded(x: np.ndarray | pa.Array) -> np.ndarray:
    """Numbers from 0 on for the distinct values."""
    return pa.array(x).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _grown(code: np.ndarray, at: np.ndarray, step: int, reach: np.ndarray, most: int) -> np.ndarray:
    """Classes of stretches by their first t words from `at` on, in steps of +1 or -1; -1 beyond a stretch's reach."""
    out = np.full((most + 1, len(at)), -1, dtype=np.int64)
    out[0] = 0
    size = int(code.max()) + 1 if len(code) else 1
    for t in range(1, most + 1):
        own = np.flatnonzero(reach >= t)
        if not len(own):
            break
        out[t, own] = _coded(out[t - 1, own] * size + code[at[own] + step * (t - 1)])
    return out


def extend(values: pa.Array, before: np.ndarray, docs: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each window of each stretch, and where a stretch's windows begin.

    values: words joined by a space; before: words in front of the seed.
    """
    parts = pc.split_pattern(values, " ")
    begin = parts.offsets.to_numpy().astype(np.int64)
    code = _coded(parts.values)
    size = np.diff(begin)
    windows = size - window + 1
    at = begin[:-1] + before
    right = _grown(code, at, 1, size - before, window)
    left = _grown(code, at - 1, -1, before, window - seed)
    first = np.concatenate(([0], np.cumsum(windows)))
    least = np.empty(first[-1], dtype=np.int64)
    for k in range(window - seed + 1):
        # windows with k words to the left of the seed
        own = np.flatnonzero((before >= k) & (before - k < windows))
        if len(own):
            which = _coded(left[k, own] * (len(docs) + 1) + right[window - k, own])
            lowest = np.full(int(which.max()) + 1, B.NO_ID)
            np.minimum.at(lowest, which, docs[own])
            least[first[own] + before[own] - k] = lowest[which]
    return least, first


def _asked(packed: DataFrame, window: int, seed: int, key_bits: int) -> tuple[DataFrame, list]:
    """The blocks with what was found out about their seeds (met), windows (twice) and stretches (owned)."""
    buckets, fine = B.buckets_for(packed), B.buckets_for(packed, EXTEND_BYTES)
    mask = np.uint64((1 << B.KEY_BITS) - (1 << B.KEY_BITS - key_bits))

    def seeds(number: int, block: B.Block) -> Iterator[tuple]:
        found = _Windows(block, None, buckets, seed, window, mask)
        yield from B.ask(number, found.seeds, found.seed_docs, buckets)

    def windows(number: int, block: B.Block, met: list | None) -> Iterator[tuple]:
        found = _Windows(block, met, buckets, seed, window, mask)
        yield from B.ask(number, found.keys, found.docs, buckets)

    def send(number: int, block: B.Block, met: list | None, twice: list | None) -> Iterator[tuple]:
        found = _Stretches(block, met, twice, buckets, fine, seed, window, mask)
        for b, part in found.groups():
            values = found.values[part]
            lengths = pc.binary_length(values).to_numpy(zero_copy_only=False)
            flat = np.frombuffer(b"".join(values.to_pylist()), np.uint8)
            yield b, number, B.squeeze(found.least[part], found.before[part].astype(np.uint16), lengths.astype(np.uint32), flat)

    def solve(table: pa.Table) -> pa.Table:
        asked = [B.stretch(x) for x in table.column("payload").to_pylist()]
        docs = np.concatenate([x[0].view(np.int64) for x in asked])
        before, lengths = (np.concatenate([x[k] for x in asked]).astype(np.int64) for k in (1, 2))
        data = np.concatenate([x[3] for x in asked])
        once, which, place, smallest = B.distinct(B.strings(data, np.cumsum(lengths) - lengths, lengths), docs)
        del data
        least, first = extend(once, before[place], smallest, window, seed)
        count = np.diff(first)[which]
        cuts = np.cumsum([0, *(len(x[0]) for x in asked)])
        bits = [np.packbits(least[B.spread(first[which[a:b]], count[a:b])] < np.repeat(docs[a:b], count[a:b])).tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    met = B.answer(B.over_blocks(packed, seeds, B.QUESTION, B.QUESTION_NAMES), "met").checkpoint()
    both = packed.join(met, "block", "left")
    twice = B.answer(B.over_blocks(both, windows, B.QUESTION, B.QUESTION_NAMES, "met"), "twice").checkpoint()
    both = both.join(twice, "block", "left")
    sent = B.over_blocks(both, send, B.QUESTION, B.QUESTION_NAMES, "met", "twice")
    owned = B.by_block(sent.groupBy("bucket").applyInArrow(solve, B.ANSWER), "owned")
    return both.join(owned, "block", "left"), [buckets, fine, seed, window, mask]


def _runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _cut(block: B.Block, words: Words, removed: np.ndarray, d: int) -> bytes:
    """A document's text without its removed words; white space stays as it is outside the removed runs."""
    first, last = int(words.first[d]), int(block.starts[d])
    parts = []
    for x, y in _runs_of(removed[first : int(words.first[d + 1])]):
        parts.append(block.data[last : words.start[first + x]])
        last = int(words.end[first + y - 1])
    return b"".join([*parts, block.data[last : block.starts[d + 1]]])


def repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = True, key_bits: int = B.KEY_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), kept_text, spans.

    kept_text is the text without the removed words; spans are the removed runs
    as first and past-the-last word. Both are null when `with_text` is false.
    """
    asked, how = _asked(B.packed(documents), window, seed, key_bits)

    def report(number: int, block: B.Block, met: list | None, twice: list | None, owned: list | None) -> Iterator[tuple]:
        found = _Stretches(block, met, twice, *how)
        words, removed = found.words, found.removed(owned, window)
        total = np.concatenate(([0], np.cumsum(removed)))
        for d in range(len(block.ids)):
            a, b = int(words.first[d]), int(words.first[d + 1])
            kept, n = block.data[block.starts[d] : block.starts[d + 1]].split(), int(total[b] - total[a])
            if n:
                kept = [w for w, r in zip(kept, removed[a:b].tolist()) if not r]
            text, spans = None, None
            if with_text:
                text, spans = _cut(block, words, removed, d).decode(), [{"start": x, "end": y} for x, y in _runs_of(removed[a:b])]
            doc_id = None if block.ids[d] == B.NO_ID else int(block.ids[d])
            yield doc_id, b - a, n, hashlib.sha256(b" ".join(kept)).hexdigest(), text, spans

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>"
    return B.over_blocks(asked, report, schema, names, "met", "twice", "owned")


def without_repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The documents, row by row, with repeated words cut out of their texts; null texts become empty."""
    asked, how = _asked(B.packed(documents, carry=True), window, seed, B.KEY_BITS)

    def texts(block: B.Block, met: list | None, twice: list | None, owned: list | None) -> list[str]:
        found = _Stretches(block, met, twice, *how)
        removed = found.removed(owned, window)
        return [_cut(block, found.words, removed, d).decode() for d in range(len(block.ids))]

    return B.over_rows(asked, texts, documents.schema, "met", "twice", "owned")
