"""Exact substring dedup over bytes with blockwise suffix sorting.

Every window of 50 bytes that also starts in a document with a smaller doc_id
is removed. Candidate stretches come first: each window picks a winnowed anchor
of 20 bytes, and only windows whose anchor stands in two documents can repeat.
The stretches around shared anchors are dealt to buckets by anchor, equal
stretches once per block, so equal windows always meet in one bucket.

A bucket's suffixes are sorted with a difference cover: suffixes at cover
positions (4 of 13 residues) get ranks first; then one block of suffixes with
neighbouring prefixes at a time is sorted by its first 16 bytes, and longer
ties are settled by the ranks at the offset where both suffixes meet the cover.
Only one block's keys are held besides the text and the ranks, so memory is
bounded by the bucket. Buckets are even but for an anchor whose surroundings
differ in very many documents: it is one bucket, which grows with them. Windows of
equal bytes are then neighbours, and the smallest doc_id of each run owns it.

Scale: see `blocks`. Shuffled are the blocks once (compressed), about 4 bytes
for one of 16 bytes of text, and the stretches around shared anchors. Blocks
have 8 MB of text, worked on 1 MB at a time, and a block sends all that goes to
a bucket in one message, which the bucket takes apart into parts for sorting:
messages cost by their number where they are small.

Defined cases: null and empty texts have no bytes; of repeated rows with one
doc_id none is smaller than the other; a null doc_id counts as the largest;
texts under 50 bytes lose nothing; extra columns are not read. Cuts may fall
inside a character: kept bytes are given as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talus.llm import blocks as B

WINDOW, ANCHOR = 50, 20
#: Differences of these residues give every residue modulo PERIOD.
COVER, PERIOD = (0, 1, 3, 9), 13
#: Text of a block: the more, the fewer messages.
BLOCK_BYTES = 8 << 20
#: Parts of a bucket that are sorted one after the other: sorting takes some 80 bytes for each window, and there are some 4 MB of raw text behind one.
PARTS = 3
#: Suffixes sorted at a time.
AT_ONCE = 1 << 18

_IN_COVER = np.zeros(PERIOD, dtype=bool)
_IN_COVER[list(COVER)] = True
#: _SHIFT[r, s]: the least step after which residues r and s are both in the cover.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(r + d) % PERIOD] and _IN_COVER[(s + d) % PERIOD]) for s in range(PERIOD)] for r in range(PERIOD)])


class SuffixBlocks:
    """Suffixes of one text, sorted block by block; only the first `depth` bytes of a suffix count."""

    def __init__(self, text: bytes, depth: int = WINDOW):
        self.n, self.depth = len(text), depth
        # zeros behind the end: prefixes of any suffix can be read
        self.text = np.frombuffer(text + bytes(depth + PERIOD + 16), np.uint8)
        self._eight = np.lib.stride_tricks.sliding_window_view(self.text, 8)
        self.rank = np.zeros(0, dtype=np.int32)
        self._slot = np.cumsum(_IN_COVER) - 1
        self._rank_cover()

    def word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each position on, as a number in the order of the bytes."""
        return np.ascontiguousarray(self._eight[at]).view(">u8").reshape(len(at)).astype(np.uint64)

    def in_blocks(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in blocks of neighbouring prefixes, in order, with their first words."""
        head = np.concatenate([self.word(at[i : i + AT_ONCE]) for i in range(0, len(at), AT_ONCE)]) if len(at) else np.zeros(0, dtype=np.uint64)
        parts = -(-len(at) // AT_ONCE)
        if parts <= 1:
            if len(at):
                yield at, head
            return
        sample = np.sort(head[:: max(1, len(head) // (parts * 64))])
        bounds = np.unique(sample[np.linspace(0, len(sample) - 1, parts + 1).astype(int)[1:-1]])
        which = np.searchsorted(bounds, head, "right")
        for b in range(len(bounds) + 1):
            own = np.flatnonzero(which == b)
            if len(own):
                yield at[own], head[own]

    def _rank_of(self, at: np.ndarray) -> np.ndarray:
        """Ranks of cover positions; behind the end all are equal."""
        return self.rank[(at // PERIOD) * len(COVER) + self._slot[at % PERIOD]]

    def _rank_cover(self) -> None:
        whole = -(-(self.n + PERIOD) // PERIOD)
        at = (np.arange(whole, dtype=np.int64)[:, None] * PERIOD + np.array(COVER)).ravel()
        at = at[at < self.n]
        self.rank = np.zeros(whole * len(COVER), dtype=np.int32)
        words, done = -(-self.depth // 8), 1
        for own, head in self.in_blocks(at):
            order = np.argsort(head, kind="stable")
            own, head = own[order], head[order]
            fresh = np.concatenate(([True], head[1:] != head[:-1]))
            for k in range(1, words):  # refine the groups that still tie
                group = np.cumsum(fresh) - 1
                size = np.bincount(group)
                tied = np.flatnonzero(size[group] > 1)
                if not len(tied):
                    break
                more = self.word(own[tied] + 8 * k)
                order = np.lexsort((more, group[tied]))
                own[tied] = own[tied][order]
                more, of = more[order], group[tied]
                fresh[tied] |= np.concatenate(([True], (more[1:] != more[:-1]) | (of[1:] != of[:-1])))
            ranks = np.cumsum(fresh) - 1
            self.rank[(own // PERIOD) * len(COVER) + self._slot[own % PERIOD]] = ranks + done
            done += int(ranks[-1]) + 1

    def sorted(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """Blocks of positions in the order of their suffixes."""
        for own, head in self.in_blocks(at):
            second = self.word(own + 8)
            order = np.lexsort((second, head))
            own, head, second = own[order], head[order], second[order]
            group = np.cumsum(np.concatenate(([True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])))) - 1
            size = np.bincount(group)
            tied = np.flatnonzero(size[group] > 1)
            if len(tied):
                own[tied] = own[tied][self._settle(own[tied], group[tied])]
            yield own

    def _settle(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes that tie within their groups: by how many of the group are smaller, residue by residue."""
        below = np.zeros(len(at), dtype=np.int64)
        residue = at % PERIOD
        members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
        wide = np.int64(len(self.rank) + 2)
        for r, mine in enumerate(members):
            if not len(mine):
                continue
            for s, other in enumerate(members):
                if not len(other):
                    continue
                d = _SHIFT[r, s]
                theirs = np.sort(group[other] * wide + self._rank_of(at[other] + d))
                ours = group[mine] * wide + self._rank_of(at[mine] + d)
                below[mine] += np.searchsorted(theirs, ours) - np.searchsorted(theirs, group[mine] * wide)
        return np.lexsort((below, group))


def owners(text: bytes, at: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The smallest doc of all windows (at their positions, of their docs) with the same bytes, for each window."""
    least = np.empty(len(at), dtype=np.int64)
    if not len(at):
        return least
    suffixes = SuffixBlocks(text, window)
    place = np.full(suffixes.n, -1, dtype=np.int32)
    place[at] = np.arange(len(at), dtype=np.int32)
    for own in suffixes.sorted(at):
        same = np.ones(len(own) - 1, dtype=bool)
        for k in [*range(0, window - 7, 8), window - 8]:
            w = suffixes.word(own + k)
            same &= w[1:] == w[:-1]
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        who = place[own]
        least[who] = np.repeat(np.minimum.reduceat(doc[who], head), np.diff(np.append(head, len(own))))
    return least


def _solve(asked: list[list[np.ndarray]], window: int) -> list[np.ndarray]:
    """For each block's stretches: a bit for each window, whether a smaller document has it."""
    docs = np.concatenate([x[0].view(np.int64) for x in asked])
    lengths = np.concatenate([x[1] for x in asked]).astype(np.int64)
    data = np.concatenate([x[2] for x in asked])
    for x in asked:
        x[2] = x[2][:0]
    # equal stretches once, for their smallest document
    once, stands, _, least = B.distinct(B.strings(data, np.cumsum(lengths) - lengths, lengths), docs)
    del data
    begin = np.frombuffer(once.buffers()[1], np.int64, len(once) + 1, 8 * once.offset)
    text = once.buffers()[2].to_pybytes()[begin[0] : begin[-1]]
    count = np.diff(begin) - window + 1
    own = owners(text, B.spread(begin[:-1] - begin[0], count), np.repeat(least, count), window)
    first = np.concatenate(([0], np.cumsum(count)))
    windows = lengths - window + 1
    cuts = np.cumsum([0, *(len(x[0]) for x in asked)])
    # a block at a time: positions take many times the memory of the bits
    return [own[B.spread(first[stands[a:b]], windows[a:b])] < np.repeat(docs[a:b], windows[a:b]) for a, b in zip(cuts, cuts[1:])]


def _solve_parts(asked: list[list[np.ndarray]], window: int) -> list[np.ndarray]:
    """_solve for messages that begin with the numbers of their stretches in each part, one part at a time."""
    docs = [np.concatenate(([0], np.cumsum(x[0], dtype=np.int64))) for x in asked]
    ends = [np.concatenate(([0], np.cumsum(x[2], dtype=np.int64)))[d] for x, d in zip(asked, docs)]
    bits: list[list[np.ndarray]] = [[] for _ in asked]
    for k in range(len(asked[0][0])):
        having = [i for i, d in enumerate(docs) if d[k + 1] > d[k]]
        if not having:
            continue
        part = [[asked[i][1][(own := slice(docs[i][k], docs[i][k + 1]))], asked[i][2][own], asked[i][3][ends[i][k] : ends[i][k + 1]]] for i in having]
        for i, found in zip(having, _solve(part, window)):
            bits[i].append(found)
    return [np.concatenate(x) for x in bits]


class _Stretches:
    """The stretches of a block around shared anchors, equal ones once."""

    def __init__(self, block: B.Block, met: list | None, buckets: int, window: int, anchor: int):
        data = np.frombuffer(block.data, np.uint8)
        runs = B.anchors(block, anchor, window)
        shared = B.read_bits(runs.key, buckets, met)
        self.first, self.last = runs.first[shared], runs.last[shared]
        self.doc = block.ids[runs.doc[shared]]
        self.lengths = self.last - self.first + window
        # stretches with the same bytes have the same anchor, and so the same part of a bucket
        _, which, place, self.least = B.distinct(B.strings(data, self.first, self.lengths), self.doc)
        part = B.bucket_of(runs.key[shared][place], buckets * PARTS)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        #: A stretch of each content, in the order they are sent; which content each stretch has.
        self.sent, self.part, self.least, self.stands = place[order], part[order], self.least[order], back[which]
        self.data = data

    def groups(self) -> Iterator[tuple[int, slice]]:
        """Buckets, and which of the sent stretches go there."""
        for b in np.unique(self.part // PARTS):
            i, j = np.searchsorted(self.part, [b * PARTS, (b + 1) * PARTS])
            yield int(b), slice(int(i), int(j))


def repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes left), spans (removed byte ranges).

    kept and spans are null when `with_bytes` is false.
    """
    packed = B.packed(documents, size=BLOCK_BYTES)
    buckets = B.buckets_for(packed)

    def seeds(number: int, block: B.Block) -> Iterator[tuple]:
        runs = B.anchors(block, anchor, window)
        yield from B.ask(number, runs.key, block.ids[runs.doc], buckets)

    def send(number: int, block: B.Block, met: list | None) -> Iterator[tuple]:
        found = _Stretches(block, met, buckets, window, anchor)
        for b, part in found.groups():
            own = found.sent[part]
            sizes = np.bincount(found.part[part] - b * PARTS, minlength=PARTS).astype(np.uint32)
            text = found.data[B.spread(found.first[own], found.lengths[own])]
            yield b, number, B.squeeze(sizes, found.least[part], found.lengths[own].astype(np.uint32), text)

    def solve(table: pa.Table) -> pa.Table:
        bits = _solve_parts([B.stretch(x) for x in table.column("payload").to_pylist()], window)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    def remove(number: int, block: B.Block, met: list | None, owned: list | None) -> Iterator[tuple]:
        found = _Stretches(block, met, buckets, window, anchor)
        told = {x["bucket"]: x["bits"] for x in owned or ()}
        count = found.lengths - window + 1
        sent_count = count[found.sent]
        bits = np.zeros(int(sent_count.sum()), dtype=bool)
        ends = np.concatenate(([0], np.cumsum(sent_count)))
        for b, part in found.groups():
            i, j = ends[part.start], ends[part.stop]
            bits[i:j] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=int(j - i)).astype(bool)
        for c, d in B.chunks(block.starts):
            low, high = int(block.starts[c]), int(block.starts[d])
            change = np.zeros(high - low + 1, dtype=np.int64)
            own = slice(*np.searchsorted(found.first, [low, high]))
            stands, windows = found.stands[own], count[own]
            if len(windows):
                # a stretch takes what its equal of the smallest document was told; all of it where that document is smaller
                whole = found.least[stands] < found.doc[own]
                gone = bits[B.spread(ends[stands], windows)] | np.repeat(whole, windows)
                at = B.spread(found.first[own] - low, windows)[gone]
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
            removed = np.cumsum(change)[:-1] > 0
            total = np.concatenate(([0], np.cumsum(removed)))
            for k in range(c, d):
                a, b = int(block.starts[k]) - low, int(block.starts[k + 1]) - low
                n, kept, spans = int(total[b] - total[a]), block.data[low + a : low + b], []
                if n:
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], removed[a:b], [False])).astype(np.int8)))
                    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
                    kept = found.data[low + a : low + b][~removed[a:b]].tobytes()
                doc_id = None if block.ids[k] == B.NO_ID else int(block.ids[k])
                yield doc_id, b - a, n, len(spans), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None, [{"start": x, "end": y} for x, y in spans] if with_bytes else None

    met = B.answer(B.over_blocks(packed, seeds, B.QUESTION, B.QUESTION_NAMES), "met").checkpoint()
    both = packed.join(met, "block", "left")
    sent = B.over_blocks(both, send, B.QUESTION, B.QUESTION_NAMES, "met")
    owned = B.by_block(sent.groupBy("bucket").applyInArrow(solve, B.ANSWER), "owned")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    return B.over_blocks(both.join(owned, "block", "left"), remove, schema, names, "met", "owned")
