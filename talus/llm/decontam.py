"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items go into one automaton. Training
text is streamed through it word by word; the state and the matched length say
which item windows end at each word. Only stretches whose neighbouring word
pairs all occur in the benchmark are streamed: elsewhere the matched length
cannot reach a window, so nothing is lost.

Scale: the benchmark is a curated table, broadcast behind a size check; one of
more than `MAX_BENCHMARK_BYTES` is cut into parts by item, and the documents go
through the parts one after the other, with what was hit so far beside them.
Documents are a narrow map with no shuffle at all.

Defined cases: null or empty texts have no words; an item without words is
ignored; repeated items and repeated documents are each judged on their own;
extra columns of either table are not read; one item of more than the bound is
a part of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import col, ensure_checkpoints, replaced, slices, text_bytes

WINDOW = 8
#: Share of hit words beyond which a document is dropped as a whole.
MAX_COVERAGE = 0.5
#: Text of the items whose automaton a task holds at a time.
MAX_BENCHMARK_BYTES = 64 << 20
#: Columns beside the documents between parts of a large benchmark: bits of hit words, items.
_HIT, _ITEMS = "__talus_hit", "__talus_items"

_SEPARATORS = [b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]
_LOWER = bytes(32 if b in set(_SEPARATORS) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words; digits, letters and everything beyond ASCII are word characters."""
    return text.translate(_LOWER).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ids in items:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.occurs: list[set[int]] = [set() for _ in self.link]
        self.whole: list[dict[int, set[int]]] = [{} for _ in self.link]
        self.names = [name for name, _ in items]
        for k, (_, ids) in enumerate(items):
            v = 0
            for c in ids:
                v = u = self.next[v][c]
                while u > 0 and k not in self.occurs[u]:
                    self.occurs[u].add(k)
                    u = self.link[u]
            if 0 < len(ids) < window:
                self.whole[v].setdefault(len(ids), set()).add(k)
        self._cache: dict[tuple[int, int], tuple[int, frozenset[int]]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def ending(self, state: int, matched: int) -> tuple[int, frozenset[int]]:
        """Length of the longest window that ends here, and the items of all that do."""
        key = (state, min(matched, self.window))
        if key not in self._cache:
            longest, found, u = 0, set(), state
            while u > 0:
                low = self.length[self.link[u]]
                if low < self.window <= min(matched, self.length[u]):
                    longest = max(longest, self.window)
                    found |= self.occurs[u]
                for n, who in self.whole[u].items():
                    if n <= matched:
                        longest = max(longest, n)
                        found |= who
                u = self.link[u]
            self._cache[key] = longest, frozenset(found)
        return self._cache[key]

    def stream(self, ids: list[int], at: int, hit: np.ndarray, found: dict[int, set[int]]) -> None:
        """Feeds the ids of words at, at+1, ...; marks hit words and gathers items by the word a window ends at."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for i, c in enumerate(ids):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
                k, who = self.ending(v, n)
                if k:
                    hit[at + i + 1 - k : at + i + 1] = True
                    found[at + i] = who


class Matcher:
    """The automaton with its vocabulary and the word pairs that can be part of a window."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        texts = [(name, words(text)) for name, text in items]
        texts = [(name, w) for name, w in texts if w]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(x for _, ws in texts for x in ws))}
        coded = [(name, [self.ids[x] for x in ws]) for name, ws in texts]
        self.automaton = Automaton(coded, window)
        self.base = len(self.ids) + 1
        self.pairs = np.unique(np.array([a * self.base + b for _, c in coded for a, b in zip(c, c[1:])], dtype=np.int64))
        self.shortest = min((min(len(c), window) for _, c in coded), default=0)

    def match(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
        """First word of each document among all words (one gap after each), hit words, and items by word."""
        get = self.ids.get
        flat: list[int] = []
        starts = np.zeros(len(docs) + 1, dtype=np.int64)
        for i, w in enumerate(docs):
            flat.extend([get(x, 0) for x in w])
            flat.append(0)
            starts[i + 1] = len(flat)
        ids = np.array(flat, dtype=np.int64)
        hit, found = np.zeros(len(ids), dtype=bool), {}
        if not self.shortest:
            return starts, hit, found
        good = np.zeros(len(ids) + 1, dtype=bool)  # good[i]: words i-1 and i can stand in one window
        if self.shortest == 1:
            good[1:] = ids > 0  # a single word may be a window
            least = 1
        else:
            code = ids[:-1] * self.base + ids[1:]
            if len(self.pairs):
                k = np.searchsorted(self.pairs, code)
                good[1:-1] = self.pairs[np.minimum(k, len(self.pairs) - 1)] == code
            least = self.shortest - 1
        edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        keep = end - begin >= least
        for a, b in zip(begin[keep], end[keep]):
            first = a - 1
            self.automaton.stream(ids[first:b].tolist(), int(first), hit, found)
        return starts, hit, found


_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, clean_text string, dropped boolean"


def _byte_spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    spans, at = [], [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        spans.append({"start": at[a][0], "end": at[b - 1][1]})
    return spans


def _matchers(benchmark: DataFrame, window: int, bound: int) -> Iterator[Matcher]:
    """A matcher of each part of the benchmark."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // bound))
    for k in range(parts):
        own = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        items = [(str(r[0]), r[1].encode()) for r in own.collect() if r[0] is not None and r[1]]
        yield Matcher(sorted(items), window)


def _match(matcher: Matcher, batch: pa.RecordBatch, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Where each document's words start, which are hit and the items of each document, with what earlier parts have found."""
    starts, hit, found = matcher.match(docs)
    names, items = matcher.automaton.names, [set() for _ in docs]
    for i, who in found.items():
        items[int(np.searchsorted(starts, i, "right")) - 1].update(names[k] for k in who)
    if _HIT in batch.schema.names:
        for d, (bits, known) in enumerate(zip(col(batch, _HIT).to_pylist(), col(batch, _ITEMS).to_pylist())):
            items[d].update(known or ())
            if bits:
                hit[starts[d] : starts[d + 1] - 1] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(docs[d])).astype(bool)
    return starts, hit, items


def _through_parts(documents: DataFrame, matchers: Iterator[Matcher]) -> tuple[DataFrame, Matcher]:
    """The documents after all parts but the last, which is left to the caller."""
    spark, last = documents.sparkSession, next(matchers)
    for following in matchers:
        held = spark.sparkContext.broadcast(last)
        before = documents if _HIT in documents.columns else documents.withColumns({_HIT: F.lit(None).cast("binary"), _ITEMS: F.lit(None).cast("array<string>")})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    starts, hit, items = _match(held.value, batch, [words(t) for t in text_bytes(col(batch, "text"))])
                    bits = [np.packbits(hit[a : b - 1]).tobytes() for a, b in zip(starts[:-1], starts[1:])]
                    arrays = [*batch.columns[:-2], pa.array(bits, batch.schema.field(_HIT).type), pa.array([sorted(x) for x in items], batch.schema.field(_ITEMS).type)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

        ensure_checkpoints(spark)
        documents, last = before.mapInArrow(run, before.schema).checkpoint(), following
    return documents, last


def _without(text: bytes, spans: list[dict[str, int]]) -> str:
    cuts = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode()


def cleaned(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, bound: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """The documents with benchmark passages cut out of their texts, without those that such passages cover too far."""
    schema = documents.schema
    documents, last = _through_parts(documents, _matchers(benchmark, window, bound))
    held = documents.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                raw = text_bytes(col(batch, "text"))
                texts, stays = col(batch, "text").to_pylist(), [True] * len(raw)
                docs = [words(t) for t in raw]
                starts, hit, _ = _match(held.value, batch, docs)
                batch = batch.select(schema.names) if _HIT in batch.schema.names else batch
                total = np.concatenate(([0], np.cumsum(hit)))
                for d in np.flatnonzero(total[starts[1:]] > total[starts[:-1]]):
                    own = hit[starts[d] : starts[d + 1] - 1]
                    stays[d] = bool(own.sum() <= max_coverage * len(docs[d]))
                    texts[d] = _without(raw[d], _byte_spans(raw[d], own))
                made = replaced(batch, texts) if hit.any() else batch
                yield made.filter(pa.array(stays, pa.bool_()))

    return documents.mapInArrow(run, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, with_text: bool = True, bound: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """Finds and cuts benchmark passages.

    Per document: doc_id, n_words, n_hit (words inside any window of an item),
    items (ids of items with occurring windows, sorted as strings), spans (byte
    ranges of the hit runs), clean_text (the text without those spans), dropped
    (more than `max_coverage` of the words are hit). Spans and text are null
    when `with_text` is false.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents, last = _through_parts(documents, _matchers(benchmark, window, bound))
    held = documents.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, texts = col(batch, "doc_id").to_pylist(), text_bytes(col(batch, "text"))
                docs = [words(t) for t in texts]
                starts, hit, items = _match(held.value, batch, docs)
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[starts[1:]] - total[starts[:-1]]
                spans, clean = [None] * len(docs), [None] * len(docs)
                if with_text:
                    for d, text in enumerate(texts):
                        spans[d], clean[d] = [], text.decode()
                        if n_hit[d]:
                            spans[d] = _byte_spans(text, hit[starts[d] : starts[d + 1] - 1])
                            clean[d] = _without(text, spans[d])
                n = [len(w) for w in docs]
                out = [ids, n, n_hit.tolist(), [sorted(x) for x in items], spans, clean, [bool(h > max_coverage * k) for h, k in zip(n_hit, n)]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["doc_id", "n_words", "n_hit", "items", "spans", "clean_text", "dropped"])

    return documents.mapInArrow(run, _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from what `decontaminate` returns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )
