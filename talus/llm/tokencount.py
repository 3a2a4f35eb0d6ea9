"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens go into a trie. Each trie node is a prefix, and its best
score over all segmentations is computed once from the nodes above it: a piece
that ends at the node adds to the score of the node where it starts. Words that
share a prefix share that work; nodes where a word ends hold its token count.

The pieces come from a public vocabulary with scores (see `unigram_pieces`);
characters that no piece covers count as their bytes. Pre-tokens are words
between white space, with a mark for the space before; no token reaches beyond
one, so counts add up over a text.

Scale: a narrow map, no shuffle; each worker's trie holds at most `MAX_NODES`
prefixes and starts anew beyond that, which changes no count.

Defined cases: null, empty and blank texts have no tokens; among segmentations
of equal score the one with the longest last piece counts; extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import col, slices, text_bytes

SPACE = "▁"
MAX_NODES = 300_000
#: Longer pre-tokens are scored without being kept.
LONG = 1000
#: Cost of a byte of a character that no piece covers.
BYTE_SCORE = -20.0


def unigram_pieces(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece file with log probabilities by Zipf's law over their rank."""
    from talus.llm.spm import read_model

    ranked = [p for p, _, kind in sorted(((p, s, k) for p, s, k in read_model(path)), key=lambda x: -x[1]) if kind == "normal"]
    total = sum(1 / (k + 2.7) for k in range(len(ranked)))
    return {p: -math.log((k + 2.7) * total) for k, p in enumerate(ranked)}


class Trie:
    """Prefixes of pre-tokens with the best score of each and how many tokens that takes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.search = ahocorasick.Automaton()  # finds the pieces that end at a place
        for p, s in pieces.items():
            self.search.add_word(p, (len(p), s))
        if pieces:
            self.search.make_automaton()
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of a pre-token; kept at the node where it ends."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        if len(self.children) > MAX_NODES:
            self.clear()
        children, node, path = self.children, 0, [0]
        for c in word:
            below = children[node].get(c)
            if below is None:
                break
            node = below
            path.append(node)
        shared = len(path) - 1
        scores, tokens = [self.score[k] for k in path], [self.tokens[k] for k in path]
        if shared < len(word):
            self._forward(word, shared, scores, tokens)
            if len(word) <= LONG:
                for depth in range(shared, len(word)):
                    below = len(children)
                    children[node][word[depth]] = below
                    children.append({})
                    self.score.append(scores[depth + 1])
                    self.tokens.append(tokens[depth + 1])
                    node = below
        if len(word) <= LONG:
            self.terminal[word] = tokens[-1]
        return tokens[-1]

    def _forward(self, word: str, shared: int, scores: list[float], tokens: list[int]) -> None:
        """Extends the forward scores from the shared prefix to the end of the word."""
        pieces = self.pieces
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(word) - shared)]
        if pieces:
            for end, found in self.search.iter(word, max(0, shared + 1 - self.longest)):
                if end >= shared:
                    ending[end - shared].append(found)
        for depth in range(shared, len(word)):
            best, n = -math.inf, 0
            for length, s in ending[depth - shared]:  # the longest comes first, and stays among equals
                if (total := scores[depth + 1 - length] + s) > best:
                    best, n = total, tokens[depth + 1 - length] + 1
            if word[depth] not in pieces:
                wide = len(word[depth].encode())
                if (total := scores[depth] + BYTE_SCORE * wide) > best:
                    best, n = total, tokens[depth] + wide
            scores.append(best)
            tokens.append(n)


class _Counts(dict):
    """Counts of words as they stand in texts."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_NODES // 4:
            self.clear()
        n = self[word] = self.trie.count(SPACE + word.decode())
        return n


def token_counts(documents: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens of every row."""
    held = documents.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Trie(held.value))
        for whole in batches:
            for batch in slices(whole, "text"):
                words = [t.split() for t in text_bytes(col(batch, "text"))]
                n = [sum([counts[w] for w in ws]) for ws in words]
                yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(np.array(n, dtype=np.int64))], names=["doc_id", "n_words", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
