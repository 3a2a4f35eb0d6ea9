"""Language-model scoring by cross-entropy difference.

Two bigram models, one of trusted documents and one of the whole corpus, share
a vocabulary, an order and a smoothing. A document's score is the mean over its
tokens of the loss under the target model less the loss under the background
model: the lower, the more it is like the target.

Every word and every bigram of every document counts; the tables grow with the
corpus and stay on the cluster. Documents are packed into blocks (see
`blocks`). A block sends each of its words and bigrams once, as a 56-bit hash
with its counts, to a bucket of hashes; a bucket adds up what all blocks sent
and answers each block in the order of its hashes, so a bigram that all
documents have costs an entry per block. Words are summed
first, as their totals are part of every rate. The driver sees four sums.

The probability of word w after c is BIGRAM * n(c, w) / n(c) plus (1 - BIGRAM)
times the unigram (n(w) + 1) / (tokens + distinct words of the corpus), and the
unigram alone after a c that the model has not seen. A start stands before each
document; it is a context, never a word.

Two of n distinct n-grams clash with probability n**2 / 2**57, and then share
their counts: some 10 of 10**9 would.

Defined cases: null, empty and blank texts have no tokens and score 0; without
trusted documents every score is 0; repeated rows are counted and scored as
often as they stand; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import blocks as B
from talus.llm.common import few

#: Share of the bigram estimate; the rest goes to the unigram.
BIGRAM = 0.6
#: Stands for the start of a document among the hashes of words.
START = np.uint64(0x53544152545354)
KEY_BITS = 56
#: Text of a block: the more, the fewer bigrams are sent more than once.
BLOCK_BYTES = 4 << 20


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that some label calls good and none calls bad or toxic."""
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return judged.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def _flagged(packed: DataFrame, labels: DataFrame) -> DataFrame:
    """The blocks with the ids of their trusted documents (good)."""
    held = packed.select("block", F.explode("ids").alias("doc_id")).distinct()
    good = few(held.join(trusted(labels), "doc_id").groupBy("block").agg(F.collect_list("doc_id").alias("good"))).checkpoint()
    return packed.join(good, "block", "left")


class Grams:
    """Distinct words (the start among them) and bigrams of a block, in the order of their hashes, with counts."""

    def __init__(self, block: B.Block, good: list[int] | None, pairs: bool = True):
        number: dict[bytes, int] = {}
        flat: list[int] = []
        self.counts = np.zeros(len(block.ids), dtype=np.int64)
        for i in range(len(block.ids)):
            words = block.data[block.starts[i] : block.starts[i + 1]].lower().split()
            self.counts[i] = len(words)
            if words:
                flat.append(0)
                flat.extend([number.setdefault(w, len(number) + 1) for w in words])
        ids = np.array(flat, dtype=np.int64)
        hashes = np.array([int(START) << 8, *map(xxhash.xxh64_intdigest, number)], dtype=np.uint64) >> np.uint64(64 - KEY_BITS)
        after = np.flatnonzero(ids)
        word, context = ids[after], ids[after - 1]
        weight = np.repeat(np.isin(block.ids, np.array(good or [], dtype=np.int64)), self.counts).astype(np.float64)
        n = len(hashes)
        order = np.argsort(hashes)
        self.words = hashes[order]
        self.word_counts = [np.bincount(x, w, minlength=n)[order].astype(np.uint32) for x, w in ((word, None), (word, weight), (context, None), (context, weight))]
        if not pairs:
            return
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        met, where = np.unique(rank[context] * n + rank[word], return_inverse=True)
        first, second = met // n, met % n
        keys = B.mix(B.mix(self.words[first]) * np.uint64(3) + self.words[second]) >> np.uint64(64 - KEY_BITS)
        order = np.argsort(keys, kind="stable")
        back = np.empty(len(met), dtype=np.int64)
        back[order] = np.arange(len(met))
        #: Of each token, the place of its bigram; of each bigram, the places of its words.
        self.token, self.first, self.second = back[where], first[order], second[order]
        self.pairs = keys[order]
        self.pair_counts = [np.bincount(self.token, w, minlength=len(met)).astype(np.uint32) for w in (None, weight)]


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 31)).astype(np.int64) * buckets) >> 31


def _ask(block: int, keys: np.ndarray, counts: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    bucket = _bucket_of(keys, buckets)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[a]), block, B.squeeze(np.diff(keys[a:b], prepend=np.uint64(0)), *(c[a:b] for c in counts))


def _sums(table: pa.Table) -> pa.Table:
    """Answers a bucket's questions: the sums of the counts of each key, in the block's order. The first row has the bucket's totals."""
    asked = [B.stretch(x) for x in table.column("payload").to_pylist()]
    keys = [np.cumsum(x[0], dtype=np.uint64) for x in asked]
    once, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([x[k] for x in asked])).astype(np.uint64) for k in range(1, len(asked[0]))]
    ends = np.cumsum([0, *map(len, keys)])
    out = [B.squeeze(*(s[where[a:b]] for s in sums)) for a, b in zip(ends[:-1], ends[1:])]
    rest = [0] * (len(asked) - 1)
    totals = [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())]
    made = {"bucket": table.column("bucket"), "block": table.column("block"), "payload": pa.array(out, pa.binary())}
    return pa.table(made | {c: pa.array([x, *rest], pa.int64()) for c, x in zip(("distinct", "tokens", "good_tokens"), totals)})


def _summed(asked: DataFrame) -> DataFrame:
    return asked.groupBy("bucket").applyInArrow(_sums, f"{B.QUESTION}, distinct long, tokens long, good_tokens long")


def _answers(summed: DataFrame, name: str) -> DataFrame:
    return summed.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))


def _read(keys: np.ndarray, n: int, buckets: int, answers: list[dict] | None) -> list[np.ndarray]:
    bucket = _bucket_of(keys, buckets)
    out = [np.zeros(len(keys)) for _ in range(n)]
    for x in answers or ():
        a, b = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
        for to, part in zip(out, B.stretch(x["payload"])):
            to[a:b] = part
    return out


def _loss(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """Loss (nats) of each bigram."""
    unigram = (word + 1) / (total + distinct)
    return -np.log(np.where(context > 0, BIGRAM * pair / np.maximum(context, 1) + (1 - BIGRAM) * unigram, unigram))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score of every row."""
    packed = B.packed(documents, size=BLOCK_BYTES)
    buckets = B.buckets_for(packed)
    flagged = _flagged(packed, labels)

    def words(number: int, block: B.Block, good: list | None) -> Iterator[tuple]:
        grams = Grams(block, good, pairs=False)
        yield from _ask(number, grams.words, grams.word_counts, buckets)

    def pairs(number: int, block: B.Block, good: list | None) -> Iterator[tuple]:
        grams = Grams(block, good)
        yield from _ask(number, grams.pairs, grams.pair_counts, buckets)

    asked = [B.over_blocks(flagged, f, B.QUESTION, B.QUESTION_NAMES, "good") for f in (words, pairs)]
    # words have to be known before anything is rated; bigrams, most of the volume, are moved and not kept
    of_words = _summed(asked[0]).checkpoint()
    distinct, tokens, good_tokens = (x or 0 for x in of_words.agg(F.sum("distinct"), F.sum("tokens"), F.sum("good_tokens")).first())
    both = flagged.join(_answers(of_words, "of_words"), "block", "left").join(_answers(_summed(asked[1]), "of_pairs"), "block", "left")

    def rate(number: int, block: B.Block, good: list | None, of_words: list | None, of_pairs: list | None) -> Iterator[tuple]:
        grams = Grams(block, good)
        raw_word, good_word, raw_context, good_context = _read(grams.words, 4, buckets, of_words)
        raw, own = _read(grams.pairs, 2, buckets, of_pairs)
        first, second = grams.first, grams.second
        gain = np.zeros(len(raw))
        if good_tokens:
            gain = _loss(own, good_context[first], good_word[second], good_tokens, distinct) - _loss(raw, raw_context[first], raw_word[second], tokens, distinct)
        total = np.concatenate(([0.0], np.cumsum(gain[grams.token])))
        ends = np.concatenate(([0], np.cumsum(grams.counts)))
        mean = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(grams.counts, 1)
        for i, n, x in zip(block.ids.tolist(), grams.counts.tolist(), mean.tolist()):
            yield None if i == B.NO_ID else i, n, x

    return B.over_blocks(both, rate, "doc_id long, n_tokens long, score double", ["doc_id", "n_tokens", "score"], "good", "of_words", "of_pairs")
