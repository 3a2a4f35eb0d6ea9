"""Language identification with a byte convolutional network in numpy.

Filters of several widths run over the bytes of fixed-length windows; each
filter keeps its maximum over a window, and a softmax layer reads the maxima.
A text is cut into windows from its first to its last byte, and its
probabilities are the mean over its windows, by their length.

Training uses labelled texts only: at most `PER_LANGUAGE` documents a language,
those with a small hash of their id, with a few stretches of each; this
bound is a parameter. All labelled languages are learned, so what the driver
holds grows with their number, never with the rows. Prediction covers all
documents as a narrow map; the model (some 200 kB) is broadcast.

Defined cases: null texts and texts without a letter (of Unicode's categories
L*) are `und` with score 0; with nothing to learn from all are; repeated rows
are predicted alike; null ids are neither learned from nor held out; of equal
probabilities the first language counts; extra columns are not read. A text's
windows are rated 512 at a time, but cut at once: some three bytes for one of a
very long text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import col, slices, text_bytes

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16
PER_LANGUAGE = 400
UNKNOWN = "und"
#: Below, a text is in none of the learned languages.
MIN_SCORE = 0.35
_LATIN = re.compile(rb"[A-Za-z]")
_AT_ONCE = 512


def lettered(text: bytes) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


class Network:
    """tables[w][j]: what byte values add to each filter of width w at offset j."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def _convolved(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        for w, table in zip(WIDTHS, self.tables):
            n = windows.shape[1] - w + 1
            total = table[0][windows[:, :n]]
            for j in range(1, w):
                total += table[j][windows[:, j : j + n]]
            yield total

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([c.max(axis=1) for c in self._convolved(windows)], axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of each window (bytes, zeros behind its end)."""
        made = []
        for i in range(0, len(windows), _AT_ONCE):
            hidden = np.maximum(self.pooled(windows[i : i + _AT_ONCE]) + self.bias, 0)
            made.append(_softmax(hidden @ self.out + self.out_bias))
        return np.concatenate(made)

    def train(self, windows: np.ndarray, labels: np.ndarray, rounds: int = 6, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over the cross-entropy; a maximum passes its gradient to the place it came from."""
        rng = np.random.default_rng(seed)
        weights = (len(labels) / np.maximum(np.bincount(labels, minlength=len(self.languages)), 1))[labels]
        weights = (weights / weights.mean()).astype(np.float32)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), 64):
                own = order[i : i + 64]
                x, y = windows[own], labels[own]
                places, tops = [], []
                for total in self._convolved(x):
                    at = total.argmax(axis=1)
                    places.append(at)
                    tops.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
                raw = np.concatenate(tops, axis=1) + self.bias
                hidden = np.maximum(raw, 0)
                slope = _softmax(hidden @ self.out + self.out_bias)
                slope[np.arange(len(y)), y] -= 1
                slope *= weights[own][:, None] / len(y)
                back = (slope @ self.out.T) * (raw > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                for k, (w, at) in enumerate(zip(WIDTHS, places)):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    which = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for j in range(w):
                        np.add.at(grads[k][j], (np.take_along_axis(x, at + j, axis=1), which), part)
                grads += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (zeros behind an end), the text each is of, and how many bytes it has."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    joined = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts))
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(np.array([len(t) for t in texts], dtype=np.int64)[owner] - place * WINDOW, WINDOW)
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), owner, size


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network trained on labelled documents that aren't held out."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    # a hash threshold for each language gives about per_language documents of it, wherever they are
    most = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int((1 << 30) * min(1.0, per_language / n)))])
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(most, F.col("lang"))
    third = F.greatest(F.lit(1), (F.char_length("text") / 3).cast("int"))
    parts = F.array(*[F.substring(F.col("text"), F.lit(1) + third * k, F.lit(WINDOW)) for k in range(3)])
    rows = labelled.where(chosen).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", parts.alias("parts"))
    languages = sorted(counts)
    windows, labels = [], []
    for doc_id, lang, stretches in sorted((tuple(r) for r in rows.collect()), key=lambda r: r[:2]):
        for k, text in enumerate(stretches):
            full = text.encode()[:WINDOW]
            # some short ones, for short texts
            for raw in (full, full[: 24 + 17 * (len(windows) % 5)]) if k == 0 else (full,):
                if lettered(raw):
                    windows.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8))
                    labels.append(languages.index(lang))
    if not windows:
        return None
    network = Network(languages)
    network.train(np.array(windows), np.array(labels))
    return network


def classify(net: Network | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text."""
    found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if net is not None and t and lettered(t)]
    if known:
        windows, owner, size = cut([texts[i] for i in known])
        weighed = net.probabilities(windows) * size[:, None]
        starts = np.searchsorted(owner, np.arange(len(known)))
        mean = np.add.reduceat(weighed.astype(np.float64), starts) / np.add.reduceat(size, starts)[:, None]
        for i, k, p in zip(known, mean.argmax(axis=1), mean.max(axis=1)):
            found[i], scores[i] = net.languages[k], min(1.0, float(p))
    return found, scores


def predict(documents: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    held = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found, scores = classify(held.value, text_bytes(col(batch, "text")))
                arrays = [col(batch, "doc_id"), col(batch, "held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(documents, learn(documents, per_language))


def accepted(documents: DataFrame, network: Network | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows, unchanged, whose language is known with at least this probability.

    Where there was nothing to learn from, no row is in an unknown language: all that have a letter stay.
    """
    held = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = text_bytes(col(batch, "text"))
                if held.value is None:
                    keep = [lettered(t) for t in texts]
                else:
                    keep = [f != UNKNOWN and s >= min_score for f, s in zip(*classify(held.value, texts))]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
