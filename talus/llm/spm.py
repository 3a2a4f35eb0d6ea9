"""SentencePiece encoding and decoding with a BPE model, exact, by backtracking.

A piece sequence is the merge result of a text exactly when every neighbouring
pair is: merging the text of two neighbours again must give these two. So the
encoder takes the longest piece at each position (Aho-Corasick over the text
read backwards, which names the longest piece of a position first), checks it
against the piece before it, goes to shorter pieces and then back to earlier
positions where the check fails, and marks positions from which no encoding
exists in a bitfield, so that each is given up once: linear, whatever the text.

Texts are cut where no piece can reach across (before a run of spaces and at
characters that no longer piece holds). An Arrow batch is cut into words at
once and only its distinct words are looked up, in a bounded table that a
worker keeps from task to task; a word that is not there is encoded, and its
ids are decoded to see whether they give the word again. A text of such words
alone decodes to itself; any other is decoded from its ids.

Scale: a narrow map, no shuffle; the model file is 0.5 MB and is read on the
driver and broadcast. A worker holds a slice (4 MB, or one longer text) some
ten times over, besides its tables.

Defined cases: null and empty texts have no pieces and decode to an empty
text; U+2581 in a text counts as a space, as in the library; repeated rows come
out as often as they stand; extra columns are not read; of pieces that merging
scores alike the leftmost is merged first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import col, slices

SPACE = "▁"
#: Words remembered by a worker, in each of two generations.
MAX_CHUNKS = 100_000


def read_model(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is one of normal, unknown, control, user, byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "byte" if model.is_byte(i) else "unused" if model.is_unused(i) else "normal"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class _Fits(dict):
    """Whether two pieces may stand side by side, by (code of the first) << 21 | code of the second."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, key: int) -> bool:
        if len(self) > 3 * MAX_CHUNKS:
            self.clear()
        a, b = self.bpe.text_of[key >> 21], self.bpe.text_of[key & 0x1FFFFF]
        made = self[key] = self.bpe.merged(a + b) == [a, b]
        return made


class Bpe:
    """Encoder and decoder over a list of pieces. Pieces go by code: their ids, and further numbers for characters without one."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.pieces = pieces
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.score = {p: s for p, s, kind in pieces if kind == "normal"}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == "unknown"), 0)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else b" \xe2\x81\x87 " if kind == "unknown" else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        # pieces that merging can arrive at
        reached = {p for p in self.id if len(p) == 1 or self.merged(p) == [p]}
        self.codes = {p: self.id[p] for p in reached}
        self.text_of = [p for p, _, _ in pieces]
        self.size = [len(p) for p in self.text_of]
        #: The ids that a code stands for, as decimal numbers joined by commas too, and what they decode to.
        self.ids_of = [(i,) for i in range(len(pieces))]
        self.decimal = [str(i) for i in range(len(pieces))]
        self.plain = [x.decode("utf-8", "replace") for x in self.bytes_of]
        self.shorter = [-1] * len(pieces)
        self.search = ahocorasick.Automaton()
        for p in sorted(reached):
            self.search.add_word(p[::-1], self.codes[p])
            if len(p) > 1:
                self.shorter[self.codes[p]] = self.code(next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in reached), p[0]))
        self.search.make_automaton()
        self.fits = _Fits(self)
        # characters that stand in no longer piece: pieces end there
        inner = {c for p in self.id if len(p) > 1 for c in p}
        self.breaks = [c for c in "\n" if c not in inner]
        self.space_leads = all(SPACE not in p.lstrip(SPACE) for p in self.id)

    def code(self, p: str) -> int:
        """Of a reached piece or of any character; there are fewer characters than 2**21 less the pieces."""
        at = self.codes.get(p)
        if at is None:
            at = self.codes[p] = len(self.text_of)
            self.text_of.append(p)
            self.size.append(1)
            self.shorter.append(-1)
            ids = tuple(self.byte[b] for b in p.encode()) if self.byte else (self.unknown,)
            self.ids_of.append(ids)
            self.decimal.append(",".join(map(str, ids)))
            self.plain.append(self.decode_bytes(ids).decode("utf-8", "replace"))
        return at

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first, leftmost among equals: the definition."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def segment(self, text: str) -> list[int]:
        """Codes of the pieces of a text in which spaces are escaped; an unknown character stands alone."""
        if (whole := self.codes.get(text)) is not None:
            return [whole]
        n = last = len(text)
        longest, size, shorter, fits = [-1] * n, self.size, self.shorter, self.fits
        for end, code in self.search.iter(text[::-1]):
            if end != last:
                longest[~end] = code
                last = end
        if -1 in longest:
            longest = [self.code(text[i]) if x < 0 else x for i, x in enumerate(longest)]
        failed = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0] if n else -1
        while pos < n:
            while token >= 0:
                end = pos + size[token]
                if not failed[end] and (not out or fits[out[-1] << 21 | token]):
                    out.append(token)
                    pos = end
                    if pos < n:
                        token = longest[pos]
                    break
                token = shorter[token]
            else:
                failed[pos] = 1
                token = out.pop()
                pos -= size[token]
                token = shorter[token]
        return out

    def ids(self, codes: list[int]) -> list[int]:
        return [i for c in codes for i in self.ids_of[c]]

    def chunks(self, text: str) -> list[str]:
        """Parts that can be encoded on their own; joined they are the escaped text with its leading space."""
        whole = SPACE + text.replace(" ", SPACE)
        if not self.space_leads:
            return [whole]
        stop = "".join(self.breaks)
        return re.findall(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+" + (f"|[{stop}]" if stop else ""), whole)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.ids(self.segment(c))] if text else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace").removeprefix(" ")


class _Table(dict):
    """What was made of a key, for the last keys that were asked for: a full table becomes the old one."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) < 200:
            if len(self) >= MAX_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


class Codec:
    """Whole texts through tables of chunks and words."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.bpe = Bpe(pieces)
        self.simple = self.bpe.space_leads and "\n" in self.bpe.breaks
        self.chunk, self.word = _Table(self._chunk), _Table(self._word)

    def _chunk(self, chunk: str) -> tuple[str, bytes]:
        """Decimal ids joined by commas, and the bytes that they decode to."""
        ids = self.bpe.ids(self.bpe.segment(chunk))
        return ",".join(map(str, ids)), self.bpe.decode_bytes(ids)

    def _word(self, word: str) -> str:
        """Decimal ids of a word after a space, or of a newline and the word after it; empty if its text is not plain.

        Plain: it has a character, no escaped space, and the ids of each of its pieces decode to the piece.
        """
        if not word or SPACE in word:
            return ""
        if word[0] == "\n":
            codes, want = self.bpe.segment("\n") + self.bpe.segment(word[1:]), word
        else:
            codes, want = self.bpe.segment(SPACE + word), " " + word
        if "".join([self.bpe.plain[c] for c in codes]) != want:
            return ""
        return ",".join([self.bpe.decimal[c] for c in codes])

    def one(self, text: str) -> tuple[str, str]:
        """Ids of any text, joined by commas, and the text that they decode to."""
        if not text:
            return "", ""
        made = [self.chunk[c] for c in self.bpe.chunks(text)]
        return ",".join([x[0] for x in made]), b"".join([x[1] for x in made]).decode("utf-8", "replace").removeprefix(" ")

    @staticmethod
    def numbers(joined: list[str]) -> np.ndarray:
        return np.array([x.count(",") + 1 if x else 0 for x in joined], dtype=np.int64)

    def code(self, texts: pa.Array) -> tuple[list[str], list[str], np.ndarray]:
        """Ids of each text, joined by commas; what they decode to; their number."""
        plain = texts.to_pylist()
        if not self.simple:
            made = [self.one(x) for x in plain]
            return [x[0] for x in made], [x[1] for x in made], self.numbers([x[0] for x in made])
        # each newline begins a word
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words = parts.values.dictionary_encode()
        table = self.word
        made = [table[w] for w in words.dictionary.to_pylist()]
        ids = pa.array([x or None for x in made], pa.string()).take(words.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(parts.offsets, ids), ",").to_pylist()  # null where a word is
        for i, x in enumerate(joined):
            if x is None:
                joined[i], plain[i] = self.one(plain[i])
        return joined, plain, self.numbers(joined)


_CODECS: dict[str, Codec] = {}


def _codec(name: str, pieces: list[tuple[str, float, str]]) -> Codec:
    """The worker's codec of a model: the last one stays from task to task."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(pieces)
    return _CODECS[name]


def encode(documents: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (the piece ids), decoded (text of the ids), ids_sha256 and decoded_sha256.

    ids_sha256 is over the decimal ids joined by commas; ids and decoded are
    null when `with_ids` is false. The model's path is read on the driver.
    """
    pieces = read_model(model_path)
    name = hashlib.sha256(repr(pieces).encode()).hexdigest()
    held = documents.sparkSession.sparkContext.broadcast(pieces)
    schema = "doc_id long, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, held.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, back, count = codec.code(col(batch, "text").fill_null(""))
                sha = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in column], pa.string()) for column in (ids, back)]
                numbers, decoded = pa.nulls(len(ids), pa.list_(pa.int32())), pa.nulls(len(ids), pa.string())
                if with_ids:
                    flat = np.fromstring(",".join(filter(None, ids)), dtype=np.int32, sep=",") if count.any() else np.zeros(0, dtype=np.int32)
                    numbers = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(flat, pa.int32()))
                    decoded = pa.array(back, pa.string())
                yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), pa.array(count), numbers, decoded, *sha], names=["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
