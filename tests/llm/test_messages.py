"""How many messages blocks and buckets exchange."""

import hashlib
import random

import numpy as np

from talus.llm import blocks as B
from talus.llm import suffix_dedup


def test_byte_repeats_of_large_blocks(spark, monkeypatch):
    """A block of several megabytes sends one row to a bucket, and its parts and chunks give the right cuts."""
    r = random.Random(5)
    text = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    shared = [text(3000) for _ in range(40)]
    rows, want, seen = [], [], set()
    for d in range(60):
        own, parts, gone = r.sample(range(40), 5), [], 0
        for k in own:
            parts += [text(5000 + 800 * (d % 40)), shared[k]]
            gone += len(shared[k]) if k in seen else 0
        seen.update(own)
        rows.append((d, "".join(parts)))
        want.append((d, gone))
    assert 4 << 20 < sum(len(t) for _, t in rows) < 8 << 20
    asked, answer = [], B.answer
    told, by_block = [], B.by_block
    monkeypatch.setattr(B, "answer", lambda questions, name: asked.append(questions.count()) or answer(questions, name))
    monkeypatch.setattr(B, "by_block", lambda answers, name: (told.append(answers.count()) if name == "owned" else None) or by_block(answers, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {x.doc_id: x for x in suffix_dedup.repeats(docs).collect()}
    for d, n in want:
        # a cut may be a little longer where the bytes beside two copies are the same by chance
        assert n <= found[d].n_removed <= n + 40
        assert found[d].kept_sha256 == hashlib.sha256(bytes(found[d].kept)).hexdigest() and len(found[d].kept) + found[d].n_removed == found[d].n_bytes
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert asked == [buckets] and told[0] <= buckets


def test_anchors_in_chunks():
    r = np.random.default_rng(3)
    lengths = [0, 700, 10, 0, 51, 400, 2500, 0]
    starts = np.concatenate(([0], np.cumsum(lengths)))
    data = r.integers(97, 100, starts[-1]).astype(np.uint8)
    block = B.Block(np.arange(len(lengths)), starts, data.tobytes())
    whole = B.winnow(B.Rolling(data.astype(np.uint64) + np.uint64(1)), starts, 20, 50)
    for size in (1, 60, 1000, 1 << 20):
        assert [x for a, b in B.chunks(starts, size) for x in range(a, b)] == list(range(len(lengths)))
        now = B.anchors(block, 20, 50, size)
        for name in ("first", "last", "doc", "at", "key"):
            assert np.array_equal(getattr(now, name), getattr(whole, name)), name
