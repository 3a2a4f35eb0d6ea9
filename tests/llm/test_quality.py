"""op6: scores and verdicts against a plain count, and the plan."""

import math
import struct
from collections import Counter

import pytest
import xxhash

from talus.llm import quality

FOLDER = "/root/testdata/sf0.001"


def _hash(value, seed=42):
    return xxhash.xxh64_intdigest(value, seed=seed)


def _grams(text, buckets):
    signed = [struct.pack("<Q", _hash(w)) for w in _words(text)]
    places = [struct.unpack("<q", h)[0] % buckets for h in signed]
    pairs = [struct.pack("<Q", _hash(b, _hash(a))) for a, b in zip(signed, signed[1:])]
    return places + [struct.unpack("<q", h)[0] % buckets for h in pairs]


def _words(text):
    import re

    return [w.encode() for w in re.findall("[^\\x20\\x09-\\x0D]+", text or "")]


@pytest.mark.parametrize("buckets", [64, quality.BUCKETS])
def test_scores(spark, buckets):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    said: dict = {}
    for r in labels.collect():
        said.setdefault(r.doc_id, []).append((r.quality, r.toxic or 0))
    trusted = {i for i, x in said.items() if min(q for q, _ in x if q is not None) == 1 and max(t for _, t in x) == 0}
    rows, raw, good = docs.select("doc_id", "text").collect(), Counter(), Counter()
    for r in rows:
        raw.update(grams := _grams(r.text, buckets))
        if r.doc_id in trusted:
            good.update(grams)
    of = lambda c, b: math.log((c[b] + 1) / (c.total() + buckets))
    ratio = [of(good, b) - of(raw, b) for b in range(buckets)]
    found = {r.doc_id: r for r in quality.judge(docs, labels, buckets).collect()}
    assert trusted and len(found) == len(rows)
    for r in rows:
        grams = _grams(r.text, buckets)
        score = sum(ratio[b] for b in grams) / max(len(grams), 1)
        assert found[r.doc_id].score == pytest.approx(score, abs=1e-9)
        assert found[r.doc_id].kept == (not found[r.doc_id].base_failed and score >= quality.THRESHOLD)


def test_plan_is_native(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality.judge(docs, labels)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "ExternalRDD"))


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, " \n\t", "x"), (3, "word " * 100_000, "x"), (None, "one two", "x"), (4, "a b", "x"), (4, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.judge(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(r.base_failed and not r.kept for r in found)
    assert {r.score for r in found if not r.n_words} == {0.0}
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0
