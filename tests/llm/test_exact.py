"""Exact operators against brute force, over awkward rows and clashing extra columns."""

import functools
import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from talus.llm import decontam, quality, seed_extend, simhash, spm, suffix_dedup, tokencount

MODEL = __import__("public_tokenizers").path("piece_bpe_32k.model")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Names that the operators use inside, or give back.
CLASHING = ("block", "bucket", "payload", "raw", "key", "n_words", "fingerprint", "component_id", "score", "kept", "ids", "w")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)] + ["Ünïcode", "日本語", "emoji😀", "ŁÓDŹ", "don't"]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, line = prose(70), prose(9)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, "A"), (7, "\x00\x1f odd    spaces　here")]
    for i in range(8, 60):
        text = prose(r.randint(1, 120))
        if i % 3 == 0:
            text += " " + passage + "\n" + prose(20)
        if i % 7 == 0:
            text = "\n".join([line] * 4) + "\n" + text
        out.append((i, text))
    out += [(60 + i, out[30][1]) for i in range(30)]  # a group of copies
    out += [(90, out[29][1] + " end"), (91, "same " * 400), (92, "same " * 401), (93, prose(30000)), (94, "x" * 60000), (95, "<#*$%&|>" * 20)]
    out.append((95, "<#*$%&|>" * 20))  # a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    base = spark.createDataFrame(rows, "doc_id long, text string")
    return base.select("*", *[F.lit("clash").alias(c) for c in CLASHING]).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return sorted(tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect())


def test_decontamination(spark, docs, rows):
    items = [(1, rows[20][1]), (2, rows[23][1]), (10, "two words"), (11, None), (12, "!!"), (13, "one"), (14, " ".join((rows[20][1] or "").split()[:9]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(0))
    windows = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        hit, who = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    who |= found
                    hit.update(range(k, k + n))
        want.append((d, len(w), len(hit), len(who), sha(",".join(sorted(who))), len(who) >= 2))
    got = by_id(decontam.digest(decontam.decontaminate(docs, benchmark, with_text=False)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want)
    parts = by_id(decontam.digest(decontam.decontaminate(docs, benchmark, with_text=False, bound=900)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert parts == got and len(list(decontam._matchers(benchmark, 8, 900))) > 2
    assert {r[3] for r in by_id(decontam.digest(decontam.decontaminate(docs, benchmark.limit(0), with_text=False)), "n_words", "n_hit", "n_items")} == {0}


def test_byte_repeats(docs, rows, empty):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, d), d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    assert by_id(suffix_dedup.repeats(docs, with_bytes=False), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)
    assert suffix_dedup.repeats(empty).count() == 0


def test_word_repeats(docs, rows, empty):
    first = {}
    for d, t in rows:
        w = SPACES.findall(t or "")
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            first[s] = min(first.get(s, d), d)
    want = []
    for d, t in rows:
        w = SPACES.findall(t or "")
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for j in range(k, k + 50)}
        want.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    assert by_id(seed_extend.repeats(docs, with_text=False), "n_words", "n_removed", "kept_sha256") == sorted(want)
    assert seed_extend.repeats(empty).count() == 0


def test_simhash(docs, rows, empty):
    prints = []
    for d, t in rows:
        w = SPACES.findall((t or "").translate(LOWER))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    of = {}
    for d, p in prints:
        of[p] = min(of.get(p, d), d)
    root = {p: p for p in of}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in of:
        for q in of:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    least = {}
    for p in of:
        least[find(p)] = min(least.get(find(p), of[p]), of[p])
    assert by_id(simhash.near_duplicates(docs), "fingerprint", "component_id") == sorted((d, f"{p:016x}", least[find(p)]) for d, p in prints)
    assert simhash.near_duplicates(empty).count() == 0


def test_sentencepiece(docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(d, len(i), sha(",".join(map(str, i))), sha(sp.decode(i))) for d, t in rows for i in [sp.encode(t or "")]]
    assert by_id(spm.encode(docs, MODEL), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    assert spm.encode(empty, MODEL).count() == 0


def test_quality_counts(spark, docs, rows, empty):
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(8, 60)] + [(None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    want = []
    for d, t in rows:
        t = t or ""
        w = SPACES.findall(t)
        lines = Counter(x for x in t.split("\n") if SPACES.search(x))
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(lines.values()) - len(lines), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)))
    found = quality.judge(docs, labels)
    assert by_id(found, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want)
    assert found.where("base_failed AND kept").count() == 0
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).count() == len(rows)


def test_token_counts(docs, rows, empty):
    pieces = tokencount.unigram_pieces(MODEL)
    longest = max(map(len, pieces))

    @functools.cache
    def tokens(word):
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            score, n = float("-inf"), 0
            for i in range(max(0, j - longest), j):  # the longest piece first: it stays among equals
                if word[i:j] in pieces and best[i][0] + pieces[word[i:j]] > score:
                    score, n = best[i][0] + pieces[word[i:j]], best[i][1] + 1
            raw = len(word[j - 1].encode())
            if word[j - 1] not in pieces and best[j - 1][0] + tokencount.BYTE_SCORE * raw > score:
                score, n = best[j - 1][0] + tokencount.BYTE_SCORE * raw, best[j - 1][1] + raw
            best.append((score, n))
        return best[-1][1]

    want = [(d, len(w), sum(tokens(tokencount.SPACE + x) for x in w)) for d, t in rows for w in [SPACES.findall(t or "")]]
    assert by_id(tokencount.token_counts(docs, pieces), "n_words", "n_tokens") == sorted(want)
    assert tokencount.token_counts(empty, pieces).count() == 0


def test_cleaned(spark):
    item = " ".join(f"i{k}" for k in range(30))
    prose = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"{prose}, I0 {item[3:]}! {prose}", 7), (2, f"some {item} words", 8), (3, None, 9), (3, None, 9), (None, prose, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit long")
    for bound in (1 << 20, 20):
        benchmark = spark.createDataFrame([(1, item), (2, "other words that stand in no document at all"), (3, None)], "item_id long, text string")
        found = sorted((r.doc_id or 0, r.text, r.n_hit) for r in decontam.cleaned(docs, benchmark, bound=bound).collect() if r.text)
        # cut out of the first, which it covers in part; the second is mostly benchmark and goes
        assert found == [(0, prose, 1), (1, f"{prose}, ! {prose}", 7)]
        assert decontam.cleaned(docs, benchmark, bound=bound).where("text IS NULL").count() == 2
        assert decontam.cleaned(docs, benchmark, bound=bound).columns == docs.columns
