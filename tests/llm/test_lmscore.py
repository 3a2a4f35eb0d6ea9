"""Scores against a brute force over all words and bigrams."""

import math
import random
from collections import Counter

import pytest

from talus.llm import lmscore


def brute_force(rows, good):
    tokens = [(d, (t or "").lower().split()) for d, t in rows]
    models = []
    for chosen in ([w for d, w in tokens if d in good], [w for _, w in tokens]):
        pair, context, word = Counter(), Counter(), Counter()
        for w in chosen:
            word.update(w)
            pair.update(zip([None, *w], w))
            context.update(([None] + w)[:-1] if w else [])
        models.append((pair, context, word, sum(word.values())))
    distinct = len(models[1][2])

    def loss(model, c, w):
        pair, context, word, total = model
        unigram = (word[w] + 1) / (total + distinct)
        return -math.log(0.6 * pair[c, w] / context[c] + 0.4 * unigram if context[c] else unigram)

    out = []
    for d, w in tokens:
        gain = [loss(models[0], a, b) - loss(models[1], a, b) for a, b in zip([None, *w], w)] if models[0][3] else []
        out.append((d or 0, len(w), sum(gain) / len(gain) if gain else 0.0))
    return sorted(out)


def found(spark, rows, good):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, 1, 0) for d in good] + [(3, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return sorted((r.doc_id or 0, r.n_tokens, r.score) for r in lmscore.score(docs, labels).collect())


def test_every_word_counts(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(1, None), (2, " \n"), (3, "one"), (None, "Of no id"), (None, "w1 w2")]
    rows += [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 200)))) for i in range(4, 120)]
    rows += [(200, "rare stones"), (201, "seldom birds"), (202, "rare stones"), (20, rows[20][1])]
    good = {*range(10, 60), 200}
    got, want = found(spark, rows, good), brute_force(rows, good)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-9)
    score = {d: s for d, _, s in got}
    assert score[200] == score[202] < score[201]


def test_every_trusted_document_counts(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert lmscore.trusted(labels).count() == 25_000
