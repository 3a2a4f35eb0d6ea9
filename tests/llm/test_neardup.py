"""Near copies of the pipeline against brute force over all pairs."""

import random

import pytest

import corpus_pipeline


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    out = [(1, None), (2, ""), (3, "one two"), (4, "One  two")]
    for _ in range(12):
        base = r.choices(vocabulary, k=r.choice([12, 60, 300]))
        for changes in (0, 0, 1, 2, 3, 5, 8, 12):
            words = list(base)
            for _ in range(changes):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append((len(out) + 1, " ".join(words)))
    many = r.choices(vocabulary, k=150)
    for _ in range(40):  # a group whose members are not all alike
        words = list(many)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((len(out) + 1, " ".join(words)))
    return out


def kept(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a | sets[j]) and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def test_stage_finds_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in found.collect()) == kept(rows)
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a b c d e f g"), (2, "h i j k l m n")]
    found = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r.doc_id, r.text) for r in found.collect()) == rows[:2]


def test_simhash_rows_of_one_id(spark):
    """Different texts of one doc_id aren't one component, and null ids don't get lost."""
    from talus.llm import simhash

    rows = [(7, "one two three four five"), (7, "six seven eight nine ten"), (3, "six seven eight nine ten"), (None, "one two three four five"), (None, "alone here with these words")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 7), (3, 3), (7, 3), (7, 7)]


def test_components_of_awkward_edges(spark):
    from talus.llm.components import components

    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3), (None, 5), (9, 4), (4, 3)], "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == [(2, 2), (3, 2), (4, 2), (9, 2)]
    assert components(edges.limit(0)).count() == 0
