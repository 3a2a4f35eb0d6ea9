"""Windows are told apart by their words, whatever their keys."""

import random

import pytest

from talus.llm import seed_extend


def brute_force(rows, window=50):
    first, out = {}, []
    for d, t in rows:
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, d), d)
    for d, t in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < d for j in range(k, k + window)}
        out.append((d, len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("key_bits", [1, 8, 48])
def test_short_keys(spark, key_bits):
    r = random.Random(key_bits)
    prose = lambda n: " ".join(r.choices(["a", "b", "cc", "ddd"], k=n))
    passages = [prose(n) for n in (49, 50, 51, 75, 130)]
    rows = [(i, " ".join(x for _ in range(r.randint(1, 3)) for x in (prose(r.randint(0, 60)), r.choice(passages)))) for i in range(60)]
    rows += [(100 + i, f"{prose(r.randint(0, 3))} {passages[4]} {prose(r.randint(0, 3))}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.n_removed, " ".join(x.kept_text.split())) for x in seed_extend.repeats(docs, key_bits=key_bits).collect())
    assert got == brute_force(rows)
    assert any(n for _, n, _ in got) and any(not n for _, n, _ in got)


def test_cut_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"x  {passage}\ty", "k"), (2, f" p\n{passage} \n q ", "l"), (None, passage, "m"), (3, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = {x.block: (x.doc_id, x.text) for x in seed_extend.without_repeats(docs).collect()}
    assert got == {"k": (1, rows[0][1]), "l": (2, " p\n \n q "), "m": (None, ""), "n": (3, "")}
