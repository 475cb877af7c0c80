import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strataweave.llm import simhash
from strataweave.llm.common import table

from .odd import odd_documents, odd_rows


def mark(text):
    w = bytes((text or "").encode()).lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(marks):
    """For each mark the least index of its component, all pairs compared."""
    up = list(range(len(marks)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(marks))]


def brute(rows):
    marks = [mark(t) for _, t in rows]
    least = {}
    roots = classes(marks)
    for r, (d, _) in zip(roots, rows, strict=True):
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return sorted(((d, f"{m:016x}", least[r]) for (d, _), m, r in zip(rows, marks, roots, strict=True)), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, simhash.op12_simhash(spark, sf_dir).collect()), key=repr) == brute(rows)


def test_spark_hashes_alike(spark):
    texts = ["a b c", "é ñ 漢字", "x" * 100, ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()]
    assert [g & (1 << 64) - 1 for g in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "C", "déf", "g" * 40]) + rng.choice(["", "\n", "  "]) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", " ", "one", " a  B", "x" * 99]
    for piece in (1, 3, 16, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(memoryview(t.encode())) for t in texts] == [mark(t) for t in texts]


def test_links_of_fingerprints_near_and_far(spark):
    """Chains, hot groups and pairs over all choices of bits; equal to comparing all pairs."""
    rng = random.Random(3)
    marks = []
    for _ in range(120):
        m = rng.getrandbits(64)
        marks.append(m)
        for _ in range(rng.randrange(4)):
            marks.append(m := m ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    base = rng.getrandbits(64)
    marks += [base ^ x for x in rng.sample(range(1 << 16), 900)]  # one key's group, over PAIRWISE members
    marks = list(dict.fromkeys(marks))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    edges = [tuple(r) for r in simhash.edges_of(spark.createDataFrame([(m,) for m in signed], "mark long")).collect()]
    up = {m: m for m in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    want, got = classes(marks), [root(m) for m in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_large_groups_equal_small_ones(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (2, 30, 200):
        places = np.unique(rng.integers(0, 1 << 16, n)).astype(np.int64)
        small = simhash.linked(places)
        monkeypatch.setattr(simhash, "PAIRWISE", 0)
        assert (simhash.linked(places) == small).all()
        monkeypatch.undo()
    every = simhash.linked(np.arange(1 << 16))
    assert (every == 0).all()


def test_odd_rows_and_one_of_each(spark):
    docs = odd_documents(spark)
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in odd_rows()])
    one = simhash.keep_one(docs.withColumnRenamed("shard", "__mark"))
    assert {r["doc_id"] for r in one.collect()} == {c for _, _, c in got} and one.count() == len(set(classes([mark(r[1]) for r in odd_rows()])))  # one id may name two
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "z y x"), (None, "z y x")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.simhash_components(nulls).collect()) == [(0, 0), (0, 0), (0, 4), (4, 4)]
    assert simhash.keep_one(nulls).count() == 2
    assert simhash.simhash_components(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
