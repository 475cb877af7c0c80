import random
import re

import numpy as np

from strataweave.llm import near_duplicates as nd
from strataweave.llm.common import table
from strataweave.llm.components import components

from .odd import odd_documents, odd_rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, n, component, links) of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for trial in range(1500):
        n = int(rng.integers(4, 60)) if trial % 3 else int(rng.integers(60, 1500))
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        drop, add = int(rng.integers(0, len(a) // 5 + 1)), int(rng.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(1, 2**63, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) != both != len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(nd.signatures(a), nd.signatures(b))), (len(a), len(b), both)


def test_prefixes_catch_sets_with_few_groups(monkeypatch):
    monkeypatch.setattr(nd, "groups_of", lambda i, p: 1)  # far too few: every set depends on its prefix
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(1, 2**63, int(rng.integers(10, 90)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[len(a) // 12 :]], rng.integers(1, 2**63, len(a) // 12, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(nd.signatures(a), nd.signatures(b)))


def test_blobs_come_back():
    rng = np.random.default_rng(7)
    held = [(int(i), rng.integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2)) for i in range(9)]
    got = {}
    keep = lambda s, bits: (s >> 64 - bits >> max(0, bits - 16) << 48) | (s & ((1 << 48) - 1))
    for bits in (6, 16, 23):
        got.clear()
        for _, bucket, *_, blob in nd._pack(held, bits):
            for s, i in zip(*nd._unpack(bucket, blob, bits), strict=True):
                got.setdefault(int(i), set()).add(int(s))
        assert got == {i: {keep(int(x), bits) for x in s} for i, s in held}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, nd.op1_ngram_jaccard(spark, sf_dir).collect())) == brute(rows)


def test_families_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        w = list(base if i % 4 else base[:60] + [f"x{i}y{k}" for k in range(60)])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000, "a b c d e f g h i j k l"), (2001, "a b c d e f g h i j k l m"), (2002, "x y"), (2003, "X  y"), (2004, "x")]
    monkeypatch.setattr(nd, "FAMILY_BLOCK", 30)
    monkeypatch.setattr(nd, "LIST_BLOCK", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, nd.jaccard_components(docs).collect())) == brute(rows)
    monkeypatch.setattr(nd, "BROADCAST_MEMBERS", 0)
    assert sorted(map(tuple, nd.jaccard_components(docs).collect())) == brute(rows)


def test_odd_rows(spark):
    got = nd.jaccard_components(odd_documents(spark)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == brute([(r[0], r[1]) for r in odd_rows()])
    assert nd.jaccard_components(odd_documents(spark).limit(0)).count() == 0
    kept = nd.keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    # One row for each component of rows with words, and every row without.
    want = {c for (_, n, c, _) in brute([(r[0], r[1]) for r in odd_rows()]) if n}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows if shingles(r["text"])} >= want
    assert sum(1 for r in rows if not shingles(r["text"])) == sum(1 for r in odd_rows() if not shingles(r[1]))


def test_null_and_repeated_ids(spark):
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(None, long[0]), (None, long[0] + " x"), (None, long[1]), (5, long[1]), (7, long[2]), (7, long[3]), (7, long[3]), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, __of int")
    got = nd.jaccard_components(docs).collect()
    key = lambda r: str(tuple(r))
    want = [(None, 36, None, 1), (None, 37, None, 1), (None, 36, 5, 1), (5, 36, 5, 1), (7, 36, 7, 0), (7, 36, 7, 1), (7, 36, 7, 1), (9, 0, 9, 0), (9, 0, 9, 0), (None, 0, None, 0)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = sorted(r["__of"] for r in nd.keep_one(docs).collect())
    assert [i for i in kept if i not in (0, 1, 5, 6)] == [3, 4, 7, 8, 9]
    assert len({0, 1} & set(kept)) == 1 and len({5, 6} & set(kept)) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(200, x) for x in range(201, 230)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {x: 200 for x in range(200, 230)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_jobs(spark):
    """What the driver plans and keeps follows the jobs: stars are known as such, and a table that is kept takes no second job."""
    sc = spark.sparkContext
    sc.setJobGroup("components", "")
    try:
        got = dict(map(tuple, components(spark.createDataFrame([(200, x) for x in range(201, 230)], "a long, b long")).collect()))
    finally:
        sc._jsc.clearJobGroup()
    assert got == {x: 200 for x in range(200, 230)}
    assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 12


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for n in (5, 300, 1100, 9000):
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(1, 2**63, n, dtype=np.uint64)]))
        c = nd.unfold([nd.sketch(a), nd.sketch(b)])
        gap = np.abs(c[0].astype(int) - c[1])
        assert np.minimum(gap, 16 - gap).sum() <= len(np.setxor1d(a, b))
