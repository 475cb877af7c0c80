import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.llm import runs
from strataweave.llm.common import table

from .odd import odd_documents, odd_rows

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return (text or "").translate({c: " " for c in range(9, 14)}).split(" ") and [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def brute_edges(s):
    after, common = [], []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        c = 0
        while j + c < len(s) and s[i + c] == s[j + c]:
            c += 1
        after.append(j)
        common.append(c)
    return after, common


def brute(s, least, repeats):
    """All runs, period by period."""
    out = set()
    for p in range(1, len(s) // repeats + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            n = j + p - i
            if n >= max(least, repeats * p) and not any(all(s[k] == s[k + d] for k in range(i, i + n - d)) for d in range(1, p)):
                out.add((i, n, p))
            i = j + 1
    return out


PIECES = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 30))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=5).map(lambda ps: [x for unit, n, cut in ps for x in (unit * n)[: cut or None]]))
def test_edges_and_runs_equal_brute_force(s):
    assert runs.edges(s) == brute_edges(s)
    for least, repeats in ((1, 2), (4, 3), (24, 3)):
        assert runs.runs_of(s, least, repeats) == brute(s, least, repeats)
    assert set(runs.find(np.array(s, np.int32))) == brute(s, 24, 3)


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [0, 1] * (n // 2), lambda n: [i.bit_count() & 1 for i in range(n)], lambda n: ([0] * 999 + [1]) * (n // 1000)])
def test_time_is_linear(make):
    began = time.process_time()
    runs.runs_of(make(300_000))
    assert time.process_time() - began < 6


def want(doc_id, text):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute(w, 24, 3), key=lambda r: (r[0], r[2]))
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, SHA("".join(f"{s},{m},{p}\n" for s, m, p in found)), SHA(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    docs = [d for d in docs if len(words(d[1])) <= 1500]  # by brute force; the longer ones are checked below
    got = {r["doc_id"]: tuple(r) for r in runs.op13_periodic_runs(spark, sf_dir).collect()}
    assert [got[d] for d, _ in docs] == [want(*d) for d in docs] and any(got[d][1] for d, _ in docs)
    assert len(got) == table(spark, sf_dir, "documents").count()


def test_odd_rows_and_long_texts(spark, tmp_path):
    rng = random.Random(4)
    many = " ".join(f"w{rng.randrange(300)}" for _ in range(60_000))
    texts = [("a b c " * 9).strip(), "x " * 24, "x " * 23, many + " r s t u" * 50 + " " + many, "L " * 30 + "l " * 30, None, "", "a b c d " * 6, "é x " * 40]
    rows = [(10_000 + i, t) for i, t in enumerate(texts)] + [(None, "q r " * 20), (10_000, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in runs.periodic_runs(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["period"], r["unit"]))
    assert found[10_001] == [(0, 24, 1, "x")] and 10_002 not in found and 10_005 not in found and 10_006 not in found
    assert found[10_003] == [(60_000, 200, 4, "r s t u")] and found[None] == [(0, 40, 2, "q r")] and len(found[10_000]) == 2
    assert sorted(found[10_004]) == [(0, 30, 1, "L"), (30, 30, 1, "l")] and found[10_008] == [(0, 40, 1, "é x")]
    short = {r["doc_id"]: r["text"] for r in runs.collapse(docs).collect()}
    assert short[10_000] == "a b c" and short[10_003] == f"{many} r s t u {many}" and short[10_002] == texts[2] and short[10_005] is None
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: repr(r)
    small = [r for r in odd_rows() if r[1] is None or len(r[1]) < 90_000]
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert len(got) == len(odd_rows())
    assert {repr(want(r[0], r[1])) for r in small} <= {repr(r) for r in got}, sorted(got, key=key)
    named = odd_documents(spark).withColumnRenamed("shard", "__text")
    assert runs.collapse(named).columns == named.columns and runs.collapse(named).count() == named.count()
    assert runs.periodic_runs(docs.limit(0)).count() == 0 and runs.collapse(docs.limit(0)).count() == 0
