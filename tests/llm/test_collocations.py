import random
import re
from collections import Counter

import duckdb
import pytest

from strataweave.llm import collocations as co
from strataweave.llm.common import table

from .odd import odd_documents, odd_rows


def brute(rows, least=10, longest=3, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by the rule's text."""
    f = {}
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        ranked = []
        for g, a in own.items():
            if len(g) < 2 or a < least:
                continue
            if any(len(h) > len(g) and c >= least and 100 * c >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, c in own.items() if len(h) > len(g)):
                continue
            score, k = min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def made(seed=1, n=150):
    rng = random.Random(seed)
    vocab = ["The", "the", "red", "rot", "é", "fox", "x" * 30, "a b", "ça"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "!"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocab) + rng.choice(seps) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("cells", [1 << 6, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, cells):
    """Whether the sketch keeps out nearly all rare n-grams or, much too small, none."""
    monkeypatch.setattr(co, "BLOCK", 500)
    rows = made() + [(r[2], r[1]) for r in odd_rows() if not r[1] or len(r[1]) < 50_000]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string").repartition(5)
    assert sorted(map(tuple, co.collocations(docs, cells=cells).collect())) == brute(rows)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = co.op11_collocations(spark, sf_dir)
    names = df.columns
    want = con.execute(f"select {', '.join(names)} from ({co.OP11_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want


def test_more_words_and_other_limits(spark):
    rows = made(5, 80)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, co.collocations(docs, least=4, longest=4, top=7).collect())) == brute(rows, 4, 4, 7)


def test_sketch_keeps_all_that_is_frequent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    bits = co.heavy_cells(docs, 1 << 16, 10)
    assert 0 < int(sum(bin(b).count("1") for b in bits.tolist())) < co.ROWS << 16
    counts = {(r["lang"], r["phrase"]): r["n"] for r in co.frequent(docs, cells=1 << 16).filter("size > 0").collect()}
    assert counts == {(r["lang"], r["phrase"]): r["n"] for r in co.frequent(docs, cells=1 << 24).filter("size > 0").collect()}
    assert min(counts.values()) >= 10


def test_large_counts_are_exact(spark):
    big = "w " * 200_000
    docs = spark.createDataFrame([("en", big)] * 3, "lang string, text string")
    got = [tuple(r) for r in co.collocations(docs).collect()]
    a2, a3, n = 3 * 199_999, 3 * 199_998, 600_000
    assert got == [("en", 1, "w w w", a3, n, a2, n, 1_000_000 * a3 * a3 // (n * a2))]


def test_odd_rows(spark):
    odd = odd_documents(spark)
    got = sorted(map(tuple, co.collocations(odd).collect()))
    assert [r[2] for r in got] == ["word word word"] and got == brute([(r[2], r[1]) for r in odd_rows()])
    assert co.collocations(odd.limit(0)).count() == 0 and co.collocations(odd.filter("text is null")).count() == 0
