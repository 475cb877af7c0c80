import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.llm import bytescan
from strataweave.llm import decontaminate as dc
from strataweave.llm.common import table

from .odd import odd_documents


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(item, text, least):
    """Greedy string tiling as defined: all longest matches of free words, marked in order, down to ``least``."""
    free_i, free_t, tiled = [True] * len(item), [True] * len(text), 0
    while True:
        best, found = least - 1, []
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and free_i[p + n] and free_t[t + n] and item[p + n] == text[t + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((p, t))
        if not found:
            return tiled
        for p, t in found:
            if all(free_i[p : p + best]) and all(free_t[t : t + best]):
                free_i[p : p + best] = [False] * best
                free_t[t : t + best] = [False] * best
                tiled += best


def codes(seq):
    return bytescan.mix(np.array(seq, np.uint64) + np.uint64(3))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60))
def test_tiles_are_greedy(item, text):
    if len(item) < 2 or len(text) < 2:
        return
    own = set(bytescan.shingles(codes(item), 2).tolist())
    seeds = np.array([i for i, h in enumerate(bytescan.shingles(codes(text), 2).tolist()) if h in own], np.int64)
    tiles = dc.tile(codes(item), codes(text), seeds, 2)
    for p, t, n in tiles:
        assert n >= 2 and item[p : p + n] == text[t : t + n]
    assert len({p + k for p, _, n in tiles for k in range(n)}) == sum(n for *_, n in tiles) == len({t + k for _, t, n in tiles for k in range(n)})
    assert sum(n for *_, n in tiles) == brute(item, text, 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=4), st.integers(1, 12)), max_size=5), st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=4), st.integers(1, 15)), max_size=5))
def test_tiles_of_repeated_words(a, b):
    item, text = ([x for unit, n in parts for x in unit * n] for parts in (a, b))
    for least in (2, 5):
        own = set(bytescan.shingles(codes(item), least).tolist()) if len(item) >= least else set()
        seeds = np.array([i for i, h in enumerate(bytescan.shingles(codes(text), least).tolist() if len(text) >= least else []) if h in own], np.int64)
        assert sum(n for *_, n in dc.tile(codes(item), codes(text), seeds, least)) == brute(item, text, least)


@pytest.mark.parametrize("item,text", [(("a " * 6 + "b ") * 30, "a " * 20_000), ("a " * 200, "a " * 20_000), (("a " * 6 + "b ") * 30, ("a " * 6 + "b ") * 3_000), ("word " * 500, "word " * 100_000)])
def test_repeated_words_take_little_time(item, text):
    items = dc.Items([1], [item], 5, 0.6)
    began = time.process_time()
    found = list(items.of_texts(pa.array([text])))
    assert time.process_time() - began < 1 and found[0][1][0][:2] == (1, sum(n for n in ([6] * 30 if "b" in item and "b" not in text else [len(item.split())])))


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], words(r["text"])) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], words(r["text"])) for r in table(spark, sf_dir, "benchmark").collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    of_item = [(i, w, grams(w)) for i, w in items]
    want = {}
    for d, text in docs:
        own = grams(text)
        for i, item, g in of_item:
            if g & own and (n := brute(item, text, 5)) >= dc.COVERAGE * len(item):
                want[d, i] = n
    got = {(r["doc_id"], r["item_id"]): r["tiled_words"] for r in dc.op10_string_tiling(spark, sf_dir).collect()}
    assert got == want and want
    blocks = dc.tiled_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), block_bytes=4000)
    assert {(r["doc_id"], r["item_id"]): r["tiled_words"] for r in blocks.collect()} == want
    for size in (dc.BLOCK_BYTES, 4000):
        left = dc.drop_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), block_bytes=size)
        assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 0])
def test_reordered_passage_and_odd_rows(spark, block_bytes):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, f"{a} {b}"), (2, "Short item here"), (3, None), (None, a), (4, f"{a} {b}")], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"x {b.upper()} y {a} z"), (8, a), (7, f"{a} {b}"), (9, None), (5, "short  ITEM here"), (6, "a short item here"), (None, a)], "doc_id long, text string")
    pairs = lambda d, i: dc.tiled_pairs(d, i, block_bytes=block_bytes)
    clean = lambda d, i: dc.drop_contaminated(d, i, block_bytes=block_bytes)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(((r["doc_id"], r["item_id"], r["n_tiles"]) for r in pairs(docs, bench).collect()), key=key)
    assert got == [(5, 2, 1), (7, 1, 1), (7, 1, 2), (7, 4, 1), (7, 4, 2), (7, None, 1), (7, None, 1), (8, None, 1), (None, None, 1)]
    assert sorted(r["doc_id"] for r in clean(docs, bench).collect()) == [6, 9]
    assert pairs(odd_documents(spark), bench).count() == 0
    assert pairs(docs, bench.limit(0)).count() == 0
    assert clean(docs.limit(0), bench).count() == 0
    odd = odd_documents(spark).withColumnRenamed("shard", "__dkey")
    assert clean(odd, bench).count() == odd.count() and clean(odd, bench).columns == odd.columns


def test_a_passage_of_a_third_of_all_documents_and_a_large_benchmark(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.range(3000).selectExpr("id as doc_id", f"if(id % 3 = 0, concat('x', id, ' {passage}'), concat_ws(' ', transform(sequence(1, 30), x -> concat('w', id * 31 + x)))) as text")
    bench = spark.range(400).selectExpr("id as item_id", f"if(id = 7, '{passage}', concat_ws(' ', transform(sequence(1, 40), x -> concat('v', id * 41 + x)))) as text")
    got = dc.tiled_pairs(docs, bench, block_bytes=1000).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 3000, 3)) and {r["item_id"] for r in got} == {7}
