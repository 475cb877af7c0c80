import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.llm import bytescan
from strataweave.llm import quality as ql
from strataweave.llm.common import table

from .odd import odd_documents

TEXT = st.text(alphabet="abAB \n\té漢\x0b#", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 60))
def test_word_hashes_tell_words_apart(texts, block):
    before, bytescan.BLOCK = bytescan.BLOCK, block
    try:
        meaning = {}
        seen = 0
        for a, b, hashes, bounds in bytescan.words(pa.array(texts, pa.string()), lower=True):
            assert a == seen
            seen = b
            for i in range(a, b):
                want = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
                got = hashes[bounds[i - a] : bounds[i - a + 1]].tolist()
                assert len(got) == len(want)
                for h, w in zip(got, want, strict=True):
                    assert meaning.setdefault(h, w) == w
        assert seen == len(texts)
        assert len(set(meaning.values())) == len(meaning)
    finally:
        bytescan.BLOCK = before


def test_shingles():
    h = bytescan.mix(np.arange(7, dtype=np.uint64))
    assert len(bytescan.shingles(h)) == 3
    assert len(bytescan.shingles(h[:4])) == 1
    assert len(bytescan.shingles(h[:0])) == 0
    assert bytescan.shingles(h[:4])[0] != bytescan.shingles(np.concatenate([h[:4], h[:1]]))[0]
    assert bytescan.shingles(h)[1] == bytescan.shingles(h[1:6])[0]


def dense_terms(c):
    """The whole term matrix of counts, spelled out."""
    out = np.zeros((len(c.n), ql.TERMS), np.float32)
    out[:, : ql.DENSE] = c.dense
    for i in range(len(c.n)):
        for k in range(c.bounds[i], c.bounds[i + 1]):
            out[i, ql.DENSE + c.cells[k]] += c.counts[k]
    return out


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    made = lambda: " ".join(f"w{rng.integers(300)}" for _ in range(rng.integers(1, 60)))
    counts = ql.term_counts(pa.array([made() for _ in range(60)]))
    labels = rng.integers(0, 2, 60)
    v = ql.Voters(counts, labels, rank=16)
    asked = ql.term_counts(pa.array(["", *(made() for _ in range(8))]))
    got = v.vote(asked, 5, block=4)

    def unit(c):
        x = np.log1p(dense_terms(c) * (200 / np.maximum(c.n, 1))[:, None]) * v.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    x = unit(counts)
    axes = np.linalg.svd(x, full_matrices=False)[2][:16].T
    assert np.linalg.norm(x @ axes) ** 2 * 0.98 <= np.linalg.norm(x @ v.axes) ** 2  # as much of the matrix as the exact axes hold
    latent = lambda c: (y := unit(c) @ v.axes) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    known = latent(counts)
    for i, q in enumerate(latent(asked)):
        cosine = sorted(((float(q @ y), l) for y, l in zip(known, labels, strict=True)), reverse=True)[:5]
        want = sum(max(c, 0) ** 4 * l for c, l in cosine) / max(sum(max(c, 0) ** 4 for c, _ in cosine), 1e-12)
        assert abs(got[i] - (want if asked.n[i] else 0)) < 1e-3


def test_term_counts():
    c = ql.term_counts(pa.array(["the cat the cat the", None, "#"]))
    whole = dense_terms(c)
    assert c.n.tolist() == [5, 0, 1]
    assert sorted(c.counts[: c.bounds[1]].tolist()) == [2, 3] and whole[1].sum() == 0
    assert whole[0, ql.SHAPES : ql.DENSE].tolist() == [0, 3, 3]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = ql.op9_neighbour_quality(spark, d).join(table(spark, d, "labels"), "doc_id").filter("held_out").collect()
    right = [(r["score"] >= 0.5) == (r["quality"] == 1) for r in got]
    clean = [r["predicted"] for r in got if r["quality"] == 1]
    junk = [r["predicted"] for r in got if r["quality"] == 0]
    print(len(got), np.mean(right), np.mean(clean), np.mean(junk))
    assert np.mean(right) > 0.97
    assert np.mean(clean) > 0.98
    assert np.mean(junk) < 0.1


def test_odd_rows(spark, sf_dir):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = ql.score_documents(odd_documents(spark), labels)
    assert got.count() == odd_documents(spark).count()
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    assert got.filter("trim(coalesce(text, '')) = ''").filter("score > 0").count() == 0
    assert ql.score_documents(odd_documents(spark), labels.limit(0)).filter("score > 0").count() == 0
    assert ql.score_documents(odd_documents(spark).limit(0), labels).count() == 0


def test_fit_leaves_the_driver_little(spark):
    """The driver gets the fitted parts, some 5 MB, and neither the labelled texts' term matrix nor what fitting takes."""
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    tracemalloc.start()
    try:
        v = ql.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert v.vectors.shape == (len(v.labels), 64) and v.axes.shape == (ql.TERMS, 64) and len(v.idf) == ql.TERMS and set(v.labels) == {0, 1}
    assert peak < 20e6
