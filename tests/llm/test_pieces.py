import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.llm import pieces

from .odd import odd_documents, odd_rows

PATH = pieces.default_model()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ours(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in pieces.encode_texts(texts, PATH)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet=" ▁ab\nthe.é漢'", max_size=80), max_size=8))
def test_encoding_equals_the_library(texts):
    assert ours(texts) == LIB.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, LIB.vocab_size() - 1), max_size=30))
def test_decoding_equals_the_library(ids):
    assert pieces.model_at(PATH).decode(ids) == LIB.decode(ids)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 500, "the" * 500, "x " * 5000, "abc.def-" * 300 + "\n" * 40, "naïve \U0001f600" * 20])
def test_long_units(text):
    assert ours([text]) == [LIB.encode(text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aeinst", min_size=1, max_size=400) | st.text(alphabet="0123456789abcdef", min_size=1, max_size=300), max_size=4))
def test_rounds_of_long_units_equal_the_library(units):
    assert ours(units) == LIB.encode(units)


def test_very_long_units_take_few_rounds():
    rng = np.random.default_rng(1)
    texts = [" " * n + w for n in (1, 15, 31, 47, 63, 64, 65, 79, 80, 81, 100, 333) for w in ("", "the", "漢", "\n", "x" * 40)]
    texts += ["a" * 200_000, "ab" * 100_000, "".join(rng.choice(list("0123456789abcdef"), 30_000)), " " * 100_000]
    assert ours(texts) == LIB.encode(texts)


def test_query_and_odd_rows(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = lambda i, t: (i, len(x := LIB.encode(t)), sha(",".join(map(str, x))), sha(LIB.decode(x)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(map(tuple, pieces.op7_piece_codec(spark, sf_dir).collect())) == sorted(want(r["doc_id"], r["text"]) for r in docs)
    rows = odd_rows()
    got = pieces.digest(pieces.encode_documents(odd_documents(spark)))
    assert sorted(map(tuple, got.collect())) == sorted(want(r[0], r[1] or "") for r in rows)
    back = pieces.decode_documents(pieces.encode_documents(odd_documents(spark))).collect()
    assert {r["decoded"] for r in back} == {(r[1] or "").replace("▁", " ") for r in rows}
    assert pieces.encode_documents(odd_documents(spark).limit(0)).count() == 0
