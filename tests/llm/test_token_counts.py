from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from strataweave.llm import token_counts as tc
from strataweave.llm.pieces import default_model

from .odd import odd_documents, odd_rows

PATH = default_model()


def library():
    t = Tokenizer(models.Unigram(tc.vocabulary(PATH), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.SPACE, prepend_scheme="always", split=True)
    return t


LIB = library()


def want(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" ▁ab\nthe.é漢'<0x>A", max_size=80))
def test_counts_equal_the_library(text):
    assert tc.count_texts([text], PATH)[0] & tc.MASK == want(text)


def test_ties_go_to_the_earliest_start():
    c = tc.Counter(PATH)
    c.matches.clear()
    for p, s in [("a", 4), ("b", 1), ("c", 2), ("ab", 3), ("bc", 1)]:  # ab|c and a|bc both cost 5
        c.matches.add_word(p, (len(p), s))
    c.matches.make_automaton()
    t = Tokenizer(models.Unigram([("<unk>", 0.0), ("a", -4.0), ("b", -1.0), ("c", -2.0), ("ab", -3.0), ("bc", -1.0)], unk_id=0))
    assert c.viterbi("abc") == (5 << tc.SHIFT) + 2
    assert len(t.encode("abc").ids) == 2


def test_query_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in tc.op6_viterbi_counts(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: want(r["text"]) for r in docs}
    got = tc.count_tokens(odd_documents(spark)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((r[0], want(r[1] or "")) for r in odd_rows())
    assert tc.count_tokens(odd_documents(spark).limit(0)).count() == 0
