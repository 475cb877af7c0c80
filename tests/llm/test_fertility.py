import math
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataweave.llm import fertility as fe
from strataweave.llm.pieces import default_model

from .odd import odd_documents, odd_rows



def byte_of(char):
    """The byte that a one-character name of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return ord(char) if ord(char) in printable else others[ord(char) - 256]


LIB = sentencepiece.SentencePieceProcessor(model_file=default_model())
FALLBACK = {i for i in range(LIB.vocab_size()) if LIB.is_byte(i) and chr(int(LIB.id_to_piece(i)[3:5], 16)) not in " \t\n\r\x0b\x0c"}
# The same byte vocabulary in another library's form: the first 256 ids are bytes, those beyond ASCII written as code points from 161.
ENC = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENC.encode_special_tokens = True
LONE = {i for name, i in ENC.get_vocab().items() if len(name) == 1 and byte_of(name) > 127}


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(deadline=None)
@given(st.lists(st.text(alphabet="ab \n#|\t", max_size=60), max_size=6))
def test_base_counts(texts):
    got = fe.base_counts(texts)
    assert [tuple(int(got[c][i]) for c in fe.COUNTS) for i in range(len(texts))] == [brute(t) for t in texts]


def measured(text):
    """For each vocabulary: tokens, characters per token, fallback share, entropy."""
    out = []
    for ids, lone in ((LIB.encode(text), FALLBACK), (ENC.encode(text, add_special_tokens=False).ids, LONE)):
        p = [c / len(ids) for c in Counter(ids).values()]
        n = len(ids)
        out.append((n, len(text) / n if n else 0, sum(i in lone for i in ids) / n if n else 0, -sum(x * math.log2(x) for x in p)))
    return out


def verdict(text, lang):
    for name, (n, cpt, share, entropy) in zip(("piece", "byte"), measured(text), strict=True):
        if n:
            low, least, most, fallback = fe.BANDS[name][lang if lang in fe.BANDS[name] else fe.script(text)]
            kind = max(k for k, c in enumerate(fe.CLASSES) if n >= c)
            if not (low[kind] <= cpt <= most and entropy >= least[kind] and share <= fallback):
                return False
    return True


def check(rows, texts, langs):
    for r, t, lang in zip(sorted(rows, key=lambda r: (r["doc_id"], r["n_words"])), texts, langs, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and verdict(t, lang))
        for name, (n, cpt, share, entropy) in zip(("piece", "byte"), measured(t), strict=True):
            assert r[f"{name}_n_tokens"] == n
            for m, want in (("chars_per_token", cpt), ("fallback_share", share), ("token_entropy", entropy)):
                assert math.isclose(r[f"{name}_{m}"], want, abs_tol=1e-5), (m, t[:50])


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    check(fe.op2_tokeniser_fertility(spark, sf_dir).collect(), [r["text"] for r in docs], [r["lang"] for r in docs])


def test_odd_rows(spark):
    rows = sorted(((r[0], r[1] or "", r[2]) for r in odd_rows()), key=lambda x: (x[0], brute(x[1])[0]))
    check(fe.fertility_rules(odd_documents(spark)).collect(), [t for _, t, _ in rows], [x for *_, x in rows])
    assert fe.fertility_rules(odd_documents(spark).limit(0)).count() == 0


def test_bands_keep_prose_and_reject_junk(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = fe.fertility_rules(d).join(d.select("doc_id", "quality"), "doc_id").filter("n_words >= 50").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.15 * len(bad)
