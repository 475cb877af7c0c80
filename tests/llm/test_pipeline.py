import corpus_pipeline as cp
import sentencepiece

from strataweave.llm import pieces, quality
from strataweave.llm import private_data as pd
from strataweave.llm.common import table

from .odd import odd_documents
from .test_decontaminate import brute as tiled
from .test_decontaminate import words
from .test_near_duplicates import brute as components
from .test_private_data import all_spans

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_run_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    good = {r["doc_id"] for r in quality.op9_neighbour_quality(spark, sf_dir).collect() if r["predicted"] == 1}
    first = {c for _, _, c, _ in components([(i, docs[i]["text"]) for i in sorted(good)])}
    items = [w for r in table(spark, sf_dir, "benchmark").collect() if len(w := words(r["text"])) >= 5]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    leaks = set()
    for i in first:
        w = words(docs[i]["text"])
        own = grams(w)
        if any(own & grams(x) and tiled(x, w, 5) >= 0.6 * len(x) for x in items):
            leaks.add(i)
    got = {r["doc_id"]: r for r in cp.run(spark, sf_dir).collect()}
    assert got.keys() == first - leaks
    assert 0 < len(leaks) and len(first) < len(good) < len(docs)
    kept = sorted(got)
    trees = pd.fit(spark.createDataFrame([(i, docs[i]["text"]) for i in kept], "doc_id long, text string"))
    changed = 0
    for i in kept:
        want = redacted(docs[i]["text"], all_spans(docs[i]["text"], trees))
        changed += want != docs[i]["text"]
        assert got[i]["ids"] == LIB.encode(want) and got[i]["decoded"] == LIB.decode(got[i]["ids"])
        assert got[i]["n_chars"] == len(want)
    assert changed


def redacted(text, spans):
    """text with each stretch that spans (kind:start:end, by start) cover replaced by its first span's kind."""
    out, to = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",") if s):
        if int(a) >= to:
            out += [text[to : int(a)], f"[{kind.upper()}]"]
        to = max(to, int(b))
    return "".join(out) + text[to:]


def test_stages_bear_odd_rows(spark, sf_dir):
    docs = odd_documents(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert 0 <= out.count() <= docs.count()
        if name != "sentencepiece_codec":
            assert out.columns == docs.columns
