"""Rows that every operator of the subpackage has to bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score double"


def odd_rows() -> list[tuple]:
    texts = [
        None, "", " ", "\n\n", "one", "a b c d", "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.",
        "é ñ 漢字 \U0001f600 ▁ x", "word " * 20_000, "x" * 5_000, " " * 3_000, "7" * 3_000, "mail a.b@c.example or 10.0.0.1, +1 (234) 555-0000, 4111 1111 1111 1111",
        "tab\tand\rreturn\x0bvertical\x0cfeed\x00nul", "<|endoftext|> <s> </s> <0x0A>",
    ]
    rows = [(i, t, None if i % 3 else "en", None, None, 1, "s", None) for i, t in enumerate(texts)]
    return rows + [(3, "\n\n", "en", None, None, 1, "s", None), (6, "another text under an id seen before", None, None, None, None, None, None)]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)
