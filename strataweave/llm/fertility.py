"""Tokeniser fertility: how well public vocabularies fit a text, with rejection bands per language or script.

For each text and vocabulary: characters per token, the share of byte-fallback tokens (single bytes in place of a character
that the vocabulary lacks) and the entropy of its tokens. A band is an interval of a measure for a vocabulary, a language
and a length class; where a row has no language of the table, the bands of its script hold. Prose lies well inside its
bands; symbol soup, shouting, tables and repeated filler do not. A text is rejected if any vocabulary finds it outside.
Base rules go first: too few words, or more than half of the words inside repeated three-word windows.

Defined results: a null or empty text has zero counts and measures and fails the base rules; lines are cut at ``\\n`` and
count as repeats only if they hold a word; a very long text is measured whole, piece by piece; repeated rows are judged alike; a null or unknown language falls back to the
script; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import documents, slices, table

SYMBOLS = "#*$%&|<>"
BLANK = " \t\r\x0b\x0c"
MIN_WORDS, MAX_REPEAT = 50, 0.5

#: The vocabularies of the query by the name that their bands and columns go by.
VOCABULARIES = {"piece": "piece_bpe_32k.model", "byte": "byte_bpe_50k.tiktoken"}
#: Fixed values. Tokens from which a length class holds; then for each vocabulary and language or script, by class, the
#: least characters per token and the least token entropy in bits; then the most of either measure and of byte fallback.
CLASSES = (0, 120, 250, 600)
BANDS = {
    "piece": {
        "en": ((1.50, 2.10, 2.31, 2.42), (4.75, 5.60, 6.00, 6.38), 4.5, 0.10),
        "de": ((1.40, 2.30, 2.38, 2.45), (4.75, 5.60, 5.95, 6.22), 4.5, 0.10),
        "es": ((1.40, 2.02, 2.09, 2.18), (4.75, 5.55, 5.88, 6.22), 4.5, 0.10),
        "fr": ((1.40, 1.92, 2.01, 2.21), (4.75, 5.45, 5.92, 6.22), 4.5, 0.10),
        "latin": ((1.30, 1.50, 1.60, 1.70), (4.50, 5.00, 5.40, 5.80), 6.5, 0.25),
        "other": ((0.20, 0.25, 0.30, 0.30), (3.50, 4.00, 4.50, 4.80), 6.5, 0.95),
    },
    "byte": {
        "en": ((1.50, 2.20, 2.42, 2.50), (4.75, 5.60, 6.00, 6.40), 5.0, 0.10),
        "de": ((1.40, 2.10, 2.20, 2.24), (4.75, 5.60, 5.95, 6.25), 5.0, 0.20),
        "es": ((1.40, 1.85, 1.90, 1.95), (4.75, 5.55, 5.75, 6.10), 5.0, 0.25),
        "fr": ((1.40, 1.90, 1.97, 2.07), (4.75, 5.50, 5.90, 6.18), 5.0, 0.25),
        "latin": ((1.30, 1.50, 1.60, 1.70), (4.50, 5.00, 5.40, 5.80), 7.0, 0.40),
        "other": ((0.20, 0.25, 0.30, 0.30), (3.50, 4.00, 4.50, 4.80), 7.0, 0.98),
    },
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the words in three-word windows that it holds twice or more."""
    n_texts = len(bounds) - 1
    if len(hashes) < 3:
        return np.zeros(n_texts, np.int64)
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    windows = bytescan.shingles(hashes, 3)
    at = np.flatnonzero(text[:-2] == text[2:])
    # A window of one text is not that of another: its text's number goes into the key.
    key = bytescan.mix(windows[at] + bytescan.mix(text[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    window = np.zeros(len(hashes), bool)
    window[at[order[twice]]] = True
    covered = window.copy()
    covered[1:] |= window[:-1]
    covered[2:] |= window[:-2]
    return np.bincount(text[covered], minlength=n_texts)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    up = np.concatenate([[0], np.cumsum(flags)])
    return up[offsets[1:]] - up[offsets[:-1]]


def base_counts(texts: list[str]) -> dict[str, np.ndarray]:
    array = pa.array(texts, pa.large_string())
    data, offsets = bytescan.buffers(array)
    data, offsets = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    n_words, repeat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, hashes, bounds in bytescan.words(array):
        n_words.append(np.diff(bounds))
        repeat.append(repeated_words(hashes, bounds))
    lines = [[x for x in t.split("\n") if x.strip(BLANK)] if "\n" in t else [] for t in texts]
    return {
        "n_words": np.concatenate(n_words).astype(np.int64),
        "word_chars": _sums(~bytescan.SEPARATOR[data] & (data & 0xC0 != 0x80), offsets).astype(np.int64),
        "n_symbols": _sums(_SYMBOL[data], offsets).astype(np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": np.concatenate(repeat).astype(np.int64),
    }


def script(text: str) -> str:
    """latin where most letters of the text are."""
    letters = re.findall(r"[^\W\d_]", text)
    return "latin" if 2 * sum(c < "ɐ" for c in letters) >= len(letters) else "other"


class Vocabulary:
    """ids of a text, and which ids are single bytes in place of a character."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.fallback = np.array([p.is_byte(i) and int(p.id_to_piece(i)[3:5], 16) not in b" \t\n\r\x0b\x0c" for i in range(p.vocab_size())])
            self.ids: Callable[[str], list[int]] = lambda t: p.encode(t, num_threads=1)
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fallback = np.zeros(max(ranks.values()) + 1, bool)
            self.fallback[[i for b, i in ranks.items() if len(b) == 1 and b[0] > 127]] = True
            self.ids = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            self.fallback = np.zeros(t.get_vocab_size(), bool)
            self.ids = lambda text: t.encode(text, add_special_tokens=False).ids

    def measures(self, texts: list[str]) -> dict[str, np.ndarray]:
        n, share, entropy = (np.zeros(len(texts)) for _ in range(3))
        for k, text in enumerate(texts):
            ids = np.array(self.ids(text), np.int64)
            if len(ids):
                n[k], share[k] = len(ids), self.fallback[ids].mean()
                counts = np.bincount(ids) if len(ids) > 8000 else np.unique(ids, return_counts=True)[1]
                p = counts[counts > 0] / len(ids)
                entropy[k] = -(p * np.log2(p)).sum()
        chars = np.array([len(t) for t in texts], float)
        return {"n_tokens": n.astype(np.int64), "chars_per_token": np.divide(chars, n, out=np.zeros_like(n), where=n > 0), "fallback_share": share, "token_entropy": entropy}


_state: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _state:
        _state[path] = Vocabulary(path)
    return _state[path]


def outside(texts: list[str], langs: list[str | None], f: dict[str, np.ndarray], bands: dict) -> np.ndarray:
    """Whether a measure of the text lies outside its band; a text without tokens has no measure to be outside."""
    out = np.zeros(len(texts), bool)
    for k, n in enumerate(f["n_tokens"].tolist()):
        if n:
            kind = sum(n >= c for c in CLASSES) - 1
            band = bands[langs[k] if langs[k] in bands else script(texts[k])]
            cpt = f["chars_per_token"][k]
            out[k] = cpt < band[0][kind] or cpt > band[2] or f["token_entropy"][k] < band[1][kind] or f["fallback_share"][k] > band[3]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("n_tokens", "chars_per_token", "fallback_share", "token_entropy")


def _columns(names: list[str]) -> list[tuple[str, str]]:
    of = [(f"{v}_{m}", "long" if m == "n_tokens" else "double") for v in names for m in MEASURES]
    return [("doc_id", "long"), *((c, "long") for c in COUNTS), *of, ("in_bands", "boolean")]


def _rows(batches: Iterator[pa.RecordBatch], paths: dict[str, str], bands: dict) -> Iterator[pa.RecordBatch]:
    names = [c for c, _ in _columns(list(paths))]
    for batch in batches:
        texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for a, b in slices(texts):
            counts, bad, measured = base_counts(texts[a:b]), np.zeros(b - a, bool), []
            for name, path in paths.items():
                f = vocabulary(path).measures(texts[a:b])
                bad |= outside(texts[a:b], langs[a:b], f, bands[name])
                measured.extend(pa.array(f[m]) for m in MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(counts[c]) for c in COUNTS), *measured, pa.array(~bad)], names)


def fertility_rules(docs: DataFrame, vocabularies: dict[str, str] | None = None, bands: dict = BANDS) -> DataFrame:
    """doc_id, text, lang -> counts, measures of each vocabulary, base_failed, kept. vocabularies: name in ``bands`` -> file."""
    if vocabularies is None:
        import public_tokenizers

        vocabularies = {name: public_tokenizers.path(file) for name, file in VOCABULARIES.items()}
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    schema = ", ".join(f"{c} {t}" for c, t in _columns(list(vocabularies)))
    out = documents(docs, lang.alias("lang")).mapInArrow(lambda it: _rows(it, vocabularies, bands), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("in_bands"))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", *(F.round(c, 6).alias(c) if t == "double" else c for c, t in _columns(list(VOCABULARIES)) if c.endswith(MEASURES)))
