"""Count-only Viterbi: how many tokens a unigram tokenizer makes of a text, without making them.

The vocabulary's pieces stand in one Aho-Corasick automaton. It reports every piece that ends at a character, longest
first, and dynamic programming carries, for each position, the best score and the piece count of the path that has it.
Ties follow the tokenizers library's unigram model: of equal scores the earliest start wins; a character without a
piece of its own scores 10 below the worst piece and counts its UTF-8 bytes. Each space starts a new unit (the
tokenizer's Metaspace step) and no piece holds a line break, so a text's count is the sum over its units; a worker keeps
a bounded table of units it has met.

The public vocabulary here (``piece_bpe_32k.model``) brings its own piece scores, whole numbers, so sums are exact.

Defined results: a null or empty text has no tokens; repeated rows count alike; a unit of any length is one linear
pass; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, table

SPACE = "▁"
UNK_PENALTY = 10
KNOWN_UNITS = 500_000
LONG_UNIT = 64
SHIFT = 32
MASK = (1 << SHIFT) - 1
UNITS = re.compile(r" [^ \n]*|[^ \n]+|\n").findall


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores in id order."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.vocab_size())]


class Counter(dict):
    """unit -> (-score << 32) + count."""

    def __init__(self, path: str):
        import ahocorasick

        pieces = vocabulary(path)
        if any(s != int(s) or s > 0 for _, s in pieces):
            raise ValueError("scores have to be whole numbers of at most 0")
        if any("\n" in p for p, _ in pieces):
            raise ValueError("a piece holds a line break")
        self.matches = ahocorasick.Automaton()
        for p, s in pieces:
            self.matches.add_word(p, (len(p), -int(s)))
        self.matches.make_automaton()
        self.unknown = max(-int(s) for _, s in pieces) + UNK_PENALTY

    def viterbi(self, unit: str) -> int:
        """Costs are negated scores: lower is better."""
        n = len(unit)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.matches.iter(unit):
            ending[end].append(match)
        cost, count = [0] * (n + 1), [0] * (n + 1)
        for e in range(n):
            best, pieces, single = -1, 0, False
            for length, c in ending[e]:  # longest first, so the earliest start is kept among equals
                at = e + 1 - length
                if best < 0 or cost[at] + c < best:
                    best, pieces = cost[at] + c, count[at] + 1
                single = single or length == 1
            if not single and (best < 0 or cost[e] + self.unknown < best):
                best, pieces = cost[e] + self.unknown, count[e] + len(unit[e].encode("utf-8", "surrogatepass"))
            cost[e + 1], count[e + 1] = best, pieces
        return (cost[n] << SHIFT) + count[n]

    def __missing__(self, unit: str) -> int:
        value = self.viterbi(unit.replace(" ", SPACE))
        if len(unit) <= LONG_UNIT:
            self[unit] = value
        return value


_state: dict = {}


def count_texts(texts: list[str], path: str) -> list[int]:
    """(-score << 32) + count of each text."""
    if _state.get("path") != path:
        _state.update(path=path, units=Counter(path))
    units, out = _state["units"], []
    for t in texts:
        if len(units) > KNOWN_UNITS:
            units.clear()
        t = t.replace(SPACE, " ")
        out.append(sum(map(units.__getitem__, UNITS(t if t[:1] == " " else " " + t))) if t else 0)
    return out


def _rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = count_texts(batch.column(1).to_pylist(), path)
        counts, scores = pa.array([v & MASK for v in values], pa.int64()), pa.array([float(-(v >> SHIFT)) for v in values])
        yield pa.RecordBatch.from_arrays([batch.column(0), counts, scores], ["doc_id", "n_tokens", "score"])


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, score (of the best path)."""
    from .pieces import default_model

    model = model or default_model()
    return documents(docs).mapInArrow(lambda it: _rows(it, model), "doc_id long, n_tokens long, score double")


def op6_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
