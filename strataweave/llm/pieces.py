"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by table.

Encoding. No piece has a space mark after another character, and a character that stands in no longer piece never
merges; a text therefore falls into units (spaces and the word after them) whose ids do not depend on one another.
The unknown units of a slice become one flat numpy array of symbols. In each round every pair of neighbours has the
score rank of the piece it would make, and a segmented minimum finds each unit's best rank. All pairs of that rank merge
at once, from the left and without overlap, up to the first whose merging makes a pair of as good a rank with a neighbour;
what lies to the right of that one waits for the next round. Then the arrays are compacted; finished units leave. So a
round does for each unit exactly what the library's queue does next, ties included, and a unit of any length takes
about as many rounds as ranks occur in it.

Each worker keeps a bounded table of units it has met. Decoding joins the pieces' bytes; bytes that are not UTF-8 are
replaced one by one, as the library does.

Defined results: a null or empty text has no ids and decodes to an empty text; characters outside the vocabulary
become UTF-8 byte pieces; the space mark U+2581 in a text is a space; repeated rows are encoded alike; an empty table
gives an empty result. ``encode_documents`` leaves other columns out; ``encode_columns`` carries them along, but columns
named ``ids`` or ``decoded`` give way to those made here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, slices, table

SPACE = "▁"
#: Units longer than this are not kept in the table of known ones.
LONG_UNIT = 200
#: Characters of unknown units that merge together; bounds what the rounds hold.
ROUND_CHARS = 2_000_000
KNOWN_UNITS = 300_000
FAR = np.int64(1) << 62


class PieceModel:
    """The tables of a BPE model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = p.vocab_size()
        names = [p.id_to_piece(i) for i in range(self.size)]
        self.unk = p.unk_id()
        self.control = {i for i in range(self.size) if p.is_control(i)}
        self.byte_of = {i: int(names[i][3:5], 16) for i in range(self.size) if p.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        plain = {n: i for i, n in enumerate(names) if i not in self.control and i not in self.byte_of and i != self.unk and not p.is_unused(i)}
        if any(SPACE in n.lstrip(SPACE) for n in plain):
            raise ValueError("a piece has a space mark after another character")
        scores = sorted({p.get_score(i) for i in plain.values()}, reverse=True)
        rank_of_score = {s: r for r, s in enumerate(scores)}
        self.plain = plain
        self.rank = {n: rank_of_score[p.get_score(i)] for n, i in plain.items()}
        joined = [n for n in plain if len(n) > 1]
        self.chars_in_pieces = {c for n in joined for c in n}
        #: Symbols: ids of pieces, then characters of pieces that are no piece themselves.
        self.symbol = dict(plain)
        for c in sorted(self.chars_in_pieces - plain.keys()):
            self.symbol[c] = self.size + len(self.symbol) - len(plain)
        self.name_of = {i: n for n, i in self.symbol.items()}
        self.n_symbols = max(self.symbol.values()) + 1
        pairs = {}
        for n in joined:
            for k in range(1, len(n)):
                if n[:k] in self.symbol and n[k:] in self.symbol:
                    pairs[self.symbol[n[:k]] << 20 | self.symbol[n[k:]]] = plain[n]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.rank_by_id = np.zeros(self.size, np.int64)
        for n, i in plain.items():
            self.rank_by_id[i] = self.rank[n]
        lone = "".join(map(re.escape, sorted({"\n", "\t", "\r"} - self.chars_in_pieces)))
        self.units = re.compile(rf" *[^ {lone}]+|[{lone}]| +") if lone else re.compile(r" *[^ ]+| +")
        #: code point -> symbol; beyond the table or -1: a character that never merges.
        top = max(map(ord, self.chars_in_pieces | {n for n in plain if len(n) == 1}), default=0)
        self.symbol_of_char = np.full(top + 2, -1, np.int64)
        for n, i in self.symbol.items():
            if len(n) == 1:
                self.symbol_of_char[ord(n)] = i
        self.decoded = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.decoded[self.unk] = " ⁇ ".encode()
        self.wide, self.wide_id = self.widest_blank()

    def widest_blank(self) -> tuple[int, int]:
        """(width, id) of the piece that a long run of spaces begins with over and over; width 0 if it does not."""
        width = max((len(n) for n in self.plain if not n.strip(SPACE)), default=0)
        made = self.plain.get(SPACE * width, -1)
        if width < 2 or (self.pair_keys >> 20 == made).any():  # it would merge on
            return 0, -1
        for rest in range(width):
            sym, _ = self.merge_rounds([SPACE * (3 * width + rest)])
            if sym[:3].tolist() != [made] * 3:
                return 0, -1
        return width, made

    def spell(self, name: str) -> list[int]:
        """Ids of what is no piece: its UTF-8 bytes."""
        return [self.id_of_byte[b] for b in name.encode("utf-8", "surrogatepass")]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; FAR where it makes none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        piece = np.where(hit, self.pair_piece[at], 0)
        return np.where(hit, self.rank_by_id[piece], FAR), piece

    def mergeable(self, hits: np.ndarray, sym: np.ndarray, unit: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Those of ``hits`` (places of their units' best pairs) that merge in one round with the queue's result."""
        fresh = np.concatenate([[True], np.diff(hits) > 1])  # in a run of touching pairs every other one, from the left
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
        at = hits[(np.arange(len(hits)) - begin) % 2 == 0]
        # Pairs beside a merged one as they are just after it: what is left of it has merged, what is right has not.
        left = np.where(np.concatenate([[False], at[1:] == at[:-1] + 2]), np.concatenate([[0], made[at[:-1]]]), sym[np.maximum(at - 1, 0)])
        after, n = np.minimum(at + 2, len(sym) - 1), len(sym)
        before_rank, after_rank = self.pair_ranks(left, made[at])[0], self.pair_ranks(made[at], sym[after])[0]
        before_rank[(at == 0) | (unit[np.maximum(at - 1, 0)] != unit[at])] = FAR
        after_rank[(at + 2 >= n) | (unit[after] != unit[at])] = FAR
        early = (np.minimum(before_rank, after_rank) <= rank[at]).astype(np.int64)
        first = np.concatenate([[True], unit[at][1:] != unit[at][:-1]])
        passed = np.cumsum(early) - early
        return at[passed == passed[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]

    def merge_rounds(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units (spaces already marked) and where each unit's begin and the last one's end."""
        lengths = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.symbol_of_char[np.minimum(points, len(self.symbol_of_char) - 1)]
        sym = np.where(sym < 0, -1 - points, sym)  # negative: a character by itself
        unit = np.repeat(np.arange(len(units)), lengths)
        rank, made = np.full(len(sym), FAR), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self.pair_ranks(sym[:-1], sym[1:])
            rank[:-1][unit[:-1] != unit[1:]] = FAR
        done_unit, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.concatenate([first, [len(sym)]]))
            open_ = np.repeat(best < FAR, count)
            if not open_.all():
                done_unit.append(unit[~open_])
                done_sym.append(sym[~open_])
                sym, unit, rank, made = sym[open_], unit[open_], rank[open_], made[open_]
                if not len(sym):
                    break
                keep = best < FAR
                best, count = best[keep], count[keep]
            at = self.mergeable(np.flatnonzero(rank == np.repeat(best, count)), sym, unit, rank, made)
            sym[at] = made[at]
            rest = np.ones(len(sym), bool)
            rest[at + 1] = False
            at = at - np.arange(len(at))  # where they stand after compaction: one symbol went for each merge before
            sym, unit, rank, made = sym[rest], unit[rest], rank[rest], made[rest]
            for i in (at, at[at > 0] - 1):  # only pairs beside a merge change
                if len(i):
                    j = np.minimum(i + 1, len(sym) - 1)
                    r, m = self.pair_ranks(sym[i], sym[j])
                    r[(unit[i] != unit[j]) | (i == j)] = FAR
                    rank[i], made[i] = r, m
        unit, sym = np.concatenate(done_unit or [np.zeros(0, np.int64)]), np.concatenate(done_sym or [np.zeros(0, np.int64)])
        order = np.argsort(unit, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(units)))])

    def ids_of_units(self, units: list[str]) -> dict[str, bytes]:
        """unit (with plain spaces) -> little-endian 32-bit ids."""
        # Equal ranks make spaces merge one by one from the left; what a long run begins with is known, the rest merges.
        blanks = [len(u) - len(u.lstrip(" ")) for u in units]
        whole = [max(0, n // self.wide - 3) if self.wide else 0 for n in blanks]
        sym, bounds = self.merge_rounds([u[k * self.wide :].replace(" ", SPACE) for u, k in zip(units, whole, strict=True)])
        raw, at = sym.astype("<i4").tobytes(), (4 * bounds).tolist()
        head = np.array([self.wide_id], "<i4").tobytes()
        out = {u: head * k + raw[a:b] for u, k, a, b in zip(units, whole, at[:-1], at[1:], strict=True)}
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))  # symbols that are no piece
        for k in np.unique(np.searchsorted(bounds, odd, side="right") - 1).tolist():
            ids: list[int] = []
            for s in sym[bounds[k] : bounds[k + 1]].tolist():
                ids.extend(self.spell(chr(-1 - s)) if s < 0 else self.spell(self.name_of[s]) if s >= self.size else [s])
            out[units[k]] = head * whole[k] + np.array(ids, "<i4").tobytes()
        return out

    def decode(self, ids: list[int]) -> str:
        parts = list(map(self.decoded.__getitem__, ids))
        for k, i in enumerate(ids):  # the first piece that says something loses the space put before every text
            if i not in self.control:
                if i not in self.byte_of and i != self.unk and parts[k].startswith(b" "):
                    parts[k] = parts[k][1:]
                break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return replaced(b"".join(parts))


def replaced(raw: bytes) -> str:
    """UTF-8 with each byte that belongs to no character replaced by itself."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_state: dict = {}


def model_at(path: str) -> PieceModel:
    if _state.get("path") != path:
        _state.update(path=path, model=PieceModel(path), units={})
    return _state["model"]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    model = model_at(path)
    known = _state["units"]
    out: list[bytes] = []
    for a, b in slices(texts):
        split = [model.units.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts[a:b]]
        if len(known) > KNOWN_UNITS:
            known.clear()
        new = list({u for us in split for u in us if u not in known})
        for i, j in slices(new, ROUND_CHARS):
            known.update(model.ids_of_units(new[i:j]))
        out.extend(b"".join(map(known.__getitem__, us)) for us in split)
        for u in new:
            if len(u) > LONG_UNIT:
                del known[u]
    return out


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """text first -> all columns, ids, decoded."""
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for a, b in slices(texts):
            raw = encode_texts(texts[a:b], path)
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
            flat = np.frombuffer(b"".join(raw), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            decode = model_at(path).decode
            decoded = pa.array([decode(np.frombuffer(x, "<i4").tolist()) for x in raw], pa.string())
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), ids, decoded], [*batch.schema.names, "ids", "decoded"])


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, ids (array<int>), decoded."""
    model = model or default_model()
    rows = documents(docs).select("text", "doc_id")
    return rows.mapInArrow(lambda it: released(_encode(it, model)), "text string, doc_id long, ids array<int>, decoded string").select("doc_id", "ids", "decoded")


def encode_columns(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with ids and decoded in place of text; columns of these names give way."""
    model = model or default_model()
    own = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    rows = docs.select("text", *own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", ids array<int>, decoded string"
    return rows.mapInArrow(lambda it: released(_encode(it, model)), schema).drop("text")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [model_at(path).decode(x) if x else "" for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["doc_id", "decoded"])


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, decoded."""
    model = model or default_model()
    return encoded.select("ids", "doc_id").mapInArrow(lambda it: _decode(it, model), "doc_id long, decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_documents(table(spark, sf_dir, "documents")))
