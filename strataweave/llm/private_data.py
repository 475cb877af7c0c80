"""Personal data: high-recall generators propose spans, boosted trees with calibrated thresholds select redactions.

Four strict kinds (email, ip, card, phone) are found by pattern and check and always stay. Five wide generators propose
more, and their proposals may overlap: for ``secret`` long runs of key characters, long hexadecimal runs, and values
assigned to a credential's name; for ``local_phone`` numbers grouped three-three-four and digit groups of any other cut. A
proposal is described by its format (length, share of digits, case, hexadecimal, separators) and context (quotes,
assignment), all small whole numbers. Boosted trees learn which proposals look like known cases: secrets after a
credential's name (assigned values: those that mix letters and digits or are long), local phones inside a strict phone. All proposals of
the corpus count; Spark sums them by feature tuple and fold (some tens of thousands of tuples at most, whatever the corpus).
Trees are fitted on the driver to the sums of one fold and to a fixed prior of weak beliefs, so that a small corpus
is judged as well; each generator's threshold is calibrated on the other fold and the prior: the least score from which
the isotonic fit of the known share on the score reaches ``precision``. A fold is taken from a hash of the proposed text, so that
copies never stand on both sides. The trees go back into the plan as CASE expressions.

Of chosen proposals that overlap, the better scored stands: going by start, the one that stands gives way to a later one
of a higher score, or of the same score and greater length. Proposals that touch a strict span give way to it.

Only DataFrame functions run. Texts are scanned once: spans are kept in the shared folder, fitted to and chosen from there.
Positions come from the pieces between matches, in code points, end exclusive. Patterns are possessive and anchored to the
start of a run, so a text of any length is scanned in linear time.

Defined results: a null or empty text has no spans; matches that fail their check are dropped without another try;
repeated rows are treated alike; an empty table gives an empty result; ``redact`` carries all columns along, whatever their
names, and leaves a null text null.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, new_folder, quoted, table

KINDS = ("email", "ip", "card", "phone", "secret", "local_phone")
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What assigns a value to a credential's name; the value follows.
NAMED = r"(?i)(?<![A-Za-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?)[\"'`]?\x20{0,3}[:=]{1,2}\x20{0,3}[\"'`]?"
#: Wide generators in the order of ``f_gen``: the kind they propose and their pattern.
WIDE = {
    "key_run": ("secret", r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+={0,2}"),
    "hex_run": ("secret", r"(?:\G|(?<![0-9A-Fa-f]))[0-9A-Fa-f]{24,}+"),
    "assigned": ("secret", NAMED + r"[^\s\"'`,;<>(){}\[\]]{6,}+"),
    "grouped": ("local_phone", r"(?:\G|(?<![0-9]))\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    "digit_groups": ("local_phone", r"(?:\G|(?<![0-9]))[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){2,4}+(?![0-9])"),
}
#: What a text must hold to hold a match at all; saves most texts the scan.
DIGIT = "[0-9]"
NEEDS = {"email": "@", "phone": r"\+", "assigned": "[:=]"}
KNOWN_SECRET = r"(?i)(token|secret|passw|pwd|api|key|auth|bearer)[^A-Za-z0-9]{0,8}$"
FEATURES = ("f_gen", "f_len", "f_digit", "f_case", "f_hex", "f_sep", "f_quote", "f_assign")
#: Code points around a proposal that its context features see.
BEFORE, AFTER = 32, 2

SPAN = "struct<k: int, g: int, s: bigint, e: bigint, m: string, before: string, after: string>"


def _none(of: str) -> Column:
    return F.expr(f"cast(array() as array<{of}>)")


def located(text: Column, name: str) -> Column:
    """array<SPAN> of the matches of a strict kind or a generator, in order."""
    wide = name in WIDE
    kind, pattern = WIDE[name] if wide else (name, STRICT[name])
    gen = list(WIDE).index(name) if wide else -1
    pattern = F.lit(pattern)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("i"), _none(SPAN).alias("out"))

    def walk(pieces: Column) -> Column:
        """pieces: the matches and the gaps around them."""

        def step(acc: Column, m: Column) -> Column:
            gap, after = F.get(pieces["gaps"], acc["i"]), F.get(pieces["gaps"], acc["i"] + 1)
            s = acc["at"] + F.length(gap)
            e = s + F.length(m)
            if name == "assigned":  # only the value is proposed
                lead = F.regexp_extract(m, NAMED, 0)
                s, before, m = s + F.length(lead), F.concat(gap, lead), F.substring(m, F.length(lead) + 1, F.length(m))
            else:
                before = gap
            span = F.struct(
                F.lit(KINDS.index(kind)).alias("k"), F.lit(gen).alias("g"), s.alias("s"), e.alias("e"), m.alias("m"),
                F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"),
            )
            return F.struct(e.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(pieces["matches"], start, step, lambda acc: acc["out"])

    # One-element arrays, so that the pieces are cut once and not again for each match.
    matches = F.filter(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), lambda m: F.size(m) > 0)
    pieces = F.transform(matches, lambda m: F.struct(m.alias("matches"), F.split(text, pattern, -1).alias("gaps")))
    return F.coalesce(F.get(F.transform(pieces, walk), F.lit(0)), _none(SPAN))


def _octet(p: Column) -> Column:
    short = F.ltrim(p, F.lit("0"))
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def strict_check(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\.", -1), _octet)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def has_letter_and_digit(x: Column) -> Column:
    return F.rlike(x["m"], F.lit("[0-9]")) & F.rlike(x["m"], F.lit("[A-Za-z]"))


def _before(a: Column, b: Column) -> Column:
    """Order by start, kind, generator."""
    return F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["g"] - b["g"])


def _sorted(spans: Column) -> Column:
    return F.when(F.size(spans) > 1, F.array_sort(spans, _before)).otherwise(spans)


def with_spans(rows: DataFrame, text: str = "text", strict: str = "strict", wide: str = "wide") -> DataFrame:
    """rows -> and the columns ``strict`` (checked spans) and ``wide`` (proposals), by start, kind and generator."""
    names = [*STRICT, *WIDE]
    held = fresh([*rows.columns, strict, wide], "digit", *names)
    digit, at = held[0], dict(zip(names, held[1:], strict=True))
    flagged = rows.select("*", F.rlike(F.col(text), F.lit(DIGIT)).alias(digit))
    needs = lambda k: F.rlike(F.col(text), F.lit(NEEDS[k])) if k in ("email", "assigned") else F.col(digit) & F.rlike(F.col(text), F.lit(NEEDS[k])) if k in NEEDS else F.col(digit)
    found = flagged.select("*", *(F.when(needs(k), located(F.col(text), k)).otherwise(_none(SPAN)).alias(at[k]) for k in names))
    strictly = lambda k: lambda x: strict_check(k, x["m"])
    kept = [F.filter(F.col(at[k]), strictly(k)) for k in STRICT]
    more = [F.filter(F.col(at[k]), has_letter_and_digit) if k in ("key_run", "hex_run") else F.col(at[k]) for k in WIDE]
    return found.select(*(quoted(c) for c in rows.columns), _sorted(F.concat(*kept)).alias(strict), _sorted(F.concat(*more)).alias(wide))


def features(x: Column) -> list[Column]:
    """Of a proposal, in the order of FEATURES; small whole numbers."""
    n, m = F.length(x["m"]), x["m"]
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    upper = F.length(F.regexp_replace(m, "[^A-Z]", ""))
    quote = F.rlike(x["before"], F.lit("[\"'`]$")) & F.rlike(x["after"], F.lit("^[\"'`]"))
    return [
        x["g"],
        F.when(n < 13, 0).when(n < 20, 1).when(n < 24, 2).when(n < 32, 3).when(n < 40, 4).when(n == 40, 5).when(n < 64, 6).otherwise(7),
        (5 * digits / n).cast("int"),
        F.when(upper == 0, 0).when(2 * upper < n, 1).otherwise(2),
        F.rlike(m, F.lit("^[0-9a-fA-F]+$")).cast("int"),
        F.rlike(m, F.lit("[^A-Za-z0-9]")).cast("int") + F.rlike(m, F.lit("\\(")).cast("int"),
        quote.cast("int"),
        F.rlike(x["before"], F.lit("[=:]\\s{0,3}[\"'`(]?$")).cast("int"),
    ]


def prior() -> list[tuple[tuple[int, ...], float, float]]:
    """Weak beliefs that hold before any corpus: (features, weight, weight of known cases).

    What is assigned is a secret if it is long or holds digits; so is a quoted run without separators that holds digits.
    Three-three-four numbers with a bracket or a separator are phones as often as not, other digit groups seldom.
    """
    names, out = list(WIDE), []
    for gen in (i for i, (kind, _) in enumerate(WIDE.values()) if kind == "secret"):
        for f in itertools.product(range(8), range(6), range(3), range(2), range(2), range(2), range(2)):
            length, digit, _, hexa, sep, quote, assign = f
            if (names[gen] == "key_run" and length < 2) or (names[gen] == "hex_run" and not (hexa and length > 2)) or (names[gen] == "assigned" and not assign):
                continue
            known = assign and (digit > 0 or length > 1) or quote and digit and not sep
            out.append(((gen, *f), 0.05, 0.05 * bool(known)))
    for gen in (i for i, (kind, _) in enumerate(WIDE.values()) if kind == "local_phone"):
        share = 0.5 if names[gen] == "grouped" else 0.05
        out.extend(((gen, length, digit, 0, 0, sep, 0, 0), 0.05, 0.05 * share) for length in (0, 1) for digit in range(3, 6) for sep in range(3))
    return out


def tallies(found: DataFrame) -> list[tuple[int, tuple[int, ...], int, int]]:
    """For each fold and feature tuple of all proposals: how many there are, how many are known cases."""
    inside = lambda x: F.exists(F.col("strict"), lambda y: (y["k"] == KINDS.index("phone")) & (y["s"] <= x["s"]) & (x["e"] <= y["e"]))
    known = lambda x: (
        F.when(x["k"] == KINDS.index("local_phone"), inside(x)).when(x["g"] == list(WIDE).index("assigned"), has_letter_and_digit(x) | (F.length(x["m"]) >= 20)).otherwise(F.rlike(x["before"], F.lit(KNOWN_SECRET)))
    )
    fold = lambda x: F.pmod(F.xxhash64(x["m"]), F.lit(2)).cast("int")
    described = F.transform("wide", lambda x: F.struct(fold(x).alias("fold"), *(f.alias(n) for n, f in zip(FEATURES, features(x), strict=True)), known(x).cast("int").alias("y")))
    each = found.filter(F.size("wide") > 0).select(F.explode(described).alias("c")).select("c.*")
    rows = each.groupBy("fold", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()  # bounded by the features' ranges
    return sorted((r["fold"], tuple(r[c] for c in FEATURES), r["n"], r["y"]) for r in rows)


def isotonic_cut(score: np.ndarray, n: np.ndarray, y: np.ndarray, share: float) -> float | None:
    """The least score from which the isotonic fit of y / n on the score is at least ``share``; None if it never is."""
    pools: list[list[float]] = []  # first score, weight, known weight; shares rise from pool to pool
    values, where = np.unique(score, return_inverse=True)
    for s, a, b in zip(values.tolist(), np.bincount(where, n).tolist(), np.bincount(where, y).tolist(), strict=True):
        pools.append([s, a, b])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    return next((s for s, a, b in pools if b >= share * a - 1e-9), None)


class Trees:
    """Boosted trees of depth two on weighted tuples (logistic loss), with a threshold for each generator.

    rows: (fold, features, weight, weight of known cases). Fold 0 and the prior are fitted to, fold 1 and the prior
    calibrated on.
    """

    def __init__(self, rows: list[tuple[int, tuple[int, ...], float, float]], rounds: int = 30, rate: float = 0.4, precision: float = 0.9):
        beliefs = prior()
        self.trees: list[tuple] = []
        x, n, y = self._arrays([r[1:] for r in rows if r[0] == 0] + beliefs)
        share = min(max(y.sum() / n.sum(), 1e-3), 1 - 1e-3)
        self.start = round(math.log(share / (1 - share)), 6)
        margin = np.full(len(x), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - n * p, np.maximum(n * p * (1 - p), 1e-9), 2, rate)
            self.trees.append(tree)
            margin += self._values(tree, x)
        self.thresholds = {}
        x, n, y = self._arrays([r[1:] for r in rows if r[0] == 1] + beliefs)
        margin = np.round(self.margins(x), 6)
        for gen in range(len(WIDE)):
            own = np.flatnonzero(x[:, 0] == gen)
            if (least := isotonic_cut(margin[own], n[own], y[own], precision)) is not None:
                self.thresholds[gen] = least

    @staticmethod
    def _arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([r[0] for r in rows], np.int64).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple:
        best, whole = None, g.sum() ** 2 / (h.sum() + 1)
        for f in range(len(FEATURES)) if depth else ():
            left_g, left_h = np.cumsum(np.bincount(x[:, f], g)), np.cumsum(np.bincount(x[:, f], h))
            gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - whole
            cut = int(np.argmax(gain[:-1])) if len(gain) > 1 else 0
            if len(gain) > 1 and gain[cut] > 1e-6 and (best is None or gain[cut] > best[0]):
                best = (gain[cut], f, cut)
        if best is None:
            return (round(float(rate * g.sum() / (h.sum() + 1)), 6),)
        _, f, cut = best
        low = x[:, f] <= cut
        return f, cut, self._grow(x[low], g[low], h[low], depth - 1, rate), self._grow(x[~low], g[~low], h[~low], depth - 1, rate)

    def _values(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] <= tree[1], self._values(tree[2], x), self._values(tree[3], x))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._values(t, x) for t in self.trees)

    def _column(self, tree: tuple, f: Column) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        return F.when(f[FEATURES[tree[0]]] <= tree[1], self._column(tree[2], f)).otherwise(self._column(tree[3], f))

    def score(self, f: Column) -> Column:
        """The margin of a proposal with features ``f`` (a struct), to six digits."""
        out = F.lit(self.start)
        for t in self.trees:
            out = out + self._column(t, f)
        return F.round(out, 6)

    def least(self, gen: Column) -> Column:
        """The threshold of a generator; null for one that has none."""
        out = F.lit(None).cast("double")
        for g, value in self.thresholds.items():
            out = F.when(gen == g, value - 1e-5).otherwise(out)
        return out


def choose(found: DataFrame, trees: Trees) -> DataFrame:
    """found with ``spans``: the strict spans and the selected proposals that touch none, by start and kind; ``wide`` goes."""
    clear = lambda x: ~F.exists(F.col("strict"), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    described = lambda x: F.struct(*(f.alias(n) for n, f in zip(FEATURES, features(x), strict=True)))
    # One-element arrays again: features are worked out once a proposal, not once a tree.
    score = lambda x: F.get(F.transform(F.array(described(x)), trees.score), F.lit(0))
    scored = F.transform(F.filter("wide", clear), lambda x: F.struct(x.alias("x"), score(x).alias("score")))
    picked = F.filter(scored, lambda c: c["score"] >= trees.least(c["x"]["g"]))
    kind = f"struct<x: {SPAN}, score: double>"
    start = F.struct(F.expr(f"cast(null as {kind})").alias("last"), _none(SPAN).alias("out"))
    done = lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]["x"])))

    def step(acc: Column, c: Column) -> Column:
        last, x = acc["last"], c["x"]
        longer = (c["score"] == last["score"]) & (x["e"] - x["s"] > last["x"]["e"] - last["x"]["s"])
        better = F.struct(c.alias("last"), acc["out"].alias("out"))
        return F.when(last.isNull() | (x["s"] >= last["x"]["e"]), F.struct(c.alias("last"), done(acc).alias("out"))).when((c["score"] > last["score"]) | longer, better).otherwise(acc)

    added = F.when(F.size("wide") > 0, F.aggregate(picked, start, step, done)).otherwise(_none(SPAN))
    return found.withColumn("spans", _sorted(F.concat("strict", added))).drop("wide")


def _kept(found: DataFrame) -> DataFrame:
    """``found`` written to the shared folder, so that texts are scanned once."""
    spark = found.sparkSession
    path = new_folder(spark, "spans")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def fit(docs: DataFrame) -> Trees:
    """Trees from all proposals in ``docs``."""
    return Trees(tallies(with_spans(documents(docs))))


def find_private(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, text -> doc_id, strict, spans (arrays of SPAN; k numbers KINDS, g the generators, -1 a strict span)."""
    found = _kept(with_spans(documents(docs)).select("doc_id", "strict", "wide"))
    return choose(found, trees or Trees(tallies(found)))


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    of = lambda i: lambda x: x["k"] == i
    counts = [F.size(F.filter("strict" if k in STRICT else "spans", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("strict")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_private(table(spark, sf_dir, "documents")))


def redacted(text: Column, spans: Column) -> Column:
    """text with each stretch that spans cover replaced by its first span's kind in brackets."""
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["to"] + 1).cast("int"), (x["s"] - acc["to"]).cast("int"))
        new = F.struct(x["e"].alias("to"), F.concat(acc["out"], gap, F.get(name, x["k"])).alias("out"))
        return F.when(x["s"] >= acc["to"], new).otherwise(F.struct(F.greatest(acc["to"], x["e"]).alias("to"), acc["out"].alias("out")))

    done = lambda acc: F.concat(acc["out"], F.substring(text, (acc["to"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with private data in text replaced; n_chars, where there is one, follows. A null text stays null."""
    # Columns by number from here on, so that no name of theirs can clash with ours.
    own = [f"c{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index("text")]
    rows = docs.toDF(*own).select("*", F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = _kept(with_spans(rows, "body"))
    chosen = choose(found, Trees(tallies(found)))
    new = {text: F.when(F.col(text).isNotNull(), redacted(F.col("body"), F.col("spans")))}
    if "n_chars" in docs.columns:
        n = own[docs.columns.index("n_chars")]
        new[n] = F.when(F.size("spans") > 0, F.length(new[text]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n))
    return chosen.select(*(new.get(c, F.col(c)).alias(name) for c, name in zip(own, docs.columns, strict=True)))
