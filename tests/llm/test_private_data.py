import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.llm import private_data as pd
from strataweave.llm.common import table

from .odd import odd_documents, odd_rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def check(rows, texts):
    for r, t in zip(rows, texts, strict=True):
        want = base(t)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t[:200], want, r["spans"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in PLAIN] == want
        keys = [(int(s.split(":")[1]), pd.KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys)


def test_query_and_proposals(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").collect()}
    rows = pd.op5_private_data(spark, d).collect()
    check(rows, [texts[r["doc_id"]] for r in rows])
    # The secrets of the corpus stand after a word that says so; all of them are added, and nothing else is.
    added = [(r["doc_id"], s) for r in rows for s in r["spans"].split(",") if s.startswith("secret")]
    assert added
    for i, s in added:
        a, b = map(int, s.split(":")[1:])
        assert re.search(r"[0-9]", texts[i][a:b]) and len(texts[i][a:b]) >= 20


def test_strict_kinds_on_made_up_texts(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "1.2.3.4.5.6", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+", "+1 (234) 555-0000", "é", " ", "x", "12", "-", "(", "a_b@c.d_e@f.g", "00001.2.3.4", "\n", "0" * 13]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pd.digest(pd.find_private(df)).orderBy("doc_id").collect(), texts)


def test_odd_rows_and_long_runs(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(odd_rows())]
    rows += [(100, "9" * 100_000), (101, "a." * 50_000), (102, "1." * 50_000), (103, "+1" * 50_000), (104, "10.0.0.1 " * 3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(pd.digest(pd.find_private(df)).orderBy("doc_id").collect(), [t for _, t in rows])
    assert pd.find_private(df.limit(0)).count() == 0


def test_redaction(spark):
    docs = odd_documents(spark)
    got = {r["doc_id"]: r for r in pd.redact(docs).collect() if r["doc_id"] == 13 or r["text"] is None}
    assert got[0]["text"] is None
    assert got[13]["text"] == "mail [EMAIL] or [IP], [PHONE], [CARD]"
    left = pd.redact(table(spark, "/root/testdata/sf0.001", "documents"))
    assert sum(len(base(r["text"])) for r in left.collect()) == 0
    names = ("spans", "wide", "strict", "__meta", "__email", "own_null", "c0", "body", "a.b")
    clash = docs.select("*", *(F.lit(n).alias(n) for n in names))
    done = pd.redact(clash)
    assert done.columns == clash.columns
    assert {tuple(r[-len(names) :]) for r in done.collect()} == {names}


# The whole of the wide part again, in plain Python.
NAMED = r"(?i)(?<![A-Za-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?)[\"'`]?\x20{0,3}[:=]{1,2}\x20{0,3}[\"'`]?"
PROPOSE = {
    "key_run": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
    "hex_run": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}+",
    "assigned": "(?P<lead>" + NAMED.removeprefix("(?i)") + r")(?P<value>[^\s\"'`,;<>(){}\[\]]{6,}+)",
    "grouped": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    "digit_groups": r"(?<![0-9])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){2,4}+(?![0-9])",
}


def proposals(text):
    out = []
    for g, (name, pattern) in enumerate(PROPOSE.items()):
        for m in re.finditer(pattern, text, re.I if name == "assigned" else 0):
            s, v = (m.start("value"), m["value"]) if name == "assigned" else (m.start(), m[0])
            if name in ("key_run", "hex_run") and not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)):
                continue
            n, digits, upper = len(v), len(re.findall("[0-9]", v)), len(re.findall("[A-Z]", v))
            before, after = text[max(0, s - 32) : s], text[m.end() : m.end() + 2]
            length = [n < x for x in (13, 20, 24, 32, 40)].index(True) if n < 40 else 5 if n == 40 else 6 if n < 64 else 7
            out.append((s, 4 if g < 3 else 5, g, m.end(), (
                g, length, 5 * digits // n, 0 if not upper else 1 if 2 * upper < n else 2, int(bool(re.fullmatch("[0-9a-fA-F]+", v))),
                int(bool(re.search("[^A-Za-z0-9]", v))) + ("(" in v), int(before[-1:] in tuple("\"'`") and after[:1] in tuple("\"'`")),
                int(bool(re.search("[=:]\\s{0,3}[\"'`(]?$", before))),
            )))
    return sorted(out)


def all_spans(text, trees):
    strict = [(int(w.split(":")[1]), list(PLAIN).index(w.split(":")[0]), int(w.split(":")[2])) for w in base(text)]
    kept, last = [], None
    for s, k, g, e, f in proposals(text):
        if g not in trees.thresholds or any(a < e and s < b for a, _, b in strict):
            continue
        score = round(float(trees.margins(np.array([f]))[0]), 6)
        if score < trees.thresholds[g] - 1e-5:
            continue
        if last and s < last[2]:
            if (score, e - s) > (last[3], last[2] - last[0]):
                last = (s, k, e, score)
        else:
            kept += [last] if last else []
            last = (s, k, e, score)
    kept += [last] if last else []
    return ",".join(f"{pd.KINDS[k]}:{s}:{e}" for s, k, e in sorted(strict + [x[:3] for x in kept]))


def test_spans_match_brute_force(spark):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()]
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    parts = [lambda: f'token = "{hexa(40)}"', lambda: f"password: {hexa(12)}Q", lambda: "API_KEY=" + hexa(30) + "/x+" + hexa(5), lambda: hexa(64), lambda: "555-123-4567", lambda: "(555) 123 4567",
             lambda: "12-345-6789", lambda: "+1 (234) 555-0000", lambda: "secret='hunter'", lambda: "the quick é fox", lambda: "10.0.0.1", lambda: "2021/04/05/06"]
    texts += [rng.choice([" ", "\n", ","]).join(rng.choice(parts)() for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trees = pd.fit(df)
    got = pd.digest(pd.find_private(df, trees)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert r["spans"] == all_spans(t, trees), t[:300]


def test_few_secrets_are_found_and_prose_is_left(spark):
    planted = [f"deploy notes password: {c}9x8Kq2LmZ7vTn4RwY6{c}b end" for c in "abcd"]
    planted += ['api_key = "Zx81kq92lm33np44qr55"', "Authorization: 9f8e7d6c5b4a39281706f5e4d3c2b1a0"]
    clean = ["the token ring network of 1985", "see section 12 of the report", "password: ", "secret gardens and open secrets", "a/very/long/path/of/plain/words/here", "versions 10 11 12"]
    df = spark.createDataFrame(list(enumerate(planted + clean)), "doc_id long, text string")
    got = [r["n_secret"] for r in pd.digest(pd.find_private(df)).orderBy("doc_id").collect()]
    assert got == [1] * len(planted) + [0] * len(clean)


def test_recall_of_planted_secrets(spark):
    rng = random.Random(4)
    names, texts = ["token", "secret", "api-key", "password", "access_key"], []
    for i in range(300):
        value = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(rng.choice([20, 24, 32, 40])))
        texts.append(f"some words {rng.choice(names)}{rng.choice([' = ', ': ', '='])}{rng.choice(['', chr(34)])}{value}\nmore words {i}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(r["n_secret"] == 1 for r in pd.digest(pd.find_private(df)).collect()) >= 0.9 * len(texts)


rows_of_tuples = st.tuples(st.integers(0, 1), st.tuples(st.integers(0, 4), *[st.integers(0, 1)] * (len(pd.FEATURES) - 1)), st.integers(1, 50), st.integers(0, 50))


@settings(max_examples=20, deadline=None)
@given(st.lists(rows_of_tuples, max_size=12, unique_by=lambda r: r[:2]))
def test_thresholds_hold_their_precision(rows):
    rows = [(fold, x, n, min(n, y)) for fold, x, n, y in rows]
    t = pd.Trees(rows, rounds=5)
    judged = [r[1:] for r in rows if r[0] == 1] + pd.prior()
    for gen, least in t.thresholds.items():
        chosen = [(n, y) for x, n, y in judged if x[0] == gen and t.margins(np.array([x]))[0] >= least - 1e-5]
        assert sum(y for _, y in chosen) >= 0.9 * sum(n for n, _ in chosen) - 1e-6
