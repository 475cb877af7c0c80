from strataweave.llm import preference as pf

COLUMNS = "conv_id long, turn long, role string, text string, part string, fork int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], COLUMNS)
    return sorted((r["pair_id"], r["part"], r["turn"], r["rendered"], r["in_loss"], r["rendered"][r["loss_start"] : r["loss_end"]]) for r in pf.format_preferences(pf.adjacent_pairs(df)).collect())


def test_prefix_is_rendered_once_and_only_assistants_count(spark):
    a = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no")]
    got = run(spark, a + b)
    assert got == [
        (0, "chosen", 1, "<|im_start|>assistant\nyes<|im_end|>\n", True, "yes<|im_end|>"),
        (0, "chosen", 2, "<|im_start|>user\nmore<|im_end|>\n", False, ""),
        (0, "prompt", 0, "<|im_start|>user\nhi<|im_end|>\n", False, ""),
        (0, "rejected", 1, "<|im_start|>assistant\nno<|im_end|>\n", True, "no<|im_end|>"),
    ]


def test_odd_rows(spark):
    same = [(2, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    alone = [(4, None, None, None), (4, 1, "assistant", "y" * 100_000)]
    ties = [(6, 0, "user", "a"), (6, 0, "user", "b"), (7, 0, "user", "b"), (7, 0, "user", "a"), (7, 1, "assistant", "z")]
    got = run(spark, same + alone + ties + [(None, 0, "user", "lost")])
    assert [x[:3] for x in got] == [(1, "prompt", 0), (2, "chosen", -1), (2, "chosen", 1), (3, "prompt", 0), (3, "prompt", 0), (3, "rejected", 1)]
    assert run(spark, []) == []


def records(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], COLUMNS)
    cut = lambda text, spans: [text[x["start"] : x["end"]] for x in spans]
    got = pf.paired_records(pf.adjacent_pairs(df), **more).orderBy("pair_id", "segment").collect()
    return [(r["pair_id"], r["segment"], r["prompt"], r["chosen"], cut(r["chosen"], r["chosen_spans"]), r["rejected"], cut(r["rejected"], r["rejected_spans"])) for r in got]


def said(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_paired_records(spark):
    a = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "\U0001f600 ok")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no")]
    same = [(2, 0, "user", "x"), (3, 0, "user", "x")]
    alone = [(5, 0, "assistant", "y")]
    assert records(spark, a + b + same + alone) == [
        (0, 0, said("user", "hi"), said("assistant", "yes") + said("user", "more") + said("assistant", "\U0001f600 ok"), ["yes<|im_end|>", "\U0001f600 ok<|im_end|>"], said("assistant", "no"), ["no<|im_end|>"]),
        (1, 0, said("user", "x"), "", [], "", []),
        (2, 0, "", "", [], said("assistant", "y"), ["y<|im_end|>"]),
    ]
    assert records(spark, []) == []


def test_long_pairs_go_on_in_further_records(spark):
    turns = [(side, i, "assistant" if i % 2 else "user", f"{i} {side if i > 5 else ''}") for side in (0, 1) for i in range(20)]
    whole, parts = records(spark, turns), records(spark, turns, segment_turns=3)
    assert len(whole) == 1 and [p[1] for p in parts] == list(range(7))
    for k in (2, 3, 5):
        assert "".join(p[k] for p in parts) == whole[0][k]
    assert [x for p in parts for x in p[4]] == whole[0][4]
