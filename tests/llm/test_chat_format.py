import random

from cohortwise.llm.chat_format import render_perspectives

SCHEMA = "conv_id long, turn long, role string, text string, part string, perspective string, t int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_views_and_masks(spark):
    rows = [(1, 1, "ann", "hi"), (1, 0, "system", "be kind"), (1, 2, "bob", "é中\U0001f600"),
            (1, 3, "ann", "bye"), (2, 0, "system", "alone")]
    got = {(r.conv_id, r.perspective): r for r in render_perspectives(table(spark, rows)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob")}
    ann = got[1, "ann"]
    assert ann.text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=bob\né中\U0001f600<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n")
    cut = [ann.text[m.start : m.start + m.length] for m in ann.masks]
    assert cut == ["hi<|im_end|>\n", "bye<|im_end|>\n"] and ann.masked_chars == sum(map(len, cut))
    assert ann.n_turns == 4
    bob = got[1, "bob"]
    assert [bob.text[m.start : m.start + m.length] for m in bob.masks] == ["é中\U0001f600<|im_end|>\n"]


def test_nulls_ties_repeats_and_long_dialogues(spark):
    rows = [(None, 0, "a", "lost"), (1, None, None, None), (1, 0, "a", "x"), (1, 0, "a", "x"),
            (1, 0, "b", "x"), (2, 0, "a", "w " * 50_000)]
    rows += [(3, i, "ab"[i % 2], str(i)) for i in range(600)]
    got = render_perspectives(table(spark, rows)).collect()
    one = {r.perspective: r for r in got if r.conv_id == 1}
    assert set(one) == {"a", "b", "unknown"} and one["a"].n_turns == 4 and len(one["a"].masks) == 2
    assert [r.masked_chars for r in got if r.conv_id == 2] == [100_000 + 11]
    three = sorted((r.part, r.n_turns) for r in got if r.conv_id == 3)
    assert three == [(0, 600), (0, 600)]
    assert not any(r.conv_id is None for r in got)
    for r in got:
        for m in r.masks:
            assert r.text[m.start : m.start + m.length].endswith("<|im_end|>\n")


def test_empty_and_native(spark):
    df = render_perspectives(table(spark, []))
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().toString()


def rendered(rows, part_bytes):
    """The views of a table, turn by turn."""
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn or 0, role or "unknown", text or ""))
    views = {}
    for conv, turns in said.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        parts, at = {}, 0
        for _, role, text in turns:
            parts.setdefault(at // part_bytes, []).append((role, text))
            at += len(role.encode()) + len(text.encode()) + 32
        opening = next((i for i, t in enumerate(turns) if t[1] != "system"), None)
        leading = parts[0][:opening]
        for part, own in parts.items():
            for who in {r for _, r, _ in turns if r != "system"}:
                text, masks, every = "", [], (leading if part else []) + own
                for role, words in every:
                    head = ("assistant" if role == who else "system" if role == "system"
                            else f"user name={role}")
                    text += f"<|im_start|>{head}\n"
                    if role == who:
                        masks.append((len(text), len(words) + len("<|im_end|>\n")))
                    text += words + "<|im_end|>\n"
                views[conv, part, who] = (len(every), text, masks)
    return views


def test_equals_a_rendering_turn_by_turn(spark):
    rng = random.Random(3)
    rows = []
    for conv in (1, 2, 3, None):
        lead = rng.randint(0, 5)
        rows += [(conv, i, "system", f"rule {i}") for i in range(lead)]
        rows += [(conv, rng.choice([None, *range(5, 60)]), rng.choice(["ann", "bo", "system", "é中", None]),
                  rng.choice(["", None, "same", "é中\U0001f600 " * rng.randint(1, 40), "x" * rng.randint(1, 900)]))
                 for _ in range(120)]
    rows += [(4, 9, "ann", "again")] * 200 + [(4, 9, "bo", "y" * 3000)] * 3 + [(5, 0, "system", "alone")]
    for part_bytes in (500, 4000, 1 << 22):
        got = {(r.conv_id, r.part, r.perspective): (r.n_turns, r.text, [tuple(m) for m in r.masks])
               for r in render_perspectives(table(spark, rows), part_bytes=part_bytes).collect()}
        want = rendered(rows, part_bytes)
        assert got == want and len(want) > 8


def test_leading_system_turns_are_carried_whole(spark):
    rows = [(1, i, "system", f"rule {i}") for i in range(300)]
    rows += [(1, 300 + i, "ab"[i % 2], "w" * 1000) for i in range(100)]
    got = render_perspectives(table(spark, rows), part_bytes=20_000).collect()
    assert len({r.part for r in got}) > 4
    for r in got:
        assert r.text.startswith("<|im_start|>system\nrule 0<|im_end|>\n") and "rule 299<" in r.text
