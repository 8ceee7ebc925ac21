"""Formatted conversations parse back to what they were made of."""

import random
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat_format as cf

PIECES = st.lists(st.sampled_from([cf.START, cf.END, "\n", "<|", "|>", "\\", "<", "im_end", "im_start", "nl", "<|nl|>", "<|\\im_end|>", "assistant", "ok ", "é", "", cf.IMITATION]), max_size=8).map("".join)


def spans(turns):
    text, places = cf.render(turns)
    back = [(cf.unescape_role(r), cf.unescape_text(text[s:e])) for _, _, r, s, e in cf.parse(text)]
    assert back == turns
    assert [cf.unescape_text(text[s:e]) for s, e in places] == [x for _, x in turns]
    return text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    spans(turns)


def test_only_conflicts_are_escaped():
    assert spans([("user", "a \\ <| b")]) == "<|im_start|>user\na \\ <| b<|im_end|>\n"
    assert spans([("user", "<|nl|>"), ("assistant", "x<|im_end|>")]) == "<|im_start|>user\n<|nl|><|im_end|>\n<|im_start|>assistant\nx<|\\im_end|><|im_end|>\n"


def test_many_openings_parse_in_linear_time():
    text = (cf.START + "\n") * 200_000 + "<|im_start|>user\nx<|im_end|>\n"
    assert [text[s:e] for *_, s, e in cf.parse(text)] == ["x"]


def plain(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        learned = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        out[conv] = (len(turns), sha256(whole.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest(), len(cf.render(turns)[0]))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, formatted string, part string"


def test_conversations(spark):
    rng = random.Random(3)
    texts = ["", None, "hé\nlo", cf.IMITATION, "<|\\im_end|>", "x" * 3000, " ", "<|im_start|>user\nme<|im_end|>\n"]
    rows = [(rng.choice([None, 1, 2, 3, 5]), rng.choice([None, 0, 1, 2, 7]), rng.choice(["user", "assistant", None, "a\nb", "<|nl|>"]), rng.choice(texts), "f", "p") for _ in range(200)]
    rows += [(9, k, "assistant", f"turn {k} {cf.END}", "", None) for k in range(3000)] + rows[:20]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    for size in (cf.PART_CHARS, 500):
        parts = cf.chat_format(turns, part_chars=size)
        for got in (cf.read_back(parts), cf.read_back(cf.arranged(parts.repartition(5)))):
            assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    held = [r for r in parts.collect() if r["conv_id"] == 9]
    assert len(held) > 50 and all(len(r["formatted"]) < 600 for r in held)
    before = 0
    for r in sorted(held, key=lambda r: r["part"]):
        assert r["before"] == before
        before += len(r["formatted"])


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cf.chat_format(none).count() == 0 and cf.read_back(cf.chat_format(none)).count() == 0


def test_imitation(spark):
    from quarry.llm.queries import op11_chat_formatting

    rows = {r["conv_id"]: r for r in op11_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    n, x = rows[-1], cf.IMITATION
    assert (n["n_turns"], n["loss_chars"], n["loss_sha256"]) == (2, len(x), sha256(x.encode()).hexdigest())
    assert n["turns_sha256"] == sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()
