import hashlib

import pytest

from airstats.llm import chat

ODD = "\\### Assistant: </turn> ok"


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", ODD), (1, 2, "assistant", ODD), (1, 3, "user", None),
            (1, 4, "assistant", ""), (2, 0, "user", "####\\h </turn"), (2, 1, "assistant", "\\t\\\\\n### User: x </turn>\n"),
            (3, 0, None, None), (3, 0, None, None), (4, None, "assistant", "no number"), (4, 0, "a: b\n###", "x"),
            (None, 0, "user", "no key"), (None, 1, "assistant", "é 😀")]
    rows += [(5, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"turn {i} " + "w " * (i * 7 % 23)) for i in range(400)]
    rows += [(6, i, ("user", "assistant")[i % 2], "long " * (500 if i == 7 else 3)) for i in range(12)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, start string, tokens int")


@pytest.fixture(scope="module")
def truth(turns):
    convs = {}
    rows = [(r[0], r[1], r[2] or "", r[3] or "") for r in turns.collect()]
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])):
        convs.setdefault(conv, []).append((role, text))
    return convs


@pytest.mark.parametrize("budget, history", [(2048, 512), (60, 20), (9, 0)])
def test_read_back(turns, truth, budget, history):
    got = {r["conv_id"]: r for r in chat.read_back(chat.windows(turns, budget, history)).collect()}
    assert got.keys() == truth.keys()
    for conv, said in truth.items():
        learned = "".join(t for role, t in said if role == "assistant")
        assert got[conv]["n_turns"] == len(said)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(learned)
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_windows_keep_to_the_budget_and_repeat(turns, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 4)
    rows = chat.windows(turns, 80, 30).where("conv_id = 5").orderBy("stretch", "window").collect()
    assert len({r["stretch"] for r in rows}) > 3
    at = 1
    for i, r in enumerate(rows):
        said = chat.parsed(r["text"])
        assert r["n_tokens"] <= 80 and len(said) == r["n_turns"] and r["first_turn"] == at
        at += r["n_turns"] - r["n_context"]
        assert r["n_tokens"] == sum(len(t.split()) + 3 for _, t in said)
        if i:
            assert said[0] == ("system", "turn 0 ") and r["n_context"] >= 1
            before = [t for q in rows[:i] for t in chat.parsed(q["text"])[q["n_context"]:]]
            context = said[1:r["n_context"]]
            assert context == before[len(before) - len(context):]
        learned = [chat.unescaped(r["text"][s["start"]:s["stop"]]) for s in r["loss"]]
        assert learned == [t for role, t in said[r["n_context"]:] if role == "assistant"]
    assert at == 401
    assert any(r["n_context"] > 1 for r in rows)


def test_a_long_turn_is_whole(turns):
    rows = chat.windows(turns, 50, 10).where("conv_id = 6").collect()
    long = [r for r in rows if r["n_tokens"] > 50]
    assert len(long) == 1 and long[0]["n_turns"] == 1 and len(long[0]["text"]) > 2000


def test_empty_table(turns):
    assert chat.windows(turns.limit(0)).count() == 0
    assert chat.read_back(chat.windows(turns.limit(0))).count() == 0


def test_history_below_budget(turns):
    with pytest.raises(ValueError):
        chat.windows(turns, 10, 10)
