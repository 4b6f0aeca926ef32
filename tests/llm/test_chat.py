import hashlib
import random

import pytest

from granary.llm import chat

PIECES = ["### Assistant: ", "### User: ", "### %x: ", "</turn>", "\n", "\\", "\\\\", "a", " ", "###", "<", "é", "\n</turn>\n", "### System: x"]


def test_any_text_comes_back():
    rnd = random.Random(8)
    for _ in range(3000):
        turns = [
            (
                rnd.choice(["user", "assistant", "system", "", "Tool: a\n", "User"]), "".join(rnd.choices(PIECES, k=rnd.randrange(8)))
            ) for _ in range(rnd.randrange(1, 4))
        ]
        whole = "".join(chat.render(r, t) for r, t in turns)
        assert [(r, t) for r, t, _ in chat.parse(whole)] == turns


def test_only_conflicts_are_escaped():
    assert chat.render("user", "plain \\ text") == "### User: plain \\ text\n</turn>\n"
    assert chat.render("user", chat.PROBE) == "### User: \\\\### Assistant: \\</turn> ok\n</turn>\n"


def test_damage_is_refused():
    for bad in (
        "### User: a", "x### User: a\n</turn>\n", "### User: a### User: b\n</turn>\n", "### User: a</turn>\n", "### User: a\n</turn>", "### user: a\n</turn>\n"
    ):
        with pytest.raises(chat.GrammarError):
            list(chat.parse(bad))


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None),
        (1, 0, "assistant", "b"),
        (1, 0, "assistant", "b"),
        (1, None, "user", "first"),
        (None, 3, "assistant", "x" * 200_000),
        (2, 1, "assistant", "</turn>"),
        (2, 0, "user", "\\"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nfirst\n\n\nassistant\nb\nassistant\nb\n") and got[1].n_turns == 4
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha("bb"))
    assert (got[2].loss_chars, got[2].loss_sha256) == (7, sha("</turn>"))
    assert got[None].loss_chars == 200_000
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(none)).count() == 0
