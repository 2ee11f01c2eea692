import random

import pytest
from tokenizers import AddedToken, Tokenizer

from lodestone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_escaping_is_reversible():
    template, rnd = chat.Template(), random.Random(0)
    atoms = [*template.own, *template.foreign, "<", "\\", "|", "[", "/INST]", "s>", "turn|>", "a", "\n", "<\\", "[\\"]
    for _ in range(5000):
        text = "".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 9)))
        safe = template.escape(text)
        assert template.unescape(safe) == text
        assert not any(c in safe for c in (*template.own, *template.foreign))


def rows():
    rnd = random.Random(1)
    words = ["hello", "wörld", "</s>", "[INST]", "<|end|>", "<|turn|>", "<\\|end|>", "😀", "\n", " ", "x" * 50, "日本"]
    out = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, None), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"), (None, 1, "assistant", "z"), (4, 0, "assistant", "y" * 200_000)]
    for conv in range(10, 60):
        for turn in range(rnd.randint(1, 9)):
            out.append((conv, turn, rnd.choice(["system", "user", "assistant", "as\nsis<|text|>tant"]), "".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))))
    rnd.shuffle(out)
    return out


def test_round_trip_and_mask(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    formatted = chat.format_conversations(docs)
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    library = Tokenizer.from_file(chat.default_vocabulary())
    library.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in chat.Template().own])
    expected = {}
    for conv, turn, role, text in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert set(back) == set(expected)
    for r in formatted.collect():
        turns = expected[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in back[r["conv_id"]]["turns"]] == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        assert back[r["conv_id"]]["loss_text"] == loss
        encoded = library.encode(r["formatted"], add_special_tokens=False)
        assert r["ids"] == encoded.ids
        # brute force: a token is in the loss if it shares a character with an assistant's text
        _, spans = chat.Template().render(turns)
        inside = set().union(*(range(a, b) for (a, b), (role, _) in zip(spans, turns, strict=True) if role == "assistant"))
        assert r["loss_mask"] == [int(any(c in inside for c in range(a, b))) for a, b in encoded.offsets]


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_span():
    starts, ends = [0, 2, 5, 5, 9], [2, 5, 9, 9, 10]
    assert [chat.token_span(starts, ends, *x) for x in ((0, 2), (2, 9), (3, 6), (5, 9), (4, 4), (9, 10))] == [(0, 1), (1, 4), (1, 4), (2, 4), (0, 0), (4, 5)]
    with pytest.raises(ValueError):
        chat.Template().parse("<|turn|>user<|end|>\n")
