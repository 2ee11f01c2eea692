import numpy as np
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from lodestone.llm import bpe, tokens

TEXTS = [None, "", "\n", "one line", "a\nb\n\nc", "\n\n\n\nx  \n  y", "ünï\ncode 😀\n😀😀\n", "line of words\n" * 500, "日本\n語\n\n\n 's"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(bpe.default_vocabulary())
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    return made


def brute(library, text, rule):
    """(tokens, by line, crossing) from the library's offsets, a character at a time."""
    encoded = library.encode(text, add_special_tokens=False)
    line = np.cumsum([0, *(c == "\n" for c in text)])[: len(text)].tolist()
    counts, crossing = [0] * (text.count("\n") + 1), 0
    for a, b in encoded.offsets:
        own = line[a:b]
        crossing += own[0] != own[-1]
        counts[own[0] if rule == "first" else max(sorted(set(own)), key=own.count)] += 1
    return len(encoded.ids), counts, crossing


@pytest.mark.parametrize("rule", tokens.RULES)
def test_matches_brute_force(spark, library, rule):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = tokens.section_tokens(docs, bpe.build(docs), rule=rule).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["n_tokens"], r["section_tokens"], r["n_crossing"]) == brute(library, TEXTS[r["doc_id"]] or "", rule)
        assert sum(r["section_tokens"]) == sum(r["field_tokens"]) == r["n_tokens"]


def test_fields(spark, library):
    docs = spark.createDataFrame([(1, "A title", "Body\ntext", None), (2, None, "", "x")], "doc_id long, title string, body string, note string")
    got = {r["doc_id"]: r["field_tokens"] for r in tokens.section_tokens(docs, bpe.build(docs, "body"), fields=("title", "body", "note"), separator=" | ").collect()}
    assert sum(got[1]) == len(library.encode("A title | Body\ntext | ").ids) and len(got[1]) == 3 and got[1][0] >= 3
    assert tokens.section_tokens(docs.limit(0), bpe.build(docs, "body"), fields=("body",)).count() == 0
    with pytest.raises(ValueError):
        tokens.section_tokens(docs, None, rule="any")


def test_rule_for_crossing_tokens():
    starts, ends, sections = np.array([0, 3, 8]), np.array([3, 8, 9]), np.array([0, 4, 7])
    assert [tokens.attributed(starts, ends, sections, 9, r)[0].tolist() for r in tokens.RULES] == [[2, 0, 1], [1, 1, 1]]
