import random

import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe

TEXTS = [
    None, "", " ", "\n\n a", "a  b\t\tc \n", "It's they'll I'd 'tis we've", "naïve café ÜBER straße 12345 x2", "日本語 テキスト 😀👩‍👩‍👧", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|end",
    "x\x1cy\x85z\xa0w v​u᠎", "ab" * 3000, "éñ" * 700, "!" * 500, " " * 300, "1" * 200, "word " * 2000, "é İstanbul", "\r\n\r\nq", "' 's 'S",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def corpus():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeéhinorstu") for _ in range(rnd.randint(1, 12))) for _ in range(400)]
    return [rnd.choice(" \n").join(rnd.choice(vocabulary) + rnd.choice(["", "", ",", ".", "'s", "!?", "7"]) for _ in range(rnd.randint(1, 300))) for _ in range(80)]


def test_equals_the_library(spark, library):
    rows = list(enumerate(TEXTS + corpus()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", bpe.F.lit("clash"))
    shared = bpe.build(docs, words=200)
    got = {r["doc_id"]: r for r in bpe.encode(docs, shared, decoded_col="decoded").collect()}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["ids"] == ids, text
        assert got[doc_id]["decoded"] == library.decode(ids, skip_special_tokens=False) == (text or "")
    again = bpe.decode(bpe.encode(docs, shared), shared)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {d: t or "" for d, t in rows}


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["tap", "taps", "top", "tops", " stop", " stops", "é", "", "t"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.find(w) == ids for w, ids in words.items())
    assert [lexicon.find(w.encode()) for w in ("ta", "tapss", "x", " sto")] == [None] * 4
    shared_suffixes = {b"xing": [1], b"ying": [2], b"zing": [3]}
    assert len(bpe.Lexicon(bpe.compile_lexicon(shared_suffixes))._first) - 1 == 5


def test_result_does_not_depend_on_the_lexicon(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    runs = [sorted(map(tuple, bpe.encode(docs, bpe.build(docs, words=n)).select("doc_id", "ids").collect())) for n in (0, 5, 5000)]
    assert runs[0] == runs[1] == runs[2]


def test_memory_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    whole = sorted(map(tuple, bpe.encode(docs, bpe.build(docs)).select("doc_id", "ids").collect()))
    with open(bpe.default_vocabulary(), "rb") as f:
        encoder = bpe.Encoder(f.read(), bpe.compile_lexicon({}))
    monkeypatch.setattr(bpe, "MEMO_WORDS", 20)
    monkeypatch.setattr(bpe, "MEMO_PARTS", 20)
    assert [(i, x.tolist()) for i, t in enumerate(corpus()) for x in encoder.encode_many([t])] == whole
    assert len(encoder) <= 20 and len(encoder.parts) <= 20


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, bpe.build(docs)).count() == 0


def test_long_and_short_merging_agree():
    with open(bpe.default_vocabulary(), "rb") as f:
        vocabulary = bpe.Vocabulary(f.read())
    rnd = random.Random(9)
    for _ in range(300):
        parts = [vocabulary.letters[b] for b in bytes(rnd.choice(b"aabcdehnrst ") for _ in range(rnd.randint(1, 40)))]
        assert vocabulary._merge_short(list(parts)) == vocabulary._merge_long(list(parts))
    pieces = [bytes(rnd.choice(b"aabcdehnrst ,'e\xc3\xa9") for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    assert vocabulary.merge_many(pieces) == [tuple(vocabulary.merge(p)) for p in pieces]


def test_word_counts_cover_everything(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, " a")], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in bpe.word_counts(docs).collect()} == {"a": 1, " b": 1, " a": 2}


def test_a_word_that_merges_whole_is_sought_once():
    with open(bpe.default_vocabulary(), "rb") as f:
        encoder = bpe.Encoder(f.read(), bpe.compile_lexicon({}))
    sought = []

    class Counted(bpe.Lexicon):
        def find(self, word):
            sought.append(word)
            return super().find(word)

        def packed(self, word):
            sought.append(word)
            return super().packed(word)

    encoder.lexicon = Counted(bpe.compile_lexicon({}))
    words = ["zebrafish", " qwertyish", " naïveté", " it's", "x,y"]
    encoder.learn(set(words))
    assert sought.count(b"zebrafish") == sought.count(b" qwertyish") == sought.count(" naïveté".encode()) == 1
    assert {u: bpe.unpacked(encoder[u]).tolist() for u in words} == {u: encoder.vocabulary.unit(u) for u in words}


def test_ids_outside_the_vocabulary_are_passed_over():
    with open(bpe.default_vocabulary(), "rb") as f:
        encoder = bpe.Encoder(f.read(), bpe.compile_lexicon({}))
    ids = [-1, *encoder.vocabulary.unit("naïve"), 1 << 40, *encoder.vocabulary.special.values(), 10**7]
    assert encoder.decode(ids) == encoder.decode(i for i in ids) == "naïve" + "".join(encoder.vocabulary.special)
    assert encoder.decode([]) == encoder.decode(bpe.np.zeros(0, bpe.np.int32)) == ""
    table = encoder.vocabulary.bytes
    rnd = random.Random(5)
    for _ in range(50):
        ids = [rnd.randrange(len(table)) for _ in range(rnd.randint(0, 60))]
        assert encoder.decode(ids) == b"".join(table[i] for i in ids).decode("utf-8", "replace")
