"""Byte-level BPE encoding and decoding with a word lexicon held in a minimal automaton.

Spark counts the words of all documents. The most frequent ones, at most
``LEXICON_WORDS``, are encoded once and compiled into a minimal acyclic automaton:
common prefixes and suffixes share states, and the numbers on a word's transitions
add up to the word's rank, which leads to its ids. The automaton is a few flat
arrays; each Python worker maps them into memory from a file and walks the bytes
of a word. Words it doesn't hold are merged exactly, rank by rank.

The result does not depend on the lexicon: it only saves merging. Its size is
bounded by ``LEXICON_WORDS``, so it can be built on the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
import math
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: Words in the lexicon at most.
LEXICON_WORDS = 1 << 15
#: Words that a worker remembers at most, parts of words likewise, and their length at most.
MEMO_WORDS, MEMO_PARTS, MEMO_LENGTH = 150_000, 60_000, 48

#: Unicode white space, as the splitting pattern of the vocabulary means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word here: a run of other characters with the space before it, or white space that is left over.
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = count(0x100)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def packed(ids: Iterable[int]) -> bytes:
    """Ids as 32-bit numbers: joining them is joining bytes."""
    return np.asarray(ids, np.int32).tobytes()


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.int32)


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, content: bytes):
        import regex

        spec = json.loads(content)
        model = spec["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.ids: dict[str, int] = model["vocab"]
        self.letters = _byte_characters()
        self.translation = dict(enumerate(self.letters))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, by_length))) if by_length else None
        self.pattern = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        none = len(self.ranks)
        self.byte_ids = np.array([self.ids[c] for c in self.letters], np.int32)
        self.byte_ranks = np.array([self.ranks.get((a, b), none) for a in self.letters for b in self.letters], np.int32)
        self.joined = np.array([self.ids[a + b] for a, b in self.ranks], np.int32)
        codes = np.array([self.ids[a] << 20 | self.ids[b] for a, b in self.ranks], np.int64)
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], order.astype(np.int32)
        byte_of = {c: b for b, c in enumerate(self.letters)}
        size = max(chain(self.ids.values(), self.special.values())) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, size)
        self.starts, self.letters_of_all = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(self.bytes), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest-ranked pair is joined, leftmost first, until none is left."""
        parts = list(piece.decode("latin-1").translate(self.translation))
        parts = self._merge_short(parts) if len(parts) <= 64 else self._merge_long(parts)
        return [self.ids[p] for p in parts]

    def _merge_short(self, parts: list[str]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        found = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while found and (best := min(found)) < none:
            i = found.index(best)
            parts[i] = joined = parts[i] + parts[i + 1]
            del parts[i + 1], found[i]
            if i:
                found[i - 1] = rank((parts[i - 1], joined), none)
            if i < len(found):
                found[i] = rank((joined, parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap, for pieces of any length."""
        rank, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := rank((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p]

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """:meth:`merge` of many pieces."""
        return [tuple(unpacked(p).tolist()) for p in self.merge_packed(pieces)]

    def merge_packed(self, pieces: list[bytes]) -> list[bytes]:
        """The same as packed ids: pieces of like length step by step together, in arrays."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) < 2 or len(piece) > 64:
                out[i] = packed(self.merge(piece))
            else:
                by_size.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for size, rows in by_size.items():
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        none = len(self.ranks)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(-1, size)
        inside = np.arange(size) < length[:, None]
        rank = np.where(inside[:, 1:], self.byte_ranks[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]], none)
        symbol = np.where(inside, self.byte_ids[raw], -1)
        row = np.arange(len(pieces))
        done = [b""] * len(pieces)
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            over = best == none
            if over.any():
                ended = symbol[over]
                ids, width = packed(ended), ended.shape[1]
                for k, (i, n) in enumerate(zip(row[over].tolist(), (ended >= 0).sum(axis=1).tolist(), strict=True)):
                    done[i] = ids[4 * k * width : 4 * (k * width + n)]
                row, rank, symbol, at, best = (x[~over] for x in (row, rank, symbol, at, best))
                if not len(row):
                    break
            n, width = symbol.shape
            each = np.arange(n)
            # the symbol after the merged pair's first goes: all to its right move up
            keep = np.ones((n, width), bool)
            keep[each, at + 1] = False
            symbol = symbol[keep].reshape(n, width - 1)
            symbol[each, at] = self.joined[best]
            if width == 2:
                rank = np.full((n, 1), none, np.int32)
                continue
            keep = np.ones((n, width - 1), bool)
            keep[each, at] = False
            rank = rank[keep].reshape(n, width - 2)
            left = at > 0
            rank[each[left], at[left] - 1] = self._pair_ranks(symbol[each[left], at[left] - 1], symbol[each[left], at[left]])
            right = at < width - 2
            rank[each[right], at[right]] = self._pair_ranks(symbol[each[right], at[right]], symbol[each[right], at[right] + 1])
        return done

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the number of merges if there is none."""
        code = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where((self.pair_codes[at] == code) & (b >= 0), self.pair_ranks[at], len(self.ranks))

    def pieces(self, unit: str) -> list[str]:
        """The parts of one word that merges don't leave."""
        if unit.isalpha() or (unit[:1] == " " and unit[1:].isalpha()):
            return [unit]
        return self.pattern.findall(unit)

    def unit(self, unit: str) -> list[int]:
        """Ids of one word, by merging."""
        return [i for piece in self.pieces(unit) for i in self.merge(piece.encode())]


# ---------------------------------------------------------------- the automaton


def compile_lexicon(entries: dict[bytes, Iterable[int]]) -> bytes:
    """Flat arrays of the minimal acyclic automaton of ``entries`` (word -> ids), as one string of bytes.

    States are merged as the sorted words come in, once nothing can be added below
    them (Daciuk et al., 2000). A transition carries how many words sort before
    those it leads to; their sum along a word is the word's rank.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    final: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def freeze(node: list) -> int:
        """node: [is final, {byte: state}]"""
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(arcs)
            final.append(node[0])
            arcs.append(key[1])
        return register[key]

    open_nodes: list[list] = [[False, {}]]
    last = b""
    for word in words:
        same = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), same, -1):
            node = open_nodes.pop()
            open_nodes[-1][1][last[depth - 1]] = freeze(node)
        open_nodes.extend([False, {}] for _ in range(len(word) - same))
        open_nodes[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        node = open_nodes.pop()
        open_nodes[-1][1][last[depth - 1]] = freeze(node)
    root = freeze(open_nodes.pop())

    below = np.zeros(len(arcs), np.int64)  # states are numbered children first
    first, labels, targets, skips = [0], bytearray(), [], []
    for state, out in enumerate(arcs):
        passed = int(final[state])
        for label, target in out:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += int(below[target])
        below[state] = passed
        first.append(len(labels))
    ids = [tuple(entries[w]) for w in words]
    starts = np.cumsum([0, *map(len, ids)])
    arrays = [
        np.array([root, len(words)], np.int32),
        np.array(first, np.int32),
        np.array(targets, np.int32),
        np.array(skips, np.int32),
        np.array(starts, np.int32),
        np.fromiter(chain.from_iterable(ids), np.int32),
        np.array(final, np.uint8),
        np.frombuffer(bytes(labels), np.uint8),
    ]
    head = np.array([x.nbytes for x in arrays], np.int64)
    return b"".join([head.tobytes(), *(x.tobytes() for x in arrays)])


class Lexicon:
    """A compiled lexicon, mapped into memory. ``find`` gives a word's ids, or None."""

    def __init__(self, content: bytes):
        with tempfile.TemporaryFile() as file:  # no name is left behind; the mapping keeps the pages
            file.write(content)
            file.flush()
            self._map = mmap.mmap(file.fileno(), len(content), access=mmap.ACCESS_READ)
        view = memoryview(self._map)
        sizes = view[:64].cast("q").tolist()
        ends = np.cumsum([64, *sizes]).tolist()
        parts = [view[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        head, self._first, self._targets, self._skips, self._starts = (p.cast("i") for p in parts[:5])
        self._ids = parts[5]
        self._final = parts[6]
        self._labels_at = ends[7]
        self._root = head[0]
        self.words = head[1]
        self._sieve = bytearray(1 << 20)
        for word in self:
            self._sieve[hash(word) & 0xFFFFF] = 1

    def __iter__(self) -> Iterator[bytes]:
        """All words, in order."""
        stack = [(self._root, b"")]
        while stack:
            state, word = stack.pop()
            if self._final[state]:
                yield word
            for at in range(self._first[state + 1] - 1, self._first[state] - 1, -1):
                stack.append((self._targets[at], word + self._map[self._labels_at + at : self._labels_at + at + 1]))

    def find(self, word: bytes) -> tuple[int, ...] | None:
        ids = self.packed(word)
        return None if ids is None else tuple(unpacked(ids).tolist())

    def packed(self, word: bytes) -> bytes | None:
        """A word's packed ids, or None."""
        if not self._sieve[hash(word) & 0xFFFFF]:  # spares the walk for nearly all words that aren't there
            return None
        state, rank = self._root, 0
        first, targets, skips, find, base = self._first, self._targets, self._skips, self._map.find, self._labels_at
        for i in range(len(word)):
            at = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if at < 0:
                return None
            rank += skips[at]
            state = targets[at]
        if not self._final[state]:
            return None
        return bytes(self._ids[4 * self._starts[rank] : 4 * self._starts[rank + 1]])


class Encoder(dict):
    """Texts to ids. The dict is its memory of words: word -> packed ids; ``parts`` that of the words' parts."""

    def __init__(self, vocabulary: bytes, lexicon: bytes):
        self.vocabulary, self.lexicon = Vocabulary(vocabulary), Lexicon(lexicon)
        self.parts: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> None:
        """Put the ids of all ``units`` into memory, those of new parts merged together."""
        fresh = [u for u in units if u not in self]  # in any order: ids don't depend on it
        held, pieces_of, parts = self.lexicon.packed, self.vocabulary.pieces, self.parts
        split: dict[str, list[str]] = {}
        whole, missing = [], {}
        for u in fresh:
            ids = held(u.encode())
            if ids is not None:
                self[u] = ids
            elif u.isalpha() or (u[0] == " " and u[1:].isalpha()):  # a single piece, which the lexicon hasn't
                ids = parts.get(u)
                if ids is not None:
                    self[u] = ids
                else:
                    whole.append(u)
                    missing[u] = None
            else:
                split[u] = pieces_of(u)
        for pieces in split.values():
            for piece in pieces:
                if piece not in parts and piece not in missing:
                    missing[piece] = held(piece.encode())
        unknown = [p for p, ids in missing.items() if ids is None]
        missing.update(zip(unknown, self.vocabulary.merge_packed([p.encode() for p in unknown]), strict=True))
        parts |= missing
        for u in whole:
            self[u] = missing[u]
        for u, pieces in split.items():
            self[u] = b"".join([parts[p] for p in pieces])
        self._fresh, self._fresh_parts = fresh, list(missing)

    def forget(self) -> None:
        """Keep the words learnt first, which frequent words are among, within bounds."""
        for memory, fresh, most in ((self, self._fresh, MEMO_WORDS), (self.parts, self._fresh_parts, MEMO_PARTS)):
            full = len(memory) - len(fresh) >= most
            for key in fresh:
                if full or len(key) > MEMO_LENGTH:
                    del memory[key]
            while len(memory) > most:
                memory.popitem()

    def units(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """The words up to each special token of the text, and the token's id; last, the rest and None."""
        at = 0
        if self.vocabulary.special_pattern and "<" in text:
            for m in self.vocabulary.special_pattern.finditer(text):
                yield UNIT.findall(text[at : m.start()]), self.vocabulary.special[m[0]]
                at = m.end()
        yield UNIT.findall(text[at:] if at else text), None

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [list(self.units(t)) for t in texts]
        self.learn(set(chain.from_iterable(units for text in split for units, _ in text)))
        out = []
        for text in split:
            parts = []
            for units, special in text:
                parts += map(self.__getitem__, units)
                if special is not None:
                    parts.append(packed([special]))
            out.append(unpacked(b"".join(parts)))
        self.forget()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; ids that the vocabulary hasn't are passed over."""
        vocabulary = self.vocabulary
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        ids = ids[(ids >= 0) & (ids < len(vocabulary.bytes))]
        sizes = vocabulary.lengths[ids]
        ends = np.cumsum(sizes)
        # where each byte stands among those of all tokens: its token's start, then on one by one
        at = np.repeat(vocabulary.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return vocabulary.letters_of_all[at].tobytes().decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(shared: Broadcast) -> Encoder:
    """This worker's encoder of a broadcast (vocabulary, lexicon); made once in each worker."""
    key = shared.value["key"]
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value["vocabulary"], shared.value["lexicon"])
    return _ENCODERS[key]


# ---------------------------------------------------------------- on Spark


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's texts, nulls as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n): how often each word occurs in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in _texts(batch, "text"):
                seen.update(UNIT.findall(text))
                if len(seen) > 200_000:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
                    seen.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, words: int = LEXICON_WORDS) -> Broadcast:
    """Vocabulary and compiled lexicon of the ``words`` most frequent words of ``docs``, broadcast.

    Counts cover all documents. Words are taken by classes of like frequency, as many
    whole classes as fit, so at most ``words`` short words reach the driver.
    """
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        content = f.read()
    vocab = Vocabulary(content)
    # The cut is found from counts of words by size class, so that no task sends more than its share of the lexicon.
    level = F.floor(F.log2("n") * 16)
    repeated = word_counts(docs, text_col).where((F.col("n") > 1) & (F.length("word") <= MEMO_LENGTH)).select("word", level.alias("level"))
    repeated = Scratch(spark, "bpe").keep(repeated, "words")
    cut, taken = math.inf, 0
    for row in repeated.groupBy("level").count().orderBy(F.desc("level")).collect():
        taken += row["count"]
        if taken > words:
            break
        cut = row["level"]
    frequent = repeated.where(F.col("level") >= cut).select("word") if cut < math.inf else repeated.select("word").limit(0)
    lexicon = compile_lexicon({w.encode(): vocab.unit(w) for (w,) in frequent.collect()})
    return spark.sparkContext.broadcast({"key": hash((content, lexicon)), "vocabulary": content, "lexicon": lexicon})


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


#: Texts of about so many characters are encoded before a batch of rows is handed on.
SLICE_CHARS = 1_000_000


def _sliced(batch: pa.RecordBatch, texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, shared: Broadcast, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text, and, if ``decoded_col`` names a column, the text of these ids.

    Null texts are encoded as empty. All other columns stay as they are; existing
    columns of the new names are replaced.
    """
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    docs = docs.drop(*new)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{ids_col}` array<int>", *([f"`{decoded_col}` string"] if decoded_col else [])])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            texts = _texts(batch, text_col)
            for lo, hi in _sliced(batch, texts):
                part = batch.slice(lo, hi - lo)
                ids = encoder.encode_many(texts[lo:hi])
                columns = [*part.columns, _lists(ids)]
                if decoded_col:
                    columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *new])

    return docs.mapInArrow(encoded, schema)


def decode(rows: DataFrame, shared: Broadcast, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids. A null list gives an empty text; unknown ids are passed over."""
    rows = rows.drop(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{text_col}` string"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            texts = [encoder.decode(i for i in x.as_py() or () if i is not None) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return rows.mapInArrow(decoded, schema)
