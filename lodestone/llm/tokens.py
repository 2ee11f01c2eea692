"""Token counts of sections, from one encoding of each whole document.

The document is encoded once; its tokens have character spans, and so have its
sections. The two ordered lists of intervals are joined by binary search. A token
that crosses a boundary goes to one section by ``rule``:

* ``first``: the section that holds its first character;
* ``most``: the section that holds most of its characters, the earlier one of equals.

Counts of the sections therefore add up to the document's tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import SLICE_CHARS, encoder_of
from lodestone.llm.common import with_computed

RULES = ("first", "most")


def token_spans(text: str, ids: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends): the characters each token has a byte of; ``token_bytes``: length by id."""
    ends = np.cumsum(token_bytes[ids])
    starts = ends - token_bytes[ids]
    if not text.isascii() and len(ids):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1
    return starts, ends


def line_starts(text: str) -> np.ndarray:
    """Where the sections of a text begin that are its lines, each with its line break."""
    found, at = [0], text.find("\n")
    while at >= 0:
        found.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(found, np.int64)


def attributed(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int, rule: str = "first") -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary). ``sections``: ascending starts, the first 0; empty sections get none."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    owner = first
    if rule == "most" and len(crossing):
        owner = first.copy()
        bounds = np.append(sections, length)
        for t in crossing.tolist():
            own = range(first[t], last[t] + 1)
            owner[t] = max(own, key=lambda s: (min(bounds[s + 1], ends[t]) - max(bounds[s], starts[t]), -s))
    return np.bincount(owner, minlength=len(sections)), len(crossing)


def section_tokens(
    docs: DataFrame, shared: Broadcast, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), separator: str = "\n\n", rule: str = "first"
) -> DataFrame:
    """Rows (doc_id, n_tokens, field_tokens, section_tokens, n_crossing), one per document row.

    ``fields`` are joined by ``separator``, which belongs to the field before it, and
    encoded as one text. ``field_tokens`` has the tokens of each field,
    ``section_tokens`` those of each line of the whole, and ``n_crossing`` how many
    tokens cross from line to line. Null fields are empty. A text without characters
    has one line without tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def rows(*columns: list) -> tuple:
        encoder = encoder_of(shared)
        token_bytes = encoder.vocabulary.lengths
        texts, out, at = [[t or "" for t in column] for column in columns], [], 0
        while at < len(texts[0]):
            upto, size = at, 0
            while upto < len(texts[0]) and size < SLICE_CHARS:
                size += sum(len(column[upto]) for column in texts)
                upto += 1
            whole = [separator.join(column[i] for column in texts) for i in range(at, upto)]
            for i, text, ids in zip(range(at, upto), whole, encoder.encode_many(whole), strict=True):
                starts, ends = token_spans(text, ids, token_bytes)
                lengths = [len(column[i]) + len(separator) for column in texts]
                by_field, _ = attributed(starts, ends, np.cumsum([0, *lengths[:-1]]), len(text), rule)
                by_line, crossing = attributed(starts, ends, line_starts(text), len(text), rule)
                out.append((len(ids), by_field.tolist(), by_line.tolist(), crossing))
            at = upto
        return tuple(zip(*out, strict=True))

    counts = pa.list_(pa.int32())
    new = [("n_tokens", "long", pa.int64()), ("field_tokens", "array<int>", counts), ("section_tokens", "array<int>", counts), ("n_crossing", "long", pa.int64())]
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"field{i}") for i, c in enumerate(fields)))
    return with_computed(named, [F.col(f"field{i}") for i in range(len(fields))], new, rows).select("doc_id", *(n for n, *_ in new))
