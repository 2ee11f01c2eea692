"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once, with the character offsets of
its tokens. The spans of its turns are known from rendering, in order; binary
search finds the tokens of each span. Control strings are tokens of their own, so
no token crosses from a control string into a text.

Control strings inside roles and texts are escaped: a backslash goes in after the
first character of every control string, and after that of every string that is
one but for backslashes there. Unescaping takes one backslash out of each, so both
ways lead back exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import default_vocabulary
from lodestone.llm.common import with_computed

#: What a turn's text takes part in the loss for.
LOSS_ROLES = ("assistant",)


@dataclass(frozen=True)
class Template:
    """Control strings that mark a turn, and others that must not show up in texts.

    Of each control string the first character must be in none of the others but at their start.
    """

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    foreign: tuple[str, ...] = ("<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
    _escape: re.Pattern = field(init=False, repr=False, compare=False)
    _unescape: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        alternatives = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in (*self.own, *self.foreign))
        object.__setattr__(self, "_escape", re.compile(alternatives))
        object.__setattr__(self, "_unescape", re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in (*self.own, *self.foreign))))

    @property
    def own(self) -> tuple[str, str, str]:
        return self.turn, self.text, self.end

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation, and the span of each turn's escaped text in it."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.turn}{self.escape(role)}{self.text}", self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.end, "\n"]
            at = spans[-1][1] + len(self.end) + 1
        return "".join(parts), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted conversation."""
        turns = []
        for piece in formatted.split(self.end + "\n")[:-1]:
            role, text = piece[len(self.turn) :].split(self.text, 1)
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


def token_span(starts: list[int], ends: list[int], lo: int, hi: int) -> tuple[int, int]:
    """Range of the tokens that touch characters [lo, hi); both lists ascend."""
    return (bisect_right(ends, lo), bisect_left(starts, hi)) if lo < hi else (0, 0)


_TOKENIZERS: dict[int, object] = {}


def _tokenizer(shared: Broadcast, template: Template):
    from tokenizers import AddedToken, Tokenizer

    key = hash((shared.value, template))
    if key not in _TOKENIZERS:
        made = Tokenizer.from_str(shared.value.decode())
        made.no_padding()
        made.no_truncation()
        made.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in template.own])
        _TOKENIZERS[key] = made
    return _TOKENIZERS[key]


def masked(tokenizer, formatted: str, spans: list[tuple[int, int]], wanted: list[bool]) -> tuple[list[int], list[int], list[list[int]]]:
    """(ids, mask, token ranges): mask is 1 on the tokens of wanted spans."""
    encoded = tokenizer.encode(formatted, add_special_tokens=False)
    starts, ends = (list(x) for x in zip(*encoded.offsets, strict=True)) if encoded.offsets else ([], [])
    mask, ranges = [0] * len(starts), []
    for (lo, hi), yes in zip(spans, wanted, strict=True):
        if yes:
            first, last = token_span(starts, ends, lo, hi)
            mask[first:last] = [1] * (last - first)
            if first < last:
                ranges.append([starts[first], ends[last - 1]])
    return encoded.ids, mask, ranges


def format_conversations(
    rows: DataFrame,
    template: Template = Template(),  # noqa: B008
    vocabulary: str | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = LOSS_ROLES,
) -> DataFrame:
    """Rows (conv_id, formatted, ids, loss_mask, loss_spans), one per conversation.

    Turns are ordered by turn number, then role, then text; a null turn number comes
    first. Repeated rows are turns of their own. Null roles and texts are empty. A
    null conversation id is a conversation too. ``loss_spans``: character ranges of
    ``formatted`` that the masked tokens cover, one per turn with a text under the
    mask; the mask is 1 on exactly the tokens of these turns' texts.
    """
    spark = rows.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    whole = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def formatted(conversations: list) -> tuple:
        tokenizer, out = _tokenizer(shared, template), []
        for turns in conversations:
            pairs = [(t["role"], t["text"]) for t in turns]
            text, spans = template.render(pairs)
            out.append((text, *masked(tokenizer, text, spans, [r in loss_roles for r, _ in pairs])))
        return tuple(zip(*out, strict=True))

    ints = pa.list_(pa.int32())
    new = [("formatted", "string", pa.string()), ("ids", "array<int>", ints), ("loss_mask", "array<int>", ints), ("loss_spans", "array<array<int>>", pa.list_(ints))]
    return with_computed(whole, [F.col("turns")], new, formatted).drop("turns")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Rows (conv_id, turns, loss_text, formatted_chars): the turns parsed out of ``formatted``, and the unescaped text under the mask."""

    def back(texts: list, spans: list) -> tuple:
        turns = [[{"role": r, "text": t} for r, t in template.parse(x)] for x in texts]
        loss = ["".join(template.unescape(x[a:b]) for a, b in own) for x, own in zip(texts, spans, strict=True)]
        return turns, loss, [len(x) for x in texts]

    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    new = [("turns", "array<struct<role: string, text: string>>", pa.list_(turn)), ("loss_text", "string", pa.string()), ("formatted_chars", "long", pa.int64())]
    chosen = formatted.select("conv_id", "formatted", "loss_spans")
    return with_computed(chosen, [F.col("formatted"), F.col("loss_spans")], new, back).drop("formatted", "loss_spans")
