"""Ignore files as rules: ordered patterns, of which the last that matches a path or a folder above it decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (pattern, replacement) from a glob to a regular expression, in this order
_TRANSLATED = (
    (r"\\([A-Za-z0-9#! ])", "$1"),  # escapes of what needs none
    (r"([.+^$(){}|])", r"\\$1"),
    (r"\[(?![^\]/]+\])", r"\\["),  # a bracket that isn't closed is itself
    (r"(?<!\\)\[(?:!|\\\^)", "[^"),
    (r"^(?:\*\*/)+", "\u0001"),
    (r"/(?:\*\*/)+", "/\u0001"),
    (r"/\*\*$", "/\u0002"),
    (r"(?<!\\)\*+", "[^/]*"),
    (r"(?<!\\)\?", "[^/]"),
    ("\u0001", "(?:.*/)?"),
    ("\u0002", ".+"),
)


def _rule(line: Column) -> Column:
    """Struct (pattern, negated, folders) of a line."""
    negated = line.startswith("!")
    body = F.regexp_replace(line, "^!", "")
    folders = body.endswith("/")
    body = F.regexp_replace(body, "/+$", "")
    # a slash within the pattern ties it to the top
    tied = F.contains(body, F.lit("/"))
    glob = reduce(lambda c, r: F.regexp_replace(c, *r), _TRANSLATED, F.regexp_replace(body, "^/", ""))
    return F.struct(F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), glob, F.lit("$")).alias("pattern"), negated.alias("negated"), folders.alias("folders"))


def rules(text: Column) -> Column:
    """The rules of an ignore file in order; blank lines and comments are none, nor is a null text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.regexp_replace(x, r"(?<!\\)\s+$", ""))
    return F.transform(F.filter(lines, lambda x: ~x.rlike(r"^(#|!?/*$)")), _rule)


def is_ignored(path: Column, rules: Column) -> Column:
    """Whether the last rule that matches a path, or any folder above it, ignores it.

    A file in an ignored folder can't be brought back by a later rule, as its folder isn't entered.
    Paths are relative to the ignore file, with forward slashes.
    """
    parts = F.split(path, "/")

    def out(i: Column) -> Column:
        here = F.array_join(F.slice(parts, F.lit(1), i), "/")
        hits = F.filter(rules, lambda r: (~r["folders"] | (i < F.size(parts))) & F.rlike(here, r["pattern"]))
        return F.coalesce(~F.try_element_at(hits, F.lit(-1))["negated"], F.lit(False))

    return F.exists(F.sequence(F.lit(1), F.size(parts)), out)


def kept(files: DataFrame, ignore: DataFrame, key: str) -> DataFrame:
    """``files`` (key, path) without what the ignore file of its ``key`` in ``ignore`` (key, text) leaves out.

    A key has one ignore file at most; files of keys without one all stay.
    """
    held = ignore.select(F.col(key).alias("__key"), rules(F.col("text")).alias("__rules"))
    joined = files.join(held, files[key] == held["__key"], "left")
    out = joined.where(F.col("__rules").isNull() | ~is_ignored(F.col("path"), F.col("__rules")))
    return out.select(*(files[c] for c in files.columns))
