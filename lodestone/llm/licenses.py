"""License scans: ordered signature rules over the words of whole texts.

A text becomes its words, lower-cased and joined by single spaces. Every rule is a regular
expression over these words with a label, a rank and a weight, and with gates: words that
any match holds. A rule is tried only on texts that have all its gates, so nearly all texts
cost one split and one look at a set. Detections are then resolved by rank and by
containment (see :func:`resolved`). Each text is a row of its own: nothing is shuffled, and
no state passes from one to another.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from functools import cache
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import with_computed

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Families of licenses. Label, pattern of the name as words (``~`` stands for the
# word "license" or nothing), words of which every form of the name holds one.
FAMILIES = (
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)~", "0bsd|bsd"),
    ("afl-3.0", "academic free ~(?:v ?|version )?3(?: 0)?", "academic"),
    ("agpl-3.0", "(?:gnu )?(?:affero general public ~|agpl ?)(?:v ?|version )?3(?: 0)?", "affero|agpl|agpl3|agplv3"),
    ("apache-1.1", "apache ~(?:software ~)?(?:v ?|version )?1 1", "apache"),
    ("apache-2.0", "apache ~(?:software ~)?(?:v ?|version )?2(?: 0)?", "apache"),
    ("artistic-1.0", "artistic ~(?:v ?|version )?1(?: 0)?", "artistic"),
    ("artistic-2.0", "artistic ~(?:v ?|version )?2(?: 0)?", "artistic"),
    ("beerware", "beer ?ware~", "beer|beerware"),
    ("blueoak-1.0", "blue oak model ~(?:v ?|version )?1(?: 0 0)?", "oak"),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause)~", "bsd|freebsd"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause)~", "bsd"),
    ("bsd-4-clause", "(?:original bsd|4 clause bsd|bsd 4 clause)~", "bsd"),
    ("bsl-1.0", "boost software ~(?:v ?|version )?1(?: 0)?", "boost"),
    ("busl-1.1", "business source ~(?:v ?|version )?1 1", "source"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?~", "cc|commons"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?~", "cc|commons"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: [1-4] [05])?~", "cc|commons"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?~", "cc|commons"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))(?: [1-4] [05])?~", "cc|commons"),
    ("cc-by-4.0", "(?:cc by|creative commons attribution) 4 0(?: international)?~", "cc|commons"),
    ("cc-by-3.0", "(?:cc by|creative commons attribution) 3 0(?: unported)?~", "cc|commons"),
    ("cc-by-2.0", "(?:cc by|creative commons attribution) 2 0(?: generic)?~", "cc|commons"),
    ("cc0-1.0", "(?:cc0|cc zero|creative commons zero)(?: (?:v ?)?1(?: 0)?)?(?: universal)?~", "cc0|cc|commons"),
    ("cddl-1.0", "(?:common development and distribution ~|cddl ?)(?:v ?|version )?1(?: [01])?", "distribution|cddl|cddl1|cddlv1"),
    ("cecill-2.1", "cecill ~(?:v ?|version )?2(?: 1)?", "cecill"),
    ("cpl-1.0", "common public ~(?:v ?|version )?1(?: 0)?", "common"),
    ("ecl-2.0", "educational community ~(?:v ?|version )?2(?: 0)?", "educational"),
    ("epl-1.0", "(?:eclipse public ~|epl ?)(?:v ?|version )?1(?: 0)?", "eclipse|epl|epl1|eplv1"),
    ("epl-2.0", "(?:eclipse public ~|epl ?)(?:v ?|version )?2(?: 0)?", "eclipse|epl|epl2|eplv2"),
    ("eupl-1.2", "(?:european union public ~|eupl ?)(?:v ?|version )?1 [12]", "european|eupl|eupl1|euplv1"),
    ("gfdl", "(?:gnu )?(?:free documentation ~|gfdl ?)(?:(?:v ?|version )?1 [123])?", "documentation|gfdl|gfdl1|gfdlv1"),
    ("gpl-1.0", "(?:gnu )?(?:general public ~|gpl ?)(?:v ?|version )?1(?: 0)?", "general|gpl|gpl1|gplv1"),
    ("gpl-2.0", "(?:gnu )?(?:general public ~|gpl ?)(?:v ?|version )?2(?: 0)?", "general|gpl|gpl2|gplv2"),
    ("gpl-3.0", "(?:gnu )?(?:general public ~|gpl ?)(?:v ?|version )?3(?: 0)?", "general|gpl|gpl3|gplv3"),
    ("hpnd", "historical permission notice and disclaimer~", "historical"),
    ("isc", "isc~", "isc"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public ~|lgpl ?)(?:v ?|version )?2 1", "lesser|lgpl|lgpl2|lgplv2"),
    ("lgpl-2.0", "(?:gnu )?(?:library general public ~|lgpl ?)(?:v ?|version )?2(?: 0)?", "library|lgpl|lgpl2|lgplv2"),
    ("lgpl-3.0", "(?:gnu )?(?:lesser general public ~|lgpl ?)(?:v ?|version )?3(?: 0)?", "lesser|lgpl|lgpl3|lgplv3"),
    ("lppl-1.3", "latex project public ~(?:v ?|version )?1 3c?", "latex"),
    ("mit", "(?:mit|expat)~", "mit|expat"),
    ("mit-0", "mit (?:no attribution|0)~", "mit"),
    ("mpl-1.1", "(?:mozilla public ~|mpl ?)(?:v ?|version )?1 1", "mozilla|mpl|mpl1|mplv1"),
    ("mpl-2.0", "(?:mozilla public ~|mpl ?)(?:v ?|version )?2(?: 0)?", "mozilla|mpl|mpl2|mplv2"),
    ("ms-pl", "microsoft public ~", "microsoft"),
    ("ms-rl", "microsoft reciprocal ~", "microsoft"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?~", "ncsa"),
    ("odbl-1.0", "(?:open database ~|odbl ?)(?:(?:v ?|version )?1(?: 0)?)?", "database|odbl|odbl1|odblv1"),
    ("ofl-1.1", "(?:sil )?open font ~(?:(?:v ?|version )?1 1)?", "font"),
    ("openssl", "openssl~", "openssl"),
    ("osl-3.0", "open software ~(?:v ?|version )?3(?: 0)?", "software"),
    ("php-3.01", "php ~(?:v ?|version )?3(?: 01)?", "php"),
    ("postgresql", "postgresql~", "postgresql"),
    ("psf-2.0", "(?:psf|python software foundation)~(?: (?:v ?|version )?2(?: 0)?)?", "psf|python"),
    ("ruby", "ruby~", "ruby"),
    ("sspl-1.0", "(?:server side public ~|sspl ?)(?:(?:v ?|version )?1(?: 0)?)?", "side|sspl|sspl1|ssplv1"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("upl-1.0", "universal permissive ~(?:(?:v ?|version )?1(?: 0)?)?", "permissive"),
    ("w3c", "w3c(?: software)?(?: notice and)?~", "w3c"),
    ("wtfpl", "wtfpl|do what the f[a-z]+ you want to public ~", "wtfpl|want"),
    ("x11", "(?:x11|x consortium)~", "x11|consortium"),
    ("zlib", "zlib(?: libpng)?~", "zlib"),
    ("zpl-2.1", "zope public ~(?:v ?|version )?2 [01]", "zope"),
)

# Forms in which a name (NAME) grants something: rank (smaller wins), weight, gate, pattern.
FORMS = (
    (1, 1.0, "spdx", "spdx license identifier NAME(?: or later| only)?"),
    (2, 0.95, "under", "(?:re)?(?:licensed|released|distributed|published|available|provided|covered|issued|shared) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:the )?NAME"),
    (2, 0.95, "under", "under (?:the )?(?:terms (?:and conditions )?of (?:the )?)(?:the )?NAME"),
    (3, 0.8, "license", "(?:license|see the license|license is|licence) (?:is )?(?:the )?NAME"),
    (4, 0.6, "license", "NAME"),
)

# Sentences and addresses that stand for a license by themselves: label, rank, weight, gates, pattern.
SENTENCES = (
    ("mit", 1, 0.95, "permission hereby granted charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 1, 0.95, "permission fee hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 2, 0.9, "redistribution binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 1, 0.95, "neither endorse promote", "neither the name of [^ ]+(?: [^ ]+){0,12}? may be used to endorse or promote products"),
    ("bsd-4-clause", 1, 0.95, "advertising acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", 1, 0.95, "apache org licenses", "(?:www )?apache org licenses license 2 0"),
    ("gpl", 2, 0.9, "redistribute modify gnu", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", 1, 0.95, "version 2 foundation", "free software foundation either version 2 of the license"),
    ("gpl-3.0", 1, 0.95, "version 3 foundation", "free software foundation either version 3 of the license"),
    ("gpl", 3, 0.7, "gnu org licenses", "(?:www )?gnu org licenses gpl(?: html)?"),
    ("lgpl", 3, 0.7, "gnu org licenses", "(?:www )?gnu org licenses lgpl(?: html)?"),
    ("agpl", 3, 0.7, "gnu org licenses", "(?:www )?gnu org licenses agpl(?: html)?"),
    ("mpl-2.0", 1, 0.95, "mozilla mpl", "(?:www )?mozilla org (?:en us )?mpl 2 0"),
    ("unlicense", 1, 0.95, "unencumbered domain", "free and unencumbered software released into the public domain"),
    ("zlib", 1, 0.95, "warranty express implied altered", "provided as is without any express or implied warranty"),
    ("bsl-1.0", 1, 0.95, "boost org", "(?:www )?boost org license 1 0"),
    ("cc0-1.0", 1, 0.95, "creativecommons zero", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 2, 0.8, "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 4, 0.5, "public domain", "(?:is|are) in the public domain"),
    ("opensource-mit", 3, 0.8, "opensource mit", "opensource org licenses mit(?: license)?(?: php)?"),
    ("opensource-bsd", 3, 0.8, "opensource bsd", "opensource org licenses bsd(?: license| [23] clause)?(?: php)?"),
    ("apache", 5, 0.5, "apache license", "apache license"),
    ("gpl-unversioned", 5, 0.5, "general public license", "gnu general public license"),
    ("lgpl", 5, 0.5, "lesser public license", "(?:gnu )?lesser general public license"),
    ("agpl", 5, 0.5, "affero public license", "(?:gnu )?affero general public license"),
    ("bsd", 5, 0.5, "bsd", "bsd (?:style )?license"),
    ("mozilla", 5, 0.5, "mozilla public license", "mozilla public license"),
    ("creative-commons", 5, 0.5, "creative commons", "creative commons(?: attribution)?(?: license)?"),
    ("proprietary", 3, 0.7, "confidential proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 4, 0.5, "unauthorized copying", "unauthorized copying of this (?:file|work|document)"),
    ("proprietary", 4, 0.5, "may not reproduced", "may not be reproduced (?:or distributed )?without"),
    ("proprietary", 4, 0.5, "reproduction prohibited", "reproduction (?:in whole or in part )?(?:is )?(?:strictly )?prohibited"),
    ("warranty-disclaimer", 5, 0.3, "warranties conditions kind", "without warranties or conditions of any kind"),
    ("warranty-disclaimer", 5, 0.3, "warranty merchantability", "without even the implied warranty of merchantability"),
    ("copyright", 6, 0.3, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", 6, 0.3, "copyright", "copyright holders?"),
    ("unknown-license", 7, 0.2, "under license", "(?:licensed|released|distributed) under (?:the |a |an )?(?:[^ ]+ ){1,6}?license"),
)

# Licenses of Creative Commons by the parts of their addresses.
CC_PARTS, CC_VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")


class Rule(NamedTuple):
    """One signature. Any text with a match holds all words of ``gates`` and one of ``names``."""

    label: str
    rank: int
    weight: float
    gates: frozenset
    names: frozenset
    pattern: re.Pattern
    base: bool


def _rule(label: str, rank: int, weight: float, gates: str, pattern: str, names: str = "", base: bool = False) -> Rule:
    # A match begins with the space before its first word and ends before the one after its last.
    words = frozenset(gates.encode().split())
    one_of = frozenset(names.encode().split(b"|")) if names else frozenset([max(words, key=lambda g: (len(g), g))])
    return Rule(label, rank, weight, words, one_of, re.compile(f" (?:{pattern})(?= )".encode()), base)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules by rank: base phrases, families in each form, sentences, addresses."""
    out = [_rule(label, 0, 0.3 if label == "reserved" else 0.6, phrase, re.escape(phrase).replace("\\ ", " "), base=True) for phrase, label in BASE.items()]
    for (label, name, held), (rank, weight, word, form) in product(FAMILIES, FORMS):
        said = f"(?:{name})"
        # the word stands before what follows it, or at the end, and may be missing there
        said = said.replace(" ~", " (?:license )?").replace("~", "(?: license)?")
        bare = form == "NAME"
        if bare and not re.search("[0-9]", name):
            said = f"{said}(?<=license)"  # a name without a version may be any word
        out.append(_rule(label, rank, weight, "" if bare else word, form.replace("NAME", f"(?:{said}(?<! ))"), held))
    out += [_rule(*s) for s in SENTENCES]
    for parts, version in product(CC_PARTS, CC_VERSIONS):
        label = f"cc-{parts.replace(' ', '-')}-{version.replace(' ', '.')}"
        out.append(_rule(label, 1, 0.95, "creativecommons licenses", f"creativecommons org licenses {parts} {version}"))
    return tuple(sorted(out, key=lambda r: r.rank))


# What isn't a letter or digit of ASCII, nor beyond ASCII, separates words.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@cache
def _by_name() -> dict[bytes, list[Rule]]:
    """Rules by the words of which a match holds one."""
    by = defaultdict(list)
    for rule in rules():
        for word in rule.names:
            by[word].append(rule)
    return dict(by)


class Found(NamedTuple):
    """A detection: words ``start`` to ``end`` (exclusive), counted from 0."""

    start: int
    end: int
    label: str
    rank: int
    weight: float
    base: bool


def scan(text: str | None) -> tuple[int, list[Found]]:
    """The number of words of a text and all its detections, unresolved, by place and rule."""
    words = (text or "").encode().translate(_TO_WORDS).split()
    held = set(words)
    by = _by_name()
    tried = {id(r): r for w in by.keys() & held for r in by[w] if r.gates <= held}.values()
    if not tried:
        return len(words), []
    line = b" %b " % b" ".join(words)
    places = [(m.start(), m.end(), rule) for rule in tried for m in rule.pattern.finditer(line)]
    places.sort(key=lambda x: x[:2])
    out, at, n = [], 0, 0
    for start, end, rule in places:
        n += line.count(b" ", at, start)
        at = start
        out.append(Found(n, n + line.count(b" ", start, end), rule.label, rule.rank, rule.weight, rule.base))
    return len(words), out


def resolved(found: list[Found]) -> list[Found]:
    """What stays of ``found``, by place.

    Base detections always stay and take no part in what follows. Ranks are taken in order.
    A detection goes if it meets one that stayed under a smaller rank, or if one of its own
    rank contains it: the longer of two stays, of equal ones the smaller label.
    """
    stay, taken = [f for f in found if f.base], []  # taken: disjoint intervals in order
    by_rank = defaultdict(set)
    for f in found:
        if not f.base:
            by_rank[f.rank].add(f)
    for rank in sorted(by_rank):
        kept, reach = [], -1
        for f in sorted(by_rank[rank], key=lambda f: (f.start, -f.end, f.label, f.weight)):
            i = bisect_left(taken, (f.end,)) - 1  # the last interval that begins before f ends
            if f.end > reach and not (i >= 0 and taken[i][1] > f.start):
                kept.append(f)
                reach = f.end
        stay += kept
        merged = []
        for a, b in sorted(taken + [(f.start, f.end) for f in kept]):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        taken = merged
    return sorted(stay, key=lambda f: (f.start, f.end, f.label, f.rank))


_DETECTIONS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rank", pa.int32()), ("weight", pa.float64()), ("base", pa.bool_())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, n_words, detections, score), a row for each document row.

    ``detections``: array of (start, end, label, rank, weight, base) in words of the whole
    text, by place. ``score`` is the largest weight among them, 0 without any. Null and empty
    texts have no words and no detections; repeated rows get equal results; an empty table
    gives no rows; other columns don't matter.
    """

    def compute(texts: list) -> tuple:
        counts, found, scores = [], [], []
        for text in texts:
            n, raw = scan(text)
            kept = resolved(raw)
            counts.append(n)
            found.append([f._asdict() for f in kept])
            scores.append(max((f.weight for f in kept), default=0.0))
        return counts, pa.array(found, _DETECTIONS), scores

    new = [("n_words", "long", pa.int64()), ("detections", "array<struct<start:bigint,end:bigint,label:string,rank:int,weight:double,base:boolean>>", _DETECTIONS), ("score", "double", pa.float64())]
    rows = docs.select(F.col(id_col).alias("document"), F.col(text_col).alias("whole"))
    return with_computed(rows, [F.col("whole")], new, compute).select(F.col("document").alias(id_col), *(n for n, *_ in new))


def base_places(column: str = "detections") -> Column:
    """Column: the detections of base phrases."""
    return F.filter(column, lambda d: d["base"])


def label_list(detections: Column) -> Column:
    """Column: the different labels of ``detections``, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")
