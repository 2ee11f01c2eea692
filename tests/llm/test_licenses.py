import re

import pytest

from lodestone.llm import licenses, queries

SAMPLES = [
    ("Released under the MIT License.", {"mit"}),
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", {"apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("SPDX-License-Identifier: LGPL-2.1-only", {"lgpl-2.1"}),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa-4.0"}),
    ("Text is available under CC BY-SA 3.0.", {"cc-by", "cc-by-sa"}),
    ("GNU Affero General Public License version 3", {"agpl-3.0", "gpl"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd"}),
    ("Copyright (c) 2020 Someone. ALL RIGHTS RESERVED.", {"copyright", "reserved"}),
    ("placed in the public domain", {"public-domain"}),
    ("they sat under the mit of an apache in boost and ruby by general license", set()),
    ("Copyright is a fine word, as are isc, zlib and license.", set()),
]


@pytest.mark.parametrize(("text", "labels"), SAMPLES)
def test_samples(text, labels):
    n, found = licenses.scan(text)
    assert {f.label for f in licenses.resolved(found)} == labels
    assert n == len(re.findall("[^\x00-/:-@\\[-`{-\x7f]+", text))


def test_hundreds_of_rules_and_no_gate_hides_a_match():
    assert len(licenses.rules()) > 300 and all(r.names for r in licenses.rules())
    for text, _ in SAMPLES:
        line = b" %b " % b" ".join(text.encode().translate(licenses._TO_WORDS).split())
        ungated = {(r.label, r.rank) for r in licenses.rules() if r.pattern.search(line)}
        assert ungated == {(f.label, f.rank) for f in licenses.scan(text)[1]}
    for label, name, held in licenses.FAMILIES:  # every form of a name holds one of its words
        for word in ["gpl", "gpl3", "gplv3", "gpl v3", "agplv3", "lgplv3", "lgpl 2.1", "mplv2", "cc0", "CC-0", "EPL 2", "EUPL v1.2", "general public license 2", "beer-ware license", "PSF license", label]:
            line = b" %b " % b" ".join(word.encode().translate(licenses._TO_WORDS).split())
            rule = next(r for r in licenses.rules() if r.label == label and r.rank == 4)
            assert not rule.pattern.search(line) or (rule.names & set(line.split()) and rule.gates <= set(line.split()))


def found(start, end, label, rank, base=False):
    return licenses.Found(start, end, label, rank, 0.5, base)


def brute_resolved(all_found):
    """By ranks, each detection against all others."""
    stay = []
    for rank in sorted({f.rank for f in all_found if not f.base}):
        own = sorted({f for f in all_found if f.rank == rank and not f.base}, key=lambda f: (f.start, -f.end, f.label))
        own = [f for f in own if not any(f.start < s.end and s.start < f.end for s in stay)]
        keep = []
        for f in own:
            if not any(k.start <= f.start and f.end <= k.end for k in keep):
                keep.append(f)
        stay += keep
    return sorted([f for f in all_found if f.base] + stay, key=lambda f: (f.start, f.end, f.label, f.rank))


def test_resolution_by_rank_and_containment():
    import random

    rnd = random.Random(2)
    for _ in range(500):
        rows = [found(a := rnd.randint(0, 20), a + rnd.randint(1, 6), rnd.choice("xyz"), rnd.randint(1, 3)) for _ in range(rnd.randint(0, 12))]
        rows += [found(a := rnd.randint(0, 20), a + 2, "b", 0, True) for _ in range(2)]
        assert licenses.resolved(rows) == brute_resolved(rows)


WORD = re.compile("[^\x00-/:-@\\[-`{-\x7f]+")


def brute_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_query_equals_brute_force(spark, tmp_path, table):
    odd = [None, "", " .!", "CC BY", "cc by cc-by cc/by", "écc by", "cc  BY ", "All rights\nreserved. all rights reserved", "cc_by ccby", "General Public\tLicense v3 " * 2000, "x " * 300_000 + "cc by", "ALL RIGHTS RESERVED" * 3]
    where = "/root/testdata/sf0.01"
    if table == "odd":
        rows = [(i, t, "clash", 1) for i, t in enumerate(odd)] + [(3, "CC BY", "clash", 2), (None, "cc by", None, None)]
        spark.createDataFrame(rows, "doc_id long, text string, document string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
        where = str(tmp_path)
    got = queries.op13_license_scan(spark, where).collect()
    texts = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
    expect = sorted(((r["doc_id"] is None, r["doc_id"] or 0), *map(str, brute_base(r["text"]))) for r in texts)
    assert sorted(((r[0] is None, r[0] or 0), *map(str, r[1:6])) for r in got) == expect
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) for r in got)
    if table == "odd":
        assert licenses.detect(spark.read.parquet(f"{where}/documents.parquet").limit(0)).count() == 0
    else:
        assert {"mit", "apache-2.0", "gpl-3.0"} <= {x for r in got for x in r["labels"].split(",")}
