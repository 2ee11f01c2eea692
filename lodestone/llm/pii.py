"""Personal data: patterns, secrets, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers, and secrets: long
random-looking strings such as keys and tokens. Each distinct value found is a protected
entity, and so is what it belongs to: the domain of an address, the network of an IP
address, the issuer of a card, the area of a phone number. So a value that stands in a
single text still counts toward its owner. Terms may reveal an entity too: over the
distinct texts of the corpus, a term ``t`` tells about an entity ``e`` the pointwise
information ``log2(N * n(t,e) / (n(t) * n(e)))`` of the ``log2(N / n(e))`` bits that
make up ``e``. Where that share reaches ``DISCLOSURE``, with ``n(t,e)`` of at least
``SUPPORT`` texts, the term is sanitised in texts that hold the entity: ``redact`` puts
a general label in its place, or removes it. A pair seen in one text alone says nothing
of a connection: any word that stands nowhere else would be one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, free_names, pieces, plain, with_computed

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
ADDED = ("secret", "term")
#: Share of an entity's information from which a term discloses it.
DISCLOSURE = 0.8
#: Distinct texts that must hold term and entity together.
SUPPORT = 2
#: Bits of information that an owner must have to be protected: what many texts share identifies nobody.
OWNER_BITS = 8
#: Characters of a secret at least, and digits among them.
SECRET_CHARS, SECRET_DIGITS = 24, 4

# An e-mail match starts at the first of the local characters before an @ that is not
# part of the match before; so each @ is looked at once, whatever stands around it.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive runs of digits, begun at a run's first digit, can't be scanned twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,}+={0,2}")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start, then kind; code points, end exclusive."""
    found = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and not x[:-3].strip("0") for x in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def secret_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of secrets: runs of key characters with digits and letters mixed, outside ``taken``."""
    out, found = [], sorted(taken)
    for m in _SECRET.finditer(text):
        value = m[0]
        digits = sum(c.isdigit() for c in value)
        letters = sum(c.isalpha() for c in value)
        if digits >= SECRET_DIGITS and letters >= SECRET_DIGITS and len(set(value)) >= 8 and not any(s < m.end() and m.start() < e for s, e, _ in found):
            out.append((*m.span(), len(KINDS)))
    return out


def entity(text: str, start: int, end: int, kind: int) -> str:
    """The protected value: kind, and the match in one way of writing."""
    value = text[start:end]
    return f"{(*KINDS, *ADDED)[kind]}:{value.lower() if kind < 2 else value if kind >= len(KINDS) else re.sub('[^0-9]', '', value)}"


def entities(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """The protected values of a text, and what they belong to."""
    out = set()
    for span in spans:
        own = entity(text, *span)
        out.add(own)
        kind, value = own.split(":", 1)
        if kind == "email":
            out.add(f"domain:{value.rpartition('@')[2]}")
        elif kind == "ip":
            out.add(f"network:{value.rpartition('.')[0]}")
        elif kind in ("card", "phone"):
            out.add(f"{'issuer' if kind == 'card' else 'area'}:{value[:6 if kind == 'card' else 4]}")
    return out


OWNERS = ("domain", "network", "issuer", "area")


def terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of words outside ``spans``, in lower case."""
    out, it, cover = [], iter(sorted(spans)), (-1, -1)
    upcoming = next(it, None)
    for m in _WORD.finditer(text):
        s, e = m.span()
        while upcoming and upcoming[0] < e:
            cover = max(cover, (upcoming[1], upcoming[0]))
            upcoming = next(it, None)
        if s >= cover[0]:
            out.append((m[0].lower(), s, e))
    return out


_SPAN = "struct<start: int, end: int, kind: string>"


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_key, spans, entities, terms), one per document row.

    ``terms`` has every occurrence of a word in texts with an entity, else nothing.
    """

    def rows(texts: list) -> tuple:
        spans, held, words = [], [], []
        for text in texts:
            found = base_spans(text)
            found = sorted([*found, *secret_spans(text, found)], key=lambda x: (x[0], x[2]))
            spans.append([{"start": s, "end": e, "kind": (*KINDS, *ADDED)[k]} for s, e, k in found])
            held.append(sorted(entities(text, found)))
            words.append([{"term": t, "start": s, "end": e} for t, s, e in terms(text, found)] if found else [])
        return spans, held, words

    place = [("start", pa.int32()), ("end", pa.int32())]
    new = [
        ("spans", f"array<{_SPAN}>", pa.list_(pa.struct([*place, ("kind", pa.string())]))),
        ("entities", "array<string>", pa.list_(pa.string())),
        ("terms", "array<struct<term: string, start: int, end: int>>", pa.list_(pa.struct([("term", pa.string()), *place]))),
    ]
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return with_computed(chosen, [F.col("text")], new, rows).drop("text")


#: Candidate terms, and the telling terms of all texts, are sent to the tasks if they are at most so many.
BROADCAST_TERMS = 200_000


def term_texts(docs: DataFrame, candidates: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (term, n_term): in how many distinct texts of ``docs`` each candidate term stands."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = spark.sparkContext.broadcast({r["term"] for r in candidates.collect()}) if candidates.count() <= BROADCAST_TERMS else None

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(batches):
            found = [list(_distinct_words(x, wanted.value if wanted else None)) for x in part["text"]]
            held = [bool(f) for f in found]
            if any(held):
                yield pd.DataFrame({"text_key": part["text_key"][held], "terms": pd.Series(found, index=part.index)[held]})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for part in batches:
            for terms in part["terms"]:
                total.update(terms)
            if len(total) > 500_000:
                yield plain(pd.DataFrame({"term": list(total.keys()), "n": list(total.values())}))
                total.clear()
        if total:
            yield plain(pd.DataFrame({"term": list(total.keys()), "n": list(total.values())}))

    texts = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).mapInPandas(rows, "text_key long, terms array<string>").dropDuplicates(["text_key"])
    counts = texts.select("terms").mapInPandas(summed, "term string, n long")
    counts = counts if wanted else counts.join(candidates, "term", "left_semi")
    return counts.groupBy("term").agg(F.sum("n").alias("n_term"))


def _distinct_words(text: str, wanted: set[str] | None) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words & wanted if wanted is not None else words


def disclosures(docs: DataFrame, rows: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(disclosures, places): terms that disclose entities of ``docs``, and the texts where they do.

    Rows (entity, term, n_pair, n_term, n_entity, share), written, and rows (text_key, term).
    ``rows`` is the written result of :func:`found_spans`. Counts are of distinct texts.
    """
    held = rows.where(F.size("entities") > 0).select("text_key", "entities", F.array_distinct("terms.term").alias("terms"))
    texts = scratch.keep(held.dropDuplicates(["text_key"]), "texts")
    entities = texts.select("text_key", F.explode("entities").alias("entity"))
    total = F.lit(float(max(1, rows.select("text_key").distinct().count())))
    whole = F.log2(total / F.col("n_entity"))
    protected = (F.col("n_entity") >= SUPPORT) & (~F.substring_index("entity", ":", 1).isin(*OWNERS) | (whole >= OWNER_BITS))
    supported = scratch.keep(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(protected), "supported")

    def share(n_pair, n_term):
        return F.when(whole > 0, F.log2(total * n_pair / (n_term * F.col("n_entity"))) / whole).otherwise(0.0)

    # A term is in at least as many texts of the corpus as of those with an entity, and meets an entity in
    # at most all of its texts. What falls short by these bounds falls short by the true counts, so an entity
    # is joined with the terms rare enough for it only. The bound grows with the entity: none passes the largest's.
    def near(n_entity, n_term):
        most = F.log2(total / n_entity)
        return F.when(most > 0, F.log2(total / n_term) / most).otherwise(0.0) >= DISCLOSURE - 1e-9

    terms = texts.select("text_key", F.explode("terms").alias("term"))
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_held")).where(F.col("n_held") >= SUPPORT)
    largest = supported.where(F.col("n_entity") < total).agg(F.max("n_entity")).first()[0]
    if largest is None:
        return _none(scratch)
    counted = scratch.keep(counted.where(near(F.lit(largest), F.col("n_held"))), "counted")
    placed = scratch.keep(terms.join(counted, "term"), "placed")
    held_by = scratch.keep(entities.join(supported, "entity"), "held_by")
    met = scratch.keep(held_by.join(placed, "text_key").where(near(F.col("n_entity"), F.col("n_held"))), "met")
    pairs = met.groupBy("entity", "n_entity", "term", "n_held").agg(F.count(F.lit(1)).alias("n_pair")).where(F.col("n_pair") >= SUPPORT)
    pairs = scratch.keep(pairs.where(share(F.col("n_pair"), F.col("n_held")) >= DISCLOSURE).drop("n_held"), "pairs")
    candidates = scratch.keep(pairs.select("term").distinct(), "candidates")
    if candidates.isEmpty():
        return _none(scratch)
    scored = pairs.join(term_texts(docs, candidates, text_col), "term").where(share(F.col("n_pair"), F.col("n_term")) >= DISCLOSURE)
    scored = scratch.keep(scored.select("entity", "term", "n_pair", "n_term", "n_entity", share(F.col("n_pair"), F.col("n_term")).alias("share")), "disclosures")
    return scored, met.select("text_key", "entity", "term").join(scored.select("entity", "term"), ["entity", "term"]).select("text_key", "term").distinct()


def _none(scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    schema = "entity string, term string, n_pair long, n_term long, n_entity long, share double"
    return scratch.spark.createDataFrame([], schema), scratch.spark.createDataFrame([], "text_key long, term string")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_key, spans, n_email, n_ip, n_card, n_phone), one per document row.

    ``spans``: array of (start, end, kind) by start, then kind as in ``KINDS`` and ``ADDED``;
    ``term`` is the kind of disclosing terms. Neither they nor secrets overlap the patterns' spans. Offsets are code points of the whole text, ends
    exclusive. Null and empty texts have no spans. Repeated rows get equal results.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.keep(found_spans(docs, id_col, text_col), "rows")
    _, places = disclosures(docs, rows, scratch, text_col)
    hits = scratch.keep(places.groupBy("text_key").agg(F.collect_set("term").alias("telling")), "hits")
    added = F.transform(
        F.filter("terms", lambda t: F.array_contains("telling", t["term"])),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("term").alias("kind")),
    )
    spans = F.when(F.col("telling").isNull(), F.col("spans")).otherwise(_by_start(F.concat("spans", added)))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    few = (hits.agg(F.sum(F.size("telling"))).first()[0] or 0) <= BROADCAST_TERMS
    return rows.join(F.broadcast(hits) if few else hits, "text_key", "left").select("doc_id", "text_key", spans.alias("spans"), *counts)


def _is(kind: str):
    return lambda span: span["kind"] == kind


def _by_start(spans):
    """Spans by start, then kind as listed."""
    rank = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    number = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), number[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def written(spans):
    """Column: ``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "term": "[TERM]"}


def redacted(text: str | None, spans: list, remove_terms: bool = False) -> str:
    """``text`` with each span replaced by its kind's label; of overlapping spans the first counts."""
    text, out, at = text or "", [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], "" if remove_terms and span["kind"] == "term" else LABELS[span["kind"]]]
            at = span["end"]
        else:
            at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, detected: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_terms: bool = False) -> DataFrame:
    """``docs`` with the detected spans of each text replaced. ``detected``: the result of :func:`detect` for these texts.

    Rows and all other columns stay as they are, null texts too; an empty table gives no rows.
    """
    key_name, spans_name, new_name = free_names(docs, "text_key", "found_spans", "new_text")
    spans = detected.where(F.size("spans") > 0).select(F.col("text_key").alias(key_name), F.col("spans").alias(spans_name)).dropDuplicates([key_name])
    joined = docs.select("*", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(key_name)).join(spans, key_name, "left")

    def rows(texts: list, found: list) -> tuple:
        return ([redacted(t, own, remove_terms) if own else t for t, own in zip(texts, found, strict=True)],)

    made = with_computed(joined, [F.col(text_col), F.col(spans_name)], [(new_name, "string", pa.string())], rows)
    return made.select(*(F.col(new_name if c == text_col else f"`{c}`").alias(c) for c in docs.columns))
