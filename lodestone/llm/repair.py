"""Conversation structure repair: cheapest edits by a graph of tight arcs.

A conversation's roles shall read ``(system)? (user assistant)+`` or be nothing. The nodes of its graph
are (rows read, last role written); arcs keep, rerole or delete the next row or insert one.
Minimum costs from the start and to the end make an arc tight if it lies on a cheapest path.
Among these, the set of nodes reached by the least letters so far goes on along the least
letter of any of its tight arcs, so ties are settled without listing paths. (Here letters
lead from one state to one, as roles alternate, so the set has one node.)

Rows of a conversation may be many. They are sorted by Spark's range exchange, which splits
any conversation, and cut into segments of bounded size, whose costs from each state to each
other (four by four) and whose moves between states are combined along the conversation. Only
these summaries of segments meet by conversation; equal rows are counted, not repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and characters of a segment; one longer row is a segment of its own.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20

_BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing written yet, or the role written last.
START, SYSTEM, USER, ASSISTANT = range(4)
_INF = 1 << 60
#: By letter of a role: the state from each state, or None where the role may not follow.
_AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Costs to the end once all rows are read: nothing is right, a lone system role lacks two rows, a user's one.
_END = (0, 2 * INSERT, INSERT, 0)
_WHOLE = (0, _INF, _INF, _INF)


def _inserts(cost: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from the start after any number of insertions."""
    u = min(cost[USER], min(cost[START], cost[SYSTEM], cost[ASSISTANT]) + INSERT)
    return cost[START], cost[SYSTEM], u, min(cost[ASSISTANT], u + INSERT)


def _before_inserts(cost: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before any number of insertions."""
    u = min(cost[USER], cost[ASSISTANT] + INSERT)
    return min(cost[START], u + INSERT), min(cost[SYSTEM], u + INSERT), u, min(cost[ASSISTANT], u + INSERT)


def _arcs(symbol: str) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of a row. Symbols: a role's letter or ``x``, a capital where truncated, ``-`` where it must go."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if symbol == "-":
        return out
    more = TRUNCATED if symbol.isupper() else 0
    role = symbol.lower()
    out += [("K", q, t, KEEP + more) for q, t in enumerate(_AFTER.get(role, ())) if t is not None]
    return out + [("R", q, t, REROLE + more) for r in "ua" for q, t in enumerate(_AFTER[r]) if t is not None]


_ROW_ARCS = {s: _arcs(s) for s in "suaxSUAX-"}
_INSERT_ARCS = [(q, t, INSERT) for r in "ua" for q, t in enumerate(_AFTER[r]) if t is not None]


def forward(symbols: str, runs: list[int], first: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least costs from the start at each row, insertions before it included, and after the last without them.

    ``runs``: how many deletions follow each row.
    """
    out, now = [], first
    for s, n in zip(symbols, runs, strict=True):
        now = _inserts(now)
        out.append(now)
        after = [_INF] * 4
        for _, q, t, c in _ROW_ARCS[s]:
            after[t] = min(after[t], now[q] + c)
        now = tuple(c + DELETE * n for c in after)
    return [*out, now]


def backward(symbols: str, runs: list[int], last: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least costs to the end at each row, before insertions, and after the last."""
    out, now = [last], last
    for s, n in zip(reversed(symbols), reversed(runs), strict=True):
        before = [_INF] * 4
        for _, q, t, c in _ROW_ARCS[s]:
            before[q] = min(before[q], c + now[t] + DELETE * n)
        now = _before_inserts(tuple(before))
        out.append(now)
    return out[::-1]


def walk(symbols: str, runs: list[int], first: tuple[int, ...], last: tuple[int, ...], total: int, front: int, ends: bool) -> tuple[str, int]:
    """(letters, state after them): the least letters along tight arcs from state ``front``. ``ends``: no segment follows."""
    f, b = forward(symbols, runs, first), backward(symbols, runs, last)
    letters, now = [], {front}

    def tight(costs_from, costs_to, arcs):
        return {t for q, t, c in arcs if q in now and costs_from[q] + c + costs_to[t] == total}

    for i, (s, n) in enumerate(zip(symbols, runs, strict=True)):
        after = [c + DELETE * n for c in b[i + 1]]
        letter = "I"
        while letter == "I":
            options = {x: tight(f[i], after, [a[1:] for a in _ROW_ARCS[s] if a[0] == x]) for x in "DKR"}
            options["I"] = tight(f[i], b[i], _INSERT_ARCS)
            letter = min(x for x, to in options.items() if to)
            now = options[letter]
            letters.append(letter)
        letters.append("D" * n)
    if ends:
        f_end = _inserts(f[-1])
        while not any(q in (START, ASSISTANT) and f_end[q] == total for q in now):
            now = tight(f_end, _END, _INSERT_ARCS)
            letters.append("I")
    (state,) = now
    return "".join(letters), state


def written(letters: str, roles: list[str], texts: list[str], runs: list[int], state: int) -> list[tuple[str, str]]:
    """(role, text) of the rows that the letters leave or make from ``state`` on."""
    out, letter = [], iter(letters)
    for role, text, n in zip(roles, texts, runs, strict=True):
        while (x := next(letter)) == "I":
            state = ASSISTANT if state == USER else USER
            out.append((_NAMES[state], ""))
        if x == "K":
            state = _AFTER[role[:1]][state]
            out.append((role, text))
        elif x == "R":
            state = ASSISTANT if state == USER else USER
            out.append((_NAMES[state], text))
        for _ in range(n):
            next(letter)
    for _ in letter:
        state = ASSISTANT if state == USER else USER
        out.append((_NAMES[state], ""))
    return out


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, n): rows damaged by their key's checksum, equal ones counted in ``n``.

    The checksum of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes ``.!?``
    out of it, 3 repeats it, 4 makes its role user. A null is one space, in the key too; a null
    turn stays null.
    """
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)}
    kind = F.crc32(F.concat_ws(":", said[conv], said[turn]).cast("binary")) % 20
    new = F.when(kind == 1, "").when(kind == 2, F.translate(said[text], ".!?", "")).otherwise(said[text])
    made = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(said[role]).alias("role"), new.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"), kind.alias("kind"))
    return made.where("kind <> 0").groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, n) with the fault of the first of each row's ``n``, and the symbol of that one.

    The others are duplicates, or blank as well. The first row of a role and text is found by
    the least turn of each that stands at more than one; these are few and pre-aggregated.
    """
    scratch = Scratch(rows.sparkSession, "faults")
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = scratch.keep(rows.withColumn("mark", mark), "rows")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.groupBy("conv", "mark").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    again = scratch.keep(again.select(F.col("conv").alias("conv_"), F.col("mark").alias("mark_"), F.col("first.turn").alias("first")), "again")
    met = rows.join(again, rows["conv"].eqNullSafe(again["conv_"]) & (rows["mark"] == again["mark_"]), "left")
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = (
        F.when(bare == "", "blank")
        .when(F.col("mark_").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first")), "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return scratch.keep(met.select("conv", "turn", "role", "text", "n", fault.alias("fault")).withColumn("symbol", symbol), "faults")


def _initials(roles: list[str]) -> list[str]:
    return [r[:1] for r in roles]


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_SEGMENT = "part int, piece long, symbols string, runs array<long>, roles array<string>, texts array<string>, illegal long, head string, tail string"


def segments(rows: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Consecutive rows of a conversation, at most ``size``, as (conv, part, piece, symbols, runs, roles, texts, illegal, head, tail).

    ``part`` and ``piece`` order the segments; ``illegal`` counts neighbours within one; head and tail are its first and last initials.
    """
    place = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    # ranges by beginnings, which are small enough to sample; rows of the same beginnings meet and are sorted in full
    dealt = rows.repartitionByRange(*place, F.substring("role", 1, 40), F.substring("text", 1, 40)).sortWithinPartitions(*place, "role", "text")
    dealt = dealt.select("conv", "role", "text", "symbol", "n", F.spark_partition_id().alias("part"))
    schema = pa.schema([("conv", pa.null()), ("part", pa.int32()), ("piece", pa.int64()), ("symbols", pa.string()), ("runs", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, chars, now = 0, [], 0, None

        def made(conv_type):
            nonlocal piece, held, chars
            own, held, chars = held, [], 0
            first = _initials([r[1] for r in own])
            illegal = sum(pair not in _LEGAL for pair in zip(first, first[1:], strict=False)) + sum(r[4] - 1 for r in own)
            row = [[own[0][0]], [own[0][5]], [piece], ["".join(r[3] for r in own)], [[r[4] - 1 for r in own]], [[r[1] for r in own]], [[r[2] for r in own]], [illegal], [first[0]], [first[-1]]]
            piece += 1
            return pa.RecordBatch.from_arrays([pa.array(v, conv_type if i == 0 else schema.field(i).type) for i, v in enumerate(row)], names=schema.names)

        conv_type = pa.null()
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != now or len(held) >= size or chars >= SEGMENT_CHARS):
                    yield made(conv_type)
                now = row[0]
                held.append(row)
                chars += len(row[2])
        if held:
            yield made(conv_type)

    return dealt.mapInArrow(cut, f"conv {rows.schema['conv'].dataType.simpleString()}, {_SEGMENT}")


def _summaries(parts: DataFrame) -> DataFrame:
    """Costs from each state to each other over every segment: 16 numbers by (from, to)."""

    def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [[c for q in range(4) for c in forward(s, list(r), tuple(0 if i == q else _INF for i in range(4)))[-1]] for s, r in zip(batch["symbols"], batch["runs"], strict=True)]
            yield pd.DataFrame({"part": batch["part"], "piece": batch["piece"], "costs": made})

    return parts.select("part", "piece", "symbols", "runs").mapInPandas(costs, "part int, piece long, costs array<long>")


_BOUNDS = "part int, piece long, first array<long>, last array<long>, total long, ends boolean, before string"


def _bounds(joined: DataFrame) -> DataFrame:
    """Costs at both ends of every segment of conversations that have several, from the costs over each.

    One group is a conversation's summaries, at most a row for each ``SEGMENT_ROWS`` rows or ``SEGMENT_CHARS`` characters.
    """

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["part", "piece"], ignore_index=True)
        matrices = [np.array(c).reshape(4, 4) for c in part["costs"]]
        first, last = [np.array(_WHOLE)], [np.array(_END)]
        for m in matrices:
            first.append(np.minimum((first[-1][:, None] + m).min(axis=0), _INF))
        for m in reversed(matrices):
            last.append(np.minimum((m + last[-1][None, :]).min(axis=1), _INF))
        total = int(min((first[-1] + np.array(_END)).min(), _INF))
        n = len(part)
        return pd.DataFrame({"part": part["part"], "piece": part["piece"], "first": [x.tolist() for x in first[:-1]], "last": [x.tolist() for x in last[::-1][1:]], "total": total, "ends": [i == n - 1 for i in range(n)], "before": [None, *part["tail"][:-1]]}).astype({"before": object})

    return joined.groupBy("conv").applyInPandas(scan, _BOUNDS)


def _moves(parts: DataFrame) -> DataFrame:
    """For each state in which a segment may be entered along cheapest paths: the state in which it is left."""

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                first, last, runs = tuple(r.first), tuple(r.last), list(r.runs)
                at = backward(r.symbols, runs, last)[0]
                for front in range(4):
                    if first[front] + at[front] == r.total:
                        out.append((r.part, r.piece, front, walk(r.symbols, runs, first, last, r.total, front, r.ends)[1]))
            yield pd.DataFrame(out, columns=["part", "piece", "front", "after"])

    return parts.select("part", "piece", "symbols", "runs", "first", "last", "total", "ends").mapInPandas(ways, "part int, piece long, front int, after int")


def _fronts(moves: DataFrame) -> DataFrame:
    """The state in which each segment is entered, by following the moves along each conversation."""

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        now, out = START, []
        for (p, piece), own in part.groupby(["part", "piece"], sort=True):
            out.append((p, piece, now))
            now = int(own["after"][own["front"] == now].iloc[0])
        return pd.DataFrame(out, columns=["part", "piece", "front"])

    return moves.groupBy("conv").applyInPandas(follow, "part int, piece long, front int")


def repair(judged: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Repaired conversations by segment: (conv, part, piece, whole, audit, cost, turns, illegal) of the result of :func:`faults`.

    Rows are taken by turn, nulls first, then role and text; ``n`` counts equal ones. Blank
    rows and repeats of an earlier role and text must go; a row that stays without ``.!?`` at
    its end costs 3; a role without a first letter s, u or a can't be kept. ``audit`` has a
    letter for each edit: Delete, Insert, Keep, Rerole; of the cheapest ones the least.
    ``turns`` are the rows after it, ``cost`` that of the conversation, ``illegal`` counts
    neighbours that may not follow each other, that with the segment before included.
    ``whole``: the segment is all of its conversation. Null conversations are one; repeated
    rows are duplicates; an empty table gives no rows.
    """
    scratch = Scratch(judged.sparkSession, "repair")
    own = scratch.keep(segments(judged, size), "segments")
    several = scratch.keep(own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("conv_")), "several")
    light = own.select("conv", "part", "piece", "symbols", "runs", "tail")
    split = scratch.keep(light.join(several, light["conv"].eqNullSafe(several["conv_"]), "left_semi"), "split")
    at = ["part", "piece"]
    bounds = scratch.keep(_bounds(split.select("conv", *at, "tail").join(_summaries(split), at)), "bounds")
    moves = _moves(split.join(bounds, at))
    fronts = scratch.keep(_fronts(split.select("conv", *at).join(moves, at)), "fronts")
    entered = bounds.join(fronts, at)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                runs, whole = r["runs"], r["total"] is None
                first, last, ends = (_WHOLE, _END, True) if whole else (tuple(r["first"]), tuple(r["last"]), r["ends"])
                total = min(c + b for c, b in zip(first, backward(r["symbols"], runs, last)[0], strict=True)) if whole else r["total"]
                front = START if whole else r["front"]
                letters, _ = walk(r["symbols"], runs, first, last, total, front, ends)
                turns = written(letters, r["roles"], r["texts"], runs, front)
                joint = 0 if whole or r["before"] is None else int((r["before"], r["head"]) not in _LEGAL)
                out.append((whole, letters, total, [{"role": a, "text": b} for a, b in turns], r["illegal"] + joint))
            new = zip(*out, strict=True) if out else [[]] * 5
            arrays = [pa.array(list(v), t) for v, t in zip(new, _MENDED, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=["conv", "part", "piece", "whole", "audit", "cost", "turns", "illegal"])

    joined = own.join(entered, at, "left").select("conv", "part", "piece", "symbols", "runs", "roles", "texts", "illegal", "head", "first", "last", "total", "ends", "before", "front")
    schema = f"conv {own.schema['conv'].dataType.simpleString()}, part int, piece long, whole boolean, audit string, cost long, turns array<struct<role:string,text:string>>, illegal long"
    return scratch.keep(joined.mapInArrow(mend, schema), "repaired")


_MENDED = [pa.bool_(), pa.string(), pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.int64()]


def summaries(judged: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of the result of :func:`faults`; null turns don't count for gaps."""
    of = lambda kind: F.when(F.col("fault") == kind, F.col("n")).otherwise(0)
    again = F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("n")).otherwise(F.col("n") - 1)
    first = F.when(F.col("fault") == "truncated", 1).otherwise(0)
    by_turn = judged.groupBy("conv", "turn").agg(F.sum(of("blank")).alias("blank"), F.sum(again).alias("duplicate"), F.sum(first).alias("truncated"))
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")
    return by_turn.groupBy("conv").agg(F.coalesce(span.cast("long"), F.lit(0).cast("long")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256): of ``role:text`` of all rows of each conversation, joined by line feeds.

    A hash takes its text from front to back, so segments of one conversation pass through one
    task in order; it holds one of them at a time.
    """
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = repaired.where("whole").select("conv", F.sha2(line, 256).alias("sha256"))
    pieces = repaired.where("not whole").select("conv", "part", "piece", (F.size("turns") > 0).alias("any"), line.alias("line"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, begun = None, None, False
        kind = None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([made.hexdigest()])], names=["conv", "sha256"])
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, some, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if now != (conv,):
                    if now is not None:
                        yield row()
                    now, made, begun = (conv,), hashlib.sha256(), False
                if some:
                    made.update((b"\n" if begun else b"") + text.as_py().encode())
                    begun = True
        if now is not None:
            yield row()

    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return whole.union(ordered.mapInArrow(fold, whole.schema))


def audits(repaired: DataFrame) -> DataFrame:
    """(conv, audit, cost, illegal): letters of each conversation's segments in order, a character for each edit."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "piece", "audit")))
    return repaired.groupBy("conv").agg(F.array_join(F.transform(ordered, lambda x: x["audit"]), "").alias("audit"), F.max("cost").alias("cost"), F.sum("illegal").alias("illegal"))


def report(rows: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``rows`` (conv, turn, role, text, n)."""
    judged = faults(rows)
    repaired = repair(judged, size)
    out = summaries(judged)
    for more in (audits(repaired), digests(repaired).withColumnRenamed("sha256", "repaired_sha256")):
        more = more.withColumnRenamed("conv", "conv_")
        out = out.join(more, out["conv"].eqNullSafe(more["conv_"])).drop("conv_")
    return out
