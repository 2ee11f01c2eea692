"""Operators whose result depends on the order of rows.

Folds by key pass their rows in order through :func:`carried`: Spark deals the rows out by key
and sorts them, and a task goes through them batch by batch with the state of the key it is at.
So it holds a batch and one small state, however many rows a key has; a hot key takes long, as
each of its rows waits for the one before, but never more memory. The long-lived forms are
streams with state, in :mod:`lodestone.streaming`. Merging of similar rows is in
:mod:`lodestone.operators.merging`.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def carried(rows: DataFrame, key: str, order: list[str], inputs: list[str], begin: Callable[[], Any], step: Callable, new: tuple[str, str, pa.DataType]) -> DataFrame:
    """``rows`` with a new column: what ``step(state, *inputs)`` returns for each, by key in the given order.

    ``begin`` makes the state of a key, which ``step`` changes in place. ``new``: name, Spark
    type and Arrow type of the column. Null keys are one key; no rows give none.
    """
    name, kind, arrow = new
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), None
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if (k,) != now:
                    now, state = (k,), begin()
                out.append(step(state, *values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    return dealt.mapInArrow(fold, StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields]))


def transcript_chunks(segments: DataFrame, group: str, seconds: float) -> DataFrame:
    """(group, chunk, start, end, text) of transcript segments (start, duration, text): a chunk ends once it is ``seconds`` long.

    The first chunk starts at 0, each later one where the one before ended.
    """

    def step(state: dict, start: float, duration: float) -> dict:
        end = start + duration
        placed = {"chunk": state["chunk"], "begin": state["begin"], "end": end}
        if end - state["begin"] >= seconds:
            state.update(chunk=state["chunk"] + 1, begin=end)
        return placed

    chosen = segments.select(F.col(group).cast("string").alias("grp"), F.col("start").cast("double").alias("start"), F.col("duration").cast("double").alias("duration"), "text")
    kind = pa.struct([("chunk", pa.int32()), ("begin", pa.float64()), ("end", pa.float64())])
    placed = carried(chosen, "grp", ["start"], ["start", "duration"], lambda: {"chunk": 0, "begin": 0.0}, step, ("place", "struct<chunk:int,begin:double,end:double>", kind))
    said = F.array_sort(F.collect_list(F.struct("start", "text")))
    chunks = placed.groupBy("grp", F.col("place.chunk").alias("chunk")).agg(F.min("place.begin").alias("start"), F.max(F.struct("start", "place.end"))["end"].alias("end"), F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"))
    return chunks.select("grp", "chunk", "start", "end", "text")


def sliding_log(times: list[float], window: float, most: int) -> list[bool]:
    """Which of ascending times are allowed: fewer than ``most`` allowed ones in the ``window`` before. Denied ones don't count."""
    log: deque[float] = deque()
    out = []
    for t in times:
        while log and log[0] <= t - window:
            log.popleft()
        out.append(len(log) < most)
        if out[-1]:
            log.append(t)
    return out


def _allowed(log: deque, t: float, window: float, most: int) -> bool:
    while log and log[0] <= t - window:
        log.popleft()
    if len(log) >= most:
        return False
    log.append(t)
    return True


def sliding_limit(events: DataFrame, key: str, seconds: str, tie: str, window: float, most: int) -> DataFrame:
    """(key, tie, allowed): the sliding-log rate limit of each key over all its events.

    The state of a key is the times of its last ``most`` allowed events at most.
    """
    chosen = events.select(F.col(key).cast("long").alias(key), F.col(tie).cast("long").alias(tie), F.col(seconds).cast("double").alias("seconds"))
    judged = carried(chosen, key, ["seconds", tie], ["seconds"], deque, lambda log, t: _allowed(log, t, window, most), ("allowed", "boolean", pa.bool_()))
    return judged.select(key, tie, "allowed")


def circuit_breaker(events: DataFrame, key: str, seconds: str, tie: str, failed: str, failures: int = 3, pause: float = 30.0) -> DataFrame:
    """(key, tie, rejected): calls refused while the circuit is open, ``pause`` seconds after ``failures`` failures in a row."""

    def step(state: dict, t: float, bad: bool | None) -> bool:
        if t < state["until"]:
            return True
        state["count"] = state["count"] + 1 if bad else 0
        if state["count"] >= failures:
            state.update(count=0, until=t + pause)
        return False

    chosen = events.select(F.col(key).cast("long").alias(key), F.col(tie).cast("long").alias(tie), F.col(seconds).cast("double").alias("seconds"), F.col(failed).alias("failed"))
    judged = carried(chosen, key, ["seconds", tie], ["seconds", "failed"], lambda: {"count": 0, "until": float("-inf")}, step, ("rejected", "boolean", pa.bool_()))
    return judged.select(key, tie, "rejected")


def greedy_parents(children: DataFrame, doc: str, target: int) -> DataFrame:
    """(doc, chunk_index, parent_index) of ``children`` (doc, chunk_index, tokens): parents take children while the sum is within ``target``."""

    def step(state: dict, n: int) -> int:
        if state["size"] and state["size"] + n > target:
            state.update(parent=state["parent"] + 1, size=0)
        state["size"] += n
        return state["parent"]

    chosen = children.select(F.col(doc).cast("long").alias(doc), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("tokens").cast("long").alias("tokens"))
    placed = carried(chosen, doc, ["chunk_index"], ["tokens"], lambda: {"parent": 0, "size": 0}, step, ("parent_index", "int", pa.int32()))
    return placed.select(doc, "chunk_index", "parent_index")


def cache_replay(requests: DataFrame, cache: str, key: str, seconds: str, tie: str, size: int, ttl: float) -> DataFrame:
    """(cache, tie, hit): whether each request finds its key in a cache of ``size`` entries that live ``ttl`` seconds.

    A miss stores the key. A hit makes an entry the most recently used one but doesn't lengthen
    its life; storing drops what has expired first, then the least recently used beyond
    ``size``. The state is the cache itself, so it is bounded by ``size``.
    """

    def step(entries: OrderedDict, k: str | None, t: float) -> bool:
        if (until := entries.get(k)) is not None and until > t:
            entries.move_to_end(k)
            return True
        entries.pop(k, None)
        for gone in [x for x, end in entries.items() if end <= t]:
            del entries[gone]
        entries[k] = t + ttl
        while len(entries) > size:
            entries.popitem(last=False)
        return False

    chosen = requests.select(F.col(cache).alias(cache), F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias(tie), F.col(seconds).cast("double").alias("seconds"))
    judged = carried(chosen, cache, ["seconds", tie], ["key", "seconds"], OrderedDict, step, ("hit", "boolean", pa.bool_()))
    return judged.select(cache, tie, "hit")


#: Characters of chunks that a task holds before it hands them on.
CHARS = 2_000_000


def boundary_chunks(docs: DataFrame, doc: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc, chunk_index, start, end, content): windows of ``size`` words that retreat to a paragraph's or sentence's end.

    A window that isn't the last ends after a blank line within its last 200
    characters, else after a sentence within its last 100, if that keeps more than
    half of it. The next one starts ``overlap`` words before, at least one word on.
    """

    kinds = {"doc": pa.int64(), "chunk_index": pa.int32(), "start": pa.int32(), "end": pa.int32(), "content": pa.string()}

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word, stop = re.compile(r"\S+"), re.compile(r"[.!?](?=\s)")
        for part in batches:
            out, chars = [], 0
            # texts become strings one by one, and chunks leave before they fill the memory of the task
            for key, whole in zip(part.column("doc"), part.column("text"), strict=True):
                key, whole = key.as_py(), whole.as_py()
                spans = [m.span() for m in word.finditer(whole or "")]
                at = index = 0
                while at < len(spans):
                    last = min(at + size, len(spans)) - 1
                    begin, end = spans[at][0], spans[last][1]
                    if last < len(spans) - 1:
                        cut = whole.rfind("\n\n", max(begin, end - 200), end)
                        if cut < 0:
                            found = [m.end() for m in stop.finditer(whole, max(begin, end - 100), end)]
                            cut = found[-1] if found else -1
                        if cut > begin + (end - begin) // 2:
                            end = cut
                    content = whole[begin:end].strip()
                    out.append((key, index, begin, end, content))
                    chars += len(content)
                    if chars >= CHARS:
                        yield made(out)
                        out, chars = [], 0
                    if last == len(spans) - 1:
                        break
                    taken = sum(1 for s, _ in spans[at : last + 1] if s < end)
                    at, index = at + max(1, taken - overlap), index + 1
            if out:
                yield made(out)

    chosen = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return chosen.mapInArrow(rows, "doc long, chunk_index int, start int, end int, content string").withColumnRenamed("doc", doc)
