"""Source code as tables: symbols, imports, calls, and checks of what a text says about them."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import markup
from lodestone.operators.graph import cut, spread

# Words that look like calls and aren't.
NOT_CALLS = ("if", "for", "while", "return", "print", "len", "str", "int", "def", "class", "with", "not", "and", "or", "in")


#: Files of a task at most where :func:`dealt` deals them out: code shrinks on its way far more than other texts, and parsing it takes long.
FILES_A_TASK = 4_000


def dealt(files: DataFrame, *keys: str) -> DataFrame:
    """``files`` dealt out by keys into tasks of a bounded number of files."""
    return spread(files, *keys, most=FILES_A_TASK)


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, qualified, first_line, last_line) of Python files (path, text); files that don't parse give none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    stack = [(ast.parse(text or ""), "", False)]
                except (SyntaxError, ValueError):
                    continue
                while stack:
                    node, prefix, in_class = stack.pop()
                    for child in ast.iter_child_nodes(node):
                        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            is_class = isinstance(child, ast.ClassDef)
                            name = f"{prefix}{child.name}"
                            out.append((path, child.name, "class" if is_class else "method" if in_class else "function", name, child.lineno, child.end_lineno))
                            stack.append((child, f"{name}.", is_class))
            if out:
                yield pd.DataFrame(out, columns=["path", "name", "kind", "qualified", "first_line", "last_line"]).astype({"path": object, "name": object, "kind": object, "qualified": object})

    return files.select("path", "text").mapInPandas(rows, "path string, name string, kind string, qualified string, first_line int, last_line int")


def imports(files: DataFrame) -> DataFrame:
    """(path, module): what a file imports or requires, once each."""
    found = F.array_distinct(
        F.concat(
            F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+([A-Za-z_][\w.]*)"), 1),
            F.regexp_extract_all("text", F.lit(r"(?m)^\s*from\s+([A-Za-z_.][\w.]*)\s+import"), 1),
            F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s[^'\"\n]*['\"]([^'\"]+)['\"]"), 1),
            F.regexp_extract_all("text", F.lit(r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"), 1),
        )
    )
    return files.select("path", F.explode(found).alias("module"))


def called(files: DataFrame) -> DataFrame:
    """(path, name): what looks like a call in a file, once each."""
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^\s*(def|class|async def|function)\b"))
    names = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"([A-Za-z_]\w*)\s*\("), 1)
    return files.select("path", F.explode(F.array_distinct(F.array_except(names, F.array(*map(F.lit, NOT_CALLS))))).alias("name"))


def definitions(table: DataFrame) -> DataFrame:
    """(name, target): the first place that defines each name."""
    return table.groupBy("name").agg(F.min(F.struct("path", "first_line", "qualified")).alias("d")).select("name", F.concat_ws(":", "d.path", "d.qualified").alias("target"))


def calls(files: DataFrame, table: DataFrame) -> DataFrame:
    """(path, name, target): names called in a file that the symbol table has; the target is the first definition."""
    return called(files).join(definitions(table), "name").select("path", "name", "target")


def symbol_checks(references: DataFrame, table: DataFrame) -> DataFrame:
    """``references`` (name) with is_valid and confidence: 1.0 for a known qualified name, 0.9 for a known name, else wrong at 0.8."""
    names = table.select(F.col("name").alias("n")).distinct()
    qualified = table.select(F.col("qualified").alias("q")).distinct()
    joined = references.join(qualified, F.col("name") == F.col("q"), "left").join(names, F.element_at(F.split("name", r"\."), -1) == F.col("n"), "left")
    confidence = F.when(F.col("q").isNotNull(), 1.0).when(F.col("n").isNotNull(), 0.9).otherwise(0.8)
    return joined.select(*references.columns, (F.col("q").isNotNull() | F.col("n").isNotNull()).alias("is_valid"), confidence.alias("confidence"))


def import_checks(wanted: DataFrame, stdlib: DataFrame, installed: DataFrame, declared: DataFrame, local: DataFrame) -> DataFrame:
    """``wanted`` (module) with origin: the first of stdlib, installed, declared and local that knows its top level, else missing."""
    out = wanted.withColumn("top", F.lower(F.replace(F.split("module", r"\.")[0], F.lit("_"), F.lit("-"))))
    for name, known in (("stdlib", stdlib), ("installed", installed), ("declared", declared), ("local", local)):
        keys = known.select(F.lower(F.replace("module", F.lit("_"), F.lit("-"))).alias(f"__{name}")).distinct()
        out = out.join(keys, out["top"] == keys[f"__{name}"], "left")
    origin = F.lit("missing")
    for name in ("local", "declared", "installed", "stdlib"):
        origin = F.when(F.col(f"__{name}").isNotNull(), name).otherwise(origin)
    return out.select(*wanted.columns, origin.alias("origin"))


def endpoint_checks(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """``asked`` (method, path) with verdict and confidence against ``routes`` (method, template).

    A missing route is told less surely, at 0.5, where no routes are known at all. Candidates meet on the number of path segments, so templates are not tried on every path.
    """
    segments = lambda c: F.size(F.split(c, "/"))
    pattern = F.concat(F.lit("^"), F.regexp_replace("template", r"\{[^}]*\}", "[^/]+"), F.lit("$"))
    r = routes.select(F.col("method").alias("r_method"), "template", pattern.alias("pattern"), segments("template").alias("n"))
    pairs = asked.withColumn("n", segments("path")).join(r, "n", "left")
    hit = F.coalesce(F.rlike("path", F.col("pattern")), F.lit(False))
    same = F.col("method") == F.col("r_method")
    score = F.when(hit & same & (F.col("path") == F.col("template")), 3).when(hit & same, 2).when(hit, 1).otherwise(0)
    best = pairs.groupBy("method", "path").agg(F.max(score).alias("s"))
    verdict = F.when(F.col("s") == 3, "exact").when(F.col("s") == 2, "template").when(F.col("s") == 1, "wrong_method").otherwise("missing")
    known = routes.agg((F.count(F.lit(1)) > 0).alias("known"))
    confidence = F.when(F.col("s") == 3, 1.0).when(F.col("s") == 2, 0.95).when(F.col("s") == 1, 0.9).when(F.col("known"), 0.8).otherwise(0.5)
    best = best.crossJoin(known)  # one row beside each
    return best.select("method", "path", verdict.alias("verdict"), confidence.alias("confidence"))


#: Unknown and known names of a task's two packs.
ASKED, KNOWN = 256, 16_384
#: Tasks at most that pairs of packs are dealt out into.
MOST_TASKS = 2_000


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(names x places) characters as numbers from 1, 0 beyond a name's end, and lengths."""
    size = np.array([len(x) for x in names], np.int64)
    out = np.zeros((len(names), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return out, size


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many characters each two names of ``a`` and ``b`` have in common, repeats counted; the names as numbers."""
    alphabet = np.intersect1d(a, b)
    out = np.zeros((len(a), len(b)), np.float32)
    for x in alphabet[alphabet > 0]:
        left, right = ((side == x).sum(axis=1) for side in (a, b))
        # the lesser of two counts is the number of steps that both reach
        steps = np.arange(1, min(left.max(), right.max()) + 1)
        out += (left[:, None] >= steps).astype(np.float32) @ (right[:, None] >= steps).astype(np.float32).T
    return out


def _in_order(name: str, alphabet: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """The longest common subsequence of ``name``, of at most 63 characters, with each row of ``coded``, places in ``alphabet``; bit by bit of the name."""
    bits, full = np.zeros(len(alphabet), np.uint64), np.uint64((1 << len(name)) - 1)
    for i, x in enumerate(name):
        bits[alphabet == ord(x) + 1] |= np.uint64(1 << i)
    left = np.full(len(coded), full, np.uint64)
    for column in coded.T:
        hit = left & bits[column]
        left = ((left + hit) | (left - hit)) & full
    return len(name) - np.bitwise_count(left).astype(np.int64)


def _closest(name: str, known: list[str], alphabet: np.ndarray, coded: np.ndarray, size: np.ndarray, most: np.ndarray, n: int, cutoff: float) -> list[tuple[float, str]]:
    """The ``n`` best (ratio, known) of at least ``cutoff``; ``most``: what the ratio of each can't exceed."""
    at = np.flatnonzero(most >= cutoff)
    most = most[at]
    if 0 < len(name) < 64 and len(at) > n:
        # blocks that match are in the same order in both names
        most = np.minimum(most, 2.0 * _in_order(name, alphabet, coded[at]) / (size[at] + len(name)) + 1e-6)
        at, most = at[most >= cutoff], most[most >= cutoff]
    best: list[tuple[float, str]] = []
    matcher = difflib.SequenceMatcher(None, "", name)
    # the most promising first, then, if they don't settle it, the rest
    floor = np.partition(most, -64)[-64] if len(most) > 64 else -1.0
    for some in (most >= floor, most < floor):
        for bound, x in sorted(((float(m), known[i]) for i, m in zip(at[some], most[some], strict=True)), reverse=True):
            if len(best) == n and bound < best[-1][0]:
                return best
            matcher.set_seq1(x)
            ratio = matcher.ratio()
            if ratio >= cutoff:
                best = sorted([*best, (ratio, x)], reverse=True)[:n]
    return best


def suggestions(unknown: DataFrame, names: DataFrame, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """(name, similar): up to ``n`` known names (name) alike by matching blocks, for each unknown one that has any; as ``difflib.get_close_matches`` has them.

    Packs of unknown names meet packs of known ones, each two under a key of their own. Only
    known names that can reach the best found by the characters they share, and by those in the same order,
    are compared.
    """

    def packs(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        rows = cut(df.select("name").where("name IS NOT NULL").distinct())
        count = rows.count() // size + 1
        dealt = rows.withColumn(f"{name}_pack", F.pmod(F.xxhash64("name"), F.lit(count)).cast("int"))
        return dealt.groupBy(f"{name}_pack").agg(F.collect_list("name").alias(name)), count

    def rated(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for asked, known in zip(part["asked"], part["known"], strict=True):
            asked, known = list(asked), list(known)
            (a, a_size), (b, b_size) = _letters(asked), _letters(known)
            most = 2.0 * _shared(a, b) / np.maximum(a_size[:, None] + b_size, 1)
            most[a_size == 0] = b_size == 0  # two empty names are alike
            alphabet, coded = np.unique(b, return_inverse=True)
            coded = coded.reshape(b.shape)
            for i, x in enumerate(asked):
                # a little more, as the cutoff is met in double precision
                out += [(x, y, ratio) for ratio, y in _closest(x, known, alphabet, coded, b_size, most[i].astype(np.float64) + 1e-6, n, cutoff)]
        return pd.DataFrame(out, columns=["name", "known", "ratio"]).astype({"name": object, "known": object, "ratio": float})

    (asked, few), (known, many) = packs(unknown, "asked", ASKED), packs(names, "known", KNOWN)
    # a row each for two packs; by their bytes Spark would put most of them into one task
    pairs = asked.crossJoin(known).repartition(min(2 * few * many, MOST_TASKS), "asked_pack", "known_pack")
    good = pairs.groupBy("asked_pack", "known_pack").applyInPandas(rated, "name string, known string, ratio double")
    ranked = good.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ratio"), F.desc("known")))).where(F.col("r") <= n)
    return ranked.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "known"))), lambda x: x["known"]).alias("similar"))


# Built-in names that are never doubted.
BUILT_IN = (
    "print", "len", "range", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "open", "type", "isinstance", "hasattr", "getattr", "setattr", "None", "True", "False", "self", "cls",
    "Exception", "ValueError", "TypeError", "KeyError", "IndexError", "AttributeError", "ImportError", "RuntimeError", "StopIteration",
)


def symbol_verdicts(references: DataFrame, table: DataFrame) -> DataFrame:
    """(name, kind, is_valid, confidence, similar) of ``references`` (name, kind; null: any kind) against a symbol table (name, kind), each once.

    Built-in names and names of the kind asked for are valid at 1.0; a name known as other
    kinds only is wrong at 0.9, with them as similar; an unknown one is wrong at 0.85 with
    the known names most like it, at 0.8 where there are none. Null names are left out.
    """
    asked = references.where("name IS NOT NULL").select("name", "kind").distinct()
    known = cut(table.groupBy("name").agg(F.array_sort(F.collect_set("kind")).alias("kinds")))
    joined = asked.join(known, "name", "left")
    unknown = joined.where(F.col("kinds").isNull() & ~F.col("name").isin(*BUILT_IN)).select("name")
    rows = joined.join(suggestions(unknown, known.select("name")), "name", "left")
    built_in, right = F.col("name").isin(*BUILT_IN), F.col("kind").isNull() | F.array_contains("kinds", F.col("kind"))
    valid = built_in | (F.col("kinds").isNotNull() & right)
    confidence = F.when(valid, 1.0).when(F.col("kinds").isNotNull(), 0.9).when(F.col("similar").isNotNull(), 0.85).otherwise(0.8)
    said = F.when(valid, F.array().cast("array<string>")).otherwise(F.coalesce("kinds", "similar", F.array().cast("array<string>")))
    return rows.select("name", "kind", valid.alias("is_valid"), confidence.alias("confidence"), said.alias("similar"))


def symbol_counts(table: DataFrame, most: int) -> DataFrame:
    """(kind, symbols, files, names) of a symbol table (path, name, kind) of at most ``most`` rows: how many there are, in how many files, of how many names.

    Files and names are told apart in tasks of a bounded number of them, each once.
    """
    by_file = spread(table.select("kind", "path"), "path", rows=most).groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))
    files = by_file.groupBy("kind").agg(F.sum("n").alias("symbols"), F.count("path").alias("files"))
    names = spread(table.select("kind", "name"), "name", rows=most).distinct().groupBy("kind").agg(F.count("name").alias("names"))
    return files.join(names, files["kind"].eqNullSafe(names["kind"])).select(files["kind"], "symbols", "files", "names")


def symbol_lines(files: DataFrame) -> DataFrame:
    """(path, name, kind, line): classes, functions and methods by the look of their first lines; for languages without a parser at hand."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "code"))
    name = F.regexp_extract("code", r"^\s*(?:async\s+)?(?:def|class|function)\s+([A-Za-z_]\w*)", 1)
    kind = F.when(F.col("code").rlike(r"^\s*class\b"), "class").when(F.col("code").rlike(r"^\s+"), "method").otherwise("function")
    return lines.where(name != "").select("path", name.alias("name"), kind.alias("kind"), (F.col("at") + 1).alias("line"))


def routes(files: DataFrame) -> DataFrame:
    """(path, method, template) of route decorators."""
    lines = files.select("path", F.explode(F.split("text", "\n")).alias("code"))
    pattern = r"^\s*@\w+\.(get|post|put|delete|patch)\(\s*[\"']([^\"']+)[\"']"
    return lines.where(F.col("code").rlike(pattern)).select("path", F.upper(F.regexp_extract("code", pattern, 1)).alias("method"), F.regexp_extract("code", pattern, 2).alias("template"))


# The ways in which a text refers to code, and words that are no symbols.
REFERENCES = {
    "function_call": r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    "class_name": r"\b([A-Z][a-zA-Z0-9]*)\b",
    "file_path": r"(?:^|[\s`\"'])([a-zA-Z0-9_./-]+\.(?:py|ts|tsx|js|jsx|json|yaml|yml|md))",
    "api_endpoint": r"(?:GET|POST|PUT|DELETE|PATCH)\s+(/[a-zA-Z0-9_/-]+(?:\{[^}]+\})?)",
    "import": r"(?:from|import)\s+([a-zA-Z0-9_.]+)",
    "qualified_name": r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)\b",
}
NO_SYMBOLS = ("the", "and", "for", "with", "this", "that", "from", "import", "class", "def", "return", "if", "else", "get", "post", "put", "delete", "patch", "call", "use")


def references(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, kind, name): what a text refers to, each name once for each kind; common words left out."""
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.regexp_extract_all(text_col, F.lit(p), 1)).alias("names")) for kind, p in REFERENCES.items()))
    rows = texts.select(key, F.explode(found).alias("f")).select(key, "f.kind", F.explode("f.names").alias("name"))
    return rows.where(~F.lower("name").isin(*NO_SYMBOLS))


def path_checks(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``asked`` (path) with verdict and confidence: known, outside, similar (a file of that name elsewhere) or missing."""
    path = markup.normal_path(F.col("path"))
    rows = asked.select("path", path.alias("normal"), markup.base_name(path).alias("base"))
    files = known.select(F.col("path").alias("normal"), F.lit(True).alias("there")).distinct()
    names = known.select(markup.base_name(F.col("path")).alias("base"), F.lit(True).alias("alike")).distinct()
    outside = F.exists(F.split("normal", "/"), lambda x: x == "..")
    verdict = F.when(F.col("there"), "known").when(outside, "outside").when(F.col("alike"), "similar").otherwise("missing")
    confidence = F.when(F.col("there") | outside, 1.0).when(F.col("alike"), 0.85).otherwise(0.8)
    return rows.join(files, "normal", "left").join(names, "base", "left").select("path", verdict.alias("verdict"), F.coalesce(confidence, F.lit(0.8)).alias("confidence"))


def or_whole_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunks`` (path, qualified, part, content), and each file without any as one chunk of its own."""
    none = files.join(chunks.select("path"), "path", "left_anti").where(F.trim("text") != "")
    return chunks.unionByName(none.select("path", F.lit("").alias("qualified"), F.lit(0).alias("part"), F.col("text").alias("content")))


def code_chunks(files: DataFrame, table: DataFrame, max_chars: int = 1000, headers: bool = False) -> DataFrame:
    """(path, qualified, part, content): each symbol's lines, in parts of at most ``max_chars`` characters of whole lines.

    With ``headers`` the first line of its class stands before a method.
    """
    # rows of a file stay in one task from here on
    joined = dealt(files, "path").join(table, "path").withColumn("lines", F.slice(F.split("text", "\n"), F.col("first_line"), F.col("last_line") - F.col("first_line") + 1))
    if headers:
        method = F.col("kind") == "method"
        owner = F.when(method, F.regexp_replace("qualified", r"\.[^.]*$", "")).when(F.col("kind") == "class", F.col("qualified"))
        header = F.min(F.when(F.col("kind") == "class", F.trim(F.col("lines")[0]))).over(Window.partitionBy("path", "owner"))
        joined = joined.withColumn("owner", owner).withColumn("header", header)
        joined = joined.withColumn("lines", F.when(method & F.col("owner").isNotNull() & F.col("header").isNotNull(), F.concat(F.array("header"), "lines")).otherwise(F.col("lines")))

    def add(state, line):
        size = F.length(line) + 1
        fresh = (state["size"] > 0) & (state["size"] + size > max_chars)
        part = F.when(fresh, state["part"] + 1).otherwise(state["part"])
        rows = F.concat(state["rows"], F.array(F.struct(part.alias("part"), line.alias("line"))))
        return F.struct(part.alias("part"), F.when(fresh, size).otherwise(state["size"] + size).alias("size"), rows.alias("rows"))

    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("size"), F.array().cast("array<struct<part: int, line: string>>").alias("rows"))
    numbered = joined.select("path", "qualified", F.posexplode(F.aggregate("lines", start, add)["rows"]).alias("pos", "r"))
    grouped = numbered.groupBy("path", "qualified", F.col("r.part").alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("r.line").alias("line")))).alias("l"))
    return grouped.select("path", "qualified", "part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
