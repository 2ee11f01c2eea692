"""Symbols of nested code as running aggregates: scopes by indentation (Python) and by braces (JavaScript, TypeScript).

Strings and comments are blanked first; lines then become rows. A window over the lines
of a file gives each its depth, each line that ends scopes becomes one row for every level
it ends, and a definition ends at the first such row of its level. Only the names of what
encloses a definition are folded, over the definitions of one file.

Not understood: strings inside the braces of another string of the same quotes, regular
expressions that hold quotes or braces, tabs other than eight columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.code import dealt
from lodestone.sources import files as files_of

SCHEMA = ["path", "name", "kind", "qualified", "first_line", "last_line"]
_INSIDE = "\u0001"  # starts a line that lies inside a string

_QUOTED = r"""(?s:"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')"""
_PYTHON = r'(?s:"""(?:[^"\\]++|\\.|"(?!""))*+"""|' + r"'''(?:[^'\\]++|\\.|'(?!''))*+''')|" + _QUOTED + r"""|#[^\n]*+|[^"'#]++|["']"""
_BRACES = _QUOTED + r"""|(?s:`(?:[^`\\]++|\\.)*+`)|//[^\n]*+|(?s:/\*(?:[^*]++|\*(?!/))*+\*/)|[^"'`/]++|["'`/]"""

# Words that stand before brackets and name no method.
_NO_METHODS = ("if", "for", "while", "switch", "catch", "return", "function", "with", "do", "else", "throw", "new", "await", "super")


def _lines(files: DataFrame, tokens: str, comment: str) -> DataFrame:
    """(path, line, code): lines of the texts without comments, with an s for each line of a string."""

    def blank(token: Column) -> Column:
        string = F.concat(F.lit("s"), F.replace(F.regexp_replace(token, r"[^\n]", ""), F.lit("\n"), F.lit("\n" + _INSIDE)))
        quoted = (F.length(token) > 1) & token.rlike("^[\"'`]")
        return F.when(token.rlike(comment), F.regexp_replace(token, r"[^\n]", "")).when(quoted, string).otherwise(token)

    plain = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(tokens), 0), blank), "")
    rows = files.where(F.col("text").isNotNull()).select("path", F.posexplode(F.split(plain, "\n")).alias("at", "code"))
    return rows.select("path", (F.col("at") + 1).alias("line"), F.rtrim("code").alias("code"))


def _count(code: str, kind: str) -> Column:
    return F.length(code) - F.length(F.regexp_replace(code, kind, ""))


def _ended(found: DataFrame, endings: DataFrame, ends: DataFrame) -> DataFrame:
    """``found`` (path, level, first_line, name, kind, alone) with last_line: where the first of ``endings`` (path, level, line, upto) after it says, or at the end of the file."""
    marks = endings.select("path", "level", F.col("line").alias("first_line"), "upto", F.lit(0).alias("place"))
    both = found.withColumn("place", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    after = Window.partitionBy("path", "level").orderBy("first_line", "place").rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("next", F.first("upto", ignorenulls=True).over(after)).where("place = 1")
    last = F.when(F.col("alone"), F.col("first_line")).otherwise(F.coalesce("next", "end"))
    return both.join(ends, "path").select("path", "level", "first_line", last.alias("last_line"), "name", "kind")


def _named(found: DataFrame) -> DataFrame:
    """``SCHEMA`` of definitions with their ends; kind ``member?`` stays, as a method, only where it stands directly in a class."""
    place = "struct<level: int, last: int, kind: string, qualified: string>"
    row = "struct<name: string, kind: string, qualified: string, first_line: int, last_line: int>"
    start = F.struct(F.array().cast(f"array<{place}>").alias("open"), F.array().cast(f"array<{row}>").alias("rows"))

    def add(state, d):
        still = F.filter(state["open"], lambda o: (o["last"] >= d["first_line"]) & (o["level"] < d["level"]))
        parent = F.try_element_at(still, F.lit(-1))
        in_class = F.coalesce(parent["kind"] == "class", F.lit(False))
        member = in_class & (d["level"] == parent["level"] + 1)
        keep = (d["kind"] != "member?") | member
        kind = F.when(d["kind"] == "member?", "method").when((d["kind"] == "function") & in_class, "method").otherwise(d["kind"])
        name = F.concat(F.coalesce(F.concat(parent["qualified"], F.lit(".")), F.lit("")), d["name"])
        own = F.struct(d["level"].alias("level"), d["last_line"].alias("last"), kind.alias("kind"), name.alias("qualified"))
        out = F.struct(d["name"].alias("name"), kind.alias("kind"), name.alias("qualified"), d["first_line"].alias("first_line"), d["last_line"].alias("last_line"))
        return F.struct(F.when(keep, F.concat(still, F.array(own))).otherwise(still).alias("open"), F.when(keep, F.concat(state["rows"], F.array(out))).otherwise(state["rows"]).alias("rows"))

    cells = F.struct("first_line", F.col("level").cast("int").alias("level"), "last_line", "name", "kind")
    listed = found.groupBy("path").agg(F.array_sort(F.collect_list(cells)).alias("found"))
    return listed.select("path", F.explode(F.aggregate("found", start, add)["rows"]).alias("r")).select("path", "r.name", "r.kind", "r.qualified", "r.first_line", "r.last_line")


def indented(files: DataFrame) -> DataFrame:
    """``SCHEMA`` of Python files (path, text); paths are unique, null texts have no symbols.

    A logical line starts where no bracket, string or backslash is open. A definition ends
    at the last line with content before a logical line that is indented no deeper.
    """
    order = Window.partitionBy("path").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = _lines(files, _PYTHON, "^#").where("code <> ''")
    rows = rows.withColumn("open", F.coalesce(F.sum(_count("code", r"[(\[{]") - _count("code", r"[)\]}]")).over(before), F.lit(0)))
    held = (F.col("open") > 0) | F.startswith("code", F.lit(_INSIDE)) | F.coalesce(F.endswith(F.lag("code").over(order), F.lit("\\")), F.lit(False))
    rows = rows.withColumn("held", held).withColumn("upto", F.lag("line").over(order))
    ends = rows.groupBy("path").agg(F.max("line").alias("end"))
    lead = F.replace(F.regexp_extract("code", r"^(\s*)", 1), F.lit("\t"), F.lit(" " * 8))
    logical = rows.where(~F.col("held")).withColumn("level", F.length(lead)).withColumn("was", F.lag("level").over(order))
    endings = logical.where("was >= level").select("path", F.explode(F.sequence("level", "was")).alias("level"), "line", "upto")
    defined = r"^\s*(?:async\s+)?(def|class)\s+([^\W\d]\w*)"
    kind = F.when(F.regexp_extract("code", defined, 1) == "class", "class").otherwise("function")
    found = logical.where(F.col("code").rlike(defined)).select("path", "level", F.col("line").alias("first_line"), F.regexp_extract("code", defined, 2).alias("name"), kind.alias("kind"), F.lit(False).alias("alone"))
    return _named(_ended(found, endings, ends))


def braced(files: DataFrame) -> DataFrame:
    """``SCHEMA`` of JavaScript and TypeScript files (path, text): classes, interfaces, enums, functions, arrows with a name, methods, and type aliases.

    A definition ends where the depth of braces falls back to that of its first line; one
    that opens none on a line of its own ends there.
    """
    order = Window.partitionBy("path").orderBy("line")
    rows = _lines(files, _BRACES, r"^/[/*]").where("code <> ''").withColumn("net", _count("code", r"\{") - _count("code", r"\}"))
    rows = rows.withColumn("after", F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("level", F.col("after") - F.col("net"))
    ends = rows.groupBy("path").agg(F.max("line").alias("end"))
    endings = rows.where("after < level").select("path", F.explode(F.sequence(F.col("after"), F.col("level") - 1)).alias("level"), "line", F.col("line").alias("upto"))
    out = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
    name = r"([A-Za-z_$][\w$]*)"
    patterns = (
        ("class", out + r"(?:abstract\s+)?class\s+" + name),
        ("interface", out + r"interface\s+" + name),
        ("enum", out + r"(?:const\s+)?enum\s+" + name),
        ("type_alias", out + r"type\s+" + name + r"\s*(?:<[^=]*>)?\s*="),
        ("function", out + r"(?:async\s+)?function\s*\*?\s*" + name),
        ("function", out + r"(?:const|let|var)\s+" + name + r"\s*(?::[^=]*)?=\s*(?:async\s+)?(?:\([^=]*\)|[\w$]+)\s*(?::[^=]*)?=>"),
        ("member?", r"^\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*[*#]?" + name + r"\s*(?:<[^>]*>)?\([^;]*$"),
    )
    kind, found_name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, p in reversed(patterns):
        hit = F.col("code").rlike(p)
        kind, found_name = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract("code", p, 1)).otherwise(found_name)
    found = rows.withColumn("kind", kind).withColumn("name", found_name).where(F.col("kind").isNotNull() & ~((F.col("kind") == "member?") & F.col("name").isin(*_NO_METHODS)))
    closed = F.contains("code", F.lit("{")) | F.endswith("code", F.lit(";")) | (F.col("kind") == "type_alias")
    alone = (F.col("net") == 0) & closed
    return _named(_ended(found.select("path", "level", F.col("line").alias("first_line"), "name", "kind", alone.alias("alone")), endings, ends))


def symbols(files: DataFrame) -> DataFrame:
    """``SCHEMA`` of source files (path, text), each by the rules of its language; files of other kinds have none."""
    # lines of a file stay in one task; blanked code shrinks so well that Spark, going by bytes, would put too much of it in one
    known = dealt(files_of.scanned(files.select("path", "text"), ()), "path")
    python = F.col("language") == "python"
    return indented(known.where(python)).unionByName(braced(known.where(~python)))
