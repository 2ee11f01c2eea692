"""Tables, sections, prompts and other texts that are put together or taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def table_markdown(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    """A Markdown table of an array of headers and one of rows of cells; bars in cells are escaped."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    width = F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.size(F.get(rows, 0)))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    head = F.when(F.size(headers) > 0, F.array(line(headers), rule)).otherwise(F.array(rule))
    body = F.transform(rows, lambda r: line(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))))
    top = F.array(F.concat(F.lit("**"), caption, F.lit("**\n"))) if caption is not None else F.array().cast("array<string>")
    lines = F.concat(F.filter(top, lambda x: x.isNotNull()), head, body)
    return F.when((F.size(headers) == 0) & (F.size(rows) == 0), "").otherwise(F.array_join(lines, "\n"))


def row_slices(rows: Column, most: int) -> Column:
    """Array of (first, rows): a table's rows ``most`` at a time, ``first`` counted from 0."""
    starts = F.filter(F.sequence(F.lit(0), F.size(rows), F.lit(most)), lambda i: i < F.size(rows))
    return F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice(rows, i + 1, most).alias("rows")))


def row_maps(headers: Column, rows: Column) -> Column:
    """Array of maps from header to cell; a missing cell is empty."""
    return F.transform(rows, lambda r: F.map_from_arrays(headers, F.transform(headers, lambda h, i: F.coalesce(F.get(r, i), F.lit("")))))


def section_text(heading: Column, content: Column) -> Column:
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("## "), heading, F.lit("\n\n"), content)).otherwise(content)


def summary(response: Column) -> Column:
    """The text after the last SUMMARY: at a line's beginning."""
    lines = F.filter(F.split(F.trim(response), "\n"), lambda x: x.startswith("SUMMARY:"))
    found = F.trim(F.replace(F.element_at(lines, -1), F.lit("SUMMARY:"), F.lit("")))
    return F.when((F.size(lines) > 0) & (found != ""), found).otherwise("A community of related entities")


def keywords(response: Column) -> Column:
    """The words after the last KEYWORDS: at a line's beginning, without empty ones."""
    lines = F.filter(F.split(F.trim(response), "\n"), lambda x: x.startswith("KEYWORDS:"))
    words = F.transform(F.split(F.replace(F.element_at(lines, -1), F.lit("KEYWORDS:"), F.lit("")), ","), lambda w: F.trim(w))
    return F.when(F.size(lines) > 0, F.filter(words, lambda w: w != "")).otherwise(F.array().cast("array<string>"))


def normal_path(path: Column) -> Column:
    """A path without leading slashes and ``./``, with forward slashes."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"^[/\\]+", ""), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def requirement(line: Column) -> Column:
    """The package of a requirement line; null for comments, options and blank lines."""
    entry = F.trim(F.regexp_replace(F.trim(line), r"^-e ", ""))
    entry = F.trim(F.substring_index(entry, ";", 1))
    entry = F.when(F.contains(entry, F.lit("@")) & F.contains(entry, F.lit("://")), F.trim(F.substring_index(entry, "@", 1))).otherwise(entry)
    entry = F.trim(F.regexp_replace(F.substring_index(entry, "[", 1), r"(==|>=|<=|!=|~=|>|<).*$", ""))
    skipped = F.trim(line).rlike(r"^(#|-r|--)")
    return F.when(~skipped & (entry != ""), entry)


def _names(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))


# Sections of package.json that name packages.
_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def json_packages(text: Column) -> Column:
    """Sorted names of packages that a package.json declares; none where it doesn't parse, or a section is no object."""
    sections = [F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{s}")), F.array().cast("array<string>")) for s in _SECTIONS]
    return _names(F.concat(*sections))


def toml_packages(text: Column) -> Column:
    """Sorted names of packages that a pyproject.toml declares: the project's lists, required and optional, and the keys of Poetry's tables but ``python``.

    Null and texts without such tables give none. Inline tables of lists and names in headers aren't understood.
    """
    string = r"\"[^\"\n]*\"|'[^'\n]*'"
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?m)({string})|#[^\n]*$", "$1")

    def tables(header: str) -> Column:
        return F.array_join(F.regexp_extract_all(plain, F.lit(rf"(?ms)^[ \t]*\[[ \t]*{header}[ \t]*\][ \t]*$(.*?)(?=^[ \t]*\[[^\n]*\][ \t]*$|\z)"), 1), "\n")

    def listed(block: Column, key: str) -> Column:
        lists = F.array_join(F.regexp_extract_all(block, F.lit(rf"(?m)^[ \t]*{key}[ \t]*=[ \t]*\[((?:{string}|[^\]\"'])*)\]"), 1), "\n")
        return F.transform(F.regexp_extract_all(lists, F.lit(rf"({string})"), 1), lambda x: requirement(F.substring(x, 2, F.length(x) - 2)))

    word = r"(?:[\w.-]+|\"[^\"\n]*\"|'[^'\n]*')"
    poetry = F.concat(tables(r"tool\.poetry\.dependencies"), F.lit("\n"), tables(r"tool\.poetry\.group\.[\w-]+\.dependencies"))
    keys = F.transform(F.regexp_extract_all(poetry, F.lit(rf"(?m)^[ \t]*({word})[ \t]*="), 1), lambda x: F.regexp_replace(x, "[\"']", ""))
    return _names(F.concat(listed(tables("project"), "dependencies"), listed(tables(r"project\.optional-dependencies"), word), F.filter(keys, lambda x: F.lower(x) != "python")))


def masked_proxy(url: Column) -> Column:
    """A proxy's URL without its credentials; what comes after the port goes with them."""
    parts = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]+)@([^/?#@]+)", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]+@([^/?#@]+)", 1))
    return F.when(parts == "", url).otherwise(F.concat(parts, F.lit("://***:***@"), host))


def cut_words(text: Column, most: int) -> Column:
    """A text of at most ``most`` words; a longer one is cut and says so."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) <= most, text).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("... [truncated]")))


def overlap(left: Column, right: Column, most: int) -> Column:
    """The longest piece, of at most ``most`` characters, that ends ``left`` and begins ``right``."""
    probe = F.least(F.length(left), F.length(right), F.lit(most))
    sizes = F.filter(F.sequence(F.lit(0), probe), lambda n: F.right(left, n) == F.left(right, n))
    return F.array_max(sizes)
