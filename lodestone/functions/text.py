"""Text, URL and hash functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(tenant: Column, doc: Column, level: Column, index: Column) -> Column:
    """``chunk_{level}_{16 hex digits}`` of the chunk's place."""
    place = F.concat(tenant, F.lit(":"), doc.cast("string"), F.lit(":L"), level.cast("string"), F.lit(":C"), index.cast("string"))
    return F.concat(F.lit("chunk_"), level.cast("string"), F.lit("_"), F.substring(F.sha2(place, 256), 1, 16))


def tenant_bucket(tenant: Column, n: int) -> Column:
    """Bucket of a tenant by the first eight hex digits of its hash."""
    return F.conv(F.substring(F.sha2(tenant, 256), 1, 8), 16, 10).cast("long") % n


def cache_key(ids: Column, query: Column) -> Column:
    """Hash of a query and its sorted ids."""
    return F.sha2(F.concat(query, F.lit("\n"), F.array_join(F.array_sort(ids), "|")), 256)


def normalised_url(url: Column) -> Column:
    """Without fragment and trailing slash; null unless http or https."""
    clean = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    return F.when(clean.rlike("^https?://"), clean)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]+)", 1)


def public_url(url: Column) -> Column:
    """Whether a URL is http(s) with a host that is neither local nor private."""
    host = F.regexp_replace(F.lower(url_host(url)), ":[0-9]+$", "")
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    return F.coalesce((host != "") & ~private, F.lit(False))


def hrefs(html: Column) -> Column:
    """Distinct link targets."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('<a[^>]* href="([^"]*)"'), 1))


def joined_url(base: Column, reference: Column) -> Column:
    """A reference taken from the page at ``base``, as RFC 3986 resolves it: dot segments go, another scheme or host stays as it is. Empty segments of a relative path go too."""
    page = F.regexp_replace(base, r"#[\s\S]*$", "")
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(page, r"\?[\s\S]*$", "")
    folder = F.regexp_replace(F.substring(bare, F.length(origin) + 1, F.length(bare)), r"[^/]*$", "")
    said = F.trim(reference)
    rest = F.regexp_extract(said, r"^([^?#]*)([\s\S]*)$", 2)
    path = F.regexp_extract(said, r"^([^?#]*)", 1)

    def step(done, part):
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    def without_dots(path):
        parts = F.split(F.regexp_replace(path, "^/", ""), "/")
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        last = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last, F.lit("/")).otherwise(F.lit("")))

    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path), "/{2,}", "/"))
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return (
        F.when(said.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), said)
        .when(F.startswith(said, F.lit("//")), F.concat(scheme, said))
        .when(path == "", F.concat(F.when(F.startswith(said, F.lit("?")), bare).otherwise(page), rest))
        .otherwise(F.concat(origin, without_dots(rooted), rest))
    )


def html_references(html: Column) -> Column:
    """Targets of anchors, quoted either way or not at all, repeats included."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))


def markdown_references(markdown: Column) -> Column:
    """Targets of ``[text](target)``, repeats included."""
    return F.regexp_extract_all(markdown, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), 1)


def site_links(references: Column, base: Column) -> Column:
    """References resolved against their page, normalised, each once, in order; only those of the page's own host and port."""
    urls = F.transform(references, lambda x: normalised_url(joined_url(base, x)))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (F.lower(url_host(u)) == F.lower(url_host(base)))))


def markdown_title(markdown: Column) -> Column:
    """The first heading of the first level; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(markdown, r"(?m)^#[ \t]+(\S.*)$", 1)), F.lit(""))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1)), F.lit(""))


#: Named references of the markup dialect (fixed values).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def markup_text(markup: Column) -> Column:
    """Storage-format markup to plain text: macros out, other tags to a space, references decoded, white space collapsed."""
    out = F.regexp_replace(markup, r"</?(ac|ri):[^>]*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"<!\[CDATA\[", ""), r"\]\]>", "")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def truncated(text: Column, chars: int) -> Column:
    """At most ``chars`` characters and an ellipsis."""
    return F.when(F.length(text) > chars, F.concat(F.rtrim(F.substring(text, 1, chars)), F.lit("..."))).otherwise(text)


def terms(text: Column, stopwords: tuple[str, ...]) -> Column:
    """Distinct lower-case terms of three characters or more, in order, stopwords out."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9_-]{2,}"), 0), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stopwords)))


def longest(words: Column, n: int) -> Column:
    """The ``n`` longest, earlier ones first among equals."""
    numbered = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(numbered), 1, n), lambda x: x["w"])


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def estimated_chunks(tokens: Column, size: int) -> Column:
    """0 for nothing, 1 up to ``size``, else the tokens by four fifths of it, rounded up."""
    return F.when(tokens <= 0, 0).when(tokens <= size, 1).otherwise(F.ceil(tokens / (F.lit(0.8) * size))).cast("long")
