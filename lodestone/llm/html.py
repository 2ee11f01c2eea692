"""Main text of HTML pages, with site templates found by counting subtrees.

A page is read into elements by a forgiving scan. The hash of every element's
subtree (tags, classes and text) goes to Spark, which counts in how many different
pages of a host it stands. Subtrees above the limit are the site's template and are
deleted, beside elements that can't be main text by their tag, role or class.

Pages count as different by the longest block of their article, so copies and edited
copies of one page don't make a template of its text. Prose that stands directly in
the article is deleted as template only at its beginning or end, and only if half of
the host's different pages have it there: passages that articles share are their text.
An element that holds the article is never dropped by its class, role or count.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, free_names, with_computed

#: A subtree is template if more than this many different pages of the host have it
MIN_PAGES = 5
#: and more than this share of them; prose at the edge of an article needs the larger share.
MIN_SHARE, PROSE_SHARE = 0.05, 0.5
#: Template hashes are sent to the tasks if they are at most so many.
BROADCAST_TEMPLATES = 500_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_HINT = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that are never main text.
DROP = frozenset("nav footer aside form script style noscript template head title iframe object embed svg canvas audio video button select textarea input label dialog menu noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of class names and ids that tell what an element is for.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar footer masthead header"
    " comment comments disqus replies respond share sharing social related recommended newsletter subscribe signup login search skip widget".split()
)
#: Words of names that say only where an element stands or that it holds something.
PARTS = frozenset("area bar block box button buttons column container content form group icons inner item items link links list panel post posts article articles row section slot text unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSES_P = BLOCK - {"body", "html", "option", "optgroup"}
#: A start tag ends an open element of these tags, up to a boundary.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Element:
    __slots__ = ("tag", "attributes", "children", "key")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.key = tag, attributes, [], None

    def named(self) -> tuple[list[str], list[str], str, bool]:
        """(classes, ids, role, whether it is hidden), names in lower case with words apart"""
        if not self.attributes:
            return [], [], "", False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(self.attributes)}
        classes, ids = (re.sub(r"([a-z])([A-Z])", r"\1-\2", found.get(k, "")).lower().split() for k in ("class", "id"))
        return classes, ids, found.get("role", "").lower(), "hidden" in found or found.get("aria-hidden", "").lower() == "true"


def parse(html: str) -> Element:
    """The page's elements. Unclosed and stray tags are taken as browsers do in the common cases."""
    root = Element("#root")
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].children.append(entities.unescape(html[at:start]))
        if not m:
            break
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[0] == "<" and re.match(r"/?[a-zA-Z]", html[at : at + 2]):  # a tag with an open quote, or cut off
                at = html.find(">", at) + 1 or n
            elif m[0] == "<":
                stack[-1].children.append("<")
            elif m[1]:
                stack[-1].children.append(m[1])
            continue
        tag = tag.lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table", "article", "main", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "article", "main", "body", "html"):
                    break
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK or stack[i].tag in ("td", "th", "button"):
                    break
        if tag in _IMPLIED:
            ended, within = _IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                    if tag != "tr":
                        break
                elif stack[i].tag in within:
                    break
            # a row ends its open cells and then the row before
        element = Element(tag, m[4])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(element)
    return root


def _purpose(e: Element, in_article: bool) -> set[str]:
    """The hints in the names of an element.

    Prose (paragraphs, headings, lists, tables) is told by classes made of hints alone.
    Other elements of an article are told by names that end in a hint or are made of
    hints and parts ("share-box", not "share-price"), sections by such classes and by
    ids of others' text, as ids of sections follow their headings. Elsewhere any word counts.
    """
    classes, ids, _, _ = e.named()
    prose = e.tag in _PROSE
    if prose:
        ids = []
    elif in_article and e.tag == "section":
        ids = [i for i in ids if i in _OTHERS]
    found: set[str] = set()
    for name in classes + ids:
        words = _HINT.findall(name)
        hints = HINTS.intersection(words)
        if prose:
            told = all(w in HINTS or w.isdigit() for w in words)
        elif in_article:
            whole = words[-1:] and words[-1] in HINTS
            told = not name.startswith(("has-", "with-", "no-")) and (whole or all(w in HINTS or w in PARTS or w.isdigit() for w in words))
        else:
            told = True
        if told:
            found |= hints
    return found - _TOPS if prose and in_article else found


def _unwanted(e: Element, in_article: bool, holders: set[int]) -> bool:
    """By tag, role or class; never what holds an article. A header inside the article is left to :func:`_pruned`."""
    if id(e) in holders:
        return False
    if e.tag in DROP or (e.tag == "header" and not in_article):
        return True
    if e.tag in ("html", "body", "main", "#root") or not e.attributes:
        return False
    _, _, role, hidden = e.named()
    return hidden or role in ROLES or bool(_purpose(e, in_article) - (_TOPS if in_article else set()))


#: Of what these name within an article the headings stay.
_TOPS = frozenset({"header", "masthead"})
#: An article in one of these is not the page's.
_ASIDES = frozenset("aside footer nav form dialog template noscript".split())
#: Words of classes whose articles are readers' or other pages'.
_OTHERS = frozenset("comment comments disqus replies respond related recommended sidebar ad ads advert adverts sponsor sponsored promo".split())


def _holders(root: Element) -> set[int]:
    """``id()`` of the page's outermost articles, else of its main elements, and of all that they stand in."""
    for tag in ("article", "main"):
        found: set[int] = set()
        stack: list = [(root, None)]
        while stack:
            e, above = stack.pop()
            here = (id(e), above)  # a chain up to the root
            if e.tag == tag:
                while here and here[0] not in found:
                    found.add(here[0])
                    here = here[1]
                continue
            for c in e.children:
                # whole words only: a layout named after its sidebar still holds the article
                if isinstance(c, Element) and c.tag not in _ASIDES and not (c.attributes and _names(c) & _OTHERS):
                    stack.append((c, here))
        if found:
            return found
    return set()


def _names(e: Element) -> set[str]:
    """Classes and id of an element, whole, and the last word of each ("post-comments": comments; "has-sidebar": none)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(e.attributes)}
    whole = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    return {w for name in whole for w in [name, *name.replace("_", "-").split("-")[-1:]] if not name.startswith(("has-", "with-", "no-"))}


def _pruned(root: Element) -> Element:
    """The tree without elements that can't be main text."""

    holders = _holders(root)
    stack = [(root, False)]
    while stack:
        e, inside = stack.pop()
        inside = inside or e.tag in ("article", "main")
        kept = []
        for c in e.children:
            if isinstance(c, Element):
                if _unwanted(c, inside, holders):
                    kept.append(" " if c.tag not in BLOCK else Element("hr"))
                    continue
                if c.tag == "header" or (inside and id(c) not in holders and c.attributes and _purpose(c, True)):  # its headings are text
                    c.children = _headings(c)
                stack.append((c, inside))
            kept.append(c)
        e.children = kept
    return root


def _headings(e: Element) -> list[Element]:
    found, stack = [], list(reversed(e.children))
    while stack:
        c = stack.pop()
        if isinstance(c, Element):
            if c.tag in HEADINGS:
                found.append(c)
            else:
                stack.extend(reversed(c.children))
    return found


def _postorder(root: Element) -> list[Element]:
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        out.append(e)
        stack.extend(c for c in e.children if isinstance(c, Element))
    return out[::-1]


def _hashed(root: Element) -> None:
    """Give every element the hash of its subtree."""
    import xxhash

    for e in _postorder(root):
        h = xxhash.xxh3_64()
        h.update(f"<{e.tag} {' '.join(e.attributes.split())}>".encode("utf-8", "surrogatepass"))
        for c in e.children:
            h.update(c.key.to_bytes(8, "big", signed=True) if isinstance(c, Element) else b"\0" + _SPACE.sub(" ", c).strip().encode("utf-8", "surrogatepass"))
        value = h.intdigest()
        e.key = value - (1 << 64) if value >> 63 else value


def _articles(root: Element) -> list[Element]:
    """The outermost articles, else the main elements, else the body, else the page."""
    for tag in ("article", "main", "body"):
        found, stack = [], [root]
        while stack:
            e = stack.pop()
            if e.tag == tag:
                found.append(e)
            else:
                stack.extend(c for c in reversed(e.children) if isinstance(c, Element))
        if found:
            return found
    return [root]


_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre table thead tbody tfoot tr td th caption figcaption".split())


def _candidates(root: Element) -> list[Element]:
    """Block elements that may be template: none in an article's prose, and not what holds the whole page or article."""
    out, stack = [], [(c, False) for c in root.children if isinstance(c, Element)]
    holders = _holders(root)
    while stack:
        e, strict = stack.pop()
        if strict and e.tag in _PROSE:
            continue
        if e.tag in BLOCK and e.tag not in ("html", "body", "main", "article", "hr") and id(e) not in holders:
            out.append(e)
        stack.extend((c, strict or e.tag in ("main", "article")) for c in e.children if isinstance(c, Element))
    return out


def _edges(articles: list[Element]) -> list[Element]:
    """The prose elements of the articles, outermost ones, in page order."""
    out, stack = [], [c for a in reversed(articles) for c in reversed(a.children) if isinstance(c, Element)]
    while stack:
        e = stack.pop()
        if e.tag in _PROSE:
            out.append(e)
        else:
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))
    return out


def _peeled(prose: list[Element], template: Callable[[int], bool]) -> set[int]:
    """``id()`` of the prose elements from the beginning and from the end that are template, up to the first that isn't."""
    gone: set[int] = set()
    for run in (prose, prose[::-1]):
        for e in run:
            if not template(e.key):
                break
            gone.add(id(e))
    return gone


def blocks(articles: list[Element], dropped: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """The texts of the blocks, in page order, without the elements whose ``id()`` is in ``dropped``."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := _SPACE.sub(" ", "".join(parts)).strip():
            out.append(text)
        parts.clear()

    for top in articles:
        flush()
        stack: list = [(top, False)]
        while stack:
            e, closing = stack.pop()
            if isinstance(e, str):
                parts.append(e)
            elif closing or id(e) in dropped:
                flush()
            elif e.tag == "br" or e.tag in VOID - {"hr", "wbr"}:
                parts.append(" ")
            else:
                if e.tag in BLOCK:
                    flush()
                    stack.append((e, True))
                elif e.tag in ("td", "th"):
                    parts.append(" ")
                stack.extend((c, False) for c in reversed(e.children))
        flush()
    return out


def read(html: str | None) -> tuple[list[Element], list[Element], list[Element]]:
    """The page's article elements, pruned, the candidates for template, and the articles' prose; all hashed before pruning."""
    root = parse(html or "")
    _hashed(root)
    candidates = _candidates(root)
    articles = _articles(_pruned(root))
    strict = [a for a in articles if a.tag in ("article", "main")]
    return articles, candidates, _edges(strict)


def host_of(url):
    """Column: the host of a URL in lower case; empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_keys(html: str) -> tuple[int, list[int], list[int]]:
    """(hash of the longest block of the article, keys of candidate subtrees, keys of the article's prose)."""
    import xxhash

    articles, candidates, prose = read(html)
    longest = max(blocks(articles), key=lambda b: (len(b), b), default="")
    return xxhash.xxh3_64_intdigest(longest.encode("utf-8", "surrogatepass")) - (1 << 63), sorted({e.key for e in candidates}), sorted({e.key for e in prose})


def subtree_hashes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, page, keys, prose): per page row, see :func:`page_keys`; keys once each."""
    longs = pa.list_(pa.int64())
    new = [("page", "long", pa.int64()), ("keys", "array<long>", longs), ("prose", "array<long>", longs)]
    chosen = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return with_computed(chosen, [F.col("html")], new, lambda texts: tuple(zip(*map(page_keys, texts), strict=True))).drop("html")


def templates(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, key, prose), written: subtrees in more different pages of the host than the limits; ``prose``: goes at edges only."""
    found = scratch.keep(subtree_hashes(pages, url_col, html_col), "hashes")
    totals = found.groupBy("host").agg(F.countDistinct("page").alias("total"))
    seen = [found.select("host", "page", F.explode(c).alias("key"), F.lit(c == "prose").alias("prose")) for c in ("keys", "prose")]
    counts = seen[0].union(seen[1]).distinct().groupBy("host", "key", "prose").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MIN_PAGES)
    share = F.when(F.col("prose"), PROSE_SHARE).otherwise(MIN_SHARE)
    return scratch.keep(counts.join(totals, "host").where(F.col("n") > F.col("total") * share).select("host", "key", "prose"), "templates")


def _without(html: str, is_template: Callable[[int], bool], is_prose: Callable[[int], bool]) -> str:
    articles, candidates, prose = read(html)
    dropped = {id(e) for e in candidates if is_template(e.key)}
    return "\n".join(blocks(articles, dropped | _peeled(prose, is_prose)))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col`` and with ``text_col``: each page's main text, blocks joined by newlines.

    Null and empty pages give an empty text, and so do pages with nothing but
    template. The article's headings stay. White space within a block becomes one
    space; ``<br>`` is white space. Cells of a table row are joined by a space.
    Repeated rows get equal texts; a null URL is a host of its own. All other columns
    stay as they are; an empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    found = templates(pages, scratch, url_col, html_col)
    names = [c for c in pages.columns if c not in (html_col, text_col)]
    html_name, host_name, keys_name, page_name = free_names(pages, "whole_page", "own_host", "own_keys", "page_key")
    html = F.coalesce(F.col(html_col), F.lit(""))
    tagged = pages.select(*names, html.alias(html_name), host_of(F.col(url_col)).alias(host_name))
    shared = None
    if found.count() <= BROADCAST_TEMPLATES:
        shared = spark.sparkContext.broadcast({(r["host"], r["key"], r["prose"]) for r in found.collect()})
        tagged = tagged.withColumn(keys_name, F.lit(None).cast("array<struct<key: bigint, prose: boolean>>"))
    else:  # too many to send: the page's own hashes meet the templates in a join
        keyed = pages.select(F.xxhash64(html).alias("page"), host_of(F.col(url_col)).alias("host"), html.alias("html")).dropDuplicates(["page", "host"])
        own = with_computed(keyed, [F.col("html")], [("keys", "array<long>", pa.list_(pa.int64())), ("prose", "array<long>", pa.list_(pa.int64()))], lambda texts: tuple(zip(*(page_keys(t)[1:] for t in texts), strict=True)))
        own = [own.select("host", "page", F.explode(c).alias("key"), F.lit(c == "prose").alias("prose")) for c in ("keys", "prose")]
        own = own[0].union(own[1]).join(found, ["host", "key", "prose"]).groupBy(F.col("host").alias(host_name), F.col("page").alias(page_name)).agg(F.collect_set(F.struct("key", "prose")).alias(keys_name))
        tagged = tagged.withColumn(page_name, F.xxhash64(html_name)).join(scratch.keep(own, "own"), [host_name, page_name], "left")

    def texts(htmls: list, hosts: list, keys: list) -> tuple:
        out = []
        for html, host, own in zip(htmls, hosts, keys, strict=True):
            if shared is not None:
                out.append(_without(html, lambda k, h=host: (h, k, False) in shared.value, lambda k, h=host: (h, k, True) in shared.value))
            else:
                mine = {(x["key"], x["prose"]) for x in own or ()}
                out.append(_without(html, lambda k, m=mine: (k, False) in m, lambda k, m=mine: (k, True) in m))
        return (out,)

    made_name = free_names(tagged, text_col)[0]
    made = with_computed(tagged, [F.col(html_name), F.col(host_name), F.col(keys_name)], [(made_name, "string", pa.string())], texts)
    return made.select(*(F.col(f"`{c}`") for c in names), F.col(made_name).alias(text_col))
