"""References of pages, resolved as the standard library does it."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from lodestone.functions import text

BASES = ["http://h/a/b/c?q=1#f", "https://h:81", "http://h/", "http://h/a", "https://h/a/b/"]
REFERENCES = ["x", "./x", "../x", "../../x", "../../../../x", "/x/../y", "?p=2", "#top", "", "//o/z", "https://o/z?a#b", "mailto:a@b", "x/./y/../z/", "..", ".", "g?y/../x", "g#s/../x", "/", "a//b", "x;y=1"]


def test_references_resolve_as_by_the_standard_library(spark):
    df = spark.createDataFrame([(b, r) for b in BASES for r in REFERENCES], "base string, ref string")
    for row in df.select("*", text.joined_url(F.col("base"), F.col("ref")).alias("got")).collect():
        want = urljoin(row["base"], row["ref"])
        same = row["got"] == want or row["got"].rstrip("/") == want.rstrip("/")
        # an empty reference keeps the page's address; the fragment goes in normalising
        assert same or (row["ref"] == "" and row["got"] == want.split("#")[0]), (row, want)


def test_links_and_titles(spark):
    html = """<A class=x HREF='b'>b</A> <a href="/c/">c</a><a href=d#e>d</a> <a href="http://other/x">o</a> <a href="HTTP://no">n</a> <a name="q">q</a> <a href="/c">again</a> <abbr href="z">"""
    md = "Text\n#no\n#  Title here \n# Second\n[a](x) ![i](/pic.png) [b](https://h/y) [o](ftp://h/z) []()"
    r = spark.createDataFrame([("http://h/a/p", "https://H/q", html, md)], "u string, v string, html string, md string").select(
        text.site_links(text.html_references(F.col("html")), F.col("u")).alias("a"),
        text.site_links(text.markdown_references(F.col("md")), F.col("v")).alias("b"),
        text.markdown_title(F.col("md")).alias("t"), text.markdown_title(F.lit("no")).alias("none"), text.site_links(text.html_references(F.lit(None).cast("string")), F.col("u")).alias("null"),
    ).first()
    assert r["a"] == ["http://h/a/b", "http://h/c", "http://h/a/d"]
    assert r["b"] == ["https://H/x", "https://H/pic.png", "https://h/y"]
    assert (r["t"], r["none"], r["null"]) == ("Title here", None, None)
