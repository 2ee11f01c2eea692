import random

import pytest

from lodestone.llm import html

SCHEMA = "page_id long, url string, html string, text string"


def text(page):
    return "\n".join(html.blocks(html.read(page)[0]))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b\n  c<br>d</p>", "a\nb c d"),
        ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';if(a<b){}</script></head><body><nav>menu</nav><article><h1>H &copy; &#233;&#x4e2d;</h1><p><b>one<br><p>two</article><footer>f</footer>", "H © é中\none\ntwo"),
        ("<body><div class='ad'>x</div><!-- <p>no</p> --><main><div class=\"post-comments\"><article>nope</article></div><p>yes<i>!</i></p></main><aside>s</aside></body>", "yes!"),
        ("<article><header><nav>n</nav><h1>T</h1><span>by X</span></header><p>a</p><form><p>f</p></form><div id=share-box>s</div></article>", "T\na"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><th>c</table><pre>x\n\ty</pre></article>", "one\ntwo\na b\nc\nx y"),
        ("<article>1 < 2 &lt;b&gt; &notit; <img src='a>b'> z</article>", "1 < 2 <b> ¬it; z"),
        ("<p title='<p>x</p>'>a</p", "a"),
        ("<article><p>a</p><script>never closed <p>b</p>", "a"),
        ("<article><div hidden>h</div><p>a&nbsp;b  c</p></article><article>second</article>", "a b c\nsecond"),
        ("<div class='layout has-sidebar'><article><p>Hello world</p></article></div>", "Hello world"),
        ("<div class='page-with-header'><main><p>Hello</p></main></div>", "Hello"),
        ("<article class='post share-enabled'><p>Hello</p></article>", "Hello"),
        ("<section id='advertisement-law'><article><p>On adverts</p></article></section>", "On adverts"),
        ("<article><p>a</p></article><div class='comments'><article><p>first!</p></article></div>", "a"),
        ("<article><p>a</p><p class='share-price'>b</p><p class=header-note>c</p><section id=related-work><h2 id=search>d</h2>e</section><div class='search-algorithms'>f</div>g <math><mi>x</mi></math></article>", "a\nb\nc\nd\ne\nf\ng x"),
        ("<article><table class='header'><tr class=header><th class='header'>t</table><div class=section-header><h2>H</h2>by X</div><ul><li id=login>l</ul><section id=notices>n</section></article>", "t\nH\nl\nn"),
        ("<article>a<div class='cookie-banner'>1</div><div class=relatedPosts>2</div><p class='ad'>3</p><p class='cookie-notice'>4</p><section id=comments>5</section><div class='post-comments'>6</div><div class=social-links>7</div><ul class=pagination><li>8</ul><section class=newsletter>9</section><p role=alert>10</p></article>", "a"),
        ("<div class='top-nav-container'>menu</div><p class='search-result'>a</p><div id=site-footer-inner>f</div>", "a"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_extraction(page, expected):
    assert text(page) == expected


def site(n, host="a.example.com"):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    out = []
    for i in range(n):
        own = [" ".join(word() for _ in range(12)) for _ in range(3)]
        shared = "A passage that all of the articles share."
        page = f"<body><div class=top>Welcome to us</div><article><h1>{own[0]}</h1><p>{own[1]}</p><div class=box><p>Read our guide</p></div><p>{shared}</p><section><p>{own[2]}</p></section></article><div>All about us</div></body>"
        out.append((f"https://{host}/{i}", page, "\n".join([own[0], own[1], shared, own[2]])))
    return out


def test_templates_go_and_copies_stay(spark, monkeypatch):
    monkeypatch.setattr(html, "MIN_PAGES", 5)
    pages = site(12) + site(1, "b.example.com")
    copies = [(f"https://a.example.com/copy{i}", "<body><article><section><p>copied text</p></section></article></body>", "copied text") for i in range(30)]
    few = [(u, p, e.replace("A passage", "Read our guide\nA passage")) for u, p, e in site(1, "c.example.com")]
    rows = pages[:12] + [(pages[12][0], pages[12][1], pages[12][2].replace("A passage", "Read our guide\nA passage"))] + copies + few + [(None, None, ""), ("x", "", "")]
    runs = []
    for limit in (html.BROADCAST_TEMPLATES, -1):
        monkeypatch.setattr(html, "BROADCAST_TEMPLATES", limit)
        out = html.extract(spark.createDataFrame([(i, u, p, "clash") for i, (u, p, _) in enumerate(rows)], SCHEMA))
        assert out.columns == ["page_id", "url", "text"]
        runs.append({r["page_id"]: r["text"] for r in out.collect()})
    assert runs[0] == runs[1] == {i: e for i, (_, _, e) in enumerate(rows)}


def brute(rows):
    """Main text of each (url, html) with templates counted in plain dicts."""
    from collections import defaultdict
    from urllib.parse import urlsplit

    seen, total, out = defaultdict(set), defaultdict(set), []
    for url, page in rows:
        host, (longest, keys, prose) = urlsplit(url or "").hostname or "", html.page_keys(page or "")
        total[host].add(longest)
        for kind, found in ((False, keys), (True, prose)):
            for k in found:
                seen[host, k, kind].add(longest)
    template = {x for x, p in seen.items() if len(p) > html.MIN_PAGES and len(p) > (html.PROSE_SHARE if x[2] else html.MIN_SHARE) * len(total[x[0]])}
    for url, page in rows:
        host = urlsplit(url or "").hostname or ""
        articles, candidates, prose = html.read(page or "")
        gone = {id(e) for e in candidates if (host, e.key, False) in template}
        for run in (prose, prose[::-1]):
            for e in run:
                if (host, e.key, True) not in template:
                    break
                gone.add(id(e))
        out.append("\n".join(html.blocks(articles, gone)))
    return out


def test_matches_brute_force_and_edges_go(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    own = lambda: " ".join(word() for _ in range(20))
    rows, expected = [], []
    for i in range(60):
        host = "ab"[i % 2]
        body = [own() for _ in range(rnd.randint(1, 4))]
        box = "<div><p>Read more here</p></div>" if i % 3 else ""
        rows.append((f"http://{host}.example/{i}", f"<body><div class='wrap with-header'><article><p>{body[0]}</p>{box}" + "".join(f"<p>{b}</p>" for b in [*body[1:], "Write to us for our letter.", "All rights reserved."][: rnd.choice((3, 9))]) + "</article></div></body>"))
    for i in range(30):  # edited copies of one page share their prose, which stays
        rows.append((f"http://c.example/{i}", f"<article><p>one long paragraph {'that all of them share ' * 5}</p><p>edit {i}</p><p>the end</p></article>"))
    found = brute(rows)
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(rows)], "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(found))
    assert all("Read more" not in t and "All rights" not in t for t in found[:60]) and all(t.endswith("the end") for t in found[60:])
    assert sum("Read more" in p for _, p in rows) >= 30 and sum("All rights" in p for _, p in rows) >= 20


def test_ids_stay_exact_and_names_may_clash(spark):
    rows = [((1 << 60) + 1, "http://a.b/", "<p>x", "h", None), (None, None, "<p>y", None, 5), ((1 << 60) + 3, "u", None, "k", (1 << 60) + 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, own_host string, whole_page long").coalesce(1)
    got = html.extract(pages).collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(page_id=a, url=b, own_host=d, whole_page=e, text=t) for (a, b, _, d, e), t in zip(rows, ("x", "y", ""), strict=True)]))


def test_pages_without_an_article(spark, monkeypatch):
    monkeypatch.setattr(html, "MIN_PAGES", 5)
    rows = [(i, "http://h.example/", f"<body><div><p>Site name</p><p>Slogan</p></div><p>own text {i}</p></body>", "") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"own text {i}" for i in range(8)}


def test_long_page_is_linear_and_empty_table(spark):
    for page in ("<p>" * 100_000, "<" * 200_000, "<a b='" * 5_000, "</p>" * 100_000, "&" * 200_000, "<!--" * 50_000, "<div>" * 100_000 + "<article>x"):
        text(page)
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_runs_of_template_go(spark):
    shared = [f"<p>Clause {i} of our terms of use.</p>" for i in range(30)]
    rows = [(i, "http://h.example/", f"<article><p>text of page {i} alone, which says more than any clause</p>{''.join(shared)}</article>", "") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"text of page {i} alone, which says more than any clause" for i in range(12)}
