import html
import math
import random
import re
import time
from collections import defaultdict

import pytest

from tracewell.llm import html_text as h


def one(page, url="http://a.example/x"):
    return h.extracted(h.parse(page), h.host_of(url), frozenset())


def test_blocks_space_and_references():
    page = "<html><body><article><h1>A &amp; B</h1><p>one <b>two\n\t three<br>four<p>five &lt;p&gt; &#233;<ul><li>x<li>y</ul></article></body></html>"
    assert one(page) == "A & B\none two three four\nfive <p> é\nx\ny"


def test_parts_that_are_not_the_article():
    noise = [
        "<nav><ul><li>menu</li></ul></nav>", "<header><p>site</p></header>", "<aside>side</aside>", "<footer>foot</footer>", "<form><label>f</label><input></form>",
        '<div class="ad">buy</div>', '<div class="cookie-notice">we use</div>', '<div id="sidebar"><p>links</p></div>', '<section class="comments"><article><p>reader</p></article></section>',
        '<script>var t="</p><p>no</p>";</script>', "<style>p{}</style>", "<!-- <p>no</p> -->", "<noscript><p>no</p></noscript>", '<div role="navigation">n</div>', '<div style="display: none">no</div>',
    ]
    for n in noise:
        for page in (f"<body>{n}<article><p>yes</p></article></body>", f"<body><article><p>yes</p>{n}</article></body>", f"<body><main><p>yes</p>{n}</main>", f"<body><div class=story><p>yes</p></div>{n}</body>"):
            if "<header>" in n and "<p>yes</p><header>" in page and "story" not in page:
                continue
            assert one(page) == "yes", (n, page)


def test_broken_markup_and_nothing():
    assert one("") == ""
    assert one("<p>a<div>b</p>c") == "a\nb\nc"
    assert one("<article><p>cut <b>off") == "cut off"
    assert one("just text &nbsp;x") == "just text \xa0x"
    assert one("a < b <article") == "a < b"
    assert one("<p>x</p><script>never ends <p>no") == "x"
    assert one("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert one("<div>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize("shared", [200_000, 0])
def test_site_style_tree_removes_what_pages_share(spark, monkeypatch, shared):
    monkeypatch.setattr(h, "SHARED", shared)
    rows = []
    for i in range(40):
        words = " ".join(f"w{i}x{j}" for j in range(30))
        box = "<div><div>About this site</div><div>Read the rules</div></div>"
        rows.append((i, "http://one.example/p", f"<body>{box}<div><p>Story {i}.</p><p>{words}</p></div><div>All rights of one.example</div></body>"))
    rows += [(100, "http://two.example/", "<body><div>About this site</div><div><p>Alone.</p></div></body>"), (101, None, None), (102, "http://[bad", "<p>odd")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in h.main_text(df).collect()}
    for i in range(40):
        words = " ".join(f"w{i}x{j}" for j in range(30))
        assert got[i].text == f"Story {i}.\n{words}"
        assert got[i].n_chars == len(got[i].text)
    assert got[100].text == "About this site\nAlone."
    assert (got[101].text, got[101].n_chars, got[102].text) == ("", 0, "odd")


def test_nested_wrappers_keep_what_they_wrap(spark):
    rows = []
    for i in range(40):
        words = " ".join(f"w{i}x{j}" for j in range(30))
        for host, depth in (("ten", 10), ("twenty", 20)):
            inner = f"{'<div>' * depth}<p>Story {i}.</p><p>{words}</p>{'</div>' * depth}"
            rows.append((len(rows), f"http://{host}.example/p", f"<body><div>About this site</div>{inner}<div>All rights</div></body>"))
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        i = r.page_id // 2
        assert r.text == f"Story {i}.\n" + " ".join(f"w{i}x{j}" for j in range(30))


def test_end_tags_of_elements_too_deep():
    page = f"<p>yes</p>{'<div>' * 180}<div class=ad>{'<div>' * 40}a{'</div>' * 40}no</div>"
    assert one(page) == "yes"


def test_deep_elements_keep_order_and_marks():
    for depth in (10, 198, 199, 200, 201, 250, 1000):
        open_, close = "<div>" * depth, "</div>" * depth
        assert one(f"{open_}<nav>menu</nav><p>yes</p>{close}") == "yes"
        assert one(f"{open_}a<div>b</div>c<p>d <b>e</b> f</p>g{close}h") == "a\nb\nc\nd e f\ng\nh"
        assert one(f"{open_}<nav>no<div>no<p>no</div>no</nav>x <i>y</i>{close}") == "x y"


def test_names_that_only_contain_a_word_of_noise():
    assert one("<div class='page has-sidebar'><article><p>yes</article></div>") == "yes"
    assert one("<div class='content share-enabled'><p>yes</p></div>") == "yes"
    assert one("<article><div class='post-header'><h1>Title</h1></div><p>yes</p></article>") == "Title\nyes"
    for name in ("sidebar", "site-footer", "ad banner2", "ad-box-1", "cookie_notice", "reader-comments"):
        assert one(f"<div class='{name}'>no</div><p>yes</p>") == "yes", name


def brute_values(pages):
    """place -> (pages, importance) by plain dictionaries: entropies of what a place holds, then from the leaves up."""
    seen, parent_of, leaf = defaultdict(lambda: defaultdict(set)), {}, set()
    for page_id, url, page in pages:
        for _, place, parent, content, is_leaf in h.judged(h.host_of(url), h.parse(page or "")):
            seen[place][content].add(page_id)
            parent_of[place] = parent
            leaf |= {place} if is_leaf else set()
    n, own = {}, {}
    for place, contents in seen.items():
        n[place] = sum(map(len, contents.values()))
        shares = [len(x) / n[place] for x in contents.values()]
        own[place] = -sum(p * math.log(p) for p in shares) / math.log(n[place]) if n[place] > 1 else 1.0
    inner = defaultdict(list)
    for place, parent in parent_of.items():
        inner[parent].append(place)

    def value(place):
        below = inner.get(place)
        if not below:
            return own[place]
        mean = sum(n[c] * value(c) for c in below) / sum(n[c] for c in below)
        mixed = h.DECAY * mean + (1 - h.DECAY) * own[place]
        return max(mean, mixed) if len(below) == 1 else mixed

    return {place: (n[place], value(place)) for place in seen}


def test_importance_is_that_of_a_plain_model_and_decides(spark):
    rng = random.Random(12)
    pages = []
    for i in range(60):
        story = "".join(f"<p>{' '.join(rng.choice('abcdefgh') * rng.randint(1, 9) for _ in range(20))}</p>" for _ in range(rng.randint(1, 4)))
        links = "".join(f"<li>{x}</li>" for x in ("Home", "News", "About"))
        promo = f"<div><div><p>{rng.choice(['Buy now', 'Join us'])}</p></div></div>"
        pages.append((i, f"http://h{i % 2}.example/{i}", f"<body><div><ul>{links}</ul></div><div><div>{story}</div>{promo}</div><div><p>Terms</p></div></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    places = df.mapInArrow(h._places, "page_id long, place long, parent long, content long, leaf boolean")
    got = {r.place: (r.pages, r.value) for r in h.composite(h.importance(places)).collect()}
    want = brute_values(pages)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    texts = {r.page_id: r.text for r in h.main_text(df).collect()}
    for i, url, page in pages:
        story = re.findall(r"<p>([a-h ]+)</p>", page)
        assert texts[i] == "\n".join(story)
        assert one(page, url) != texts[i]  # without the tree, menus and promotions stay


def test_repeated_articles_stay(spark):
    rows = [(i, "http://one.example/", "<body><nav>n</nav><article><h1>T</h1><p>the same</p></article></body>") for i in range(30)]
    assert {r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"T\nthe same"}


def test_the_pages_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li|div)>", re.sub(r"<br>|</?b>", " ", inner))
        lines = [re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(b)).strip(" ") for b in blocks]
        want[r.page_id] = "\n".join(x for x in lines if x)
    assert {r.page_id: r.text for r in h.main_text(pages).collect()} == want


def test_empty_table(spark):
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("page", ["<p>" + "<i>" * 20_000 + "<p>" * 3_000, "<select>" + "<p><select>" + "<i>" * 20_000 + "<p>" * 3_000, "<div>" * 100_000, "<i>" * 100_000, "<td>" * 50_000 + "<li>" * 50_000], ids=["p", "scope", "div", "i", "cells"])
def test_unclosed_elements_take_linear_time(page):
    began = time.process_time()
    h.parse(page)
    assert time.process_time() - began < 5
