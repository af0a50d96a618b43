import collections
import math
import random

import pytest

from quarry.llm import html_text

NEVER = lambda keys: [False] * len(keys)


def test_pages():
    for html, want in {
        "<p>a<p>b<b>c</b>d  e&amp;&nbsp;f": "a bcd e& f",
        '<div class="sidebar">x</div><article><h1>T</h1><p>One <i>t</i>wo<br>three</p><div class="comments"><p>no</p></div><form>q<p>w</form><aside>z</aside></article><footer>f</footer>': "T One two three",
        '<body><script>var a="</p>";</script><style>x{}</style><!-- c --><p>k < 3 &lt;b&gt;</p></body>': "k < 3 <b>",
        '<nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>Head</h1><p><b>Text one.<br><p>Two.</p></article><footer>&copy; host</footer>': "Head Text one. Two.",
        '<article><header><p>by me</p><h1>Title</h1></header><p>x<span class="ad">no</span> y</p><div hidden>h</div></article>': "Title x y",
        "": "", "<a href=\"unclosed>x": "x", "<article></article><p>only this": "only this",
    }.items():
        assert html_text.text_of("http://h/", html, NEVER) == want
    assert html_text.text_of(None, None, NEVER) == ""


def test_style_tree_removes_what_a_hosts_pages_share(spark):
    page = lambda i: f"<div id='top'>Welcome to our site</div><div id='text'><p>Own words {i} and more {i * 7}.</p></div><div id='end'>All rights reserved</div>"
    data = [(i, f"http://big.example/{i}", page(i), "x", 1) for i in range(12)] + [(20, "http://small.example/", page(99), "x", 1), (21, None, None, None, None), (21, None, None, None, None), (22, "odd", "", "x", 1)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, id string, text int")
    for most in (10**6, 0):  # all at once, and page by page
        got = html_text.extract(df, most=most).collect()
        assert len(got) == len(data)
        by = {r["page_id"]: r for r in got}
        assert all(by[i]["text"] == f"Own words {i} and more {i * 7}." for i in range(12))
        assert by[20]["text"].startswith("Welcome") and by[21]["text"] == by[22]["text"] == ""
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def test_copied_articles_stay(spark):
    html = "<nav>menu</nav><article><p>The same article on every page.</p></article>"
    df = spark.createDataFrame([(i, "http://h/", html) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(df).collect()} == {"The same article on every page."}


def test_style_tree_judges_the_marked_part_too(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    page = lambda i: f"<article><h1>T{i}</h1><p>{own(i)}</p><p>Read all of our stories at any time.</p></article>"
    teasers = lambda i: f"<article>Teaser</article><article>Another {i}</article><div><p>{own(100 + i)}</p></div>"
    data = [(i, "http://a/", page(i)) for i in range(12)] + [(100 + i, "http://b/", teasers(i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i} {own(i)}" for i in range(12))
    assert all(own(100 + i) in got[100 + i] for i in range(3))


def test_copies_of_a_body_are_no_template(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    copy = lambda i: f"<div><h1>Seen on day {i}</h1><p>{own('copy')}</p></div>"
    data = [(i, "http://h/", copy(i)) for i in range(60)] + [(100 + i, "http://h/", f"<div><h1>Title {i}</h1><p>{own(i)}</p></div>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Seen on day {i} {own('copy')}" for i in range(60))
    assert all(got[100 + i] == f"Title {i} {own(i)}" for i in range(60))


def plain_tree(pages):
    """The texts by a style tree kept in dictionaries, host by host."""
    parsed = [(html_text.host_of(u), *html_text.parse(h or "")) for _, u, h in pages]
    texts, shapes = collections.defaultdict(set), collections.defaultdict(set)
    for host, blocks, children in parsed:
        page = html_text.body_key(blocks)
        for b in blocks:
            if not b.noise:
                texts[host, b.path, b.text].add(page)
        for path, c in children.items():
            shapes[host, path, tuple(c)].add(page)
    held, seen = collections.Counter(), collections.defaultdict(list)
    for (host, path, _), pages_of in texts.items():
        held[host, path] += len(pages_of)
    for (host, path, _), pages_of in shapes.items():
        seen[host, path].append(len(pages_of))
    out = []
    for host, blocks, _ in parsed:
        kept = []
        blocks = [b for b in blocks if not b.noise]
        for b in blocks:
            c, m = len(texts[host, b.path, b.text]), held[host, b.path]
            n = seen.get((host, b.path), [])
            total = sum(n)
            shape = -sum(x / total * math.log(x / total) for x in n) / math.log(total) if total > 1 else 1.0
            if not (c >= 3 and m >= html_text.LEAST_PAGES and html_text.BLEND * (1 - math.log(c) / math.log(m)) + (1 - html_text.BLEND) * shape < html_text.LEAST_IMPORTANCE):
                kept.append(b)
        out.append(" ".join(b.text for b in html_text.body(kept or blocks)))
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_texts_are_those_of_a_plain_style_tree(spark, most):
    rng = random.Random(2)
    line = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    pages = []
    for host in ("a.org", "b.org"):
        own = [line(12), line(30), line(25)]
        for i in range(14):
            body = "".join(f"<p>{line(rng.randint(5, 40))}</p>" + (f"<div class='x{rng.randrange(2)}'><b>{line(3)}</b></div>" if rng.random() < 0.4 else "") for _ in range(3))
            marked = f"<p>{own[0]}</p>{body}<p>{own[1]}</p>"  # boilerplate inside the marked part
            pages.append((len(pages), f"http://{host}/{i}", f"<html><body><div>{own[2]}</div><main>{marked}</main></body></html>" if host == "a.org" else f"<body><p>{own[0]}</p>{body}</body>"))
        pages += [(len(pages), pages[-1][1], pages[-1][2])] * 6
    pages += [(None, None, None), (900, "", "<p>" + line(5) + "</p>"), (901, "http://a.org/long", "<main>" + f"<p>{line(50)}</p>" * 400 + "</main>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = html_text.extract(df, most=most).collect()
    want = plain_tree(pages)
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == sorted((str(p[0]), t) for p, t in zip(pages, want, strict=True))
    boiler = pages[0][2].split("<main><p>")[1].split("</p>")[0]
    assert all(boiler not in r["text"] for r in got if r["url"] and "a.org" in r["url"]) and all(r["n_chars"] == len(r["text"]) for r in got)
