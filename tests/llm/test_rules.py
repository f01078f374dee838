"""URL rules, quality rules and HTML text against plain versions."""

import re
from collections import Counter

import pytest

from conftest_llm import prose
from patronage.llm import html_text, quality, queries, url_rules

URLS = [
    "http://example.net/", "http://a.b.Example.NET/en/x?q#f", "https://example.net", "https://example.net/en", "http://EXAMPLE.com/de/", "http://myexample.com/de/x",
    "http://x.example.com/de/1?a=/fr/", "http://org/fr/", "http://a.org/fr/x", "http://a.org/fra", "http://net/", "http://net?x", "http://net#x", "http://.net/", "ftp://a..net//x",
    "no scheme", "", None, "://net/x", "http://a.net/http://b.org/fr/", "http://example.net:80/en/", "http://u@example.net/en/", "http://é.example.net/ü/", "http://a.net/x\ny", "http:///en/",
]


def plain_verdict(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h.count("."), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [
    queries.URL_RULES, (),
    (("block", "net", ""), ("allow", "a.net", ""), ("block", "b.a.net", "/"), ("allow", "net", "/x"), ("allow", "net", "/xy/"), ("block", "net", "/xy/"), ("allow", "example.net", "/en/")),
])
def test_url_rules(spark, rnd, rules):
    urls = URLS + [f"http://{'.'.join(rnd.choice(['a', 'b', 'example']) for _ in range(rnd.randrange(4)))}.net/{rnd.choice(['', 'x', 'xy/', 'en/', 'xy/z'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "old", "old", 1, "c") for i, u in enumerate(urls + [URLS[0]])], "page_id bigint, url string, host string, rule string, depth int, cell string")
    got = url_rules.apply_rules(pages, url_rules.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], rules), r
        assert (r["depth"], r["cell"]) == (1, "c")
    assert url_rules.apply_rules(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0


def test_url_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id bigint, url string").select("page_id", "url").distinct()
    plan = url_rules.apply_rules(pages, url_rules.rule_table(spark, queries.URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_quality_counts(documents, rnd):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x y z", "x y", "é日 本\x0b语\x0c# *", "l\nl\n l\n\nl"]
    texts += [prose(rnd, rnd.randrange(120), "ab", 3) for _ in range(60)] + [prose(rnd, 20) + "\n" + prose(rnd, 3, "a#$", 2) for _ in range(20)] + [prose(rnd, 30_000)]
    got = quality.judged(documents([*enumerate(texts), (0, None), (None, "x")])).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "x" if r["doc_id"] is None else texts[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_counts(text)
        assert not (r["kept"] and r["base_failed"])


def test_quality_lines(documents, rnd):
    body = "\n".join(prose(rnd, 30) + "." for _ in range(5))
    menu, shout, legal = "Home | News | Sport | Contact", "BUY!! NOW!! FREE!! WIN!!", "Copyright 2020. All rights reserved."
    df = documents([(1, body), (2, f"{menu}\n{body}\n{legal}"), (3, shout), (4, "\n".join([shout + " " + prose(rnd, 1)] * 1 + [f"{w}!! {w}x!! {w}y!!" for w in prose(rnd, 60).split()])), (5, None)])
    verdict = {r["doc_id"]: r for r in quality.judged(df).collect()}
    assert [verdict[i]["kept"] for i in range(1, 6)] == [True, True, False, False, False]
    kept = {r["doc_id"]: r for r in quality.keep_clean(df).collect()}
    assert set(kept) == {1, 2} and kept[1]["text"] == kept[2]["text"] == body and kept[2]["n_chars"] == len(body)
    assert quality.keep_clean(df).columns == df.columns and kept[2]["class"] == "extra"
    assert quality.keep_clean(df.limit(0)).count() == quality.judged(df.limit(0)).count() == 0


def test_boilerplate_phrases_are_whole_and_of_a_site():
    clean = ["ereaes oftheshare onstor.", "The dialog in the catalog in question has a design in blue.", "She baked a cookie.", "JavaScript has closures."]
    site = ["Log in or sign up", "Share on Facebook", "We use cookies.", "This site uses cookies", "Please enable JavaScript", "SPDX-License-Identifier: MIT", "© 2020 x", "(c) 2020"]
    assert [quality.line_fails(x) for x in clean] == [None] * len(clean)
    assert [quality.line_fails(x) for x in site] == ["boilerplate"] * len(site)


def test_quality_labels(spark, con):
    """Of the labelled rows that pass the base rules, the good ones stay and the others go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    count = {(r[0], r[1]): r[2] for r in rows}
    assert count.get((1, False), 0) <= 0.01 * count[1, True] and count.get((0, True), 0) <= 0.05 * count[0, False]


ARTICLE = "One two three four five six seven eight nine ten eleven &amp; twelve."
LONG = " ".join(["Plain words of an article go on for quite a while here."] * 6)
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>A</a></ul></nav><article><h1>Head &lt;line</h1><p>{ARTICLE}<p>Short.<br>Next\n\t line<b> bold</b>er"
     f"</article><footer>&copy; site</footer></body>", "Head <line " + ARTICLE.replace("&amp;", "&") + " Short. Next line bolder"),
    (f"<body><header><h1>Site name</h1><a href=/>Home</a></header><main><h2>Title</h2><p>{LONG}</p><aside>More from us and a lot of other words that nobody wants to read</aside><p>{ARTICLE}</p>"
     f"<form><label>Mail</label><input name=x><button>Send it</button></form><div class='comments'><p>{LONG}</p></div></main><div id=cookie-notice>We use cookies to make this site work for you and for others.</div>",
     f"Title {LONG} " + ARTICLE.replace("&amp;", "&")),
    (f"<div class=\"menu\"><a>One</a> <a>Two</a></div><div><p>{LONG}</p><p>Few words.</p><p>{LONG}</p></div><div><a>Prev</a></div><div><a>Next</a></div>", f"{LONG} Few words. {LONG}"),
    (f"<article>{LONG}<script>var x = '<p>no</p>';</script><!-- <p>no --><p title='a > b'>{ARTICLE}</p><article class='comment'>{LONG}</article><p>End of it.</p></article>",
     f"{LONG} " + ARTICLE.replace("&amp;", "&") + " End of it."),
    (f"<article><p>a &#233;&nbsp;&#x65E5; x &notanentity; 1 < 2 &amp;lt; <unclosed attr='x>y</p>", None), ("", ""), (None, ""), ("<", None), ("no markup", None), ("<p" * 2000, ""), ("<div>" * 3000, ""),
]


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(i, "u", p, "t", 5) for i, (p, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "t", 5), (99, None, f"<article><p>{LONG * 200}</article>", "t", 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    assert html_text.extract(df.limit(0)).count() == 0
    return html_text.extract(df).collect()


def test_html_pages(extracted):
    assert len(extracted) == len(PAGES) + 2
    for r in extracted:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] == 99:
            assert r["text"] == " ".join((LONG * 200).split())
        elif PAGES[r["page_id"]][1] is not None:
            assert r["text"] == PAGES[r["page_id"]][1]


def test_html_table(spark, con):
    """On the pages table the main text is the article element."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for p, t in zip(sorted(pages.collect()), sorted(html_text.extract(pages).collect())):
        body = re.sub(r"</?(?:p|br|h1)>", "\x00", re.search("<article>(.*?)</article>", p["html"], re.S)[1])
        assert t["text"] == " ".join(html.unescape(re.sub("<[^>]*>", "", body)).replace("\x00", " ").split())


def test_labelled_pages_are_learned(spark):
    tree = html_text.fit_tree(spark)
    rows = html_text.labelled_rows()
    assert sum(html_text.is_main(tree, tuple(x)) == (y == 1.0) for y, x in rows) >= 0.97 * len(rows)


LONG = " ".join(["plain words of a long paragraph"] * 24)
ARTICLE = f"<article><p>{LONG}</p></article>"


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit_tree(spark)


@pytest.mark.parametrize("page", [
    f"<nav><a>All the news of today</a></nav>{ARTICLE}",
    f"{ARTICLE}<footer><a>Privacy and terms of use</a></footer>",
    f"<nav><ul><li><a>World news and politics today</a><li><a>Home and garden for everyone</a></ul></nav>{ARTICLE}",
    f'<div class="article with-sidebar"><p>{LONG}</p></div>',
    f"<header><h1><a>The daily paper of the town</a></h1></header>{ARTICLE}",
    f'<div class="menu"><a>Everything about sports and games</a></div>{ARTICLE}<div id="footer">{LONG}</div>',
    f"{ARTICLE}<aside><a>More stories that you may like</a></aside>",
    f'{ARTICLE}<div class="related"><a>Read this other long story next</a></div>',
    f'<div class="cookie-notice">{LONG}</div>{ARTICLE}',
    f'{ARTICLE}<div class="comments"><div class="comment-content">{LONG}</div></div>',
    f'<div class="main-sidebar"><a>Topics of the week</a><p>{LONG}</p></div>{ARTICLE}',
    f'<p><a>Back to the list of all stories</a></p>{ARTICLE}<p><a>Imprint and contact of the publisher</a></p>',
    f'{ARTICLE}<form><p>{LONG}</p></form><div role="contentinfo"><a>About us and our partners</a></div>',
    f'<div role="navigation"><a>Skip to the content of this page</a></div><main><p>{LONG}</p></main><footer>{LONG}</footer>',
    f'<ul class="breadcrumb"><li><a>Home</a><li><a>Science and nature of the world</a></ul>{ARTICLE}',
])
def test_nothing_beside_the_article(tree, page):
    assert html_text.main_text(tree, page) == LONG


def test_no_block_of_another_place_is_main(tree):
    """Whatever its size, links and neighbours: outside the article or in another container nothing is main text."""
    for place in (html_text.OUTSIDE, html_text.IN_OTHER):
        for words in (1, 3, 5, 12, 30, 70, 100, 300):
            for links in (0.0, 0.3, 0.5, 0.6, 0.9, 1.0):
                for before in ((0, 0.0), (3, 1.0), (80, 0.0), (200, 0.1)):
                    for behind in ((0, 0.0), (5, 0.8), (70, 0.0), (250, 0.0)):
                        for heading in (0.0, 1.0):
                            assert not html_text.is_main(tree, (words, links, *before, *behind, heading, place))
