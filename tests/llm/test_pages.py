"""Operators 5 and 7."""

import random

import numpy as np
import pytest

from tests.llm.tables import plain
from wordloom.llm import html_text, url_filter

SCHEMA = "page_id long, url string, html string, host string, path string, text string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], SCHEMA)


def page(body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>Name</title><style>p{{a:b}}</style><script>var t="</p><article>no";</script></head>
    <body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <article>no</article> --><div class="ad">Buy now</div>{extra}
    <article>{body}</article><div id="comments"><p>Reader says no</p></div><footer>&copy; foot</footer></body></html>"""


CASES = [
    (page("<h1>Head &amp; more</h1><p>One\n two&nbsp;three<br>four <b>bold</b>er</p><ul><li>item<li>last</ul>"), "Head & more\nOne two three four bolder\nitem\nlast"),
    (page("<p>Text <form>no <input></form> and on</p><aside>side</aside><div class='cookie-notice'>no</div><p>end &#x41;&eacute;"), "Text\nand on\nend Aé"),
    (page("<header><h1>Own head</h1></header><p>1 < 2 and 3 > 2</p>"), "Own head\n1 < 2 and 3 > 2"),
    ("", ""), (None, ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"), ("<div", ""), ("<script>never ends <p>x</p>", ""), ("<nav>only menu</nav>", ""),
    ("<html><body><div class='content main-7'><p>" + "long text " * 30 + "</p></div><div class='sidebar'>" + "side " * 99 + "</div></body></html>", ("long text " * 30).strip()),
]


def best(html):
    return html_text.best_path(list(html_text.blocks(html)))


@pytest.mark.parametrize("at", range(len(CASES)))
def test_extract(at):
    html, text = CASES[at]
    assert html_text.extract(html or "", best(html or "")) == text


def test_consensus_of_a_host(spark):
    body = "<html><body><div class='c{}'><p>{}</p></div><div class='rel'><p>{}</p></div></body></html>"
    rows = [(i, f"http://A.example/{i}", body.format(i, "main text " * 20, "other " * 3)) for i in range(9)]
    rows += [(9, "http://a.EXAMPLE/9?x", body.format(9, "short", "a misleading long block " * 30))]  # its host's path beats its own best
    rows += [(20, None, CASES[0][0]), (21, "nonsense", CASES[1][0]), (22, "http://b/", None), (22, "http://b/", None), (None, "http://b/x", CASES[4][0])]
    for few in (10_000, 0):
        got = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows), few).collect()}
        assert got[9] == "short" and got[3] == ("main text " * 20).strip() and got[20] == CASES[0][1] and got[21] == CASES[1][1] and got[22] == "" and got[None] == ""
    out = html_text.main_text(pages(spark, rows))
    assert out.count() == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert html_text.main_text(pages(spark, []).limit(0)).collect() == []


def test_very_long_page():
    html = page("".join(f"<p>paragraph {i} of <i>many</i></p>" for i in range(60_000)))
    text = html_text.extract(html, best(html))
    assert text.count("\n") == 59_999 and text.endswith("paragraph 59999 of many")


def test_deep_pages_take_linear_time():
    import time

    start = time.time()
    for inner in ("deep", "<b>" * 50_000 + "deep", "deep" + "</section>" * 50_000):
        assert html_text.extract("<div>" * 100_000 + inner + "</div>" * 100_000, None) == "deep"
    each = "".join(f"<div>text {i}" for i in range(100_000))
    assert html_text.extract(each, best(each)).count("\n") == 99_999
    assert time.time() - start < 60


def test_sibling_below_a_long_path_stays_out():
    wrapped = "<div class='wrapper-of-the-page'>" * 30
    html = f"<body>{wrapped}<div class='main'><p>{'the text ' * 40}</p></div><div class='other'><p>OTHER BLOCK</p></div></body>"
    assert html_text.extract(html, best(html)) == ("the text " * 40).strip()


def test_parts_of_an_article_stay_and_boilerplate_goes():
    keep = "".join(f"<div class='{c}'><p>kept {c}</p></div>" for c in ("legal", "tags", "copyright", "share-price", "legal-analysis", "cookie-recipe", "comment-culture"))
    drop = "".join(f"<div class='{c}'><p>gone</p></div>" for c in ("ad", "ad-slot-3", "comment-list", "share-buttons", "related posts", "newsletter-box", "cookieNotice", "notice"))
    assert html_text.extract(page(f"<h1>Head</h1>{keep}{drop}"), None).split("\n") == ["Head", *(f"kept {c}" for c in ("legal", "tags", "copyright", "share-price", "legal-analysis", "cookie-recipe", "comment-culture"))]
    outside = "<div class='legal'><p>terms</p></div><div class='main'><p>" + "words " * 50 + "</p></div>"
    assert html_text.extract(f"<body>{outside}</body>", best(f"<body>{outside}</body>")) == ("words " * 50).strip()


def test_heading_and_lead_outside_the_inner_container_stay():
    html = "<body><main><h1>Head</h1><p>Lead.</p><div class='body'><p>" + "long text " * 60 + "</p></div></main></body>"
    assert html_text.extract(html, best(html)).split("\n")[:2] == ["Head", "Lead."]


def test_one_page_has_one_vote(spark):
    small = "<html><body><div class='a'><p>{}</p></div><div class='b'><p>x</p></div></body></html>"
    large = "<html><body><div class='b'><p>" + "very long " * 5000 + "</p></div><div class='a'><p>y</p></div></body></html>"
    rows = [(i, "http://h/", small.format("some words here " * 3)) for i in range(3)] + [(3, "http://h/", large)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got == {0: ("some words here " * 3).strip(), 1: ("some words here " * 3).strip(), 2: ("some words here " * 3).strip(), 3: "y"}


def test_made_pages_of_many_hosts(spark):
    """Pages of known articles in layouts of their hosts: every extracted word is of the article, and no word of it is missing."""
    r = random.Random(8)
    said = lambda n, mark: " ".join(f"{mark}{r.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for host in range(12):
        box = r.choice([("<article>", "</article>"), ("<div class='post-{}'>", "</div>"), ("<main><div class='c'>", "</div></main>"), ("<section class='entry'>", "</section>")])
        side = r.choice(["sidebar", "related-posts", "widget-area", "menu"])
        for k in range(15):
            i = 100 * host + k
            blocks = [said(r.randrange(5, 80), "t") for _ in range(r.randrange(2, 9))]
            want[i] = "\n".join(blocks)
            inner = "".join(r.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>"]).format(b.replace(" ", "\n ", 1)) + (f"<div class='ad'>{said(9, 'no')}</div>" if r.random() < 0.3 else "") for b in blocks)
            noise = f"<div class='{side}'><p>{said(60, 'no')}</p></div><div id='comments'><p>{said(80, 'no')}</p></div>"
            rows.append((i, f"https://h{host}.example/{i}", f"<html><head><title>{said(3, 'no')}</title></head><body><header>{said(6, 'no')}</header><nav><a href='/'>{said(9, 'no')}</a></nav><div id='page'>{box[0].format(k)}{inner}{box[1]}{noise}</div><footer>{said(9, 'no')}</footer></body></html>"))
    got = {x["page_id"]: x["text"] for x in html_text.main_text(pages(spark, rows)).collect()}
    assert got == want


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:at], rest[at:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


URLS = [
    "http://example.net/en/1", "https://A.b.EXAMPLE.net/en/", "http://example.net/de/", "http://notexample.net/en/x", "http://x.example.com/de/5?q=1#f", "http://example.com/fr/de/", "ftp://w.org/fr/", "http://w.org/fr", "http://org/fr/x",
    "http://net", "http://net/", "http://x.net?x=/en/", "no scheme.net/", None, "", "://example.net/en/", "http:///en/", "http://a#b/c", "http://a/b://c.net/", "http://É.net/é", "http://" + "a" * 5000 + "/" + "b" * 5000, "http://casino-1.example.org/x",
]


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[4], None)]
    got = url_filter.judge_urls(pages(spark, rows)).collect()
    want = [(i, *brute_rule(u)) for i, u, _ in rows]
    assert plain(r[:4] for r in got) == plain((i, h, p, b[0] if b else None) for i, h, p, b in want)
    assert all(r["verdict"] in ("allow", "block") for r in got)
    said = {(h, p): b[1] for _, h, p, b in want if b}
    assert all(r["verdict"] == said[r["host"], r["path"]] for r in got if r["rule"])
    assert url_filter.judge_urls(pages(spark, []).limit(0)).collect() == []


def test_labels_of_pages(spark):
    """Pages of junk text teach the trees the look of their URLs; no rule and no word takes part."""
    r = random.Random(12)
    prose = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(120))
    junk = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) + "###" for _ in range(120))
    docs = spark.createDataFrame([(i, (junk if i % 3 == 0 else prose)()) for i in range(240)] + [(None, "x"), (0, prose())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(None, 0, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        url = f"http://x{i}-y-z.example/{i}?a=1&b=2&c=3" if bad else f"http://site{i}.example/en/{i}"
        rows.append((i, url, f"<html><script>{junk()}</script><body><p>{(junk if bad else prose)()}</p></body></html>"))
    rows += [(300, None, "x"), (301, rows[0][1], None)]
    made = url_filter.labels_of_pages(pages(spark, rows), docs, labels)
    by = {}
    for x in made.collect():
        by.setdefault(x["url"], []).append(x["blocked"])
    assert all(by[u] == [i % 4 == 0] for i, u, _ in rows[1:300]) and by[rows[0][1]] == [True, True] and None not in by
    fresh = [(1000 + i, f"http://x{i}-q-r.example/?a=1&b=2&c={i}" if i % 2 else f"http://web{i}.example/de/{i}", None) for i in range(40)]
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge_urls(pages(spark, fresh), (), made).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i, _, _ in fresh)
    assert url_filter.labels_of_pages(pages(spark, []).limit(0), docs, labels).collect() == []
    assert {x["verdict"] for x in url_filter.judge_urls(pages(spark, fresh), ()).collect()} == {"allow"}


def test_learned_verdicts_hold_out(spark):
    r = random.Random(6)

    def url(bad):
        word = "".join(r.choice("abcdefghijkl") for _ in range(6))
        return f"http://{word}-win-{r.randrange(99)}.{r.choice(['info', 'com'])}/a?x={r.randrange(9)}&y=2&z=3" if bad else f"http://www.{word}.{r.choice(['com', 'info'])}/{word}/{word}"

    known = [(url(i % 4 == 0), i % 4 == 0) for i in range(1200)]
    held = [(url(i % 4 == 0), i % 4 == 0) for i in range(400)]
    labels = spark.createDataFrame([*known, (None, True), ("http://x", None)], "url string, blocked boolean")
    got = {x["page_id"]: x["verdict"] == "block" for x in url_filter.judge_urls(pages(spark, [(i, u, None) for i, (u, _) in enumerate(held)]), (), labels).collect()}
    assert np.mean([got[i] == bad for i, (_, bad) in enumerate(held)]) > 0.97


def test_no_trees_where_the_features_say_nothing(spark):
    r = random.Random(13)
    known = [(f"http://{''.join(r.choice('abcdefgh') for _ in range(r.randrange(4, 12)))}.example/{i}", r.random() < 0.2) for i in range(1500)]
    fresh = [(i, f"http://{''.join(r.choice('abcdefgh') for _ in range(r.randrange(4, 12)))}.example/x{i}", None) for i in range(500)]
    got = url_filter.judge_urls(pages(spark, fresh), (), spark.createDataFrame(known, "url string, blocked boolean")).collect()
    assert {x["verdict"] for x in got} == {"allow"}


def test_trees_column_is_predict(spark):
    g = np.random.default_rng(0)
    x = g.random((300, len(url_filter.FEATURES))).round(3)
    trees = url_filter.Trees(x, ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.3)).astype(float))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *url_filter.FEATURES])
    got = dict(map(tuple, rows.select("i", trees.column()).collect()))
    assert np.allclose([got[i] for i in range(300)], trees.predict(x))


def test_bounded_sample_is_that_of_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from wordloom.llm.common import in_hash_order, smallest_hashes

    df = spark.range(20_000).select(F.col("id").cast("string").alias("url"))
    near = smallest_hashes(df, ["url"], 500)
    assert 500 <= near.count() <= 1000
    assert [r[0] for r in near.orderBy(*in_hash_order(["url"])).limit(500).collect()] == [r[0] for r in df.orderBy(*in_hash_order(["url"])).limit(500).collect()]
    assert smallest_hashes(df, ["url"], 15_000).count() == 20_000
