"""The block labeller on pages written by hand, of kinds that fitting never sees as such."""

import os

import numpy as np
import pandas as pd
import pytest

from sightline.llm import mainhtml

TABLE = "/root/testdata/sf0.01/pages.parquet"
P1 = "Onder the ation werely est of thand, and then it was in the hering of all that they had."
P2 = "Tier ates of inheth a edti and onwh therheth for orti nterble the of, inha erntatin ederan."
P3 = "The rivers of the north carry cold water, which the towns along them have used for centuries."


def pg(body):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>" + body + "</body></html>"


NAV = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
PAGES = [
    ("plain div", pg(NAV + f"<div><h1>Some Head</h1><p>{P1}</p><h2>Another part</h2><p>{P2}</p></div><footer>&copy; Us</footer>"), f"Some Head {P1} Another part {P2}"),
    ("bare body", pg(NAV + f"<h1>Some Head</h1><p>{P1}</p><h2>Another part</h2><p>{P2}</p><footer>&copy; Us</footer>"), f"Some Head {P1} Another part {P2}"),
    ("unnamed boilerplate", pg(f'<div><a href="/">Home</a> <a href="/n">News</a></div><div><h1>Some Head</h1><p>{P1}</p><h2>Another part</h2><p>{P2}</p></div><div>Copyright. All rights reserved.</div>'), f"Some Head {P1} Another part {P2}"),
    ("table and list", pg(NAV + f"<article><h1>Some Head</h1><p>{P1}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table><ul><li>first thing</li><li>second thing</li></ul><p>{P2}</p></article><footer>&copy; Us</footer>"), f"Some Head {P1} Year Sum 1999 12 first thing second thing {P2}"),
    ("site header, own header", pg(f'<header><a href="/">The Site</a></header><article><header><h1>Some Head</h1></header><p>{P1}</p><p>{P2}</p></article><footer>&copy; Us</footer>'), f"Some Head {P1} {P2}"),
    ("unnamed comments", pg(NAV + f"<article><h1>Some Head</h1><p>{P1}</p><p>{P2}</p></article><div><h3>Comments</h3><p>I liked this very much.</p><p>So did I.</p></div>"), f"Some Head {P1} {P2}"),
    ("quotes", pg(NAV + f"<main><h1>Some Head</h1><p>{P1}</p><blockquote><p>{P3}</p></blockquote><p>{P2}</p></main><footer>&copy; Us</footer>"), f"Some Head {P1} {P3} {P2}"),
    ("definition list", pg(NAV + f'<div class="entry"><h1>Some Head</h1><p>{P1}</p><dl><dt>River</dt><dd>A stream of water.</dd><dt>Town</dt><dd>A place where people live.</dd></dl></div><aside><h3>Related articles</h3><ul><li><a href="/x">Other things</a></li></ul></aside>'), f"Some Head {P1} River A stream of water. Town A place where people live."),
    ("figure", pg(NAV + f'<article><h1>Some Head</h1><figure><img src="a.png"><figcaption>A town by the river.</figcaption></figure><p>{P1}</p></article><footer><p>Privacy policy</p></footer>'), f"Some Head A town by the river. {P1}"),
    ("ordered list in section", pg(f'<div id="masthead"><h1><a href="/">The Site</a></h1></div><section><h2>How to do it</h2><p>{P3}</p><ol><li>Take the first part and clean it.</li><li>Put it on the second part.</li><li>Wait.</li></ol></section><div class="newsletter"><form><p>Subscribe to our newsletter</p><input></form></div>'), f"How to do it {P3} Take the first part and clean it. Put it on the second part. Wait."),
    ("sidebar first", pg(f'<div class="wrapper"><div class="sidebar"><h4>Most read</h4><p>{P2}</p></div><div class="content"><h1>Some Head</h1><p>{P1}</p><p>{P3}</p></div></div><div id="footer"><p>Imprint</p></div>'), f"Some Head {P1} {P3}"),
    ("advert inside", pg(NAV + f'<article><h1>Some Head</h1><p>{P1}</p><div class="ad">Buy our fine shoes.</div><p>{P3}</p></article>'), f"Some Head {P1} {P3}"),
    ("cookie notice", pg(f'<div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div>{NAV}<main><article><h1>Some Head</h1><p>{P1}</p><p>{P3}</p></article></main><section id="comments"><h2>3 comments</h2><div class="comment"><p>{P2}</p></div></section>'), f"Some Head {P1} {P3}"),
    ("search form, pre", pg(f'<header><h2>The Site</h2><form action="/s"><input name="q"><button>Search</button></form></header><div class="post"><h1>Some Head</h1><p>{P3}</p><pre>x = 1\ny = 2</pre><p>{P1}</p></div><footer>&copy; Us</footer>'), f"Some Head {P3} x = 1 y = 2 {P1}"),
    ("links in text", pg(NAV + f'<article><h1>Some Head</h1><p>{P1} See <a href="/q">the other text</a> for more.</p><h2>Part</h2><p>Short one.</p></article><div class="share"><a href="/f">Share</a> <a href="/t">Tweet</a></div>'), f"Some Head {P1} See the other text for more. Part Short one."),
    ("notices around list article", pg(f'<div class="alert"><p>Please note the office is closed.</p></div><div id="text"><h1>Winter</h1><ul><li>{P1}</li><li>{P2}</li></ul><p>{P3}</p></div><div class="related"><a href="/1">One</a> <a href="/2">Two</a></div>'), f"Winter {P1} {P2} {P3}"),
    ("nested divs", pg(f'<div><div><a href="/">Site</a></div></div><div><div><div><h1>Winter</h1><div>{P1}</div><div>{P3}</div></div></div></div><footer>Terms of use</footer>'), f"Winter {P1} {P3}"),
    ("byline and sections", pg(NAV + f'<main><section><h2>Early</h2><p>{P1}</p></section><section><h2>Late</h2><p>{P2}</p><p>{P3}</p></section></main><aside><p>{P1}</p></aside>'), f"Early {P1} Late {P2} {P3}"),
    ("table article", pg(f'<header><p>The Daily</p></header><article><h1>Prices</h1><table><caption>By year</caption><tr><th>Year</th><th>Price</th></tr><tr><td>2001</td><td>7 euro</td></tr><tr><td>2002</td><td>8 euro</td></tr></table></article><div class="sponsored"><p>{P2}</p></div>'), "Prices By year Year Price 2001 7 euro 2002 8 euro"),
    ("login form between", pg(f'<article><h1>Winter</h1><p>{P1}</p><form><label>Your email</label><input><button>Sign up</button></form><p>{P3}</p></article>{NAV}'), f"Winter {P1} {P3}"),
    ("replies in section", pg(NAV + f'<section><h1>Winter</h1><p>{P3}</p><blockquote>{P2}</blockquote></section><section class="replies"><h3>Responses</h3><div><p>{P1}</p></div></section>'), f"Winter {P3} {P2}"),
]


@pytest.fixture(scope="module")
def net():
    if not os.path.exists(TABLE):
        pytest.skip("no tables")
    return mainhtml.fitted(pd.read_parquet(TABLE).sort_values("page_id").html.tolist()[:125])


def test_pages_written_by_hand(net):
    right = {name: mainhtml.main_texts([page], net)[0] == want for name, page, want in PAGES}
    assert sum(right.values()) >= 16, [n for n, ok in right.items() if not ok]
    assert right["table and list"] and right["site header, own header"] and right["unnamed comments"]


def test_the_net_reads_more_than_its_rule(net):
    """A heading in an element without a name is no main text by the rule, but by what is around it."""
    page, want = next((p, w) for n, p, w in PAGES if n == "plain div")
    assert mainhtml.main_texts([page], net)[0] == want != " ".join(b.text for b in mainhtml.blocks_of(page) if mainhtml.weak_label(b))


def test_remade_pages_have_labels_by_place():
    rng = np.random.default_rng(5)
    page = "<nav>n1 n2</nav><article><h1>t</h1><p>" + " ".join(f"w{i}" for i in range(40)) + "</p></article>"
    kinds = set()
    for _ in range(200):
        shown, meant = (mainhtml.blocks_of(p) for p in mainhtml.remade(page, rng))
        assert [b.text for b in shown] == [b.text for b in meant]
        assert any(map(mainhtml.weak_label, meant))
        kinds |= {b.path[0][-1] for b in meant if mainhtml.weak_label(b) and b.path[0]}
    assert {"li", "td", "th", "dt", "dd", "figcaption", "pre", "blockquote", "h2", "p", "div"} <= kinds


def test_a_very_long_page(net):
    long = pg(NAV + "<article>" + f"<p>{P3}</p>" * 60_000 + "</article><footer>&copy; x</footer>")
    assert len(mainhtml.main_texts([long], net)[0]) >= 0.999 * 60_000 * (len(P3) + 1)
    x = np.random.default_rng(1).normal(size=(30, 2, mainhtml.INPUT)).astype(np.float32)
    assert np.allclose(net._states(x, "b"), np.stack(net._run(x, "b")[0][1:]), atol=1e-5)


def test_pages_with_columns_of_clashing_names(spark):
    rows = [(1, "u", NAV, "a", 1), (1, "u", NAV, "b", 2)]
    out = mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"), mainhtml.BlockLabeller())
    assert out.columns == ["page_id", "url", "text"] and out.count() == 2
