"""Main text of hand-made pages of different build, and the ratios against a plain version."""

import pytest

from docloom.llm import html
from docloom.llm.common import table

S = ["The river rose in the night, and by morning the lower fields stood under water; nobody had expected it so early.",
     "Farmers moved their animals uphill, helped by neighbours, and counted what was lost: two barns, some hay, a tractor.",
     "“We have seen worse,” one of them said, “but not in March, and not twice in a year.”",
     "The council will meet on Monday; until then, the road to the mill remains closed, as does the school."]
P = "".join(f"<p>{s}</p>" for s in S)
TEXT = "\n".join(S)
COMMENT = "I was there too, and I must say that it was every bit as bad as you write; thanks for telling, and greetings from up the valley!"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def comments(n, name="comments", tag="section"):
    return f'<{tag} class="{name}"><h3>Comments</h3>' + "".join(f"<div><p>{COMMENT} {i}.</p></div>" for i in range(n)) + f"</{tag}>"


MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
SOURCES = "<ol><li><a href='a'>First source, 2019</a></li><li><a href='b'>Second source, 2021</a></li></ol>"
LISTED = "First source, 2019\nSecond source, 2021"

PAGES = {
    "article": (f"<header>Site</header><nav>{MENU}</nav><article><h1>Flood</h1>{P}</article><footer>(c) us.</footer>", f"Flood\n{TEXT}"),
    "main": (f"<nav>{MENU}</nav><main><h1>Flood</h1>{P}</main><aside><p>{COMMENT}</p></aside>", f"Flood\n{TEXT}"),
    "divs": (f'<div id="top">{MENU}</div><div id="content"><h1>Flood</h1>{P}</div><div id="sidebar"><h4>About</h4><p>Short text.</p></div>', f"Flood\n{TEXT}"),
    "nested divs": (f'<div class="page"><div class="navbar">{MENU}</div><div class="row"><div class="col-8"><div class="post"><h1>Flood</h1><div class="post-body">{P}</div></div></div><div class="col-4">{MENU}</div></div></div>', f"Flood\n{TEXT}"),
    "flat": (f"<h1>Flood</h1>{P}", f"Flood\n{TEXT}"),
    "flat with a menu": (f"{MENU}<h1>Flood</h1>{P}", f"Flood\n{TEXT}"),
    "unlinked menu beside a div": (f"<nav><ul><li>Home</li><li>News and views</li></ul></nav><div><h1>Flood</h1>{P}</div>", f"Flood\n{TEXT}"),
    "unlinked menu in an article": (f"<article><nav><ul><li>Home</li><li>News and views</li></ul></nav><h1>Flood</h1>{P}</article>", f"Flood\n{TEXT}"),
    "sources in a section": (f"<article><h1>Flood</h1>{P}<section><h2>Sources</h2>{SOURCES}</section></article>", f"Flood\n{TEXT}\nSources\n{LISTED}"),
    "sources in the article": (f"<article><h1>Flood</h1>{P}<h2>Sources</h2>{SOURCES}</article>", f"Flood\n{TEXT}\nSources\n{LISTED}"),
    "sources in a div": (f'<article><h1>Flood</h1>{P}<div class="refs"><h2>Sources</h2>{SOURCES}</div></article>', f"Flood\n{TEXT}\nSources\n{LISTED}"),
    "sources without an article element": (f'<div class="site-nav">{MENU}</div><div id="c"><h1>Flood</h1>{P}<h2>Sources</h2>{SOURCES}</div>', f"Flood\n{TEXT}\nSources\n{LISTED}"),
    "links in sentences": (f'<article>{P}<p>See <a href="x">the report of the council, with all figures</a>.</p></article>', f"{TEXT}\nSee the report of the council, with all figures."),
    "notice": (f'<article>{P}<div class="item-notice"><p>We changed our terms; please read them, they matter.</p></div></article>', TEXT),
    "letter form": (f'<article>{P}<div class="mc4wp-form"><p>Get our letter, every week; no spam, we promise.</p></div></article>', TEXT),
    "cookie box": (f'<div class="cookie-consent-banner"><p>{COMMENT}</p><button>Yes</button></div><article>{P}</article>', TEXT),
    "adverts": (f'<article><p>{S[0]}</p><div class="ad-slot"><p>Buy boots, the best; now.</p></div>{"".join(f"<p>{s}</p>" for s in S[1:])}<div class="sponsored-content"><p>{COMMENT}</p></div></article>', TEXT + "\n" + COMMENT),
    "sponsored box": (f'<article>{P}<div class="sponsored"><p>{COMMENT}</p></div></article>', TEXT),
    "share row": (f'<article><h1>Flood</h1><div class="social-share"><a href=f>Tell friends</a> <a href=m>Mail it</a></div>{P}</article>', f"Flood\n{TEXT}"),
    "related": (f'<article>{P}<div class="related-posts"><h3>More</h3><ul><li><a href=1>Another flood, in May</a></li></ul></div></article>', TEXT),
    "label between parts": (f'<article><div class="x7">Advertisement</div><div class="t">{P}</div><div class="x8">Share this story</div></article>', TEXT),
    "row of subjects": (f'<article><h1>Flood</h1>{P}<div class="t9">floods valley farms</div></article>', f"Flood\n{TEXT}"),
    "column without a name": (f'<div class="row"><div class="c1"><h1>Flood</h1>{P}</div><div class="c2"><div>Rain today</div><div>Sun tomorrow</div></div></div>', f"Flood\n{TEXT}"),
    "menu in main": (f'<main><div class="x1">{MENU}</div><h1>Flood</h1>{P}</main>', f"Flood\n{TEXT}"),
    "sources after a colon": (f"<article><h1>Flood</h1>{P}<div><p>Read more here:</p>{SOURCES}</div></article>", f"Flood\n{TEXT}\nRead more here:\n{LISTED}"),
    "byline": (f'<article><header><h1>Flood</h1><p class="byline">By A. Writer, 3 March.</p></header>{P}</article>', f"Flood\nBy A. Writer, 3 March.\n{TEXT}"),
    "entry header": (f'<article><div class="entry-header"><h1>Flood</h1></div><div class="entry-content">{P}</div></article>', f"Flood\n{TEXT}"),
    "wrapper that denies a sidebar": (f'<div class="layout no-sidebar"><div class="c"><h1>Flood</h1>{P}</div></div><div class="bottom">(c) 2020</div>', f"Flood\n{TEXT}"),
    "wrapper named for a sidebar": (f'<div class="sidebar-layout sidebar"><main><h1>Flood</h1>{P}</main></div><div class="bottom">(c) 2020</div>', f"Flood\n{TEXT}"),
    "widgets of a page builder": (f'<div class="builder-widget"><div class="builder-widget-inner"><h1>Flood</h1></div></div><div class="builder-widget"><div class="builder-widget-inner">{P}</div></div>', f"Flood\n{TEXT}"),
    "camel case": (f'<article>{P}<div class="userComments"><p>{COMMENT}</p></div></article>', TEXT),
    "thread by id": (f'<article>{P}</article><div id="disqus_thread"><p>{COMMENT}</p></div>', TEXT),
    "lead and parts": (f'<div id="content"><h1>Flood</h1><p class="lead">In short: water.</p><div class="body">{P}</div><p>By us.</p></div>', f"Flood\nIn short: water.\n{TEXT}\nBy us."),
    "tables": (f"<article>{P}<table><caption>Losses</caption><tr><th>Farm</th><th>Barns</th></tr><tr><td>Mill</td><td>2</td></tr></table></article>", f"{TEXT}\nLosses\nFarm\nBarns\nMill\n2"),
    "code": (f"<main>{P}<div class='highlight'><pre>a = 1\nb = (a, 2)</pre></div></main>", f"{TEXT}\na = 1 b = (a, 2)"),
    "definitions": (f"<main>{P}<dl><dt>mill</dt><dd>A house that grinds.</dd></dl></main>", f"{TEXT}\nmill\nA house that grinds."),
    "figure": (f"<article>{P}<figure><img src=x><figcaption>The mill, on Monday.</figcaption></figure></article>", f"{TEXT}\nThe mill, on Monday."),
    "unclosed": (f"<div id=menu>{MENU}</div><div id=c><h1>Flood<p>" + "<p>".join(S), f"Flood\n{TEXT}"),
    "old layout table": (f"<table><tr><td width=100>{MENU}</td><td><h1>Flood</h1>{P}</td></tr></table>", f"Flood\n{TEXT}"),
    "roles": (f'<div role="navigation">Home, news.</div><div role="main"><h1>Flood</h1>{P}</div><div role="contentinfo">(c) us, 2020.</div>', f"Flood\n{TEXT}"),
    "hidden": (f'<article>{P}<p hidden>{COMMENT}</p><div style="display: none"><p>{COMMENT}</p></div></article>', TEXT),
    "only a menu": (f"<nav>{MENU}</nav>", ""),
    "several articles": (f'<article><h2>One</h2>{P}</article><div class="ads">Buy, now.</div><article><h2>Two</h2>{P}</article>', f"One\n{TEXT}\nTwo\n{TEXT}"),
    "paragraphs in boxes": ("<div class='story'>" + "".join(f'<div class="para"><span>{s}</span></div>' for s in S) + f"</div><div class='sidebar'>{MENU}</div>", TEXT),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_made_page(name):
    body, want = PAGES[name]
    assert html.main_text(page(body)) == want


@pytest.mark.parametrize("times", [1, 2, 10, 100])
@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("name", ["comments", "comment-list", "post-comments", "reader_replies"])
def test_comments_go_however_long(times, inside, name):
    some = comments(max(1, times * len(TEXT) // len(COMMENT)), name)
    body = f"<article><h1>Flood</h1>{P}{some if inside else ''}</article>{'' if inside else some}"
    assert html.main_text(page(body)) == f"Flood\n{TEXT}"
    short = f"<article><h1>Flood</h1><p>It rose, at night.</p>{some if inside else ''}</article>{'' if inside else some}"
    assert html.main_text(page(short)) == "Flood\nIt rose, at night."


def plain_ratios(blocks):
    """Of each path, in page order: root of the mean length, times a factor for marks, both smoothed by the neighbours."""
    order, of = [], {}
    for b in blocks:
        if b.path not in of:
            order.append(b.path)
        of.setdefault(b.path, []).append(b.text)
    lengths = [sum(map(len, of[p])) / len(of[p]) for p in order]
    marks = [sum(len(html.PUNCTUATION.findall(t)) for t in of[p]) / len(of[p]) for p in order]
    side = (1 - html.OWN_WEIGHT) / 2

    def smooth(x, i):
        total, weight = html.OWN_WEIGHT * x[i], html.OWN_WEIGHT
        for j in (i - 1, i + 1):
            if 0 <= j < len(x):
                total, weight = total + side * x[j], weight + side
        return total / weight

    return {p: (n := smooth(lengths, i)) ** 0.5 * (1 + 2 * min(1, 40 * smooth(marks, i) / max(1, n)) ** 2) for i, p in enumerate(order)}


def test_ratios_like_a_plain_version(spark, sf):
    pages = [r["html"] for r in table(spark, sf, "pages").select("html").collect()] + [page(b) for b, _ in PAGES.values()]
    for p in pages:
        blocks = [b for b in html.blocks_of(p)[0] if not b.left_out]
        assert html.fused_ratios(blocks) == pytest.approx(plain_ratios(blocks))


def test_length_and_punctuation_decide(monkeypatch):
    """With lengths and marks held constant, links and names left as they are, texts change; and with either of them."""
    real = html.length_and_marks

    def changed(constant):
        monkeypatch.setattr(html, "length_and_marks", lambda blocks: {p: constant(*x) for p, x in real(blocks).items()})
        got = {n for n, (b, want) in PAGES.items() if html.main_text(page(b)) != want}
        monkeypatch.setattr(html, "length_and_marks", real)
        return got

    both = changed(lambda length, marks: (100.0, 2.0))
    assert "label between parts" in both and len(both) >= 3
    assert changed(lambda length, marks: (100.0, marks)) and changed(lambda length, marks: (length, 2.0))
