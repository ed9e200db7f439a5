"""Main text of written pages, and of the kind of page the tables hold."""

import pytest

from pitchside.llm import html_text as H

TREE = H.train()
PAGES = {
    "article": ("<html><head><title>t &amp; u</title><script>if(a<b)x('</p>')</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
                "<div class='cookie-notice'>We use cookies to make this a better place for everyone.</div><article><h1>Head &eacute;&#233;</h1><p>One   <b>bold</b>\n<a href=x>link</a> &lt;end&gt;."
                "<p>Two<br>lines &amp;amp; more<div class=ad-box>Buy now</div><blockquote>Said.</blockquote><form><label>Mail</label><input> sign up</form><ul><li>a item<li>b item</ul></article>"
                "<section id=comments><div class=comment><p>A long comment of a reader that goes on and on for many words here.</p></div></section><aside>Aside</aside><footer>&copy; Me</footer></body></html>",
                "Head éé\n\nOne bold link <end>.\n\nTwo lines &amp; more\n\nSaid.\n\na item\n\nb item"),
    "unclosed": ("<article><p><b>First.<br><p>Second</article><footer>foot", "First.\n\nSecond"),
    "comment": ("<main><!-- <p>no</p> --><p>yes</p><!-- never closed <p>no</p>", "yes"),
    "no main": ("<div class=menu>" + "<a href=x>y</a> " * 5 + "</div><div><p>" + "word " * 40 + "</p><p>" + "text " * 30 + "</p></div><div>tiny</div>", " ".join(["word"] * 40) + "\n\n" + " ".join(["text"] * 30)),
    "table": ("<article><table><tr><td>c1<td>c2<tr><td>c3</table><p>after</p></article>", "c1\n\nc2\n\nc3\n\nafter"),
    "hidden": ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p><p><span class=advert>no</span>rest</p></article>", "yes\n\nrest"),
    "null": (None, ""), "empty": ("", ""), "broken": ("<p title=\"abc>hello", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert H.main_text(page, TREE) == want


TEXT = "<article><p>One line.</p><p>Another line.</p></article>"


@pytest.mark.parametrize("page", [
    f"<body><script>for(i=0;i<n;i++){{f(i)}}</script>{TEXT}",
    f"<body><script>if(a<b){{x=\"it's\"}}</script>{TEXT}",
    f"<body><script>if (a <b) y();</script>{TEXT}<script>z()</script>",
    f"<body><script>var s = '<!-- <p>';</script>{TEXT}",
    f"<body><SCRIPT>a='</p><b'</SCRIPT >{TEXT}",
    f"<html><head><title>t <b it's</title><style>a:before{{content:'<x'}}</style><script>if(a<b)c()</script></head><body>{TEXT}",
    f"<body><textarea>a <b \"c</textarea>{TEXT}",
    f"<body><iframe><!-- </iframe>{TEXT}",
    f"<body><noscript><img alt='x></noscript>{TEXT}",
    f"<body><svg><title/><style>a>b</style><script href=x /><path d=''/></svg>{TEXT}",
    f"<body><button><script>if(a<b)c()</script>Push</button>{TEXT}",
    f"<html><head><meta charset=utf-8><title>t</title><link rel=x href=y><noscript><img src=z></noscript>\n{TEXT}",
    f"<head><title>t</title><template><p>no</p></template><header>Site</header>{TEXT}",
    f"<head><script>if(a<b)c()</script><base href=x></head>{TEXT}",
    f"<head><title>t</title></html>{TEXT}",
])
def test_raw_content_and_heads_end_where_they_should(page):
    assert H.main_text(page, TREE) == "One line.\n\nAnother line."


def test_head_ends_at_text():
    assert [b.text for b in H.blocks_of("<head><title>t</title>Some text<p>more")] == ["Some text", "more"]


def test_long_and_hostile_pages():
    assert H.main_text("<article>" + "<div>" * 30_000 + "deep" + "</div>" * 30_000 + "</article>", TREE) == "deep"
    assert H.main_text("<" * 100_000, TREE) == ""
    assert H.main_text("<article><p>" + "x " * 200_000 + "</p></article>", TREE) == " ".join(["x"] * 200_000)


def test_tree_learns_its_table():
    import numpy as np

    rows = np.array(H.LABELLED, float)
    assert H.classify(TREE, rows[:, :-1]) == rows[:, -1].astype(int).tolist()


def test_frame(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", p, "clash", 1) for i, (p, _) in enumerate(PAGES.values())] + [(0, "http://x/0", PAGES["article"][0], "clash", 1), (None, None, None, None, None)],
                                  "page_id long, url string, html string, text string, label int")
    got = H.extract(pages)
    assert got.columns == ["page_id", "url", "label", "text"]
    want = [(i, w) for i, (_, w) in enumerate(PAGES.values())] + [(0, PAGES["article"][1]), (None, "")]
    assert sorted(((r.page_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert H.extract(pages.limit(0)).count() == 0
