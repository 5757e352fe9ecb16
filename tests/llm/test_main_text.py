"""Main text of pages with the furniture and the faults that pages have."""

import pytest

from pitlane.llm.main_text import extract, main_text

P1 = "The first paragraph goes on for a while, with commas, and says enough to be counted as text."
P2 = "A second one follows, which is about as long, so that the container is plainly the best of all."


@pytest.mark.parametrize("html, text", [
    (f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
     f"<div class='ad'>Buy now, today, at once, for all of your needs, and more.</div><article><h1>Title</h1><p><b>{P1}<br><p>{P2}</p></article>"
     "<footer>&copy; x</footer></body></html>", f"Title\n{P1}\n{P2}"),
    (f"<body><div id=top><a>a</a> <a>b</a> <a>c</a></div><div id=content><h2>Head</h2><div><p>{P1}</p><p>{P2}</p><p>Short.</p></div>"
     f"<div class='comments'><p>Nice post, I really liked it, thank you so much, all of you, indeed.</p></div></div>", f"Head\n{P1}\n{P2}\nShort."),
    (f"<div><p>{P1}</p><aside><p>{P2}</p></aside><form><p>{P2}</p></form><div class=cookie-notice>{P2}</div></div>", P1),
    (f"<p>A &lt;b&gt; &amp; c&nbsp;d &#233;\n\n  e</p><p>{P1}", f"A <b> & c d é e\n{P1}"),
    ("", ""), ("plain words only", "plain words only"), ("<p>", ""), ("<<>><p <b>", None), ("<div>" * 3000 + P1, P1),
    (f"<article><p>{P1}</p><section id=comments><article class=comment><p>{P2}</p></article></section></article>", P1),
    (f"<article><div style='display: none'>{P2}</div><p>{P1}</p><!-- {P2} --><style>p{{}}</style></article>", P1),
    (f"<ul><li>{P1}<li>{P2}</ul>", f"{P1}\n{P2}"),
    (f"<main><p>{P1}</p><ul><li><a>one link here</a><li><a>two links here</a><li><a>three of them</a></ul></main>", P1),
])
def test_pages(html, text):
    got = main_text(html)
    assert text is None or got == text


def test_table(spark):
    rows = [(1, "u", f"<p>{P1}</p>", "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", f"<p>{P1}</p>", "x"), (4, "v", f"<p>{P1 * 2000}</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(pages, ["page_id", "url"]).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in out) == sorted(
        (r[0] or 0, r[1] or "", len(P1) if r[2] and len(r[2]) < 500 else len(P1) * 2000 if r[2] else 0) for r in rows)
    assert all(len(r["text"]) == r["n_chars"] for r in out)
    assert extract(pages.limit(0)).count() == 0


def test_siblings_and_names_in_articles():
    a, b = (f"{w} one text, with commas, that goes on for as long as a paragraph does, and then some more of it." for w in ("The", "Another"))
    for html in (f"<body><article><p>{a}</p></article><article><p>{b}</p></article></body>",
                 f"<main><article><p>{a}</p></article><section><p>{b}</p></section></main>",
                 f"<article><p>{a}</p><div class='legal notice'><p>{b}</p></div><div class='share'><a href='#'>Share</a></div></article>"):
        assert main_text(html) == f"{a}\n{b}"
    assert main_text(f"<article><h2 id='search'>Search</h2><p>{a}</p><h5 class='legal'>Law</h5><p>{b}</p></article>") == f"Search\n{a}\nLaw\n{b}"
    assert main_text(f"<body><article><p>{a}</p></article><div><a href='#'>x</a> <a href='#'>y</a></div></body>") == a


LONG = "A box with much more than eighty characters of text in it, none of them links, which is not the article's own at all."


@pytest.mark.parametrize("html, text", [
    (f"<main><p>{P1}</p><p>{P2}</p><div class=sidebar>{LONG}</div></main>", f"{P1}\n{P2}"),
    (f"<main><p>{P1}</p><p>{P2}</p><div id=newsletter><p>{LONG}</p></div></main>", f"{P1}\n{P2}"),
    (f"<article><p>{P1}</p><p>{P2}</p><div class=cookie-notice>{LONG}</div></article>", f"{P1}\n{P2}"),
    (f"<article><p>{P1}</p><p>{P2}</p><div class=advert><p>{LONG}</p></div><p class=notice>Short.</p></article>", f"{P1}\n{P2}"),
    (f"<article><div class='post widget-area notice'><p>{P1}</p><p>{P2}</p></div><p>End.</p></article>", f"{P1}\n{P2}\nEnd."),
    (f"<article><p>{P1}</p><h2>References</h2><ol><li><a href=a>A first work that is cited here</a><li><a href=b>A second work of another author</a>"
     f"<li><a href=c>A third one</a></ol></article>", f"{P1}\nReferences\nA first work that is cited here\nA second work of another author\nA third one"),
    (f"<article><p>{P1}</p><ul><li><a href=a>A first work that is cited here</a><li><a href=b>A second work of another author</a>"
     f"<li><a href=c>A third one, cited too, at length</a></ul></article>",
     f"{P1}\nA first work that is cited here\nA second work of another author\nA third one, cited too, at length"),
    (f"<article><p>{P1}</p><p><a href=a>One</a>, <a href=b>two</a> and <a href=c>three</a></p></article>", f"{P1}\nOne, two and three"),
    (f"<body><article><h1>T</h1><p>{P1}</p></article><section><h3>3 responses</h3><article><p>{P2} {P2}</p></article></section></body>", f"T\n{P1}"),
    (f"<body><article><h1>T</h1><p>{P1}</p></article><section><article><p>{P2} And a little more, to be the longer one.</p></article></section></body>",
     f"T\n{P1}\n{P2} And a little more, to be the longer one."),
    (f"<article><p>{P1}</p><section><h2>Discussion of results</h2><p>{P2}</p></section></article>", f"{P1}\nDiscussion of results\n{P2}"),
])
def test_named_boxes_references_and_responses(html, text):
    assert main_text(html) == text
