"""Extraction from hand-made pages of other layouts than the training pages, and hostile ones."""

import time

import pytest

from inkstream.llm import html_crf
from inkstream.llm.dom import leaves


@pytest.fixture(scope="module")
def extractor():
    return html_crf.Extractor(html_crf.trained())


#: A news page, a blog, a recipe, a forum-like manual page and an old table layout, with their main text.
PAGES = [
    (
        """<html><head><title>Paper</title></head><body><div id="top-bar"><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul></div>
        <main><article><h1>River floods the old town</h1><p class="byline">By our reporter</p><p>The river rose by two metres overnight, and the lower streets were closed.</p>
        <figure><img src="a.jpg"><figcaption>The bridge on Monday morning.</figcaption></figure><p>Residents were taken to the school, where the council had beds.</p></article></main>
        <aside class="related"><h3>More news</h3><ul><li><a href="/1">Weather warning</a></li></ul></aside><footer>&copy; 2020 Paper Ltd</footer></body></html>""",
        ["River floods the old town", "The river rose by two metres overnight, and the lower streets were closed.", "Residents were taken to the school, where the council had beds."],
        ["Home", "World", "Weather warning", "© 2020 Paper Ltd"],
    ),
    (
        """<body><header class="masthead"><a href="/">My garden</a></header><nav><a href="/about">About</a> <a href="/archive">Archive</a></nav>
        <div class="entry-content"><h1>Planting beans</h1><p>Beans want warm ground, so wait until the middle of May.</p><blockquote>Never sow before the frost is over.</blockquote><p>Then sow five to a hole.</p></div>
        <section id="comments"><h2>Two replies</h2><div class="comment"><p>Thank you, this helped me a lot with my own beans.</p></div></section>
        <form class="newsletter"><p>Get our letter every week.</p><input name="mail"></form></body>""",
        ["Planting beans", "Beans want warm ground, so wait until the middle of May.", "Never sow before the frost is over.", "Then sow five to a hole."],
        ["My garden", "Archive", "Thank you, this helped me a lot with my own beans.", "Get our letter every week."],
    ),
    (
        """<div class="cookie-banner"><p>We use cookies to make this site better for you.</p></div><div role="main"><h1>Onion soup</h1><ul><li>Six onions, cut fine.</li><li>One litre of broth.</li></ul>
        <p>Cook the onions slowly for an hour, then add the broth.</p></div><div class="ad"><p>Buy our knives now and save money.</p></div><div class="footer">All rights reserved</div>""",
        ["Onion soup", "Six onions, cut fine.", "One litre of broth.", "Cook the onions slowly for an hour, then add the broth."],
        ["We use cookies to make this site better for you.", "Buy our knives now and save money.", "All rights reserved"],
    ),
]


@pytest.mark.parametrize("page, kept, dropped", PAGES)
def test_other_layouts(extractor, page, kept, dropped):
    lines = extractor.text(page).split("\n")
    assert [x for x in kept if x not in lines] == [] and [x for x in dropped if x in lines] == []


PROSE = ["The river rose by two metres overnight, and the lower streets were closed to all traffic until noon.", "Residents were taken to the school, where the council had beds, blankets and hot food for everyone."]
WITHIN = ["{}", "<div>{}</div>", "<div><div><div>{}</div></div></div>", '<div class="post">{}</div>', '<div class="zork-box">{}</div>', '<div id="wrapper"><div class="row"><div class="col-md-8">{}</div></div></div>', "<table><tr><td>{}</td></tr></table>", "<article>{}</article>", '<div class="entry-content">{}</div>', "<main>{}</main>", "<center>{}</center>", "<font>{}</font>"]
MENU, BELOW = '<ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul>', '<div class="comments"><p>Thank you, this helped me a lot with my own beans.</p></div><div class="footer">All rights reserved</div>'


@pytest.mark.parametrize("within", WITHIN)
def test_prose_is_kept_wherever_it_stands(extractor, within):
    """Containers that the maker of training pages does not know, or that have no name."""
    article = ["River floods town", *PROSE, "Never sow before the frost is over.", "Six onions, cut fine.", "One litre of broth."]
    inner = "<h1>{}</h1><p>{}</p><p>{}</p><blockquote>{}</blockquote><ul><li>{}</li><li>{}</li></ul>".format(*article)
    for page in (within.format(inner), MENU + within.format(inner) + BELOW):
        assert extractor.text(f"<html><body>{page}</body></html>").split("\n") == article
    for n in (1, 2, 12):
        page = within.format("".join(f"<p>{PROSE[i % 2]}</p>" for i in range(n)))
        assert len(extractor.text(f"<html><body>{page}</body></html>").split("\n")) == n and extractor.text(page)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep words here.", "<div>a" * 8000, "<span>" * 8000 + "<p>x</p>" * 8000, "<b>" + "<div>" * 8000 + "</b>x" * 8000, "<ul>" + "<li>x" * 10_000, "<i>x</u>" * 10_000])
def test_time_is_linear_in_the_page(extractor, page):
    began = time.process_time()
    extractor.text(page)
    assert time.process_time() - began < 4


def test_scores_are_those_of_all_features_of_the_path(extractor):
    for seed in range(70_000, 70_030):
        page, _, _ = html_crf.labelled(seed)
        scores = html_crf.PathScores(extractor.weights)
        for leaf in leaves(page):
            assert scores.of(leaf.inside) == sum(extractor.weights.get(f, 0) for f in html_crf.path_features(leaf.inside, extractor.weights))


def test_odd_tables(spark, extractor):
    rows = [(1, "u", PAGES[0][0], "old"), (1, "u", PAGES[0][0], "old"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_crf.extract(pages, extractor.crf).collect()
    assert len(found) == 3 and len({r.text for r in found if r.page_id}) == 1 and [r.text for r in found if r.page_id is None] == [""]
    assert html_crf.extract(pages.limit(0), extractor.crf).count() == 0
