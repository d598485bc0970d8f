"""HTML extraction (op1): brute force over the states of small pages, pages that no generator made, and deep pages."""

import itertools
import re
import time

import numpy as np
import pytest

from rowsift.llm import html


def brute_extract(page, model):
    """Text of the nodes that are content in more than half of all weighted states, in document order."""
    p = html.Page(page)
    forest = html.Forest([p])
    n, kind = len(p.parent), forest.block.astype(int)
    weight, content = 0.0, np.zeros(n)
    for s in itertools.product((0, 1), repeat=n):
        score = sum((forest.x[i] @ model.w) * s[i] for i in range(n)) + sum(model.pair[kind[i], s[p.parent[i]], s[i]] for i in range(1, n))
        weight += np.exp(score)
        content += np.exp(score) * np.array(s)

    def hidden(i):
        return i >= 0 and (html.GROUPS.get(p.tag[i]) == 9 or hidden(p.parent[i]))

    chosen = [content[i] / weight > 0.5 and not hidden(i) for i in range(n)]
    return re.sub(r"\s+", "", "".join(t for i, t in p.pieces if chosen[i])), sum(chosen)


@pytest.mark.parametrize("seed", range(4))
def test_extracts_are_those_of_brute_force(seed):
    r = np.random.default_rng(seed)
    pages = ["<div><p>one two.<b>three</b></p><ul><li>four<li>five</ul></div>", "<p>x</p>tail<script>no</script>", "<nav><a>link</a></nav><article><h1>t</h1><p>long text here, and more.</p></article>", "", "bare"]
    trained = html.trained()
    model = html.TreeModel()
    model.w, model.pair = (trained.w, trained.pair) if seed == 0 else (r.normal(size=html.N_FEATURES), r.normal(size=(2, 2, 2)))
    for page, (text, nodes, n_content, certainty) in zip(pages, html.extract(pages, model), strict=True):
        assert (re.sub(r"\s+", "", text), n_content) == brute_extract(page, model) and nodes == len(html.Page(page).parent) - 1 and 0.5 <= certainty <= 1


#: Written by hand: (page, phrases of the content, phrases of the rest).
WRITTEN = [
    (
        """<html><head><title>Harbour news</title></head><body><div id="top"><a href="/">Home</a> <a href="/w">Weather</a> <a href="/s">Sport</a></div>
        <div class="article-body"><h1>Ferry returns after the storm</h1><p>The ferry to the northern islands sailed again on Monday, three days after the storm tore down part of the pier.</p>
        <p>Engineers said that repairs would go on for weeks, although passengers were asked to be patient, and most of them were.</p></div>
        <div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Tides</a></li><li><a href="/2">Tickets</a></li></ul></div><footer>Copyright Harbour Press</footer></body></html>""",
        ["sailed again on Monday", "most of them were"],
        ["Weather", "Tickets", "Copyright Harbour Press"],
    ),
    (
        """<body><nav><ul><li><a href=a>Start</a><li><a href=b>Recipes</a><li><a href=c>Contact us</a></ul></nav><main><h2>Lentil soup</h2>
        <p>Rinse the lentils well. Fry the onion in oil until it is soft, then add the carrots, the lentils and a litre of water.</p>
        <p>Let it boil for half an hour, season it with vinegar and salt, and serve it hot with bread.</p></main><div class="cookie-banner">We use cookies. <button>Accept</button></div></body>""",
        ["Fry the onion in oil", "serve it hot with bread"],
        ["Contact us", "Accept"],
    ),
    (
        """<table><tr><td><a href=1>Index</a><br><a href=2>Archive</a></td><td><p>In the spring of that year the whole village moved up the hill, because the river had taken the lower street twice.</p>
        <p>Nobody who lived through it forgot the sound, my grandmother said, and she told it to everyone who asked.</p></td></tr></table><div id=footer><a href=m>Mail the webmaster</a></div>""",
        ["moved up the hill", "told it to everyone"],
        ["Archive", "Mail the webmaster"],
    ),
    (
        """<div class=wrap><header><h1>Tech blog</h1><a href=/feed>Feed</a></header><section><h2>Why the queue stalled</h2><div>The worker held a lock while it waited for the network. Every other worker then waited for the lock,
        and after a minute the monitor restarted all of them at once.</div><blockquote>Never wait for a peer under a lock, as the old saying in our team goes.</blockquote></section><aside><p>Related posts</p><a href=x>Retries</a></aside></div>""",
        ["held a lock while it waited", "restarted all of them at once"],
        ["Feed", "Retries"],
    ),
]


def test_pages_written_by_hand():
    texts = [t for t, *_ in html.extract([p for p, _, _ in WRITTEN], html.trained())]
    kept = [phrase in text for text, (_, content, _) in zip(texts, WRITTEN, strict=True) for phrase in content]
    gone = [phrase not in text for text, (_, _, rest) in zip(texts, WRITTEN, strict=True) for phrase in rest]
    assert np.mean(kept) == 1 and np.mean(gone) >= 0.9


@pytest.mark.parametrize("page", ["<div>", "<span>", "<p><b>", "</i>", "<li>", "<span></i>", "<div><p>"])
def test_time_grows_with_the_length_of_a_page(page):
    model = html.trained()

    def seconds(n):
        began = time.perf_counter()
        html.extract([page * n + "end"], model)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 30 * seconds(4_000) + 0.5
