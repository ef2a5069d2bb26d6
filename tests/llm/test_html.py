import itertools
import math
import random

from sleuthgrid.llm import html_extract as h


def test_marginals_against_enumeration():
    model = h.default_model(60)
    rng = random.Random(3)
    for _ in range(40):
        nodes = [h.Node("body", frozenset(), -1)]
        for i in range(1, rng.randrange(2, 9)):
            inner = [k for k, v in enumerate(nodes) if v.kind != "text"]
            if rng.random() < 0.5:
                nodes.append(h.Node("text", frozenset(), rng.choice(inner), "Some words here." * rng.randrange(1, 9)))
            else:
                nodes.append(h.Node(rng.choice(["box", "nav", "article", "para"]), frozenset(rng.sample(["ad", "good"], rng.randrange(2))), rng.choice(inner)))
        total, on = 0.0, [0.0] * len(nodes)
        for y in itertools.product((0, 1), repeat=len(nodes)):
            p = math.exp(model.root) if y[0] else 1.0
            for i, v in enumerate(nodes):
                p *= model.odds(v) if y[i] else 1.0
                if i:
                    p *= model.pair(v)[2 * y[v.parent] + y[i]]
            total += p
            for i in range(len(nodes)):
                on[i] += p * y[i]
        assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(nodes), on))


def test_held_out_pages():
    model, rng = h.default_model(), random.Random(99)
    right = wrong = missed = 0
    for _ in range(150):
        page, truth = h.labelled_page(rng)
        got, want = model.extract(page).split("\n"), [" ".join(t.split()) for t in truth]
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want) - {""})
        missed += len(set(want) - set(got))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_pages(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now please.</div><article><h1>Title of it &amp; more</h1><p><b>First  line\n of text, it says.<br><p>Second &lt;one&gt; here, which is long enough.</p></article><footer>&copy; me</footer>'
    want = "Title of it & more\nFirst line of text, it says.\nSecond <one> here, which is long enough."
    rows = [(1, "u", page, 3), (2, "u", None, 3), (3, None, "", 3), (4, "u", "<p", 3), (4, "u", "<p", 3), (5, "u", "<div>" * 3000 + "x", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(h.extract(df).collect(), key=lambda r: r.page_id)
    assert len(got) == 6 and got[0].text == want and got[0].n_chars == len(want)
    assert got[1].text == got[2].text == ""
    assert h.extract(df.limit(0)).count() == 0


#: Pages of other shapes than the generator's, with their main text written by hand.
BY_HAND = [
    ("<title>T</title><article><p>Head and body tags may be left out of a page.</p></article>", "Head and body tags may be left out of a page."),
    ("<head><title>T</title><p>A paragraph ends the head, as no tag closes it.</p>", "A paragraph ends the head, as no tag closes it."),
    ("<body><main><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be the first of all numbers.</p></main>", "Let x=1 be the first of all numbers."),
    ("<main><p>Before the hidden parts, there is a sentence.</p><template>a<template>b</template>c</template><svg><g><svg>d</svg></g>e</svg><p>After them, there is another one.</p></main>", "Before the hidden parts, there is a sentence.\nAfter them, there is another one."),
    ("<article><p>A list of options that is never closed.</p><option>one<p>It must not swallow what comes after it.</p></article>", "A list of options that is never closed.\none\nIt must not swallow what comes after it."),
    ("<article><svg><p>An unclosed picture hides nothing at all.</p></article>", "An unclosed picture hides nothing at all."),
    ("<article><p>If a < b and b > c, then it's don't know.</p><p don't>Quotes in odd places, like this one.</p></article>", "If a < b and b > c, then it's don't know.\nQuotes in odd places, like this one."),
    ("<article><h1>Sales of the year</h1><p>The first paragraph tells of the sales of the year, at length.</p><p>The second one goes on, and says what came of them.</p><p>The third one ends with what is planned for the next year.</p><table><tr><td>North</td><td>12</td></tr><tr><td>South</td><td>7</td></tr></table></article>", "Sales of the year\nThe first paragraph tells of the sales of the year, at length.\nThe second one goes on, and says what came of them.\nThe third one ends with what is planned for the next year.\nNorth\n12\nSouth\n7"),
    ("<main><p>A page with a table, and a sentence before it.</p><table><tr><th>Name</th><th>Size</th></tr><tr><td>Alpha</td><td>3</td></tr></table></main>", "A page with a table, and a sentence before it.\nName\nSize\nAlpha\n3"),
    ("<article><p>Research &amp; Development &copy; D, which was founded in the spring, has grown since.</p></article>", "Research & Development © D, which was founded in the spring, has grown since."),
    ("<article><h1>News of the day</h1><p>One paragraph of the news, which is not very long.</p><p>Photo © Acme Agency, 2024.</p></article>", "News of the day\nOne paragraph of the news, which is not very long.\nPhoto © Acme Agency, 2024."),
    ("<nav><a href=/>Home</a></nav><article><header><h1>The title of it</h1><p>A lead paragraph that says what the article is about.</p></header><p>Then comes the article, which has more to say about it.</p></article><footer>© 2024 Acme</footer>", "The title of it\nA lead paragraph that says what the article is about.\nThen comes the article, which has more to say about it."),
    ("<article><p>A paragraph that stands before the link, and is long enough.</p><p>Read the full <a href=/r>report here</a></p><p>A paragraph that stands after the link, and is long enough.</p></article>", "A paragraph that stands before the link, and is long enough.\nRead the full report here\nA paragraph that stands after the link, and is long enough."),
    ("<article><p>A sentence that everybody can see, as it is shown.</p><p hidden>Nobody sees this.</p><div style='color:red; display: none'>Nor <div>any</div> of this.</div><p>Another sentence that everybody can see.</p></article>", "A sentence that everybody can see, as it is shown.\nAnother sentence that everybody can see."),
    ("<article><p>Pictures have words too, but not in the text.</p><Svg><text>leak</text></Svg></article>", "Pictures have words too, but not in the text."),
    ("<article><p>The article itself, which has a paragraph or two.</p><p>This is the second of them, and the last one.</p></article><section class=user-remarks><h3>Remarks</h3><p>I like this article a lot, thanks for it.</p></section>", "The article itself, which has a paragraph or two.\nThis is the second of them, and the last one."),
    ("<BODY><NAV><A HREF='/'>Home</A></NAV><ARTICLE><P>Capital letters in tags, as in old pages.</P></ARTICLE><SCRIPT>if (a<b) x('</p>')</SCRIPT></BODY>", "Capital letters in tags, as in old pages."),
]


def test_pages_by_hand():
    model = h.default_model()
    for page, want in BY_HAND:
        assert model.extract(page) == want, page


def test_reading_is_linear():
    import time

    took = []
    for n in (20_000, 160_000):
        start = time.process_time()
        for page in ("<a " * n, "<p a=\"" * n, "<!" * n, "<![CDATA[" * n, "<svg>" * n, "</p" * n, "<b c='" * n, "<div>" * n + "</p></x>" * n, "<li><div>" * n, "<script>" * n):
            h.parse(page)
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0] + 0.5
