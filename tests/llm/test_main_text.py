"""Hand-written pages from outside the training generator."""

from __future__ import annotations

from collections import Counter

import pytest

NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/about">About us</a></nav>'
FOOT = "<footer>&copy; 2024 Example Media. All rights reserved.</footer>"

#: Pages and their main text.
PAGES = {
    "equal paragraphs": ("<p>The same line again.</p><p>The same line again.</p><p>The same line again.</p>", "The same line again. The same line again. The same line again."),
    "line breaks": ("<div>The river rose in spring.<br>By summer it had fallen again.</div>", "The river rose in spring. By summer it had fallen again."),
    "body text": ("<html><body>plain &amp; text</body></html>", "plain & text"),
    "no tags": ("no tags at all", "no tags at all"),
    "heading above": ("<html><body><h1>Harvest report</h1><p>The wheat came in early.</p><p>Barley was late.</p></body></html>", "Harvest report The wheat came in early. Barley was late."),
    "table": ("<html><body><h1>Tides</h1><table><tr><th>Day</th><th>High</th></tr><tr><td>Monday</td><td>4.2 m</td></tr></table></body></html>", "Tides Day High Monday 4.2 m"),
    "news": (
        f'<!doctype html><html><head><title>Bridge</title><meta charset="utf-8"></head><body>{NAV}<div class="ad-slot">Try our new shoes today</div><main><article><h1>Old bridge reopens</h1><p class="byline-x">After two years of work the bridge is open.</p>'
        f'<p>Drivers queued from early morning, and a band played.</p><h2>What comes next</h2><p>The second lane follows in May.</p></article></main><aside class="related"><h3>Related stories</h3><ul><li><a href="/a">Ferry prices rise</a></li><li><a href="/b">New bus line</a></li></ul></aside>{FOOT}</body></html>',
        "Old bridge reopens After two years of work the bridge is open. Drivers queued from early morning, and a band played. What comes next The second lane follows in May.",
    ),
    "blog with comments": (
        '<html><body><div id="header"><h1>Anna bakes</h1><p>Bread and more</p></div><div id="content"><div class="post"><h2>Rye bread</h2><p>Mix the flour with water and wait a night.</p><ul><li>500 g rye</li><li>400 g water</li></ul><p>Bake it hot.</p></div>'
        '<div id="comments"><h3>3 replies</h3><div class="comment"><b>Tom</b><p>Mine did not rise, what went wrong?</p></div><div class="comment"><b>Eva</b><p>Lovely, thank you for the recipe!</p></div></div></div><div id="footer">Powered by flour</div></body></html>',
        "Rye bread Mix the flour with water and wait a night. 500 g rye 400 g water Bake it hot.",
    ),
    "cookie notice": (
        '<body><div class="cookie-banner"><p>We use cookies to make this site work. Read more in our policy.</p><button>Accept</button></div><div class="article-body"><p>Moss grows where the air is damp.</p><p>It needs little light.</p></div></body>',
        "Moss grows where the air is damp. It needs little light.",
    ),
    "form between": (
        '<body><h1>Walking the coast</h1><p>Start at the harbour and keep the sea on your left.</p><form action="/s"><label>Your e-mail</label><input name="m"><button>Send me news</button></form><p>After an hour you reach the lighthouse.</p></body>',
        "Walking the coast Start at the harbour and keep the sea on your left. After an hour you reach the lighthouse.",
    ),
    "layout table": (
        '<table><tr><td class="menu"><a href="1">Start</a><br><a href="2">Products</a><br><a href="3">Contact</a></td><td><p>Our pumps run for thirty years.</p><p>They are made from cast iron.</p></td></tr></table>',
        "Our pumps run for thirty years. They are made from cast iron.",
    ),
    "semantic header and title": (
        f"<body><header><h1>The Daily Post</h1><p>News since 1901</p></header>{NAV}<article><header><h1>Storm closes port</h1></header><p>Ships stayed at sea overnight.</p></article>{FOOT}</body>",
        "Storm closes port Ships stayed at sea overnight.",
    ),
    "script and style": ("<body><style>p{color:red}</style><script>document.write('<p>no</p>')</script><p>Only this.</p><noscript>Turn scripts on</noscript></body>", "Only this."),
    "one paragraph": ("<p>x</p>", "x"),
    "entities": ("<article><p>Caf&eacute; &lt;open&gt; &#8211; 5&nbsp;&euro;</p></article>", "Café <open> – 5 €"),
    "inline tags": ("<div><p>A <b>bold</b> and an <i>ita</i>lic wo<span>rd</span> with a <a href=x>link</a> in it.</p></div>", "A bold and an italic word with a link in it."),
    "nested wrappers": (
        f'<body><div class="x1"><div class="x2">{NAV}<div class="x3"><section><h1>Deep down</h1><div><div><p>The cave is four miles long.</p></div><div><p>No one has seen its end.</p></div></div></section></div></div></div>{FOOT}</body>',
        "Deep down The cave is four miles long. No one has seen its end.",
    ),
    "unclosed": ("<body><div id=main><p>First thought<p>Second thought<ul><li>one<li>two</ul><p>Third thought</div></body>", "First thought Second thought one two Third thought"),
    "quotes and code": ("<article><p>She wrote:</p><blockquote>All is well.</blockquote><pre>x = 1\n  y = 2</pre></article>", "She wrote: All is well. x = 1 y = 2"),
    "definition list": (f"<body>{NAV}<dl><dt>Quark</dt><dd>A small particle.</dd><dt>Lepton</dt><dd>Another one.</dd></dl></body>", "Quark A small particle. Lepton Another one."),
    "two articles": (f"<body>{NAV}<main><article><h2>One</h2><p>The first tale.</p></article><article><h2>Two</h2><p>The second tale.</p></article></main>{FOOT}</body>", "One The first tale. Two The second tale."),
    "sidebar left": (
        '<body><div class="wrap"><div class="sidebar"><h4>Popular</h4><ul><li><a href=a>Ten tips for cats</a></li><li><a href=b>Why dogs bark</a></li></ul></div><div class="text"><p>Owls hunt at night.</p><p>Their flight makes no sound.</p></div></div></body>',
        "Owls hunt at night. Their flight makes no sound.",
    ),
    "newsletter": (
        '<article><p>Rain fell for nine days.</p><div class="newsletter-signup"><p>Get our best stories every morning.</p></div><p>On the tenth the sun came out.</p></article>',
        "Rain fell for nine days. On the tenth the sun came out.",
    ),
    "share buttons": ('<article><h1>Bees</h1><div class="share-buttons"><a href=f>Facebook</a> <a href=t>Twitter</a></div><p>Bees dance to tell the way.</p></article>', "Bees Bees dance to tell the way."),
    "figure": ("<article><figure><img src=a.png><figcaption>The tower in 1910</figcaption></figure><p>It was built from oak.</p></article>", "The tower in 1910 It was built from oak."),
    "german": (f'<body>{NAV}<main><h1>Über den Fluss</h1><p>Die Brücke wurde im Mai eröffnet.</p></main><div class="impressum legal">Impressum und Datenschutz</div></body>', "Über den Fluss Die Brücke wurde im Mai eröffnet."),
    "breadcrumb": ('<body><div class="breadcrumb"><a href=/>Home</a> &gt; <a href=/g>Garden</a></div><h1>Pruning roses</h1><p>Cut above the fifth leaf.</p></body>', "Pruning roses Cut above the fifth leaf."),
    "comment articles": (
        '<article class="post"><h1>Mountain huts</h1><p>Most open in June.</p><section id="reader-comments"><article><p>Great list.</p></article><article><p>You forgot the highest one.</p></article></section></article>',
        "Mountain huts Most open in June.",
    ),
    "long paragraphs": (f"<body>{NAV}<div>" + "".join(f"<p>{'Snow covered the valley and the road to the village. ' * 6}</p>" for _ in range(5)) + f"</div>{FOOT}</body>", " ".join(["Snow covered the valley and the road to the village."] * 30)),
    "only chrome": (f'<body><header class="site-header"><h1>Shop</h1></header>{NAV}<div class="cookie-notice">We use cookies.</div>{FOOT}</body>', ""),
    "link paragraph": ('<article><p>All maps are online.</p><p><a href="/m">See the map of the whole river</a></p></article>', "All maps are online. See the map of the whole river"),
    "text beside blocks": ("<body><div>Before the list <ul><li>first</li><li>second</li></ul> after the list</div></body>", "Before the list first second after the list"),
}
EXACT = ("equal paragraphs", "line breaks", "body text", "no tags", "heading above", "table", "one paragraph", "script and style", "entities", "inline tags", "news", "text beside blocks", "long paragraphs")


def test_hand_written_pages():
    from waybill.llm.op2_html import main_texts, shipped

    got = dict(zip(PAGES, main_texts([h for h, _ in PAGES.values()], shipped()), strict=True))
    assert {n: got[n] for n in EXACT} == {n: PAGES[n][1] for n in EXACT}
    hit = {n: sum((Counter(got[n].split()) & Counter(PAGES[n][1].split())).values()) for n in PAGES}
    wrong = {n: (got[n], PAGES[n][1]) for n in PAGES if got[n] != PAGES[n][1]}
    assert sum(hit.values()) >= 0.98 * sum(len(t.split()) for t in got.values()), wrong
    assert sum(hit.values()) >= 0.99 * sum(len(t.split()) for _, t in PAGES.values()), wrong
    assert len(wrong) <= 3, wrong


STORY = ("Harbour closed by storm", "Ships stayed at sea overnight while the wind rose to ten.", "By morning two of them had reached the harbour, and the crews went ashore.")
STORY_HTML = f"<h1>{STORY[0]}</h1><p>{STORY[1]}</p><p>{STORY[2]}</p>"
NAMES = (
    "user-content message-body info more-text thread-text offer bottom comment-text see-also related-story newsletter-issue promo alert warning "
    "content sidebar footer menu banner popup subscribe share ad tools print-view archive-page form-text site-header reader copyright-page"
).split()
#: Junk without any name or telling tag.
UNMARKED = {
    "comments": "<div><h3>3 replies</h3><div><b>Tom</b><p>Mine did not rise, what went wrong?</p></div><div><b>Eva</b><p>Lovely, thank you!</p></div></div>",
    "dated comments": "<div><h4>2 comments</h4><div><b>Ann</b> 3 days ago <p>Was anyone hurt?</p></div><div><b>Jo</b> 2 days ago <p>Nobody, they say.</p></div></div>",
    "notice": "<div><p>We use cookies to make this site work.</p><button>Accept</button></div>",
    "links": '<div><h3>Related stories</h3><ul><li><a href="/a">Ferry prices rise</a></li><li><a href="/b">New bus line</a></li></ul></div>',
    "menu": '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sports</a></li></ul>',
}


def test_article_stays_whatever_its_name():
    from waybill.llm.op2_html import main_texts, shipped

    pages = [f"<html><body><{tag} {a}='{name}'>{STORY_HTML}</{tag}></body></html>" for name in NAMES for tag in ("div", "section") for a in ("class", "id")]
    got = main_texts(pages, shipped())
    assert [p for p, t in zip(pages, got, strict=True) if t != " ".join(STORY)] == []


def test_junk_goes_without_a_name():
    from waybill.llm.op2_html import main_texts, shipped

    pages = {n: f"<html><body><div>{STORY_HTML}</div>{junk}</body></html>" for n, junk in UNMARKED.items()}
    got = dict(zip(pages, main_texts(list(pages.values()), shipped()), strict=True))
    assert {n: t for n, t in got.items() if t != " ".join(STORY)} == {}


def test_broken_markup_takes_linear_time():
    import time

    from waybill.llm.op2_html import main_texts, shipped

    for source in ("<b>x" * 125_000 + "</i>" * 125_000, "<span>" * 80_000 + "</div>" * 80_000, "<span>" * 60_000 + "<h1>a</h1>" * 60_000, "<div>x" * 60_000, "<td>x" * 100_000, "<p><b>" * 100_000):
        began = time.perf_counter()
        main_texts([source], shipped())
        assert time.perf_counter() - began < 20, source[:20]


def test_very_long_deep_and_odd_pages():
    from waybill.llm.op2_html import main_texts, shipped

    long = "<p>" + "word " * 200_000 + "</p>"
    many = "".join(f"<p>line {i}</p>" for i in range(20_000))
    deep = "<div>" * 3000 + "down here" + "</div>" * 3000
    got = main_texts([long, many, deep, None, "", "   ", "<", "<p", "<!-- only a comment -->", "\x00a\x00"], shipped())
    assert got[0] == " ".join(["word"] * 200_000) and got[1] == " ".join(f"line {i}" for i in range(20_000)) and got[2] == "down here"
    assert got[3:6] == ["", "", ""] and got[8] == ""


def test_training_reproduces_itself_and_reads_back():
    import numpy as np

    from waybill.llm.dom import Forest, features, parse
    from waybill.llm.op2_html import document, read, trained
    from waybill.llm.page_samples import pages

    models = trained(40)
    text = document(models, 40)
    assert document(trained(40), 40) == text
    page = parse(pages(1, seed=3)[0])
    bins = models[0].binned(features([page], Forest([page])))
    for a, b in zip(models, read(text), strict=True):
        assert np.array_equal(a.logit(bins), b.logit(bins))


def test_labels_never_contradict():
    """What stands below a kept (dropped) node is kept (dropped) unless a mixed node lies between."""
    import numpy as np

    from waybill.llm.dom import Forest, parse
    from waybill.llm.op2_html import decoded
    from waybill.llm.page_samples import pages

    r = np.random.default_rng(4)
    for source in pages(20, seed=8):
        page = parse(source)
        f = Forest([page])
        keep, drop = r.normal(size=(2, f.n)) * 3
        size = np.array([len(t) for t in page.text], float)
        kept = decoded(f, size, keep, drop)
        # the best labelling by brute force over the labels of each subtree
        p, q = 1 / (1 + np.exp(-keep)), 1 / (1 + np.exp(-drop))
        leaf = ~np.isin(np.arange(f.n), f.parent)
        rest = np.where(leaf, 1e-9, np.clip(1 - p - q, 0.01, None))
        logs = np.log(np.stack([p, q, rest], 1) + 1e-9)
        logs[(size == 0) & leaf] = 0
        children = [np.flatnonzero(f.parent == i) for i in range(f.n)]

        def whole(i, k):
            return logs[i, k] + sum(whole(c, k) if k < 2 else max(whole(c, x) for x in range(3)) for c in children[i])

        def walk(i, above):
            k = above if above is not None and above < 2 else max(range(3), key=lambda x: whole(i, x))
            yield i, k == 0
            for c in children[i]:
                yield from walk(c, k)

        assert [x for _, x in sorted(walk(0, None))] == kept.tolist()


@pytest.mark.parametrize(("telling", "least"), [(True, 0.98), (False, 0.96)])
def test_held_out_pages_of_the_generator(telling, least):
    """Pages whose names tell, and pages on which names are missing or mislead."""
    import html
    import re

    from waybill.llm.op2_html import main_texts, shipped
    from waybill.llm.page_samples import Writer

    hit = found = true = n = 0
    for seed in range(991_000_000, 991_000_600):
        writer = Writer(seed)
        if (writer.dull or writer.misled) == telling:
            continue
        source, n = writer.page(), n + 1
        inside, gold = False, []
        for part in re.split(f"([{Writer.ON}{Writer.OFF}])", source):
            if part in (Writer.ON, Writer.OFF):
                inside = part == Writer.ON
            elif inside:
                gold += html.unescape(re.sub("<[^>]+>", "", part)).split()
        got = main_texts([source.replace(Writer.ON, "").replace(Writer.OFF, "")], shipped())[0].split()
        hit += sum((Counter(gold) & Counter(got)).values())
        found, true = found + len(got), true + len(gold)
    assert n > 200 and hit / found > least and hit / true > least, (hit / found, hit / true)
