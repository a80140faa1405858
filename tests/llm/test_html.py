import html
import random
import re
import time
from collections import Counter

import pytest

from contactgrid.llm import html_text
from contactgrid.llm.html_text import main_text

PAGES = {
    "<body><nav><a>Menu</a></nav><div class='ad'>Buy now</div><article><h1>T &amp; U</h1><p>one\n two<b>x</b><p>three<br>four<aside>no</aside></article><div id=comments><p>hi there</p></div><footer>f</footer>": "T & U\n\none twox\n\nthree four",
    "<body><ul><li><a href=x>Home</a><li><a>About</a></ul><div><p>main words here and there and more<p>and more of it in here</div><footer>foot</footer>": "main words here and there and more\n\nand more of it in here",
    "<script>var x='<p>no</p>'</script><article><p>cut sho": "cut sho",
    "<article><p>a<form><p>name</p></form><p>b &lt;i&gt;</article>": "a\n\nb <i>",
    "": "",
    "<nav>only menu</nav>": "",
    "no tags at all, just words": "no tags at all, just words",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert main_text(page) == PAGES[page]


MAIN = "<h1>Title</h1><p>" + "main words here " * 8 + "</p>"
BODY = ("main words here " * 8).strip()  # in a page without marks one word doesn't pay for its tags
TEXT = f"Title\n\n{BODY}"
MENU = "<ul class=menu>" + "<li><a href=x>Go</a>" * 30 + "</ul>"
CLASSED = {
    f"<main class='has-sidebar'>{MAIN}</main>": TEXT,
    f"<div id=page class=with-sidebar><nav>menu</nav><article>{MAIN}</article></div>": TEXT,
    f"<article class='post comments-open'>{MAIN}</article>": TEXT,
    f"<article class='post category-social'>{MAIN}</article><div class=share>Share it</div>": TEXT,
    f"<div class=post-content><div class=share>Tell all</div>{MAIN}</div><div class=article-comments>so good</div>": TEXT,
    f"<div class='wrap no-sidebar'>{MAIN}</div><div class=sidebar><p>Tags and more</div>": BODY,
    f"<span class=comment>{MAIN}</span>": BODY,
    f"<article>{MAIN}</article><div class=ad>Buy now</div>{MENU}<article>{MAIN}</article>": f"{TEXT}\n\n{TEXT}",
    f"<article>{MAIN}</article><p>see also</p><article>{MAIN}</article>": f"{TEXT}\n\n{TEXT}",
    f"<article>{MAIN}</article><div id=comments><article>I agree</article></div>": TEXT,
    f"<div class=with-sidebar><article>{MAIN}</article></div><div id=comments><p>{'me too ' * 99}</div>": TEXT,
}


@pytest.mark.parametrize("page", CLASSED)
def test_class_words_do_not_rule_out_the_article(page):
    assert main_text(page) == CLASSED[page]


def test_several_articles_and_teasers():
    assert main_text("<article><p>first story</p></article><p>para outside</p><article><p>second story is longer</p></article>") == "first story\n\nsecond story is longer"
    body = ("The long body has words. " * 30).strip()
    assert main_text(f"<article><p>Teaser words</p></article><div id=content><p>{body}</p></div>") == body
    assert main_text("<div class='post-related-work'><p>Real body words are here, and so on.</p></div>") == "Real body words are here, and so on."
    assert main_text('<p>a b c d e f g <span class="ad">x<span>y</span> leak</span> rest of it.</p>') == "a b c d e f g rest of it."
    assert main_text(f"<main><p>{body}</p><article><p>{body}</p><ul><li>one</li><li>two</li></ul></article></main>") == f"{body}\n\none\n\ntwo"


def test_stretches_are_the_maximal_ones():
    """Against their definition: the best, then the same left and right of it."""
    rng = random.Random(0)

    def best(s, lo, hi):
        sums = [(sum(s[a:b]), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        if not sums or max(sums)[0] <= 0:
            return []
        _, a, b = max(sums)
        return best(s, lo, -a) + [(-a, b)] + best(s, b, hi)

    for _ in range(300):
        s = [rng.choice((-1, 1)) * rng.uniform(0.1, 5) for _ in range(rng.randint(0, 12))]
        got = html_text.stretches(s)
        assert [x[:2] for x in got] == best(s, 0, len(s))
        assert all(abs(sum(s[lo:hi]) - total) < 1e-9 for lo, hi, total in got)


def test_fit():
    seen = Counter()
    for p in PAGES:
        seen.update(html_text.counts(p))
    w = html_text.fit(seen)
    assert w["el:nav"] < -1 and w["own:p"] > 0 > w["tag:p"] and not any("article" in f for f, _ in seen)
    assert html_text.fit(Counter()) == html_text.PRIOR


def test_weights_decide():
    page = f"<div class=tale>{MAIN}</div><div class=pinboard><p>{'Other words go here. ' * 20}</p></div>"
    odds = html_text.PRIOR | {"class:tale": 0.9, "class:pinboard": -0.9}
    assert "Other" in main_text(page)
    turned = main_text(page, html_text.Weights({k: -v if k.startswith(("own:", "words:", "link:", "end:")) else v for k, v in odds.items()}))
    assert turned == ""
    assert main_text(page, html_text.Weights(odds | {"own:p": -1.0, "words:20+": -0.5})) == "Title"


WHOLE = {
    "<article><p>Where <math><mi>x</mi><mo>+</mo><msup><mi>y</mi><mn>2</mn></msup></math> is big.</p></article>": "Where x+y2 is big.",
    "<article><p>Seen in <svg><g><title>no</title><text>figure <tspan>one</tspan></text></g></svg> here.</p></article>": "Seen in figure one here.",
    "<article><p>a <object>fallback</object> and <canvas>drawn</canvas> and <noscript>plain</noscript> text</p></article>": "a fallback and drawn and plain text",
    f"<form id=aspnetForm><nav>menu</nav><article>{MAIN}</article><form><p>name</p></form></form>": TEXT,
    f"<form><fieldset><div><p>{BODY}</p></div></fieldset><div class=footer>end</div></form>": BODY,
    f"<article>{MAIN}<div class=market-share><p>Half of all.</p></div><div class=no-comments><p>None yet.</p></div><div class=social-share>Tell</div></article>": f"{TEXT}\n\nHalf of all.\n\nNone yet.",
}


@pytest.mark.parametrize("page", WHOLE)
def test_nothing_else_is_dropped(page):
    assert main_text(page) == WHOLE[page]


@pytest.mark.parametrize("wrap", ["<body><form id='aspnetForm' action='.'>{}</form></body>", "<fieldset>{}</fieldset>", "<div class=wrap>{}</div>"])
def test_frames_of_given_pages(spark, sf, wrap):
    """A form around a whole page changes nothing."""
    some = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_text.fitted(some, 1000, "page_id", "html")
    for r in some.collect():
        bare = re.sub(r"(?i)</?(?:html|body)[^>]*>", "", r.html)
        assert main_text(wrap.format(bare), weights) == main_text(bare, weights)


def test_weights_decide_given_pages(spark, sf):
    """Turned or random weights give other texts, the fitted ones those of the marked articles."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    weights = html_text.fitted(spark.read.parquet(f"{sf}/pages.parquet"), 1000, "page_id", "html")
    fine = [main_text(p, weights) for p in pages]
    turned = html_text.Weights({k: -v for k, v in weights.odds.items()})
    rng = random.Random(1)
    chance = html_text.Weights({k: rng.uniform(-2, 2) for k in weights.odds})
    marks = html_text.Weights(weights.odds | {"mark:in": -2.0, "mark:out": 2.0})
    for other in (turned, chance, marks):
        assert sum(a != main_text(p, other) for a, p in zip(fine, pages, strict=True)) > len(pages) / 2
    unmarked = html_text.Weights(weights.odds | {"mark:in": 0.0, "mark:out": 0.0})
    same = sum(a == main_text(p, unmarked) for a, p in zip(fine, pages, strict=True))
    print(f"{same} of {len(pages)} pages have the same text without their mark")
    assert same > 0.9 * len(pages)


@pytest.mark.parametrize("piece", ["<div>", "<div>x ", "<div class=a>x</div>", '<span class="ad">', '<span class="ad">x</span>', '<span class="ad">x ', "<article>", "<article>x", "<p class=share>x", "<b>", "</div>", "<math>", "<script>", "<!--", "<a href='", "<ul><li>x"])
def test_work_is_linear(piece):
    page = piece * 40_000
    began = time.process_time()
    main_text(page)
    html_text.counts(page)
    assert time.process_time() - began < 8


def test_table(spark):
    rows = [(k, "u", p, 0) for k, p in enumerate(PAGES)] + [(99, None, None, 0), (0, "u", next(iter(PAGES)), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html_text.extract(pages).collect()
    assert len(out) == len(rows)
    texts = list(PAGES.values())
    assert all(r.text == (texts[r.id] if r.id < 99 else "") and r.n_chars == len(r.text) for r in out)
    assert html_text.extract(pages.limit(0)).count() == 0


def marked_text(page):
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?p>|</?h1>|<footer", m[1] if m else "")]
    return "\n\n".join(b for b in blocks if b)


def test_whole_table_as_marked_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op7_html_text(spark, sf).collect():
        assert r.text == marked_text(pages[r.page_id])


@pytest.mark.parametrize("strip", [r"</?article>", r"</?article>| class=\"ad\"", r"</?article>| class=\"ad\"|</?(?:nav|footer)>"])
def test_f1_without_marks(spark, sf, strip):
    """Fitted on pages as they are, then read with their marks, telling classes and elements taken away;
    pages of the fit and those held out."""
    some = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_text.fitted(some.where("page_id % 2 = 0"), 1000, "page_id", "html")
    scores = []
    for page in (r.html for r in some.where("page_id % 2 = 1").collect()):
        bare = re.sub(strip, lambda m: re.sub("nav|footer", "div", m[0]) if re.search("nav|footer", m[0]) else "", page)
        got, want = Counter(main_text(bare, weights).split()), Counter(marked_text(page).split())
        scores.append(2 * sum((got & want).values()) / max(1, sum(got.values()) + sum(want.values())))
    print(f"F1 with {strip} stripped: {sum(scores) / len(scores):.4f}")
    assert sum(scores) / len(scores) > 0.98
