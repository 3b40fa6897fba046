import math
import re
from collections import Counter
from html import escape, unescape

import pytest

from tessera.llm.html import BOXES, Page, extracted, main_text

P = "Some words of a paragraph that is long enough to count, and more of them."
BODY = " ".join([P] * 3)


def page(before="", after="", inside=None):
    inside = "".join(f"<p>{P}</p>" for _ in range(3)) if inside is None else inside
    return f"<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style></head><body>{before}{inside}{after}</body></html>"


@pytest.mark.parametrize(
    "other",
    [
        "<nav><a href=/>home</a> <a href=/x>other</a></nav>", "<header><h1>My site</h1><p>A motto of the site that is fairly long, to be sure.</p></header>", "<footer>&copy; all rights are reserved, by us and by others too</footer>",
        "<aside><p>In other news, something else happened.</p></aside>", "<div class='side-bar sidebar'><p>Things beside the text that matter little.</p></div>", "<div id=cookie-notice>We use cookies, which is what sites do.</div>",
        "<div class=ad>Buy this thing now, it is very cheap today!</div>", "<form><input name=q><button>Search</button><label>What do you seek?</label></form>", "<script>var a = '<p>no</p>'; if (a<b) {}</script>", "<!-- <p>a comment in the page</p> -->",
        "<ul><li><a href=1>One thing</a></li><li><a href=2>Another thing</a></li><li><a href=3>A third</a></li></ul>", "<section class='comments'><article class=comment><p>I think that this is right, and well said.</p></article></section>",
        "<div role=navigation>Go here or there</div>", "<div hidden>You can't see this</div>", "<noscript>Switch it on</noscript><svg><text>logo</text></svg>", "<div style='display: none'>nothing to see</div>", "<div class='relatedPosts'><p>More like this and this</p></div>",
    ],
)
def test_other_parts_go(other):
    for wrap in ("{}", "<article>{}</article>", "<div id=main>{}</div>", "<div class='content'><div>{}</div></div>"):
        text = "".join(f"<p>{P}</p>" for _ in range(3))
        assert main_text(page(before=other, inside=wrap.format(text))) == BODY
        assert main_text(page(after=other, inside=wrap.format(text))) == BODY


LINKS = "".join(f"<li><a href={k}>The source of number {k}</a></li>" for k in range(5))
LINKED = " ".join(f"The source of number {k}" for k in range(5))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"])
def test_lists_of_links_in_the_article_stay(wrap):
    text = "".join(f"<p>{P}</p>" for _ in range(3))
    menu = "<ul>" + "<li><a href=/>Go</a></li>" * 4 + "</ul>"
    for box in ("<ul>{}</ul>", "<section><ol>{}</ol></section>", "<table><tr><td>{}</table>"):
        assert main_text(page(before=menu, inside=wrap.format(text + box.format(LINKS)))) == f"{BODY} {LINKED}"


@pytest.mark.parametrize(
    "part",
    [
        "<h2 id=related-work>{}</h2>", "<h2 id=privacy>{}</h2>", "<h3 class=section-header>{}</h3>", "<section id=search-algorithms><p>{}</p></section>", "<section id=legal-history>{}</section>",
        "<p class=notice>{}</p>", "<h2 id=the-sidebar-design>{}</h2>", "<p><math><mi>{}</mi><annotation>x</annotation></math></p>", "<fieldset><legend>{}</legend></fieldset>", "<p><label>{}</label></p>",
    ],
)
def test_parts_whose_names_may_be_subjects_stay(part):
    text = "".join(f"<p>{P}</p>" for _ in range(3))
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"):
        assert main_text(page(inside=wrap.format(text + part.format("Words of it")))) == f"{BODY} Words of it"


def test_sections_named_for_what_is_no_article_go():
    for name in ("user-comments", "related-recommendations", "newsletter"):
        assert main_text(page(after=f"<section id={name}><p>{P}</p></section>")) == BODY


def test_names_within_an_article():
    text = "".join(f"<p>{P}</p>" for _ in range(3))
    inside = lambda part: main_text(page(inside=f"<article>{text}{part}</article>"))
    assert inside("<div class=reviews>What they said</div>") == f"{BODY} What they said"
    for gone in ("<div class=sidebar>x</div>", "<div class='share-widget'>x</div>", "<div class='related social'>x</div>", "<h2 id=comments>x</h2>", "<p role=alert>x</p>", "<nav>x</nav>"):
        assert inside(gone) == BODY


def test_a_page_of_links_is_not_empty():
    assert main_text(page(inside=f"<div><p>Terms</p><ul>{LINKS}</ul></div>")) == f"Terms {LINKED}"
    assert main_text(page(inside=f"<main><ul>{LINKS}</ul></main>")) == LINKED


def test_sections_and_headings_stay():
    html = page(inside=f"<main><header><h1>Head</h1></header><section><h2>One</h2><p>{P}</p></section><section><h2>Two</h2><p>{P}</p><ul><li>first item</li><li>second</li></ul><blockquote>said</blockquote></section></main>", before="<nav><a>x</a></nav>")
    assert main_text(html) == f"Head One {P} Two {P} first item second said"


def test_a_marked_article_is_taken_alone():
    other = "<div><p>Something that stands beside the article, without a name to know it by.</p></div>" * 2
    assert main_text(page(before=other, inside=f"<article><h1>T</h1><p>{P}</p><p>{P}</p><p>{P}</p></article>")) == f"T {BODY}"
    assert main_text(page(inside=f"<main><article><p>{P}</p></article></main>", after="<p>x</p>")) == P


def test_a_section_beside_the_article_in_the_chosen_box_stays():
    article, section = (f"<p>{' '.join([P] * n)}</p>" for n in (6, 5))
    for box in ("main", "div"):
        assert main_text(page(inside=f"<{box}><article>{article}</article><section>{section}</section></{box}>", before="<p>x</p>")) == " ".join([P] * 11)


@pytest.mark.parametrize("wrap", ["{}", "<main>{}</main>", "<div>{}</div>"])
def test_articles_side_by_side(wrap):
    article = lambda n, word: f"<article><h2>{word}</h2>" + f"<p>{word} {P}</p>" * n + "</article>"
    text = lambda n, word: " ".join([word] + [f"{word} {P}"] * n)
    for n in (2, 4, 6):
        assert main_text(page(inside=wrap.format(article(6, "one") + article(n, "two")))) == f"{text(6, 'one')} {text(n, 'two')}"
    teaser = "<article><h3><a href=/x>Another thing to read</a></h3><p>In few words.</p></article>"
    assert main_text(page(inside=wrap.format(article(6, "one") + teaser * 3))) == text(6, "one")


def test_a_heading_beside_the_text_stays():
    assert main_text(page(before="<div class=site-header><p>The name of the site</p></div>", inside=f"<div class=post><h1>Head</h1><div class=body><p>{P}</p><p>{P}</p><p>{P}</p></div></div>")) == f"Head {BODY}"


def test_a_page_in_a_form():
    assert main_text(page(inside=f"<form><div><p>{P}</p><p>{P}</p><p>{P}</p></div><input></form>")) == BODY


def test_references_and_white_space():
    assert main_text("<p>a &lt;b&gt; &amp;amp; &#233;&#x20AC;&nbsp;x\n\t y</p><p>z<b>z</b>z<br>w</p>") == "a <b> &amp; é€ x y zzz w"


@pytest.mark.parametrize("source", [None, "", "   ", "<html></html>", "<script>x</script>", "<nav>a</nav>", "<!-- only -->", "<!-- open", "<style>p{}"])
def test_nothing(source):
    assert main_text(source) == ""


def test_broken_pages():
    assert main_text("just text") == "just text"
    assert main_text("a < b and c > d") == "a < b and c > d"
    assert main_text(f"<p>{P}<p>{P}<p>{P}") == BODY
    assert main_text(f"<article><h1>T</h1><p><b>{P}<br><p>{P}</article>") == f"T {P} {P}"
    assert main_text(f"</div></p><div><p>{P}</span></div></div>") == P
    assert main_text("x <!-- y") == main_text("x <a href='") == main_text("x </") == "x" and main_text("x < y <3") == "x < y <3"
    assert main_text("<p>x</p><a href='un>closed <b>z</b>") == "x closed z"
    assert main_text(f"<article><p>{P}</p><p>cut of") == f"{P} cut of"
    assert main_text("<ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table>") == "one two x y z"


def test_depth_and_length():
    assert main_text("<div>" * 20_000 + f"<p>{P}</p>") == P
    for hostile in ("<p " * 50_000, "<a href='>" * 20_001, "<!--" * 50_000, "<ul>" + "<li><a>x</a>" * 20_000):
        assert main_text(hostile) == ""
    long = "word " * 200_000
    assert main_text(f"<article><p>{long}</p><p>{P}</p></article>") == f"{long.strip()} {P}"


def test_query(spark, sf_dir):
    from tessera.llm.queries import QUERIES

    got = {r.page_id: r for r in QUERIES["op5_html"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = p.html.split("<article>")[1].split("</article>")[0]
        for tag in ("<p>", "</p>", "<h1>", "</h1>", "<br>"):
            inner = inner.replace(tag, " ")
        from html import unescape

        want = " ".join(unescape(inner.replace("<b>", "").replace("</b>", "")).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def _article(source):
    inner = source.split("<article>")[1].split("</article>")[0]
    for tag in ("<p>", "</p>", "<h1>", "</h1>", "<br>"):
        inner = inner.replace(tag, " ")
    return unescape(inner.replace("<b>", "").replace("</b>", "")).split()


@pytest.mark.parametrize("kind", ["div", "neutral"])
def test_pages_that_mark_no_article(spark, kind):
    """Without the article element, and without any telling element or name: words found and words too many."""
    missed, extra, n = 0, 0, 0
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        source = p.html.replace("<article", "<div").replace("</article", "</div")
        if kind == "neutral":
            source = re.sub(r"(</?)(main|nav|header|footer|aside|section)\b", r"\1div", re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", source))
        want, got = Counter(_article(p.html)), Counter(main_text(source).split())
        missed, extra, n = missed + (want - got).total(), extra + (got - want).total(), n + want.total()
    assert missed <= 0.05 * n and extra <= 0.05 * n


def test_densities_against_brute_force(spark, sf_dir):
    """Counts, densities and sums of every node from its own part of the tree, and the node with the largest sum."""
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20).collect():
        page = Page(p.html.replace("<article", "<div").replace("</article", "</div"))
        n = len(page.tag)
        chars, density, total = page.sums()
        up = [[k] for k in range(n)]
        for k in range(1, n):
            up[k] += up[page.parent[k]]
        text = [sum(len(w) for i, t in page.flow if t and k in up[i] and not page.cut[i] for w in t.split()) for k in range(n)]
        links = [sum(len(w) for i, t in page.flow if t and k in up[i] and not page.cut[i] and any(page.tag[j] == "a" for j in up[i]) for w in t.split()) for k in range(n)]
        below = [[i for i in range(n) if i != k and k in up[i] and not page.cut[i]] for k in range(n)]
        own = []
        for k in range(n):
            tags, link_tags = max(1, len(below[k])), max(1, sum(page.tag[i] == "a" for i in below[k]))
            if page.cut[k] or text[k] < 2:
                own.append(0.0)
                continue
            base = math.log(text[k] / max(1, text[k] - links[k]) * links[k] + links[page.body] / max(1, text[page.body]) * text[k] + math.e)
            own.append(max(0.0, text[k] / tags * math.log(max(1.0, text[k] / max(1, links[k]) * tags / link_tags)) / math.log(base + math.e - 1)))
        assert [chars[k] for k in range(n) if not page.cut[k]] == [text[k] for k in range(n) if not page.cut[k]]
        assert density == pytest.approx(own)
        sums = [sum(own[i] for i in range(1, n) if page.parent[i] == k) for k in range(n)]
        assert total == pytest.approx(sums)
        chosen = page.article()
        boxes = [k for k in range(page.body + 1, n) if page.tag[k] in BOXES and not page.cut[k]]
        if boxes and max(sums[k] for k in boxes) > sums[page.body]:
            assert chosen[max(boxes, key=lambda k: sums[k])]


def test_column(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, f"<p>{escape('<é>')}</p>", "k"), (None, "", "k")], "page_id long, html string, Text string")
    with pytest.raises(ValueError, match="text"):
        extracted(df)
    got = extracted(df, "main").collect()
    assert sorted(r.main for r in got) == ["", "", "<é>"] and {r.Text for r in got} == {"k"}
    assert extracted(df.drop("Text").limit(0)).count() == 0
