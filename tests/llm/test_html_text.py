import random
import time

import pytest

from sieveline.llm import html_text

LONG = "Some text, with commas, and it is long enough to matter to the scores of a page."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("   \n ", ""), ("plain words", "plain words"), ("<p>Ok.", "Ok."), ("<script>var a='<p>x</p>'</script>", ""),
        (f"<article><h1>T</h1><p><b>{LONG}<br><p>{LONG}</article><footer>&copy; 2020, a, b, c</footer>", f"T\n\n{LONG}\n\n{LONG}"),
        (f"<nav><ul><li><a href=x>Home</a></ul></nav><main><p>{LONG} &amp; &eacute;&#233;&nbsp; x</p></main>", f"{LONG} & éé x"),
        (f"<div id=header>Site, name, and more words to be long enough</div><div><p>{LONG}</p><form><p>{LONG}</form><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><aside>{LONG}</aside><div class=cookie-notice>{LONG}</div></article>", LONG),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p><!-- <p>{LONG}</p> --><style>p{{}}</style></article>", LONG),
        (f"<body><p>{LONG}</p><p>short</p><div class=ad>{LONG}</div></body>", f"{LONG}\n\nshort"),
        (f"<p>{LONG} 1 < 2 and 3 > 2</p>", f"{LONG} 1 < 2 and 3 > 2"),
        (f"<article><ul><li>{LONG}<li>two</ul><table><tr><td>a<td>b</table></article>", f"{LONG}\n\ntwo\n\na\n\nb"),
        (f"<div><p>{LONG}</p></div></div></p></b><p>{LONG}", f"{LONG}\n\n{LONG}"),
    ],
)
def test_extract(html, want):
    assert html_text.extract(html) == want


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "page-header-wrapper", "elementor-widget", "sidebar", "modal", "ad"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_names_do_not_remove_the_article(name, kind):
    want = f"T\n\n{LONG}\n\n{LONG}"
    inner = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"
    for tag in ("article", "main", "div"):
        assert html_text.extract(f"<body><nav>x</nav><div {kind}='{name}'><{tag}>{inner}</{tag}></div><footer>{LONG}</footer></body>") == want
    assert html_text.extract(f"<main><div {kind}='{name}'><article>{inner}</article></div><div class=sidebar>{LONG}</div></main>") == want
    assert html_text.extract(f"<article><div {kind}='{name}'>{inner}</div></article>") == want
    assert html_text.extract(f"<div {kind}='{name}'><article><p>Ok.</p></article></div>") == "Ok."


def test_page_wide_forms_and_split_widgets():
    assert html_text.extract(f"<body><form action=x><div><p>{LONG}</p><p>{LONG}</p></div></form></body>") == f"{LONG}\n\n{LONG}"
    assert html_text.extract(f"<form><fieldset><article><p>{LONG}</p><form>q</form></article></fieldset></form>").startswith(LONG)
    part = f"<div class='elementor-widget'><p>{LONG}</p></div>"
    assert html_text.extract(f"<article>{part}{part}{part}</article>") == "\n\n".join([LONG] * 3)


@pytest.mark.parametrize("name", ["ad", "comments", "sidebar", "cookie-notice", "related", "share-box"])
def test_names_still_remove_what_is_beside_the_article(name):
    assert html_text.extract(f"<div class='has-sidebar'><article><p>{LONG}</p><p>{LONG}</p></article><div class='{name}'>{LONG}</div></div>") == f"{LONG}\n\n{LONG}"
    assert html_text.extract(f"<div><p>{LONG}</p><p>{LONG}</p><div class='{name}'>{LONG}</div></div>") == f"{LONG}\n\n{LONG}"
    if name != "share-box":
        assert html_text.extract(f"<div class={name}>{LONG}</div><article><p>Ok.</p></article>") == "Ok."
    assert html_text.extract(f"<p>{LONG} <span class='{name}'>x y</span></p>") == LONG


def test_long_comments_are_left_out():
    comments = f"<ol class='comments'>{'<li><article class=comment-body><p>' + LONG + '</p></article>'}</ol>" * 9
    assert html_text.extract(f"<article><p>{LONG}</p>{comments}</article>") == LONG
    assert html_text.extract(f"<div><p>{LONG}</p></div>{comments}") == LONG


def test_link_density_discounts():
    links = "".join(f"<li><a href=x>{LONG}</a></li>" for _ in range(9))
    page = f"<div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>"
    assert html_text.extract(page) == f"{LONG}\n\n{LONG}"


def test_siblings_are_kept():
    part = f"<section><p>{LONG}</p><p>{LONG}</p></section>"
    assert html_text.extract(f"<body><h1>Title</h1>{part}{part}</body>").count(LONG) == 4


@pytest.mark.parametrize("tag", ["div", "section", "article", "main"])
@pytest.mark.parametrize(
    ("beside", "text"),
    [
        ("<p>Short last line.</p>", ["Short last line."]),
        ("<ul><li>one</li><li>two</li></ul>", ["one", "two"]),
        ("<table><tr><td>a</td><td>b</td></tr></table>", ["a", "b"]),
        ("<h4>Four</h4><h5>Five</h5><h6>Six</h6>", ["Four", "Five", "Six"]),
        ("<dl><dt>a</dt><dd>b</dd></dl><pre>x = 1</pre>", ["a", "b", "x = 1"]),
        ("bare words", ["bare words"]),
        (f"<div><p>{LONG}</p></div>", [LONG]),
        (f"<article><p>{LONG}</p></article><article><p>Short.</p></article>", [LONG, "Short."]),
        ("<div><a href=x>Home</a> | <a href=y>About us</a></div>", []),
        ("<a href=x>Next page</a>", []),
        (f"<div class=comments>{LONG}</div><nav>Menu</nav>", []),
    ],
)
def test_what_is_beside_the_best_container_is_kept(tag, beside, text):
    article = f"<{tag}><p>{LONG}</p><p>{LONG}</p></{tag}>"
    assert html_text.extract(f"<div>{article}{beside}</div>") == "\n\n".join([LONG, LONG, *text])
    assert html_text.extract(f"<div>{beside}{article}</div>") == "\n\n".join([*text, LONG, LONG])


@pytest.mark.parametrize("name", ["page-header", "share", "related", "notice", "promo-text", "header", "disclaimer", "widget-title", "nav-target"])
def test_names_remove_no_heading_or_paragraph(name):
    page = f"<article><h1 class='{name}'>Title</h1><p>{LONG}</p><p class='{name}'>A short line.</p><ul><li class='{name}'>item</li></ul><p>{LONG}</p></article>"
    assert html_text.extract(page) == "\n\n".join(["Title", LONG, "A short line.", "item", LONG])
    links = f"<p class='{name}'><a href=x>Share</a> <a href=y>Print</a></p>"
    assert html_text.extract(f"<article><p>{LONG}</p>{links}<p>{LONG}</p></article>") == f"{LONG}\n\n{LONG}"
    prose = f"<div class='text-{name}-box'><p>{LONG}</p><p>{LONG}</p></div>"
    if name not in ("notice", "disclaimer"):
        assert html_text.extract(f"<article><p>{LONG}</p><p>{LONG}</p>{prose}</article>") == "\n\n".join([LONG] * 4)


@pytest.mark.parametrize("name", ["ad", "comment", "cookie-consent", "sponsored"])
def test_adverts_and_comments_go_whatever_their_element(name):
    assert html_text.extract(f"<article><p>{LONG}</p><p class='{name}'>Buy this now.</p><p>{LONG}</p></article>") == f"{LONG}\n\n{LONG}"


def prose(rng, n):
    words = [rng.choice("one two three, four five six, seven eight nine ten eleven twelve".split()) for _ in range(n)]
    return " ".join(words) + "."


def known_page(rng):
    """A page made around an article, and the blocks of that article."""
    blocks, body = [], []
    for _ in range(rng.randrange(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "table", "quote", "br", "bare"])
        if kind in ("p", "br"):
            text = prose(rng, rng.randrange(20, 60))
            blocks.append(text)
            body.append(f"<p>{text}" if rng.random() < 0.4 else f"<p class=x>\n {text.replace(' ', '<br>' if kind == 'br' else ' ', 1)}</p>")
        elif kind == "h2":
            blocks.append(prose(rng, 4))
            body.append(f"<h2 id='part-{rng.randrange(9)}'>{blocks[-1]}</h2>")
        elif kind in ("ul", "table"):
            items = [prose(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))]
            blocks += items
            body.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>" if kind == "ul" else "<table><tr>" + "".join(f"<td>{i}</td>" for i in items) + "</tr></table>")
        elif kind == "quote":
            blocks.append(f"“{prose(rng, 12)}” & more")
            body.append(f"<blockquote>{blocks[-1].replace('&', '&amp;').replace('“', '&ldquo;').replace('”', '&#8221;')}</blockquote>")
        else:
            blocks.append(prose(rng, 25))
            body.append(f"<div>{blocks[-1]}</div>")
        if rng.random() < 0.3:
            body.append(rng.choice([f"<div class=ad>{prose(rng, 15)}</div>", "<script>if (a < b) { c('</p>') }</script>", f"<!-- {prose(rng, 9)} -->", f"<aside>{prose(rng, 30)}</aside>", "<figure><svg><text>x</text></svg></figure>"]))
    for _ in range(3):
        blocks.append(prose(rng, 40))
        body.append(f"<p>{blocks[-1]}</p>")
    inner = "".join(body)
    article = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<div class='has-sidebar'><div id=content>{}</div></div>", "<div><section>{}</section></div>", "<main>{}</main>"]).format(inner)
    menu = "".join(f"<li><a href=/{i}>{prose(rng, 3)}</a>" for i in range(rng.randrange(2, 30)))
    top = rng.choice([f"<nav><ul>{menu}</ul></nav>", f"<div class=menu><ul>{menu}</ul></div>", f"<header><p>{prose(rng, 12)}</p><ul>{menu}</ul></header>", f"<ul>{menu}</ul>"])
    below = rng.choice([f"<footer>&copy; {prose(rng, 20)}</footer>", f"<div id=footer>{prose(rng, 20)}</div>", f"<div class=comments>{'<p>' + prose(rng, 50) + '</p>'}</div>" * 2, f"<form><p>{prose(rng, 12)}</p><input name=q></form>", f"<div class='sidebar'><p>{prose(rng, 15)}</p></div>"])
    return f"<!DOCTYPE html><html><head><title>{prose(rng, 5)}</title><style>p{{}}</style></head><body><div>{top}</div>{article}<div>{below}</div></body></html>", "\n\n".join(blocks)


def test_pages_made_around_a_known_article():
    rng = random.Random(9)
    for _ in range(400):
        page, want = known_page(rng)
        assert html_text.extract(page) == want, page


def slow_tag_end(html, at):
    """The bracket that ends a tag, character by character; the next one if quotes never close."""
    quote = ""
    for i in range(at, len(html)):
        if html[i] == quote:
            quote = ""
        elif not quote and html[i] in "'\"":
            quote = html[i]
        elif not quote and html[i] == ">":
            return i
    return html.find(">", at)


def test_tag_ends_match_a_slow_search():
    rng = random.Random(4)
    for _ in range(500):
        html = "".join(rng.choices("ab'\"> <", k=rng.randrange(40)))
        ends = html_text.TagEnds(html)
        for at in range(len(html) + 1):
            assert ends.after(at) == slow_tag_end(html, at)
        m = html_text.START.match("<a " + html)
        assert m[3] is None or m.end() - 4 == slow_tag_end(html, 0)


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 200_000, "<a " * 200_000, "<a" * 200_000, "<div>x" * 100_000, "<a '>' " * 100_000, "<span class=ad>x" * 50_000, "</b>" * 200_000, "<div>" * 50_000 + "</b>" * 50_000,
        "<p><table>" * 30_000 + "<div>" * 30_000, "".join(f"<div class='promo-{i}'>x" for i in range(30_000)), "<ul><li>" * 50_000, "<script>" * 50_000, "<!--" * 100_000, "<p " + "class=' " * 100_000,
    ],
)
def test_time_grows_with_length_alone(html):
    began = time.process_time()
    html_text.extract(html)
    assert time.process_time() - began < 5


def test_deep_and_broken_pages():
    assert html_text.extract("<div>" * 3000 + LONG) == LONG
    assert isinstance(html_text.extract("<p " + "a='" * 2001 + f"<p>{LONG}"), str)
    assert html_text.extract("<p " + "a='" * 2000 + f"'><p>{LONG}").endswith(LONG)
    assert html_text.extract("<p>" + "x " * 200_000).count("x") == 200_000


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}", "c", 1), (2, None, None, "c", 2), (1, "u", f"<p>{LONG}", "c", 1)], "page_id long, url string, html string, text string, n_chars int")
    found = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_text.main_text(pages).collect() if r.url)
    assert found == [(1, "u", LONG, len(LONG))] * 2
    assert html_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("See <a class='related'>this report</a> for more of it", "See this report for more of it"),
        ("It rose by <span class='share'>ten percent</span> in May.", "It rose by ten percent in May."),
        ("The <span class='notice'>red hat</span> was lost", "The red hat was lost"),
        ("Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> as known", "Energy is E=m as known"),
        ("Hello <svg><text>drawn</text></svg>world again", "Hello world again"),
        ("One <span hidden>x</span>two", "One two"),
        ("Press <button>OK</button> to go on", "Press to go on"),
        ("Click <span class=ad>Buy now</span> here", "Click here"),
        ("<span class=nav-target>First</span> words count", "First words count"),
        ("At the end <span class='share'>Share</span> <a class=related href=x>More</a>", "At the end"),
        ("<b class=notice><i>deep <span id=menu>er</span></i></b>, and on", "deep er, and on"),
        ("a <span aria-hidden=true>b <select><option>c</select></span> d", "a d"),
    ],
)
@pytest.mark.parametrize("tag", ["p", "li", "div", "td"])
def test_names_and_hidden_parts_within_a_line(line, want, tag):
    row = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}.get(tag, f"<{tag}>{{}}</{tag}>").format(line)
    assert html_text.extract(f"<article><p>{LONG}</p>{row}<p>{LONG}</p></article>") == "\n\n".join([LONG, want, LONG])


def test_code_keeps_its_comments():
    assert html_text.extract(f"<article><p>{LONG}</p><pre>x = 1 <span class='comment'># one</span></pre></article>") == f"{LONG}\n\nx = 1 # one"


def test_a_title_in_a_wrapper_of_its_own():
    article = f"<div><div><p>{LONG}</p><p>{LONG}</p></div></div>"
    assert html_text.extract(f"<div><div><h1>Title</h1></div>{article}</div>") == f"Title\n\n{LONG}\n\n{LONG}"
    assert html_text.extract(f"<div><div><h1><a href=/>Site</a></h1></div>{article}</div>") == f"{LONG}\n\n{LONG}"
    inner = f"<div><div><h1>Own</h1><p>{LONG}</p><p>{LONG}</p></div></div>"
    assert html_text.extract(f"<div><div><h1>Site</h1></div>{inner}</div>") == f"Own\n\n{LONG}\n\n{LONG}"


def test_pages_with_marked_up_lines():
    rng = random.Random(11)
    for _ in range(300):
        blocks, body = [], []
        for _ in range(rng.randrange(4, 9)):
            words = prose(rng, rng.randrange(20, 50)).split()
            shown = list(words)
            for at in sorted(rng.sample(range(len(words) - 1), 3), reverse=True):
                kind = rng.choice(["name", "hidden", "svg", "math", "ad"])
                if kind == "name":
                    shown[at] = f"<{(t := rng.choice(['span', 'a', 'em', 'b']))} {rng.choice(['class', 'id'])}='{rng.choice(['share', 'related', 'promo-text', 'nav', 'sidebar-ref', 'social'])}'>{words[at]}</{t}>"
                elif kind == "math":
                    words.insert(at, "x+y")
                    shown.insert(at, "<math><mi>x</mi><mo>+</mo><mi>y</mi></math>")
                else:
                    shown.insert(at, {"hidden": "<span style='display:none'>gone</span>", "svg": "<svg><title>t</title><text>gone</text></svg>", "ad": "<ins class='adv'>gone</ins>"}[kind])
            blocks.append(" ".join(words))
            body.append(f"<p>{' '.join(shown)}</p>")
        wrapped = rng.random() < 0.5
        head = "<div><h1>The title</h1></div>" if wrapped else ""
        page = f"<body><div><ul><li><a href=x>Home</a></ul></div><div>{head}<div><div>{''.join(body)}</div></div></div><footer>{prose(rng, 9)}</footer></body>"
        assert html_text.extract(page) == "\n\n".join((["The title"] if wrapped else []) + blocks), page
