"""Main text of pages: known pages, a plain line-block version on random ones, broken markup, long pages."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from velotrace.llm import html_text

SF = "/root/testdata/sf0.001"


def test_html():
    page = lambda body: f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"
    nav = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav>"
    text = "Some running words of the article that go on for a while, and then some more of them. " * 3
    art = f"<article><h1>Big &amp; small</h1><p>{text}</p><div class='ad'>Buy now</div><p>A&nbsp;short\n one<br>x</p><section id='comments'><p>{text}</p></section><p>End.</p></article>"
    want = f"Big & small {' '.join(text.split())} A short one x End."
    assert html_text.main_text(page(nav + "<header>Site</header><div class='cookie-notice'>We use cookies " + "a " * 100 + "</div>" + art + "<aside>See also</aside><footer>&copy; me</footer>")) == want
    assert html_text.main_text(page(nav + art)[:-28] + "<footer>cut") == want
    assert html_text.main_text(page(f"<div class='menu'><a>Home</a></div><div><p>{text}</p><p>{text}</p></div><form>mail me</form>")) == " ".join((text * 2).split())
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<<<>>><p") .strip("<>p") == ""
    assert html_text.main_text("<p hidden>no</p><p>yes</p>") == "yes"
    assert "x" in html_text.main_text("<article>" + "<b>" * 5000 + "x")


def test_html_without_article():
    """Short lines in mid-article part no page of divs."""
    para = "Some running words of the text that go on for a while. " * 3
    short = "<ul><li>a</li><li>b</li><li>c</li><li>d</li></ul><h2>Sub</h2><pre>x = 1</pre><figure><img><figcaption>Cap</figcaption></figure>"
    want = f"{para.strip()} a b c d Sub x = 1 Cap {para.strip()}"
    menu = "<ul class='menu'><li><a href='/'>Home</a></li></ul>"
    assert html_text.main_text(f"<body>{menu}<div><p>{para}</p>{short}<p>{para}</p></div><footer>f</footer></body>") == want
    assert html_text.main_text(f"<body>{menu}<div><p>{para * 2}</p>{short}<p>{para}</p>{short}<p>{para}</p></div></body>").count("x = 1") == 2
    assert html_text.main_text("<div><p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p><p>Five.</p></div>") == "One. Two. Three. Four. Five."


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "long-form", "post-tags", "hidden md:block", "comments", "with-widgets menu"])
def test_html_wrappers_stay(name):
    """An element of a furniture word that holds the article, or most of the text, is kept."""
    text = "Some running words of the text that go on for a while. " * 4
    want = f"{text.strip()} {text.strip()}"
    paras = f"<p>{text}</p><p>{text}</p>"
    for home in ("main", "article"):
        assert html_text.main_text(f"<body><nav>n</nav><div class='{name}'><{home}>{paras}</{home}></div><footer>f</footer></body>") == want
    assert html_text.main_text(f"<body><div class=\"{name}\">{paras}</div></body>") == want


def test_html_furniture_beside_goes():
    text = "Some running words of the text that go on for a while. " * 4
    for name in ("comments", "sidebar", "sidebar-left", "related-posts", "cookie-notice"):
        for page in (f"<article><p>{text}</p></article><div class='{name}'><p>{text * 3}</p></div>", f"<main><div class='{name}'><p>{text}</p></div><article><p>{text}</p></article></main>"):
            assert html_text.main_text(page) == text.strip()
    assert html_text.main_text("<p hidden class='a'>no</p><p hidden='until-found'>no</p><p class='hidden'>yes</p>") == "yes"


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html", F.lit(1).alias("text"))
    for r in html_text.extract(pages, keep=("page_id", "html")).collect():
        body = re.sub(r"<footer.*", "", r.html.partition("<article")[2].partition(">")[2].partition("</article>")[0], flags=re.S)
        assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", body).replace("<", " <") and re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.n_chars == len(r.text)
    assert html_text.extract(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(odd).collect()] == ["", "", ""]


FILLER = "some running words of it go on and on until the line is long enough".split()
FURNITURE = [("nav", ""), ("footer", ""), ("aside", ""), ("div", "class='ad'"), ("div", "id='comments'"), ("div", "class='cookie-notice'"), ("form", ""), ("section", "class='related-posts'"), ("ul", "class='menu'")]


def random_tree(rng, depth=0, home=False):
    """Children: ("text", words, linked), ("block", tag, children), ("furniture", (tag, attributes), children), ("home", tag, children)."""
    out = []
    for _ in range(rng.randrange(2, 7)):
        kind = rng.random()
        words = " ".join(rng.choices(FILLER, k=rng.choice([1, 2, 3, 12, 30, 60])))
        if kind < 0.45 or depth > 3:
            out.append(("block", rng.choice(["p", "h2", "div", "blockquote"]), [("text", words, rng.random() < 0.15)] + ([("text", "tail", False)] if rng.random() < 0.2 else [])))
        elif kind < 0.6:
            out.append(("block", "ul", [("block", "li", [("text", rng.choice(FILLER), True)]) for _ in range(rng.randrange(1, 7))]))
        elif kind < 0.75:
            out.append(("furniture", rng.choice(FURNITURE), [("block", "p", [("text", words, False)])]))
        elif kind < 0.85 and not home:
            out.append(("home", rng.choice(["article", "main"]), random_tree(rng, depth + 1, True)))
        else:
            out.append(("block", "div", random_tree(rng, depth + 1, home)))
    return out


def render(children):
    made = []
    for kind, what, rest in children:
        if kind == "text":
            made.append(f" <a href='/x'>{what}</a> " if rest else f" {what} ")
        else:
            tag, attributes = what if kind == "furniture" else (what, "")
            made.append(f"<{tag} {attributes}>{render(rest)}</{tag}>")
    return "".join(made)


def plain_main_text(children, window=3, surge=80):
    """The definition, step by step, over the tree that the page was made from."""
    homes = []

    def letters(nodes, inside):
        return sum((0 if r else len(w.replace(" ", "")) if inside else 0) if k == "text" else letters(r, inside or k == "home") for k, w, r in nodes)

    def all_letters(nodes):
        return sum((0 if r else len(w.replace(" ", ""))) if k == "text" else all_letters(r) for k, w, r in nodes)

    weigh = (lambda nodes, inside: letters(nodes, inside)) if letters(children, False) else (lambda nodes, inside: all_letters(nodes))
    whole = weigh(children, False)
    tokens = []

    def walk(nodes, home):
        for kind, what, rest in nodes:
            if kind == "text":
                tokens.append(("text", what, rest, home))
            elif kind == "furniture" and 2 * weigh(rest, home > 0) <= whole:
                tokens.append(("end",))
                tokens.append(("gone",))
            else:
                own = home
                if kind == "home":
                    homes.append(what)
                    own = len(homes)
                tokens.append(("end",))
                walk(rest, own)
                tokens.append(("end",))

    walk(children, 0)
    lines, held, gap = [], [], False
    for t in [*tokens, ("end",)]:
        if t[0] == "text":
            held.append(t)
        elif t[0] == "gone":
            gap = True
        elif held:
            line = (" ".join(x[1] for x in held), min(sum(0 if x[2] else len(x[1]) for x in held), len(" ".join(x[1] for x in held))), held[0][3])
            if lines and lines[-1][2] != line[2]:
                lines += [("", 0, line[2])] * window
            elif gap:
                lines.append(("", 0, line[2]))
            lines.append(line)
            held, gap = [], False
    n = len(lines)
    size = [x[1] for x in lines]
    add = lambda size: [sum(size[j] for j in range(n) if abs(i - j) <= window // 2) for i in range(n)]
    sums = add(size)
    if not any(s >= surge for s in sums):
        size = [x[1] if x[2] else 0 for x in lines] if any(x[1] and x[2] for x in lines) else size if any(size) else [len(x[0]) for x in lines]
        sums = add(size)
        surge = max(sums, default=0)
    kept = {}
    for i in range(n):
        if not sums[i] or i and sums[i - 1]:
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        if max(sums[i:j]) < surge:
            continue
        home = next(lines[k][2] for k in range(i, j) if size[k] == max(size[i:j]))
        for k in range(i, j):
            if lines[k][2] == home and (home or size[k]):
                kept.setdefault(home, []).append(k)
    if any(kept):
        kept = {h: k for h, k in kept.items() if h}
    some = {i for k in kept.values() for i in range(min(k), max(k) + 1)}
    return " ".join(lines[i][0] for i in sorted(some) if lines[i][0])


@pytest.mark.parametrize("seed", range(300))
def test_equals_plain_version(seed):
    tree = random_tree(random.Random(seed))
    assert html_text.main_text(f"<html><body>{render(tree)}</body></html>") == plain_main_text(tree)


TEXT = "Some running words of the text that go on for a while, and then some more. "


def test_nothing_of_the_article_is_lost():
    p = f"<p>{TEXT * 2}</p>"
    want = (TEXT * 2).strip()
    assert html_text.main_text(f"<body><div>{p}<ul><li>a</li><li>b</li></ul>{p}<p>x</p>{p}</div></body>") == f"{want} a b {want} x {want}"
    assert html_text.main_text(f"<article>{p}<p class='search-tips'>Tips.</p>{p}</article>") == f"{want} Tips. {want}"
    assert html_text.main_text(f"<body><nav><ul><li><a>Home</a><li><a>News</a></ul><article>{p}</article></body>") == want
    assert html_text.main_text(f"<body><article>{p}</article><p>between</p><article>{p}<p>End</p></article></body>") == f"{want} {want} End"
    links = "".join(f"<li><a href='/{k}'>{k}</a></li>" for k in "abcdef")
    assert html_text.main_text(f"<article><h1>T</h1>{p}<ul>{links}</ul>{p}</article>") == f"T {want} a b c d e f {want}"
    assert html_text.main_text(f"<body><ul>{links}</ul><div>{p}{p}</div><ul>{links}</ul><div>(c) me</div></body>") == f"{want} {want}"


def test_unclosed_furniture_ends_with_its_parent():
    p = f"<p>{TEXT * 2}</p>"
    want = (TEXT * 2).strip()
    assert html_text.main_text(f"<article><div><div class='ad'>Buy now<p>more</div></div>{p}</article>") == want
    assert html_text.main_text(f"<article><section><div class='ad'>Buy now<p>more</section>{p}</article>") == want
    assert html_text.main_text(f"<article><p class='ad'>Buy now{p}</article>") == want
    assert html_text.main_text(f"<article>{p}<aside>See also") == want
    assert html_text.main_text(f"<body><script>var a = '<p>'; if (a < 1) <b>{p}") == ""


def test_attributes_are_told_apart():
    p = f"<p>{TEXT * 2}</p>"
    for kept in ("data-id='ad'", 'title="see class=ad hidden"', "class='hidden'", "data-hidden", "aria-hidden='false'", "content='display:none'", "id=main-text"):
        assert html_text.main_text(f"<article>{p}<p {kept}>kept</p></article>").endswith("kept"), kept
    for gone in ("CLASS=ad", "title='x' id = \"comments\"", "hidden", "aria-hidden=true", 'style="color:red; display: none"', "role=navigation", "class='x ads' data-x='" + "y" * 1000 + "'"):
        assert html_text.main_text(f"<article>{p}<p {gone}>gone</p></article>") == (TEXT * 2).strip(), gone


def test_comments_that_are_articles_go():
    p = f"<p>{TEXT * 6}</p>"
    page = f"<main><article>{p}</article><section id='comments'><article class='comment'><p>{TEXT}</p></article><article><p>{TEXT}</p></article></section></main>"
    assert html_text.main_text(page) == (TEXT * 6).strip()


def test_whole_names():
    for name in ("ad", "ads", "ad-slot", "cookie-notice", "related-posts", "sidebar", "sidebar-left", "site-footer", "nav_bar nav", "comments", "commentList comment", "widget-2", "navMenu"):
        assert any(html_text.furniture_name(n) for n in name.split()), name
    for name in ("search-tips", "long-form", "has-sidebar", "no-sidebar", "content-sidebar-wrap", "post-tags", "ad-hoc-report", "menu-of-the-day", "social-science", "notice-period", "form-of-life", "shared", "header-image"):
        assert not html_text.furniture_name(name), name


@pytest.mark.parametrize(
    "page",
    [
        "<article>" + f"<p>{TEXT}</p>" * 12_000 + "</article>",
        "<article><p>" + TEXT * 13_000 + "</p></article>",
        f"<article><p>{TEXT * 2}</p>" + "<div class=ad>" * 70_000,
        "<article>" + "<p>some words here</p><li><b>" * 34_000,
        "<div>" * 90_000 + TEXT * 2 + "</div>" * 90_000,
        f"<p>{TEXT * 2}</p>" + "<a title='\"'>x" * 60_000,
        f"<p>{TEXT * 2}</p>" + "<ul><li>" * 40_000 + "<b>" * 40_000 + "</li></ul>" * 40_000,
        f"<p>{TEXT * 2}</p>" + "<" * 1_000_000,
        f"<p>{TEXT * 2}</p>" + "<script>" * 120_000,
    ],
)
def test_long_pages_take_linear_time(page):
    html_text.main_text(page[:10_000])
    t = time.perf_counter()
    got = html_text.main_text(page)
    took = time.perf_counter() - t
    assert got.startswith(TEXT.split()[0]) or got.startswith("some words")
    assert took < 3, took


def test_kept_columns_of_any_name_and_type(spark):
    df = spark.createDataFrame([(1, (2, {"k": 3}), "<p>x</p>")], "`a b` long, `x:y` struct<`c d`:int,m:map<string,int>>, html string")
    got = html_text.extract(df, keep=("a b", "x:y")).collect()
    assert [(r["a b"], r["x:y"].asDict(), r.text, r.n_chars) for r in got] == [(1, {"c d": 2, "m": {"k": 3}}, "x", 1)]
